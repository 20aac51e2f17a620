"""Registered queries by area; each module has ``QUERIES`` and ``SQL``."""

from . import audio, containers, frames, measure, media, probe, scans, text

_AREAS = (measure, frames, containers, media, probe, text, audio, scans)


def queries():
    return {k: v for area in _AREAS for k, v in area.QUERIES.items()}


def oracle_sql():
    return {k: v for area in _AREAS for k, v in area.SQL.items()}
