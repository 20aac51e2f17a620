"""Subtitle, time, option and address functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def format_timestamp(ms: Column, sep: str = ",") -> Column:
    """``HH:MM:SS{sep}mmm``; negative counts as 0, null stays null."""
    t = F.when(ms < 0, F.lit(0)).otherwise(ms).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60
    hours = F.when(h < 100, two(h)).otherwise(h.cast("string"))
    return F.concat(hours, F.lit(":"), two(m), F.lit(":"), two(s), F.lit(sep), F.lpad((t % 1000).cast("string"), 3, "0"))


_STAMP = r"^\s*(?:(?:.*:)?\s*([+-]?\d+)\s*:)?\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*[,.]\s*([+-]?\d+)\s*$"


def parse_timestamp(text: Column) -> Column:
    """``[HH:]MM:SS[,.]mmm`` in milliseconds, null if malformed.  The fraction
    is read as a number of milliseconds: ``.5`` is 5."""
    part = lambda i: F.regexp_extract(text, _STAMP, i).try_cast("bigint")
    hours = F.coalesce(part(1), F.lit(0))
    return F.when(text.rlike(_STAMP), ((hours * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def cue_timing(line: Column) -> Column:
    """struct(start_ms, end_ms) of a ``start --> end settings`` line, else null."""
    a = F.substring_index(line, "-->", 1)
    b = F.regexp_extract(F.regexp_replace(line, r"(?s)^.*?-->", ""), r"^\s*(\S+)", 1)
    s, e = parse_timestamp(a), parse_timestamp(b)
    return F.when(line.contains("-->") & s.isNotNull() & e.isNotNull(), F.struct(s.alias("start_ms"), e.alias("end_ms")))


def parse_cues(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Cues of SubRip or WebVTT texts: ``key, ordinal, start_ms, end_ms, text``.

    Line ends are normalised and a byte-order mark dropped; blocks are separated
    by blank lines; a block's first line with valid timing starts the cue and
    the rest is its text; other blocks are skipped.
    """
    norm = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n"), "^﻿", "")
    b = docs.select(*key, F.posexplode(F.split(norm, "\n\n")).alias("place", "block"))
    b = b.withColumn("lines", F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n"))
    # first line that has an arrow and parses
    b = b.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), cue_timing(x).alias("t"))), lambda s: s["t"].isNotNull()))
    b = b.where(F.size("at") > 0).withColumn("first", F.col("at")[0])
    rest = F.array_join(F.slice("lines", F.col("first.i") + 2, F.greatest(F.size("lines") - F.col("first.i") - 1, F.lit(0))), "\n")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    return b.select(*key, "place", F.col("first.t.start_ms").alias("start_ms"), F.col("first.t.end_ms").alias("end_ms"), rest.alias("text")).select(
        *key, (place - 1).cast("bigint").alias("ordinal"), "start_ms", "end_ms", "text"
    )


def render_cues(cues: DataFrame, key: list[str], kind: str = "srt") -> DataFrame:
    """One subtitle text a key from ``cues(key, ordinal, start_ms, end_ms, text)``."""
    if kind not in ("srt", "vtt"):
        raise ValueError(kind)
    sep = "," if kind == "srt" else "."
    timing = F.concat(format_timestamp(F.col("start_ms"), sep), F.lit(" --> "), format_timestamp(F.col("end_ms"), sep))
    body = F.regexp_replace("text", r"\s+$", "")
    index = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    block = F.concat(index.cast("string"), F.lit("\n"), timing, F.lit("\n"), body, F.lit("\n\n")) if kind == "srt" else F.concat(timing, F.lit("\n"), body, F.lit("\n\n"))
    b = cues.select(*key, "ordinal", block.alias("block"))
    g = b.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "block"))).alias("bs"))
    text = F.array_join(F.transform("bs", lambda s: s["block"]), "")
    return g.select(*key, (text if kind == "srt" else F.concat(F.lit("WEBVTT\n\n"), text)).alias("content"))


def bitrate(text: Column) -> Column:
    """``128k``, ``1.5M`` or a plain number in bits a second; null if malformed."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*[kKmM]?$", 1).try_cast("double")
    unit = F.lower(F.right(t, F.lit(1)))
    return (number * F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)).cast("bigint")


def url_parts(url: Column) -> Column:
    """struct(scheme, host, port, path); null for other schemes, an empty host
    or a bad port."""
    p = r"^(https?)://([^/]*)(/.*)?$"
    scheme, authority, path = (F.regexp_extract(url, "(?s)" + p, i) for i in (1, 2, 3))
    has_port = authority.contains(":")
    host = F.when(has_port, F.regexp_extract(authority, r"^(.*):[^:]*$", 1)).otherwise(authority)
    port = F.when(has_port, F.regexp_extract(authority, r":([^:]*)$", 1).try_cast("int")).otherwise(F.when(scheme == "https", 443).otherwise(80))
    ok = url.rlike("(?s)" + p) & (host != "") & port.between(0, 65535)
    return F.when(ok, F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), F.when(path == "", "/").otherwise(path).alias("path")))


def resolve_redirect(base: Column, location: Column) -> Column:
    """Absolute address of a Location header; relative ones count from the root."""
    u = url_parts(base)
    root = F.concat(u["scheme"], F.lit("://"), u["host"], F.lit(":"), u["port"].cast("string"), F.lit("/"))
    return F.when(location.rlike("^https?://"), location).otherwise(F.concat(root, F.regexp_replace(location, "^/", "")))


def url_extension(url: Column) -> Column:
    """Lower-case extension of an address without query and fragment, or null."""
    path = F.regexp_replace(url, r"(?s)[?#].*$", "")
    return F.lower(F.nullif(F.regexp_extract(path, r"\.([^./]*)$", 1), F.lit("")))


def json_escape(text: Column) -> Column:
    """Backslashes and quotes only."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
