"""Live packet streams: reassembly, segmentation and windows.

State is per key and bounded: one unfinished packet a PID, one open segment a
stream.  Batches arrive sorted within a trigger only, so each function orders
its rows before it folds them in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PES = "pid bigint, first_ord bigint, size bigint, parts bigint, keyframe boolean"
_PES_STATE = "open boolean, first_ord bigint, size bigint, parts bigint, keyframe boolean, expect bigint"


def pes_stream(ts: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """PES packets of a live stream ``(pid, ord, pusi, rai, expect, len)``.

    A packet closes at the next unit start of its PID, once it has ``expect``
    bytes, or after ``timeout_ms`` without new data (end of input)."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur = list(state.get) if state.exists else [False, 0, 0, 0, False, 0]
        out = []

        def close():
            if cur[0]:
                out.append((key[0], cur[1], cur[2], cur[3], cur[4]))
            cur[0] = False

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
            for o, pusi, rai, expect, n in zip(rows["ord"], rows["pusi"], rows["rai"], rows["expect"], rows["len"]):
                if pusi:
                    close()
                    cur[:] = [True, int(o), int(n), 1, bool(rai), int(expect)]
                elif cur[0]:
                    cur[2] += int(n)
                    cur[3] += 1
                if cur[0] and cur[5] and cur[2] >= cur[5]:
                    close()
            state.update(tuple(cur))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["pid", "first_ord", "size", "parts", "keyframe"])

    return ts.groupBy("pid").applyInPandasWithState(fold, PES, _PES_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


SEGMENTS = "file bigint, segment bigint, start_pts bigint, end_pts bigint"


def hls_stream(packets: DataFrame, target: float, timeout_ms: int = 60_000) -> DataFrame:
    """Closed segments of live reference streams ``(file, ordinal, pts, tb_num,
    tb_den, keyframe)``; the last segment closes on the time-out."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, last = state.get if state.exists else (-1, 0, 0)
        out = []
        if state.hasTimedOut:
            if number >= 0:
                out.append((key[0], number, start, last))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ordinal", kind="stable")
            for pts, num, den, k in zip(rows["pts"], rows["tb_num"], rows["tb_den"], rows["keyframe"]):
                pts = int(pts)
                if number < 0:
                    number, start = 0, pts
                elif (pts - start) * num / max(den, 1) >= max(target, 0.5) and k:
                    out.append((key[0], number, start, pts))
                    number, start = number + 1, pts
                last = pts
            state.update((number, start, last))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["file", "segment", "start_pts", "end_pts"])

    return packets.groupBy("file").applyInPandasWithState(fold, SEGMENTS, "number bigint, start bigint, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def resample_stream(samples: DataFrame, in_rate: int, out_rate: int, timeout_ms: int = 60_000) -> DataFrame:
    """Live resampling of ``(clip, n, v)``: the last 63 samples and the next
    output position are carried; the tail is flushed on the time-out."""
    import math

    import numpy as np

    g = math.gcd(in_rate, out_rate)
    num, den, taps = in_rate // g, out_rate // g, 32
    cut = 0.5 * min(1.0, out_rate / in_rate)

    def weights():
        x = np.arange(den)[:, None] / den + (taps - 1 - np.arange(2 * taps))[None, :]
        t = 2 * np.pi * (x + taps) / (2 * taps)
        w = 2 * cut * np.sinc(2 * cut * x) * (0.35875 - 0.48829 * np.cos(t) + 0.14128 * np.cos(2 * t) - 0.01168 * np.cos(3 * t))
        w[np.abs(x) > taps] = 0
        s = w.sum(1, keepdims=True)
        return w / np.where(s == 0, 1, s)

    def fold(key, frames, state):
        w = weights()
        first, m, seen, buf = (state.get if state.exists else (-taps, 0, 0, [0.0] * taps))
        buf = np.array(buf)
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("n", kind="stable")
            buf, seen = np.concatenate((buf, rows["v"].to_numpy(float))), seen + len(rows)
        else:
            buf = np.concatenate((buf, np.zeros(taps)))
        out = []
        while m * num // den <= seen - 1 and m * num // den + taps < first + len(buf):
            a = m * num // den - taps + 1 - first
            out.append((key[0], m, float(buf[a : a + 2 * taps] @ w[m * num % den])))
            m += 1
        drop = max(m * num // den - taps + 1 - first, 0)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((first + drop, m, seen, buf[drop:].tolist()))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["clip", "m", "y"])

    return samples.groupBy("clip").applyInPandasWithState(fold, "clip string, m bigint, y double", "first bigint, m bigint, seen bigint, buf array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """Packets and value by event type and event-time window, late rows dropped
    after ``late``; works on streams and tables."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Bursts of a user's events with no gap of ``gap`` between them."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
