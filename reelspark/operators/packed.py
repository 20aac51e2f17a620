"""Filters on whole frames ``(clip, frame_no, width, height, pixfmt, planes
ARRAY<BINARY>)``: NumPy over Arrow batches, one pass for a whole chain, no
shuffle.  For real picture sizes, where a row for each pixel would be too many;
results equal those of :mod:`reelspark.operators.frames`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.builder import _geometry
from .frames import FilterError, Geometry, _RANGES, parse_chain, scale_size


def _byte(v: np.ndarray) -> np.ndarray:
    r = np.where(v < 0, np.ceil(v - 0.5), np.floor(v + 0.5))
    return np.clip(r, 0, 255).astype(np.uint8)


def _axis(s: int, d: int):
    ratio = np.float32(s / d)
    pos = np.maximum((np.arange(d, dtype=np.float32) + np.float32(0.5)) * ratio - np.float32(0.5), np.float32(0))
    lo = np.floor(pos).astype(np.int64)
    return lo, np.minimum(lo + 1, s - 1), pos - lo.astype(np.float32)


def _bilinear(p: np.ndarray, w: int, h: int) -> np.ndarray:
    x0, x1, wx = _axis(p.shape[1], w)
    y0, y1, wy = _axis(p.shape[0], h)
    f = p.astype(np.float32)
    one = np.float32(1)
    rows = f[:, x0] * (one - wx) + f[:, x1] * wx
    return _byte((rows[y0] * (one - wy)[:, None] + rows[y1] * wy[:, None]).astype(np.float64))


def _setrange(p: np.ndarray, chroma: bool, full: bool) -> np.ndarray:
    v, span, lo, top = np.arange(256, dtype=np.float32), np.float32(224 if chroma else 219), np.float32(16), np.float32(255)
    lut = (v - lo) * top / span if full else v * span / top + lo
    return _byte(lut.astype(np.float64))[p]


def run_chain(planes: list[np.ndarray], g: Geometry, spec: str) -> tuple[list[np.ndarray], Geometry]:
    """Apply a chain to one frame's planes."""
    for name, args in parse_chain(spec):
        n = [int(a) for a in args] if name in ("scale", "crop", "pad", "transpose") else []
        sx, sy = g.sub
        div = [(1, 1), (sx, sy), (sx, sy)]
        if name == "scale":
            w, h = scale_size(*n, g.width, g.height)
            big = Geometry(w, h, g.pixfmt)
            planes = [_bilinear(p, *big.plane(i)) for i, p in enumerate(planes)]
        elif name == "crop":
            w, h, x, y = n
            if x + w > g.width or y + h > g.height or any(v % s for v, s in ((x, sx), (w, sx), (y, sy), (h, sy))):
                raise FilterError("crop: rectangle outside the frame or off the chroma grid")
            planes = [p[y // b : (y + h) // b, x // a : (x + w) // a] for p, (a, b) in zip(planes, div)]
        elif name == "pad":
            w, h, x, y = n
            if x + g.width > w or y + g.height > h or any(v % s for v, s in ((x, sx), (w, sx), (y, sy), (h, sy))):
                raise FilterError("pad: frame does not fit or is off the chroma grid")
            out = []
            for i, (p, (a, b)) in enumerate(zip(planes, div)):
                c = np.full((-(-h // b), -(-w // a)), 128 if i else 0, np.uint8)
                c[y // b : y // b + p.shape[0], x // a : x // a + p.shape[1]] = p
                out.append(c)
            planes = out
        elif name == "transpose":
            if sx != sy or n[0] not in (0, 1, 2, 3):
                raise FilterError("transpose: bad direction or chroma")
            turn = {0: lambda p: p.T, 1: lambda p: p.T[:, ::-1], 2: lambda p: p.T[::-1], 3: lambda p: p.T[::-1, ::-1]}[n[0]]
            planes = [turn(p) for p in planes]
        elif name == "hflip":
            planes = [p[:, ::-1] for p in planes]
        elif name == "vflip":
            planes = [p[::-1] for p in planes]
        elif name == "negate":
            planes = [255 - p for p in planes]
        elif name in ("gray", "grayscale"):
            planes = [planes[0], *[np.full_like(p, 128) for p in planes[1:]]]
        elif name == "setrange" and args and args[0] in _RANGES:
            planes = [_setrange(p, i > 0, _RANGES[args[0]] == "full") for i, p in enumerate(planes)]
        else:
            raise FilterError(f"unknown filter {name}")
        g = _geometry(g, name, args)
    return planes, g


def filter_frames(frames: DataFrame, spec: str) -> DataFrame:
    """``frames`` with a filter chain applied; a frame whose planes are too short
    for its size raises."""
    schema = "clip string, frame_no bigint, width int, height int, pixfmt string, planes array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                g = Geometry(r["width"], r["height"], r["pixfmt"])
                ps = [np.frombuffer(p, np.uint8).reshape(g.plane(k)[::-1]) for k, p in enumerate(r["planes"])]
                ps, g = run_chain(ps, g, spec)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["clip"]]), pa.array([r["frame_no"]], pa.int64()), pa.array([g.width], pa.int32()), pa.array([g.height], pa.int32()), pa.array([g.pixfmt]), pa.array([[np.ascontiguousarray(p).tobytes() for p in ps]], pa.list_(pa.binary()))],
                    ["clip", "frame_no", "width", "height", "pixfmt", "planes"],
                )

    return frames.select("clip", "frame_no", "width", "height", "pixfmt", "planes").mapInArrow(run, schema)


def explode(frames: DataFrame) -> DataFrame:
    """Packed frames as pixel rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g = Geometry(b.column("width")[i].as_py(), b.column("height")[i].as_py(), b.column("pixfmt")[i].as_py())
                for k, p in enumerate(b.column("planes")[i].as_py()):
                    v = np.frombuffer(p, np.uint8).astype(np.int64)
                    y, x = np.divmod(np.arange(len(v)), g.plane(k)[0])
                    n = len(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column("clip")[i].as_py()] * n, pa.string()), pa.array(np.full(n, b.column("frame_no")[i].as_py())), pa.array(np.full(n, k)), pa.array(y), pa.array(x), pa.array(v)],
                        ["clip", "frame_no", "plane", "y", "x", "v"],
                    )

    return frames.mapInArrow(run, "clip string, frame_no bigint, plane bigint, y bigint, x bigint, v bigint")


def pack(pixels: DataFrame, g: Geometry) -> DataFrame:
    """Pixel rows as packed frames: one group a plane, then one a frame."""
    p = pixels.groupBy("clip", "frame_no", "plane").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    p = p.select("clip", "frame_no", "plane", F.unhex(F.array_join(F.transform("s", lambda e: F.lpad(F.hex(e["v"]), 2, "0")), "")).alias("d"))
    f = p.groupBy("clip", "frame_no").agg(F.array_sort(F.collect_list(F.struct("plane", "d"))).alias("ps"))
    return f.select("clip", "frame_no", F.lit(g.width).alias("width"), F.lit(g.height).alias("height"), F.lit(g.pixfmt).alias("pixfmt"), F.transform("ps", lambda e: e["d"]).alias("planes"))
