"""Plan builder: a declarative job becomes one DataFrame plan.

The rules here run on the driver before Catalyst sees anything: stream
selection, the codec a container forces, range and pixel-format conversions,
and output geometry.  Everything is validated before any data is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators.probe import CODECS, DEFAULT_CODEC

# fixed values: codecs whose samples are full range by definition
FULL_RANGE = ("mjpeg", "png", "gif", "webp")
_ALIAS = {a: c for c, _, names in CODECS for a in names}
_KIND = {c: t for c, t, _ in CODECS}


class PlanError(ValueError):
    """A job that cannot be planned."""


@dataclass(frozen=True)
class MapSpec:
    input: int
    selector: str = "all"  # all, video, audio or index
    value: int | None = None


@dataclass(frozen=True)
class Stream:
    input: int
    idx: int
    media_type: str
    codec: str
    width: int = 0
    height: int = 0
    pixfmt: str = "yuv420p"
    color_range: str | None = None
    sample_rate: int = 0


@dataclass(frozen=True)
class Spec:
    """Inputs, one output and what to do in between.  ``video_codec`` and
    ``audio_codec`` are codec names, ``copy`` or None for automatic."""

    inputs: tuple[str, ...]
    output: str
    output_format: str | None = None
    maps: tuple[MapSpec, ...] = ()
    video_codec: str | None = None
    audio_codec: str | None = None
    video_filter: str | None = None
    filter_complex: str | None = None
    video_bitrate: int | None = None
    audio_bitrate: int | None = None
    frames: int | None = None
    overwrite: bool = False
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class StreamOp:
    """What happens to one selected stream."""

    stream: Stream
    out_idx: int
    action: str  # copy or transcode
    codec: str
    filters: str = ""
    width: int = 0
    height: int = 0
    sample_rate: int = 0


def conform_pixels(pixfmt: str, accepted: list[str]) -> str | None:
    """Pixel format to convert to before an encoder; None where it takes the
    source's, or where nothing it takes can be made."""
    if not accepted or pixfmt in accepted:
        return None
    return next((f for f in accepted if f in ("rgb24", "yuv420p")), None)


def effective_range(color_range: str | None, codec: str) -> str:
    return color_range or ("full" if codec in FULL_RANGE else "limited")


def auto_setrange(source_range: str | None, target_codec: str) -> str | None:
    """Filter to put first when limited-range video goes to a full-range codec."""
    return "setrange=full" if target_codec in FULL_RANGE and (source_range or "limited") == "limited" else None


def parse_overlay(spec: str) -> tuple[int, int]:
    """Offsets of ``overlay=X:Y`` in a complex filter; anything else raises."""
    m = re.search(r"overlay=([^\[\],;]*)", spec)
    if not m:
        raise PlanError(f"filter_complex: only overlay is known: {spec}")
    parts = {}
    for i, p in enumerate(m[1].split(":")):
        k, _, v = p.rpartition("=")
        parts[k or "xy"[i]] = v
    try:
        return int(parts.get("x", "0") or 0), int(parts.get("y", "0") or 0)
    except ValueError:
        raise PlanError(f"overlay: offsets must be numbers: {m[1]}") from None


def select(streams: list[Stream], maps: tuple[MapSpec, ...]) -> list[Stream]:
    if not maps:
        return [s for s in streams if s.media_type in ("video", "audio", "subtitle")]
    inputs = {s.input for s in streams}
    out = []
    for m in maps:
        if m.input not in inputs:
            raise PlanError(f"map: no input {m.input}")
        out += [s for s in streams if s.input == m.input and (m.selector == "all" or m.selector == s.media_type or m.selector == "index" and s.idx == m.value)]
    return out


def plan(spec: Spec, streams: list[Stream], output_format: str) -> list[StreamOp]:
    """One operation for each selected stream, or an error before any work."""
    if not spec.inputs:
        raise PlanError("no input")
    if spec.filter_complex:
        parse_overlay(spec.filter_complex)
        if len(spec.inputs) < 2:
            raise PlanError("overlay needs two inputs")
    chosen = select(streams, spec.maps)
    if not chosen:
        raise PlanError("no stream selected")
    video = spec.video_codec
    if video is None:
        need = DEFAULT_CODEC.get(output_format)
        if need and (output_format == "yuv4mpegpipe" or not any(s.media_type == "video" and s.codec == need for s in chosen)):
            video = need
    ops = []
    for i, s in enumerate(chosen):
        name = video if s.media_type == "video" else spec.audio_codec if s.media_type == "audio" else None
        if name in (None, "copy"):
            if s.media_type == "video" and spec.video_filter:
                raise PlanError("a filter needs a video codec: copied streams are not decoded")
            ops.append(StreamOp(s, i, "copy", s.codec, "", s.width, s.height, s.sample_rate))
            continue
        codec = _ALIAS.get(name)
        if codec is None or _KIND[codec] != s.media_type:
            raise PlanError(f"{name} is not a {s.media_type} codec")
        chain = spec.video_filter or "" if s.media_type == "video" else ""
        w, h = s.width, s.height
        if s.media_type == "video":
            first = auto_setrange(effective_range(s.color_range, s.codec), codec)
            chain = ",".join(x for x in (first, chain) if x)
            g = fr.Geometry(w, h, s.pixfmt)
            for fname, args in fr.parse_chain(chain):
                g = _geometry(g, fname, args)
            w, h = g.width, g.height
        ops.append(StreamOp(s, i, "transcode", codec, chain, w, h, s.sample_rate))
    return ops


def _geometry(g: fr.Geometry, name: str, args: list[str]) -> fr.Geometry:
    """Output geometry of one filter without running it."""
    try:
        n = [int(a) for a in args] if name in ("scale", "crop", "pad", "transpose") else []
    except ValueError:
        raise PlanError(f"{name}: bad arguments {args}") from None
    if name == "scale":
        w, h = fr.scale_size(*n, g.width, g.height)
        return fr.Geometry(w, h, g.pixfmt)
    if name in ("crop", "pad"):
        return fr.Geometry(n[0], n[1], g.pixfmt)
    if name == "transpose":
        return fr.Geometry(g.height, g.width, g.pixfmt)
    if name in ("hflip", "vflip", "negate", "gray", "grayscale", "setrange", "format"):
        return g
    raise PlanError(f"unknown filter {name}")


class Engine:
    """Entry point: probe files and run jobs on packet and pixel tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def probe(self, path: str) -> DataFrame:
        """Format of every file under ``path``: content first, then extension."""
        from ..operators.probe import format_by_extension, probe
        from ..sources.files import read_heads

        files = read_heads(self.spark, path)
        p = probe(files, ["file"], "content")
        ext = F.regexp_extract("file", r"\.([^./]*)$", 1)
        return p.select("file", F.coalesce("format", format_by_extension(ext)).alias("format"), "score")

    def run(self, spec: Spec, streams: list[Stream], packets: DataFrame, output_format: str) -> DataFrame:
        """Packets of the output, renumbered, in time order within each file.

        ``packets(input, idx, ordinal, pts, ...)``.  Copied streams pass through;
        a frame limit applies to video.  Payload columns of streams that are not
        selected are pruned by the join.
        """
        ops = plan(spec, streams, output_format)
        rows = [(o.stream.input, o.stream.idx, o.out_idx, o.codec, o.action, o.stream.media_type) for o in ops]
        chosen = self.spark.createDataFrame(rows, "input bigint, idx bigint, out_idx bigint, codec string, action string, media_type string")
        out = packets.join(F.broadcast(chosen), ["input", "idx"]).drop("idx").withColumnRenamed("out_idx", "idx")
        if spec.frames is not None:
            out = out.where((F.col("media_type") != "video") | (F.col("ordinal") < spec.frames))
        return out

    def filter_frames(self, spec: Spec, stream: Stream, pixels: DataFrame) -> fr.Framed:
        """The job's filter chain over exploded planes of one stream."""
        g = fr.Geometry(stream.width, stream.height, stream.pixfmt, effective_range(stream.color_range, stream.codec))
        return fr.apply_chain(pixels, g, spec.video_filter or "")
