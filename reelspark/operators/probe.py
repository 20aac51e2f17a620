"""Format probing, stream selection and the codec and format dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: codec names, media types, accepted aliases and whether a decoder
# and an encoder exist for the name in this engine's dimension
CODECS = [
    ("aac", "audio", ["aac"]),
    ("av2", "video", ["av2", "libavm"]),
    ("avif", "video", ["avif"]),
    ("flac", "audio", ["flac"]),
    ("gif", "video", ["gif"]),
    ("h264", "video", ["h264", "avc", "libx264"]),
    ("jpegxl", "video", ["jpegxl", "jxl"]),
    ("mjpeg", "video", ["mjpeg", "jpeg", "jpg"]),
    ("mp3", "audio", ["mp3", "mp3float", "libmp3lame"]),
    ("opus", "audio", ["opus", "libopus"]),
    ("pcm", "audio", ["pcm", "pcm_s16le", "pcm_f32le"]),
    ("png", "video", ["png"]),
    ("rawvideo", "video", ["rawvideo", "yuv4mpegpipe"]),
    ("subrip", "subtitle", ["srt", "subrip"]),
    ("vorbis", "audio", ["vorbis"]),
    ("vp9", "video", ["vp9", "libvpx-vp9"]),
    ("webp", "video", ["webp"]),
    ("webvtt", "subtitle", ["vtt", "webvtt"]),
]
PINNED_SAMPLE_FORMAT = {"pcm_s16le": "s16", "pcm_f32le": "flt"}
#: pixel format: bits a component and bytes a sample
PIXEL_FORMATS = [
    ("yuv420p", 8, 1), ("yuv422p", 8, 1), ("yuv444p", 8, 1),
    ("yuv420p10le", 10, 2), ("yuv422p10le", 10, 2), ("yuv444p10le", 10, 2),
    ("yuv420p12le", 12, 2), ("yuv422p12le", 12, 2), ("yuv444p12le", 12, 2),
    ("rgb24", 8, 1), ("rgba", 8, 1),
]
# fixed values: format names, extensions, and whether a muxer exists
FORMATS = [
    ("avi", ["avi"], True), ("avif", ["avif"], True), ("flac", ["flac"], True), ("flv", ["flv"], True), ("gif", ["gif"], True),
    ("ivf", ["ivf"], True), ("jpeg", ["jpg", "jpeg"], True), ("jpegxl", ["jxl"], True), ("matroska", ["mkv", "webm", "mka"], False),
    ("mp3", ["mp3"], True), ("mp4", ["mp4", "mov", "m4a", "m4v"], True), ("mpegts", ["ts", "m2ts", "mts"], True), ("ogg", ["opus", "ogg"], True),
    ("png", ["png"], True), ("srt", ["srt"], True), ("wav", ["wav"], True), ("webp", ["webp"], True), ("webvtt", ["vtt"], True), ("yuv4mpegpipe", ["y4m"], True),
]
#: container to the codec it needs; the first is forced, the others only where
#: no selected video stream has the codec already
DEFAULT_CODEC = {"yuv4mpegpipe": "rawvideo", "webp": "webp", "png": "png", "jpeg": "mjpeg", "gif": "gif", "avif": "avif", "jpegxl": "jpegxl"}
HEAD = 4096


def _starts(h: Column, hex_prefix: str) -> Column:
    return h.startswith(hex_prefix)


def _at(h: Column, byte: int, hex_value: str) -> Column:
    return F.substring(h, 2 * byte + 1, len(hex_value)) == hex_value


def _ascii(s: str) -> str:
    return s.encode().hex().upper()


def _mp3_sync(h: Column) -> Column:
    """Offset of the first layer III frame header, null without one: the bytes
    are matched in pairs of hexadecimal digits at even places only."""
    header = r"(?:FF(?:E[2-3]|F[2-3A-B])(?:[1-9A-E][0-9AB]|[1-9A-E][0-9AB]).)"
    hit = F.regexp_extract(h, rf"^((?:..)*?){header}", 1)
    return F.when(h.rlike(rf"^(?:..)*?{header}"), F.length(hit) / 2)


def scores(content: Column) -> Column:
    """array(struct(format, score)) of every format's probe on the first bytes."""
    h = F.hex(F.substring(content, 1, HEAD))
    n = F.length(h) / 2
    riff = lambda form: F.when(_starts(h, _ascii("RIFF")) & _at(h, 8, _ascii(form)), 100)
    ftyp = _at(h, 4, _ascii("ftyp"))
    size = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    end = F.least(F.greatest(size, F.lit(12)), n.cast("bigint"))
    brands = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(end / 4).cast("int") - 1)), lambda i: F.substring(h, i * 8 + 1, F.lit(8)))
    has = lambda *names: F.exists(brands, lambda b: b.isin(*[_ascii(x) for x in names]))
    sync = [_at(h, 188 * i, "47") for i in range(3)]
    hits = sum((s.cast("int") for s in sync[1:]), sync[0].cast("int"))
    at = _mp3_sync(h)
    rules = {
        "avi": riff("AVI "), "wav": riff("WAVE"), "webp": riff("WEBP"),
        "avif": F.when(ftyp & (n >= 12) & has("avif", "avis"), 100).when(ftyp & (n >= 12) & has("mif1", "miaf"), 50),
        "mp4": F.when(ftyp & (n >= 8), 90),
        "png": F.when(_starts(h, "89504E470D0A1A0A"), 100), "jpeg": F.when(_starts(h, "FFD8FF"), 100),
        "gif": F.when(_starts(h, _ascii("GIF8")) & (_at(h, 4, "37") | _at(h, 4, "39")) & (n >= 6), 100),
        "jpegxl": F.when(_starts(h, "FF0A") | _starts(h, "0000000C4A584C200D0A870A"), 100),
        "yuv4mpegpipe": F.when(_starts(h, _ascii("YUV4MPEG2")), 100), "ivf": F.when(_starts(h, _ascii("DKIF")), 100),
        "ogg": F.when(_starts(h, _ascii("OggS")), 100), "flac": F.when(_starts(h, _ascii("fLaC")), 100),
        "matroska": F.when(_starts(h, "1A45DFA3"), 90),
        "mpegts": F.when((n < 377) & sync[0], 1).when((n >= 377) & (hits == 3), 90).when((n >= 377) & (hits == 2), 50),
        "flv": F.when(_starts(h, _ascii("FLV")), 90),
        "mp3": F.when(_starts(h, _ascii("ID3")), 90).when(at < 4, 80).when(at.isNotNull(), 40),
        "srt": F.when(F.substring(h, 1, 1024).rlike("^(?:..)*2D2D3E"), 40), "webvtt": F.when(_starts(h, _ascii("WEBVTT")), 95),
    }
    return F.array(*[F.struct(F.lit(k).alias("format"), F.coalesce(v, F.lit(0)).alias("score")) for k, v in rules.items()])


def probe(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """``key, format, score``: the format with the best positive score, ties to
    the alphabetically last; null where none fits.  A projection, no shuffle."""
    best = F.array_max(F.filter(F.transform(scores(F.col(content)), lambda s: F.struct(s["score"].alias("score"), s["format"].alias("format"))), lambda s: s["score"] > 0))
    return files.select(*key, best.alias("b")).select(*key, F.col("b.format").alias("format"), F.col("b.score").cast("bigint").alias("score"))


def format_by_extension(ext: Column) -> Column:
    """Format of a file extension, any case; null for unknown ones."""
    pairs = [(e, name) for name, exts, _ in FORMATS for e in exts]
    m = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.element_at(m, F.lower(ext))


def codec_of(name: Column) -> Column:
    m = F.create_map(*[F.lit(x) for c, _, names in CODECS for a in names for x in (a, c)])
    return F.element_at(m, name)


def media_type_of(codec: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, t, _ in CODECS for x in (c, t)]), codec)


def sample_format_of(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in PINNED_SAMPLE_FORMAT.items() for x in p]), name)


def codec_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, t, _ in CODECS], "codec string, media_type string")


def format_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, e, m) for n, e, m in FORMATS], "format string, extensions array<string>, can_mux boolean")


def parse_map(spec: Column) -> Column:
    """struct(input, selector, value) of ``0``, ``0:v``, ``0:a`` or ``0:2``; null
    if malformed."""
    p = F.split(spec, ":")
    first = F.when(p[0].rlike(r"^\+?\d+$"), p[0].try_cast("int"))
    second = F.get(p, F.lit(1))
    kind = F.when(second.isNull(), "all").when(second.isin("v", "V"), "video").when(second == "a", "audio").when(second.rlike(r"^\+?\d+$"), "index")
    index = F.when(kind == "index", second.try_cast("int"))
    ok = first.isNotNull() & kind.isNotNull() & ((kind != "index") | index.isNotNull())
    return F.when(ok, F.struct(first.alias("input"), kind.alias("selector"), index.alias("value")))


def select_streams(streams: DataFrame, maps: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """``input, idx, out_idx``: chosen streams in output order, counted anew for
    each job where ``key`` names its columns.

    ``streams(input, idx, media_type)``; ``maps(place, input, selector, value)``.
    Without maps video, audio and subtitles in input order; with maps each in
    its turn, so a stream may come twice.
    """
    if maps is None:
        s = streams.where(F.col("media_type").isin("video", "audio", "subtitle")).withColumn("place", F.lit(0))
    else:
        m = maps.withColumnRenamed("input", "m_input")
        hit = (F.col("input") == F.col("m_input")) & (
            (F.col("selector") == "all") | (F.col("selector") == F.col("media_type")) | ((F.col("selector") == "index") & (F.col("value") == F.col("idx")))
        )
        s = streams.join(F.broadcast(m), hit)
    from pyspark.sql import Window

    # without a key the streams of one job: a handful of rows
    order = Window.partitionBy(*(key or [F.lit(0)])).orderBy("place", "input", "idx")
    return s.select(*key, "input", "idx", (F.row_number().over(order) - 1).cast("bigint").alias("out_idx"))


def default_codec(format_name: Column, source_codecs: Column) -> Column:
    """Codec a container forces, null where a selected source has it already."""
    m = F.create_map(*[F.lit(x) for p in DEFAULT_CODEC.items() for x in p])
    need = F.element_at(m, format_name)
    return F.when((format_name == "yuv4mpegpipe") | ~F.array_contains(source_codecs, need), need)


def stream_json(streams: DataFrame) -> DataFrame:
    """Probe result as JSON text, one document a row."""
    return streams.select(F.to_json(F.struct(*streams.columns)).alias("json"))


def tighten(plane: Column, stride: int, width: int, height: int) -> Column:
    """Rows of ``width`` bytes out of rows of ``stride`` bytes."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.hex(F.substring(plane, r * stride + 1, F.lit(width))))
    return F.unhex(F.array_join(rows, ""))


def split_planes(data: Column, sizes: list[int]) -> Column:
    """array of planes cut from tightly packed raw video; null if too short."""
    at, out = 1, []
    for s in sizes:
        out.append(F.substring(data, at, s))
        at += s
    return F.when(F.octet_length(data) >= at - 1, F.array(*out))


def codec_of_tag(container: Column, tag: Column) -> Column:
    """Codec of a container's own identifier (sample entry, codec id, fourcc)."""
    from ..sources.demux import AVI_CODECS, MKV_CODECS, MP4_CODECS

    pairs = [("mp4:" + k.decode(), v) for k, v in MP4_CODECS.items()] + [("matroska:" + k, v) for k, v in MKV_CODECS.items()] + [("avi:" + k.decode(), v) for k, v in AVI_CODECS.items()]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), F.concat(container, F.lit(":"), tag))
