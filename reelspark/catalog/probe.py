"""Probe, selection and dimension queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import probe as ops
from . import frames as fx


def _read(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each_part(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str):
    """Each part with one of ``rows`` by turns: ``p_partkey`` and their columns."""
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i bigint, {schema}")
    return _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).alias("_i")).join(F.broadcast(few), "_i").drop("_i")


def each_part_sql(rows: str, n: int) -> str:
    """The same for the ``n`` rows of a query."""
    return f"select p_partkey, q.* exclude (i) from part join (select *, row_number() over () - 1 as i from ({rows})) q on p_partkey % {n} = i"


# headers in hexadecimal: name and bytes
HEADS = {
    "avi": "524946460000000041564920", "wav": "524946460000000057415645", "webp": "524946460000000057454250", "avif": "000000186674797061766966", "mif1": "00000018667479706D69663100000000",
    "compat": "0000001466747970697364730000000061766966", "mp4": "0000001866747970697365736F6D", "png": "89504E470D0A1A0A0000", "jpeg": "FFD8FFE000", "gif": "474946383961", "jxl": "FF0A00", "jxlbox": "0000000C4A584C200D0A870A00",
    "y4m": "595556344D504547322057", "ivf": "444B49460000", "ogg": "4F676753", "flac": "664C6143", "mkv": "1A45DFA301", "flv": "464C5601", "id3": "49443304", "mp3": "FFFB9064", "mp3later": "0000000000FFFB9064", "tsshort": "47401110",
    "srt": "310A30303A30303A30302C303030202D2D3E20303A30310A", "vtt": "5745425654540A", "none": "00010203",
}
_WANT = {
    "avi": ("avi", 100), "wav": ("wav", 100), "webp": ("webp", 100), "avif": ("avif", 100), "mif1": ("mp4", 90), "compat": ("avif", 100), "mp4": ("mp4", 90), "png": ("png", 100), "jpeg": ("jpeg", 100), "gif": ("gif", 100),
    "jxl": ("jpegxl", 100), "jxlbox": ("jpegxl", 100), "y4m": ("yuv4mpegpipe", 100), "ivf": ("ivf", 100), "ogg": ("ogg", 100), "flac": ("flac", 100), "mkv": ("matroska", 90), "flv": ("flv", 90), "id3": ("mp3", 90),
    "mp3": ("mp3", 80), "mp3later": ("mp3", 40), "tsshort": ("mpegts", 1), "srt": ("srt", 40), "vtt": ("webvtt", 95), "none": (None, None),
}


def _probe(spark, sf_dir):
    heads = spark.createDataFrame(list(HEADS.items()), "name string, h string").select("name", F.unhex("h").alias("content"))
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.encode("text", "utf-8").alias("content"))
    return ops.probe(heads.unionByName(docs), ["name"], "content")


_q = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_vals = lambda rows: ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)
NAMES = ["libopus", "opus", "avc", "jpg", "pcm_s16le", "pcm_f32le", "libvpx-vp9", "mp3float", "vtt", "subrip", "jxl", "libavm", "nonsense", ""]
MAPS = ["0", "0:v", "1:a", "0:2", "x", "0:z", "1:V", "", "2:10"]
CHOSEN = [(0, 0, "video", None), (1, 1, "all", None), (2, 0, "index", 2), (3, 0, "video", None)]
SOURCES = [("webp", ["webp"]), ("webp", ["vp9", "opus"]), ("yuv4mpegpipe", ["rawvideo"]), ("png", ["mjpeg"]), ("mp4", ["h264"]), ("jpegxl", ["jpegxl"]), ("gif", [])]


def _streams(spark, sf_dir):
    """A job for each user, whose events are streams of two inputs."""
    return _read(spark, sf_dir, "events").selectExpr(
        "user_id as job", "event_id % 2 as input", "cast(row_number() over (partition by user_id, event_id % 2 order by event_id) - 1 as bigint) as idx", f"{_MEDIA} as media_type"
    )


_MEDIA = "case event_type when 'view' then 'video' when 'click' then 'audio' when 'error' then 'data' else 'subtitle' end"
_STREAMS = f"st as (select user_id as job, event_id % 2 as input, row_number() over (partition by user_id, event_id % 2 order by event_id) - 1 as idx, {_MEDIA} as media_type from events)"


def _default(spark, sf_dir):
    d = each_part(spark, sf_dir, SOURCES, "format string, codecs array<string>")
    return d.select("p_partkey", "format", F.array_join("codecs", "+").alias("source"), ops.default_codec(F.col("format"), F.col("codecs")).alias("codec"))


def _stride(spark, sf_dir):
    d = _read(spark, sf_dir, "events").selectExpr("event_id", "1 + cast(floor(value * 8) as bigint) % 4096 as id").select("event_id", F.unhex(F.lpad(F.hex(F.col("id") * 7919), 32, "A")).alias("plane"))
    return d.select("event_id", F.hex(ops.tighten(F.col("plane"), 4, 3, 4)).alias("tight"))


def _raw(spark, sf_dir):
    d = _read(spark, sf_dir, "events").selectExpr("1 + cast(floor(value * 8) as bigint) % 4096 as id").select("id", F.unhex(F.substring(F.lpad(F.hex(F.col("id") * 7919), 24, "B"), 1, 24)).alias("data"))
    return d.select("id", F.transform(ops.split_planes(F.col("data"), [8, 2, 2]), lambda p: F.hex(p)).alias("p")).select("id", F.array_join("p", "|").alias("planes"))


def _frame_md5(spark, sf_dir):
    p = fx.planes(spark, sf_dir).groupBy("clip", "frame_no", "plane").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    h = p.select("clip", "frame_no", "plane", F.array_join(F.transform("s", lambda e: F.lpad(F.hex(e["v"]), 2, "0")), "").alias("h"))
    g = h.groupBy("clip", "frame_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plane", "h"))), lambda e: e["h"]), "").alias("h"))
    return g.select("clip", "frame_no", F.md5(F.unhex("h")).alias("md5"))


def _conform(spark, sf_dir):
    rows = [(f, a, None if f in a.split("+") else next((x for x in a.split("+") if x in ("rgb24", "yuv420p")), None)) for f in ("yuv444p", "rgb24", "yuv420p") for a in ("yuv420p", "rgb24+rgba", "yuv422p+rgb24+yuv420p", "yuv444p")]
    from ..plans.builder import conform_pixels

    return spark.createDataFrame([(f, a, conform_pixels(f, a.split("+"))) for f, a, _ in rows], "pixfmt string, accepted string, convert string")


def _autorange(spark, sf_dir):
    from ..plans.builder import auto_setrange

    rows = [(s, c, auto_setrange(s, c)) for s in ("limited", "full", None) for c in ("mjpeg", "png", "vp9", "webp")]
    return spark.createDataFrame(rows, "source string, codec string, prepend string")


def _vf(spark, sf_dir):
    from ..operators.frames import parse_chain

    specs = ["scale=20:-1,hflip", " crop=16:8:2:4 , ,negate", "", "format=rgb24:bt709:limited"]
    return spark.createDataFrame([(s, i, n, ":".join(a)) for s in specs for i, (n, a) in enumerate(parse_chain(s))], "spec string, place bigint, name string, args string")


def _corpus(spark, sf_dir):
    """A manifest of parts, limited to the listed names, without missing files."""
    m = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"), "p_size")
    there = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    return m.where("p_size < 10").join(there, "k", "left_semi").select("k", "name")


TAGS = [("mp4", "avc1", "h264"), ("mp4", "Opus", "opus"), ("mp4", "xxxx", None), ("matroska", "V_VP9", "vp9"), ("matroska", "A_FLAC", "flac"), ("avi", "MJPG", "mjpeg"), ("avi", "V_VP9", None)]

QUERIES = {
    "fn_codec_map": lambda s, d: each_part(s, d, [t[:2] for t in TAGS], "container string, tag string").select("p_partkey", "container", "tag", ops.codec_of_tag(F.col("container"), F.col("tag")).alias("codec")),
    "probe_fmt": _probe,
    "probe_ext": lambda s, d: each_part(s, d, [(e,) for e in ("MP4", "webm", "jpg", "TS", "txt", "opus", "Y4M", "vtt")], "ext string").select("p_partkey", "ext", ops.format_by_extension(F.col("ext")).alias("format")),
    "probe_url_ext": lambda s, d: _read(s, d, "pages").select("page_id", tx.url_extension(F.col("url")).alias("ext")),
    "probe_file": lambda s, d: _read(s, d, "events").groupBy((F.col("user_id") % 10).alias("file"), F.col("user_id").alias("idx")).agg(F.count("*").alias("nb_packets")),
    "codec_alias": lambda s, d: each_part(s, d, [(n,) for n in NAMES], "name string").select("p_partkey", "name", ops.codec_of(F.col("name")).alias("codec"), ops.media_type_of(ops.codec_of(F.col("name"))).alias("media_type"), ops.sample_format_of(F.col("name")).alias("sample_fmt")),
    "codec_list": lambda s, d: ops.codec_table(s).orderBy("codec"),
    "format_list": lambda s, d: ops.format_table(s).select("format", F.array_join("extensions", ",").alias("extensions"), F.when(F.col("can_mux"), "DE").otherwise("D.").alias("flags")).orderBy("format"),
    "sort_name": lambda s, d: ops.codec_table(s).orderBy("codec").select("codec"),
    "sel_parse_map": lambda s, d: each_part(s, d, [(m,) for m in MAPS], "spec string").select("p_partkey", "spec", ops.parse_map(F.col("spec")).alias("m")).select("p_partkey", "spec", "m.*"),
    "sel_streams": lambda s, d: ops.select_streams(_streams(s, d), s.createDataFrame(CHOSEN, "place int, input bigint, selector string, value bigint"), ["job"]),
    "sel_streams_default": lambda s, d: ops.select_streams(_streams(s, d), key=["job"]),
    "sel_default_codec": _default,
    "opt_bitrate": lambda s, d: _read(s, d, "orders").select("o_orderkey", tx.bitrate(F.concat((F.col("o_custkey") % 500).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("k", ".5M", "", "K", "x")]), (F.col("o_orderkey") % 5 + 1).cast("int")))).alias("bits")),
    "stride_tighten": _stride,
    "codec_rawvideo": _raw,
    "agg_frame_md5": _frame_md5,
    "conform_video": _conform,
    "auto_setrange": _autorange,
    "fn_vf_parse": _vf,
    "src_corpus": _corpus,
    "sink_json": lambda s, d: ops.stream_json(_read(s, d, "nation").select("n_nationkey", "n_name")),
    "sink_tsv": lambda s, d: _read(s, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string")).alias("line")),
}

SQL = {
    "fn_codec_map": each_part_sql(f"select * from (values {_vals(TAGS)}) t(container, tag, codec)", len(TAGS)),
    "probe_fmt": f"select name, format, score::bigint as score from (values {_vals([(k, *v) for k, v in _WANT.items()])}) t(name, format, score) union all"
    " select 'doc' || doc_id, case when left(text, 6) = 'WEBVTT' then 'webvtt' when contains(left(text, 510), '-->') then 'srt' when left(text, 3) = 'FLV' then 'flv' when left(text, 3) = 'ID3' then 'mp3' end, case when left(text, 6) = 'WEBVTT' then 95 end from documents where left(text, 1) <> 'G'"
    " union all select 'doc' || doc_id, case when octet_length(encode(text)) < 377 or octet_length(encode(text)) >= 377 and (substr(hex(encode(text)), 377, 2) = '47' and substr(hex(encode(text)), 753, 2) = '47') then 'mpegts' when substr(hex(encode(text)), 377, 2) = '47' or substr(hex(encode(text)), 753, 2) = '47' then 'mpegts' end,"
    " case when octet_length(encode(text)) < 377 then 1 when substr(hex(encode(text)), 377, 2) = '47' and substr(hex(encode(text)), 753, 2) = '47' then 90 when substr(hex(encode(text)), 377, 2) = '47' or substr(hex(encode(text)), 753, 2) = '47' then 50 end from documents where left(text, 1) = 'G'",
    "probe_ext": each_part_sql("select * from (values ('MP4', 'mp4'), ('webm', 'matroska'), ('jpg', 'jpeg'), ('TS', 'mpegts'), ('txt', null), ('opus', 'ogg'), ('Y4M', 'yuv4mpegpipe'), ('vtt', 'webvtt')) t(ext, format)", 8),
    "probe_url_ext": r"select page_id, lower(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]*)$', 1), '')) as ext from pages",
    "probe_file": "select user_id % 10 as file, user_id as idx, count(*) as nb_packets from events group by 1, 2",
    "codec_alias": each_part_sql(f"select * from (values {_vals([('libopus', 'opus', 'audio', None), ('opus', 'opus', 'audio', None), ('avc', 'h264', 'video', None), ('jpg', 'mjpeg', 'video', None), ('pcm_s16le', 'pcm', 'audio', 's16'), ('pcm_f32le', 'pcm', 'audio', 'flt'), ('libvpx-vp9', 'vp9', 'video', None), ('mp3float', 'mp3', 'audio', None), ('vtt', 'webvtt', 'subtitle', None), ('subrip', 'subrip', 'subtitle', None), ('jxl', 'jpegxl', 'video', None), ('libavm', 'av2', 'video', None), ('nonsense', None, None, None), ('', None, None, None)])}) t(name, codec, media_type, sample_fmt)", len(NAMES)),
    "codec_list": f"select * from (values {_vals([(c, t) for c, t, _ in ops.CODECS])}) t(codec, media_type)",
    "sort_name": f"select * from (values {_vals([(c,) for c, _, _ in ops.CODECS])}) t(codec)",
    "format_list": f"select * from (values {_vals([(n, ','.join(e), 'DE' if m else 'D.') for n, e, m in ops.FORMATS])}) t(format, extensions, flags)",
    "sel_parse_map": each_part_sql("select spec, input::int as input, selector, value::int as value from (values ('0', 0, 'all', null), ('0:v', 0, 'video', null), ('1:a', 1, 'audio', null), ('0:2', 0, 'index', 2), ('x', null, null, null), ('0:z', null, null, null), ('1:V', 1, 'video', null), ('', null, null, null), ('2:10', 2, 'index', 10)) t(spec, input, selector, value)", len(MAPS)),
    "sel_streams": f"with {_STREAMS}, m(place, input, selector, value) as (values {_vals(CHOSEN)}) select job, st.input, idx, row_number() over (partition by job order by place, st.input, idx) - 1 as out_idx from st join m on st.input = m.input and (selector in ('all', media_type) or selector = 'index' and value = idx)",
    "sel_streams_default": f"with {_STREAMS} select job, input, idx, row_number() over (partition by job order by input, idx) - 1 as out_idx from st where media_type <> 'data'",
    "sel_default_codec": each_part_sql("select * from (values ('webp', 'webp', null), ('webp', 'vp9+opus', 'webp'), ('yuv4mpegpipe', 'rawvideo', 'rawvideo'), ('png', 'mjpeg', 'png'), ('mp4', 'h264', null), ('jpegxl', 'jpegxl', null), ('gif', '', 'gif')) t(format, source, codec)", len(SOURCES)),
    "opt_bitrate": "select o_orderkey, cast(case o_orderkey % 5 when 0 then (o_custkey % 500) * 1000 when 1 then (o_custkey % 500 + 0.5) * 1000000 when 2 then o_custkey % 500 when 3 then (o_custkey % 500) * 1000 end as bigint) as bits from orders",
    "stride_tighten": "select event_id, string_agg(substr(h, r * 8 + 1, 6), '' order by r) as tight from (select event_id, lpad(to_hex(id * 7919), 32, 'A') as h from (select event_id, 1 + cast(floor(value * 8) as bigint) % 4096 as id from events)), range(4) r(r) group by event_id",
    "codec_rawvideo": "select id, substr(h, 1, 16) || '|' || substr(h, 17, 4) || '|' || substr(h, 21, 4) as planes from (select id, lpad(to_hex(id * 7919), 24, 'B') as h from (select 1 + cast(floor(value * 8) as bigint) % 4096 as id from events))",
    "agg_frame_md5": f"with {fx._pix_sql()} select clip, frame_no, md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' order by plane, y, x))) as md5 from pix group by 1, 2",
    "conform_video": "select pixfmt, accepted, case when list_contains(string_split(accepted, '+'), pixfmt) then null else list_filter(string_split(accepted, '+'), lambda x: x in ('rgb24', 'yuv420p'))[1] end as convert from (values ('yuv444p'), ('rgb24'), ('yuv420p')) a(pixfmt), (values ('yuv420p'), ('rgb24+rgba'), ('yuv422p+rgb24+yuv420p'), ('yuv444p')) b(accepted)",
    "auto_setrange": "select source, codec, case when coalesce(source, 'limited') = 'limited' and codec in ('mjpeg', 'png', 'webp') then 'setrange=full' end as prepend from (values ('limited'), ('full'), (null)) a(source), (values ('mjpeg'), ('png'), ('vp9'), ('webp')) b(codec)",
    "fn_vf_parse": "select spec, place::bigint as place, name, args from (values ('scale=20:-1,hflip', 0, 'scale', '20:-1'), ('scale=20:-1,hflip', 1, 'hflip', ''), (' crop=16:8:2:4 , ,negate', 0, 'crop', '16:8:2:4'), (' crop=16:8:2:4 , ,negate', 1, 'negate', ''), ('format=rgb24:bt709:limited', 0, 'format', 'rgb24:bt709:limited')) t(spec, place, name, args)",
    "src_corpus": "select p_partkey as k, p_name as name from part where p_size < 10 and p_partkey in (select l_partkey from lineitem)",
    "sink_json": """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as json from nation""",
    "sink_tsv": "select s_suppkey || chr(9) || s_name || chr(9) || s_nationkey as line from supplier",
}
