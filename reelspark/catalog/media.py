"""Queries that write real containers and read them back, packed frames and
event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lossless, packed
from ..sources import files, mux
from ..streaming import stateful
from . import containers, frames as fx, probe as px

_S = files.STREAMS.replace(", error string", "")


def _streams(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in _S.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _S)


def _packets(spark, sf_dir, video: str = "h264") -> tuple[DataFrame, DataFrame]:
    """All events: two users are a file's video and audio stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('f', user_id div 2) as file", "cast(user_id % 2 as int) as idx", "event_id", "ts", "props", "event_type = 'purchase' as keyframe", "user_id")
    p = e.selectExpr("file", "idx", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as ordinal", "keyframe or idx = 1 as keyframe", "encode(props, 'utf-8') as data")
    p = p.selectExpr("file", "idx", "ordinal", "ordinal * 40 as pts", "ordinal * 40 as dts", "40L as duration", "1 as tb_num", "1000 as tb_den", "keyframe", "data")
    s = e.select("file", "idx").distinct().selectExpr(
        "file", "'' as format", "idx", "if(idx = 0, 'video', 'audio') as media_type", f"if(idx = 0, '{video}', 'aac') as codec", "1 as tb_num", "1000 as tb_den", "if(idx = 0, 64, null) as width", "if(idx = 0, 48, null) as height",
        "cast(null as string) as pixfmt", "cast(null as string) as color_range", "if(idx = 0, null, 44100) as sample_rate", "if(idx = 0, null, 2) as channels", "cast(null as string) as sample_fmt", "cast(null as binary) as extradata",
    )
    return p, s


_EV = "ev as (select 'f' || (user_id // 2) as file, (user_id % 2)::int as idx, row_number() over (partition by user_id order by ts, event_id) - 1 as ordinal, props, event_type = 'purchase' or user_id % 2 = 1 as keyframe from events)"


def _round_trip(fmt: str, only: str = "true", video: str = "h264", scale: int = 1):
    def query(spark, sf_dir):
        p, s = _packets(spark, sf_dir, video)
        out = mux.write_files(p.where(only), s.where(only), fmt).withColumn("format", F.lit(fmt))
        return files.parse_packets(out).select("file", "idx", "ordinal", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("md5"))

    return query


def _timed_trip(fmt: str, rate: int):
    """As :func:`_round_trip`, with video shown up to two frames after it is
    decoded; compares times, in ``1 / rate`` seconds, and key frames."""

    def query(spark, sf_dir):
        p, s = _packets(spark, sf_dir)
        p = p.withColumn("pts", F.expr("pts + if(idx = 0, 40 * (ordinal % 3), 0)"))
        out = mux.write_files(p, s, fmt).withColumn("format", F.lit(fmt))
        t = lambda c: (F.col(c) * F.col("tb_num") * rate / F.col("tb_den")).cast("bigint").alias(c)
        return files.parse_packets(out).select("file", "idx", "ordinal", t("pts"), t("dts"), "keyframe", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("md5"))

    return query


def _timed_sql(rate: int) -> str:
    k = rate // 25
    return f"with {_EV} select file, idx, ordinal, ordinal * {k} + case when idx = 0 then {k} * (ordinal % 3) else 0 end as pts, ordinal * {k} as dts, keyframe, octet_length(encode(props)) as size, md5(props) as md5 from ev"


def _trip_sql(only: str = "true") -> str:
    return f"with {_EV} select file, idx, ordinal, octet_length(encode(props)) as size, md5(props) as md5 from ev where {only}"


def _wav(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('w', event_id div 500) as file", "event_id as id", "cast(floor(value * 130) as bigint) % 65536 as u")
    data = F.unhex(F.concat(F.lpad(F.hex(F.col("u") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("u") / 256).cast("bigint")), 2, "0")))
    p = s.select("file", F.lit(0).alias("idx"), F.col("id").alias("ordinal"), F.lit(0).cast("bigint").alias("pts"), F.lit(0).cast("bigint").alias("dts"), F.lit(1).cast("bigint").alias("duration"), F.lit(1).alias("tb_num"), F.lit(8000).alias("tb_den"), F.lit(True).alias("keyframe"), data.alias("data"))
    one = _streams(spark, [{"idx": 0, "media_type": "audio", "codec": "pcm", "sample_fmt": "s16", "tb_num": 1, "tb_den": 8000, "sample_rate": 8000, "channels": 1}])
    st = s.select("file", F.lit(0).alias("idx")).distinct().join(F.broadcast(one.drop("file")), "idx").select(one.columns)
    out = mux.write_files(p, st, "wav").withColumn("format", F.lit("wav"))
    r = files.parse_packets(out).select("file", F.posexplode(F.expr("sequence(1, cast(octet_length(data) div 2 as int))")).alias("n", "at"), "data")
    from ..functions.binary import byte_at

    u = byte_at(F.col("data"), F.col("n") * 2) + 256 * byte_at(F.col("data"), F.col("n") * 2 + 1)
    return r.select("file", F.col("n").cast("bigint").alias("n"), F.when(u >= 32768, u - 65536).otherwise(u).alias("v"))


def _y4m(spark, sf_dir):
    f = packed.pack(fx.planes(spark, sf_dir), fx.G420)
    p = f.select(F.col("clip").alias("file"), F.lit(0).alias("idx"), F.col("frame_no").alias("ordinal"), F.col("frame_no").alias("pts"), F.col("frame_no").alias("dts"), F.lit(1).cast("bigint").alias("duration"), F.lit(1).alias("tb_num"), F.lit(25).alias("tb_den"), F.lit(True).alias("keyframe"), F.expr("concat(planes[0], planes[1], planes[2])").alias("data"))
    st = _streams(spark, [{"file": c, "idx": 0, "media_type": "video", "codec": "rawvideo", "tb_num": 1, "tb_den": 25, "width": fx.W, "height": fx.H, "pixfmt": "yuv420p"} for c in "AB"])
    out = mux.write_files(p, st, "yuv4mpegpipe").withColumn("format", F.lit("yuv4mpegpipe"))
    r = files.parse_packets(out)
    return r.select(F.col("file").alias("clip"), F.col("pts").alias("frame_no"), F.md5("data").alias("md5"))


def _joined(rows: DataFrame, piece: str, fmt: str, head: str = "''") -> DataFrame:
    """``rows(file, idx, ordinal)`` as files of hexadecimal pieces in that order."""
    parts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "idx", F.expr(piece).alias("x")))).alias("p"))
    return parts.select("file", F.lit(fmt).alias("format"), F.unhex(F.concat(F.expr(head), F.array_join(F.transform("p", lambda e: e["x"]), ""))).alias("content"))


def _one_stream(spark, sf_dir):
    return _packets(spark, sf_dir)[0].withColumn("file", F.expr("concat(file, '-', idx)"))


def _parsed(df: DataFrame) -> DataFrame:
    return files.parse_packets(df).select("file", "idx", "ordinal", "pts", "keyframe", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("md5"))


def _adts(spark, sf_dir):
    """AAC frames with headers of 7 bytes, behind two stray bytes."""
    size = "cast(octet_length(data) + 7 as bigint)"
    byte = lambda e: f"lpad(hex({e}), 2, '0')"
    frame = f"concat('FFF150', {byte(f'128 + shiftright({size}, 11)')}, {byte(f'shiftright({size}, 3) & 255')}, {byte(f'({size} & 7) * 32 + 31')}, 'FC', hex(data))"
    return _parsed(_joined(_one_stream(spark, sf_dir), frame, "aac", "'0000'"))


def _mp3_file(spark, sf_dir):
    """Frames of 417 bytes (128 kb/s, 44.1 kHz) behind a tag and an Info frame."""
    return _parsed(_joined(_one_stream(spark, sf_dir), "rpad(concat('FFFB9000', hex(md5(data))), 834, '0')", "mp3", "concat('4944330400000000000A', repeat('00', 10), rpad(concat('FFFB9000', repeat('00', 32), hex('Info')), 834, '0'))"))


def _element(name: str, body: str) -> str:
    return f"concat('{name}01', lpad(hex(cast(length({body}) div 2 as bigint)), 14, '0'), {body})"


def _mkv(spark, sf_dir):
    """Two tracks in a segment of unknown size; video in block groups with and
    without references, audio in simple blocks."""
    track = lambda n, kind, codec, more: _element("AE", f"concat('D781{n:02X}8381{kind:02X}', {_element('86', f'hex({codec!r})')}, {more})")
    video, audio = track(1, 1, "V_VP9", _element("E0", "'B0820040BA820030'")), track(2, 2, "A_OPUS", _element("E1", "'B584473B80009F8102'"))
    head = f"concat('1A45DFA380', '1853806701FFFFFFFFFFFFFF', {_element('1549A966', repr('2AD7B1830F4240'))}, {_element('1654AE6B', f'concat({video}, {audio})')})"
    block = "concat(hex(129 + idx), '0005', if(idx = 1, '80', '00'), hex(data))"
    group = _element("A0", f"concat({_element('A1', block)}, if(keyframe, '', 'FB81FF'))")
    cluster = _element("1F43B675", f"concat('E784', lpad(hex(pts), 8, '0'), if(idx = 0, {group}, {_element('A3', block)}))")
    return _parsed(_joined(_packets(spark, sf_dir)[0], cluster, "matroska", head))


def _ogg(spark, sf_dir):
    p, s = _packets(spark, sf_dir)
    out = mux.write_files(p.where("idx = 1").withColumn("idx", F.lit(0)), s.where("idx = 1").withColumn("idx", F.lit(0)).withColumn("codec", F.lit("opus")), "ogg")
    return files.parse_packets(out.withColumn("format", F.lit("ogg"))).select("file", "ordinal", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("md5"))


def _png_files(spark, sf_dir):
    f = packed.pack(fx.planes(spark, sf_dir), fx.G420).selectExpr("concat(clip, frame_no) as id", "width", "height", "1 as channels", "planes[0] as pixels")
    return lossless.encode_png(f)


IMAGES = [("png", "89504E470D0A1A0A0000000D4948445200000140000000F00802000000"), ("gif", "4749463839614001F000800000"), ("jpeg", "FFD8FFE000104A46494600010100000100010000FFC0001108007801400301220002110103110100"), ("webp", "524946461A000000574542505650384C0D0000002F3FC13B000000000000000000"), ("flac", "664C6143000000221000100000000000000" + "00AC442F000000000" + "0" * 32)]


def _image_files(spark, sf_dir):
    """An image of one of the formats for each part."""
    return px.each_part(spark, sf_dir, [(f, h + "0" * (len(h) % 2)) for f, h in IMAGES], "format string, h string").select(
        F.concat_ws("-", "format", "p_partkey").alias("file"), "format", F.unhex("h").alias("content")
    )


def _images(spark, sf_dir):
    return files.parse_streams(_image_files(spark, sf_dir)).select("file", "codec", "width", "height", "sample_rate", "channels")


def _src_open(spark, sf_dir):
    d = _image_files(spark, sf_dir).drop("format")
    from ..operators.probe import probe

    return probe(d, ["file"], "content").select("file", "format")


def _packed(spark, sf_dir):
    return packed.explode(packed.filter_frames(packed.pack(fx.planes(spark, sf_dir), fx.G420), "crop=16:12:4:2,hflip,negate,pad=24:16:4:2,transpose=1"))


def _packed_scale(spark, sf_dir):
    return packed.explode(packed.filter_frames(packed.pack(fx.planes(spark, sf_dir), fx.G420), "scale=20:-1"))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "src_ivf": _round_trip("ivf", "idx = 0", "vp9"),
    "src_flv": _round_trip("flv"),
    "sink_flv": _timed_trip("flv", 1000),
    "src_avi": _round_trip("avi"),
    "sink_avi": _round_trip("avi"),
    "src_mp4_file": _round_trip("mp4"),
    "src_ts_file": _round_trip("mpegts"),
    "sink_ts": _timed_trip("mpegts", 90000),
    "src_wav": _wav,
    "sink_wav": _wav,
    "src_y4m": _y4m,
    "sink_y4m": lambda s, d: _y4m(s, d).select("clip", "md5"),
    "src_adts": _adts,
    "src_mp3_file": _mp3_file,
    "src_mkv": _mkv,
    "sink_ogg": _ogg,
    "codec_png": lambda s, d: lossless.decode_png(_png_files(s, d)).select("id", "width", "height", F.md5("pixels").alias("md5")),
    "sink_png": lambda s, d: files.parse_streams(_png_files(s, d).select(F.col("id").alias("file"), F.lit("png").alias("format"), F.col("image").alias("content"))).select("file", "codec", "width", "height"),
    "src_images": _images,
    "src_open": _src_open,
    "vf_chain_packed": _packed,
    "vf_scale_packed": _packed_scale,
    "win_tumbling": lambda s, d: stateful.tumbling(_events(s, d), "1 day", "1 hour").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value")),
    "win_session": lambda s, d: stateful.sessions(_events(s, d), "12 hours", "1 hour").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
}

_ONE = f"with {_EV} select file || '-' || idx as file, 0 as idx, ordinal"

SQL = {
    "src_adts": f"{_ONE}, ordinal * 1024 as pts, true as keyframe, octet_length(encode(props)) as size, md5(props) as md5 from ev",
    "src_mp3_file": f"{_ONE}, ordinal * 1152 as pts, true as keyframe, 417::bigint as size, md5(unhex('FFFB9000') || encode(md5(props)) || unhex(repeat('00', 381))) as md5 from ev",
    "src_mkv": f"with {_EV} select file, idx, ordinal, ordinal * 40 + 5 as pts, keyframe, octet_length(encode(props)) as size, md5(props) as md5 from ev",
    "sink_ogg": f"with {_EV} select file, ordinal, octet_length(encode(props)) as size, md5(props) as md5 from ev where idx = 1",
    "codec_png": f"with {fx._pix_sql()} select clip || frame_no as id, {fx.W} as width, {fx.H} as height, md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' order by y, x))) as md5 from pix where plane = 0 group by 1",
    "sink_png": f"with {fx._pix_sql()} select c || f as file, 'png' as codec, {fx.W} as width, {fx.H} as height from (select distinct clip as c, frame_no as f from pix)",
    "src_ivf": _trip_sql("idx = 0"), "src_flv": _trip_sql(), "sink_flv": _timed_sql(1000), "src_avi": _trip_sql(), "sink_avi": _trip_sql(),
    "src_mp4_file": _trip_sql(), "src_ts_file": _trip_sql(), "sink_ts": _timed_sql(90000),
    "src_wav": "select 'w' || (event_id // 500) as file, event_id % 500 as n, case when u >= 32768 then u - 65536 else u end as v from (select event_id, cast(floor(value * 130) as bigint) % 65536 as u from events)",
    "sink_wav": "select 'w' || (event_id // 500) as file, event_id % 500 as n, case when u >= 32768 then u - 65536 else u end as v from (select event_id, cast(floor(value * 130) as bigint) % 65536 as u from events)",
    "src_y4m": f"with {fx._pix_sql()} select clip, frame_no, md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' order by plane, y, x))) as md5 from pix group by 1, 2",
    "sink_y4m": f"with {fx._pix_sql()} select clip, md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' order by plane, y, x))) as md5 from pix group by clip, frame_no",
    "src_images": f"select * exclude (p_partkey) replace (file || '-' || p_partkey as file) from ({px.each_part_sql("select file, codec, w::int as width, h::int as height, r::int as sample_rate, c::int as channels from (values ('png', 'png', 320, 240, null, null), ('gif', 'gif', 320, 240, null, null), ('jpeg', 'mjpeg', 320, 120, null, null), ('webp', 'webp', 320, 240, null, null), ('flac', 'flac', null, null, 44100, 2)) t(file, codec, w, h, r, c)", len(IMAGES))})",
    "src_open": f"select * exclude (p_partkey) replace (file || '-' || p_partkey as file) from ({px.each_part_sql("select * from (values ('png', 'png'), ('gif', 'gif'), ('jpeg', 'jpeg'), ('webp', 'webp'), ('flac', 'flac')) t(file, format)", len(IMAGES))})",
    "vf_chain_packed": fx.SQL["vf_chain"], "vf_scale_packed": fx.SQL["vf_scale"],
    "win_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "win_session": "with a as (select user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts) as p from events), b as (select user_id, sum(case when p is null or t - p >= 43200000000 then 1 else 0 end) over (partition by user_id order by t) as s from a), c as (select user_id, s, count(*) as n from b group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from c group by 1",
}
