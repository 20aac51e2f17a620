"""Scans of one long stream, and one large file, that are spread over tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, containers, scan
from ..operators.lineage import shared_folder
from ..sources import hls, indexed, transport

#: Blocks of a stream, and seconds of segments.
BLOCKS, HOUR, SEGMENT = 16, 3600.0, 6.0


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as one stream."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "0 as stream", "l_orderkey as k", "l_linenumber as i", "l_partkey as p", "cast(l_quantity as bigint) as q", "cast(round(l_extendedprice * 100) as bigint) as cents", "if(l_returnflag = 'R', l_orderkey, null) as returned"
    )


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"total": ("sum", "q"), "returns": ("count", "returned"), "dearest": ("max", "cents"), "cheapest": ("min", "cents"), "last_return": ("last", "returned")}
    return scan.carry_scan(_lines(spark, sf_dir), ["stream"], ["k", "i", "p", "cents"], values, BLOCKS).select("k", "i", "p", "cents", *values)


def _backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity still to come and the next return, seen from each line."""
    values = {"rest": ("sum", "q"), "next_return": ("last", "returned")}
    return scan.carry_scan(_lines(spark, sf_dir), ["stream"], ["k", "i", "p", "cents"], values, BLOCKS, reverse=True, exclusive=True).select("k", "i", "p", "cents", *values)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("0L as file", "event_id", "unix_micros(cast(ts as timestamp)) as us", "value", "event_type = 'purchase' as keyframe", "length(props) as size")


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running average (3/4 old, 1/4 new) of the value of all events as one clip."""
    out = scan.affine_scan(_events(spark, sf_dir), ["file"], ["us", "event_id"], F.lit(0.75), F.col("value") * 0.25, "after", "before", 0.0, BLOCKS)
    return out.select("event_id", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"))


def _one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one reference stream; time in microseconds."""
    return _events(spark, sf_dir).selectExpr("file", "event_id as ordinal", "us as pts", "1L as tb_num", "1000000L as tb_den", "keyframe")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.hls_segments_spread(_one_stream(spark, sf_dir), HOUR, blocks=BLOCKS).select("ordinal", "segment", F.col("start_pts"))


def _start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _events(spark, sf_dir).selectExpr("file", "0 as idx", "event_id as ordinal", "1152 + size % 3 as duration")
    return containers.running_pts(p, blocks=BLOCKS).select("ordinal", "pts")


def _attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each event over the running average, all events as one clip."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("0 as clip", "event_id as b", "value * value as e")
    return audio.attack_ratio(e, BLOCKS).select("b", F.round("ratio", 4).alias("ratio"))


QUERIES = {
    "scan_running": _running,
    "scan_backwards": _backwards,
    "scan_affine": _smoothed,
    "sig_attack_one_stream": _attacks,
    "hls_segments_one_stream": _segments,
    "win_running_one_stream": _start_times,
}

_LN = "ln as (select l_orderkey as k, l_linenumber as i, l_partkey as p, cast(l_quantity as bigint) as q, cast(round(l_extendedprice * 100) as bigint) as cents, case when l_returnflag = 'R' then l_orderkey end as returned from lineitem)"

SQL = {
    "scan_running": f"with {_LN} select k, i, p, cents, cast(sum(q) over w as bigint) as total, count(returned) over w as returns, max(cents) over w as dearest, min(cents) over w as cheapest, last_value(returned ignore nulls) over w as last_return from ln window w as (order by k, i, p, cents rows unbounded preceding)",
    "scan_backwards": f"with {_LN} select k, i, p, cents, cast(sum(q) over w as bigint) as rest, last_value(returned ignore nulls) over w as next_return from ln window w as (order by k desc, i desc, p desc, cents desc rows between unbounded preceding and 1 preceding)",
    # weights under 3e-26 do not reach the fifth digit
    "scan_affine": """with e as (select event_id, value, row_number() over (order by epoch_us(ts), event_id) as n from events),
s as (select a.event_id, sum(0.25 * power(0.75::double, a.n - b.n) * b.value) as y, a.n from e a join range(204) r(d) on true join e b on b.n = a.n - d group by 1, 3)
select event_id, round(coalesce(lag(y) over (order by n), 0), 5) as before, round(y, 5) as after from s""",
    "sig_attack_one_stream": """with e as (select event_id as b, value * value as e, row_number() over (order by event_id) as n from events),
s as (select a.b, a.e, a.n, coalesce(sum(0.25 * power(0.75::double, a.n - 1 - b.n) * b.e), 0) as y from e a left join e b on b.n between a.n - 204 and a.n - 1 group by all)
select b, round(e / greatest(y, (select avg(e) * 1e-3 from e)), 4) as ratio from s""",
    "hls_segments_one_stream": f"""with recursive e as (select event_id as ordinal, epoch_us(ts) as pts, event_type = 'purchase' as k from events),
seg(segment, ordinal, pts) as (select 0::bigint, ordinal, pts from (select * from e order by ordinal limit 1)
 union all select s.segment + 1, (select min(ordinal) from e where k and e.ordinal > s.ordinal and (e.pts - s.pts)::double / 1000000 >= {HOUR}),
  (select arg_min(e.pts, e.ordinal) from e where k and e.ordinal > s.ordinal and (e.pts - s.pts)::double / 1000000 >= {HOUR}) from seg s where s.ordinal is not null)
select e.ordinal, s.segment, s.pts as start_pts from e asof join (select * from seg where ordinal is not null) s on e.ordinal >= s.ordinal""",
    "win_running_one_stream": "select event_id as ordinal, cast(coalesce(sum(1152 + length(props) % 3) over (order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as pts from events",
}


def _one_file(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events as the packets of one file with a video and an audio stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id % 2 as int) as idx", "event_id", "event_type = 'purchase' or user_id % 2 = 1 as keyframe", "encode(props, 'utf-8') as data", "'all' as file", "1 as one")
    p = scan.carry_scan(e, ["idx"], ["event_id"], {"ordinal": ("count", "one")}, BLOCKS, exclusive=True)
    p = p.selectExpr("file", "idx", "ordinal", "ordinal * 40 + if(idx = 0, 40 * (ordinal % 3), 0) as pts", "ordinal * 40 as dts", "40L as duration", "1 as tb_num", "1000 as tb_den", "keyframe", "data")
    s = spark.sql("select 'all' as file, * from values (0, 'video', 'h264'), (1, 'audio', 'aac') as t(idx, media_type, codec)")
    return p, s


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"


def _ts_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transport stream of all events, written by many tasks and read in 16 ranges."""
    p, s = _one_file(spark, sf_dir)
    folder = _folder(spark)
    size = transport.write_transport(p, s, folder, BLOCKS).agg(F.sum("bytes")).first()[0] or 1
    out = transport.read_packets(spark, folder, -(-size // 16), BLOCKS)
    return out.select("idx", "ordinal", "pts", "dts", "keyframe", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("md5"))


def _mp4_ranges(only: str):
    """One MP4 file of all events, written by many tasks; of the samples that ``only``
    leaves, and of no others, the bytes are read."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, s = _one_file(spark, sf_dir)
        s = s.selectExpr("*", "1000L as timescale", "64 as width", "48 as height", "44100 as sample_rate", "2 as channels", "cast(null as binary) as config")
        folder = _folder(spark)
        indexed.write_mp4(p, s, folder, BLOCKS)
        out = indexed.fetch(indexed.mp4_table(spark, folder)[1].where(only))
        return out.select(F.col("track").alias("idx"), "ordinal", "pts", "dts", "keyframe", "size", F.md5("data").alias("md5"))

    return query


def _hls_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as segments of six seconds behind a playlist, read back file by file."""
    p, s = _one_file(spark, sf_dir)
    folder = _folder(spark)
    hls.write_hls(p, s, folder, SEGMENT)
    out = transport.read_packets(spark, folder)
    out = out.withColumn("segment", F.regexp_extract("file", r"all-(\d+)-\w+-\w+\.ts$", 1).cast("bigint"))
    return out.select("segment", "idx", "ordinal", "pts", "keyframe", F.md5("data").alias("md5"))


QUERIES |= {"sink_hls_files": _hls_files, "src_ts_ranges": _ts_ranges, "src_mp4_ranges": _mp4_ranges("true"), "src_mp4_keys": _mp4_ranges("track = 0 and keyframe")}

_ONE_FILE = "p as (select (user_id % 2)::int as idx, row_number() over (partition by user_id % 2 order by event_id) - 1 as ordinal, event_type = 'purchase' or user_id % 2 = 1 as keyframe, props from events)"

SQL["src_ts_ranges"] = f"with {_ONE_FILE} select idx, ordinal, (ordinal * 3600 + case when idx = 0 then 3600 * (ordinal % 3) else 0 end) % 8589934592 as pts, ordinal * 3600 % 8589934592 as dts, keyframe, octet_length(encode(props)) as size, md5(props) as md5 from p"

_MP4 = f"with {_ONE_FILE} select idx, ordinal, ordinal * 40 + case when idx = 0 then 40 * (ordinal % 3) else 0 end as pts, ordinal * 40 as dts, keyframe, octet_length(encode(props)) as size, md5(props) as md5 from p"
SQL |= {"src_mp4_ranges": _MP4, "src_mp4_keys": f"{_MP4} where idx = 0 and keyframe"}

SQL["sink_hls_files"] = f"""with recursive {_ONE_FILE}, v as (select ordinal, ordinal * 40 + 40 * (ordinal % 3) as pts, keyframe from p where idx = 0),
seg(segment, ordinal, pts) as (select 0::bigint, ordinal, pts from v where ordinal = 0
 union all select s.segment + 1, (select min(ordinal) from v where keyframe and v.ordinal > s.ordinal and (v.pts - s.pts)::double / 1000 >= {SEGMENT}),
  (select arg_min(v.pts, v.ordinal) from v where keyframe and v.ordinal > s.ordinal and (v.pts - s.pts)::double / 1000 >= {SEGMENT}) from seg s where s.ordinal is not null)
select s.segment, p.idx, row_number() over (partition by s.segment, p.idx order by p.ordinal) - 1 as ordinal, (p.ordinal * 3600 + case when p.idx = 0 then 3600 * (p.ordinal % 3) else 0 end) % 8589934592 as pts, p.keyframe, md5(p.props) as md5
from p asof join (select * from seg where ordinal is not null) s on p.ordinal >= s.ordinal"""
