"""Packet, sample table and reassembly queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containers as ops

TARGET = 86_400.0
#: Users of ``events`` whose files are made in one task.
FILES = 1_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: a user is a stream, time in microseconds since the
    user's first event, purchases are keyframes."""
    e = _read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) as us", "event_type", "cast(length(props) as bigint) as size")
    return e.selectExpr(
        "user_id % 10 as file", "user_id as idx", "cast(row_number() over (partition by user_id order by us, event_id) - 1 as bigint) as ordinal",
        "us - min(us) over (partition by user_id) as pts", "size", "event_type = 'purchase' as keyframe", "1L as tb_num", "1000000L as tb_den", "event_id",
    )


_PK = """pk as (select user_id % 10 as file, user_id as idx, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as ordinal,
 epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as pts, length(props) as size, event_type = 'purchase' as keyframe, event_id from events)"""


def _values(spark, sql):
    return spark.sql(sql)


def _users(spark, sf_dir):
    """A file for each user of ``events``, up to about ``FILES`` in a partition: the
    tables made of them are hundreds of times as long, and by the size of the bare
    numbers Spark would put them all in one task."""
    f = _read(spark, sf_dir, "events").selectExpr("user_id as file").distinct()
    return f.repartition(f.count() // FILES + 1, "file")


def _tables(spark, sf_dir):
    """Sample tables of each user's file: runs of samples in eight chunks."""
    f = _users(spark, sf_dir)
    stsc = f.select("file", F.explode(F.expr("array(named_struct('first_chunk', 1L, 'spc', 3L), named_struct('first_chunk', 3L, 'spc', 2L), named_struct('first_chunk', 6L, 'spc', 4L + file % 3))")).alias("e")).select("file", "e.*")
    chunks = f.select("file", F.explode(F.expr("sequence(1L, 8L)")).alias("chunk")).selectExpr("file", "chunk", "1000 * chunk + file as offset")
    sizes = f.select("file", F.explode(F.expr("sequence(1L, 20L + file % 3)")).alias("sample")).selectExpr("file", "sample", "100 + (sample * 37) % 50 as size")
    stts = f.select("file", F.explode(F.expr("array(named_struct('entry', 1L, 'count', 5L, 'delta', 512L), named_struct('entry', 2L, 'count', 4L, 'delta', 1024L), named_struct('entry', 3L, 'count', 100L, 'delta', 500L + file % 3))")).alias("e")).select("file", "e.*")
    stss = f.where("file % 3 < 2").select("file", F.explode(F.expr("array(1L, 4L, 9L, 14L)")).alias("sample"))
    return stsc, chunks, sizes, stts, stss


_TB = """f as (select distinct user_id as file from events),
stsc as (select file, first_chunk, spc from f, (values (1, 3), (3, 2), (6, 4)) v(first_chunk, s0), lateral (select case when first_chunk = 6 then 4 + file % 3 else s0 end as spc)),
chunks as (select file, chunk, 1000 * chunk + file as offs from f, range(1, 9) c(chunk)),
sizes as (select file, sample, 100 + (sample * 37) % 50 as size from f, range(1, 23) s(sample) where sample <= 20 + file % 3),
stts as (select file, entry, cnt, case when entry = 3 then 500 + file % 3 else d0 end as delta from f, (values (1, 5, 512), (2, 4, 1024), (3, 100, 500)) v(entry, cnt, d0)),
stss as (select file, sample from f, (values (1), (4), (9), (14)) v(sample) where file % 3 < 2),
runs as (select c.file, c.chunk, (select spc from stsc s where s.file = c.file and s.first_chunk <= c.chunk order by first_chunk desc limit 1) as spc from chunks c)"""


def _days(spark, sf_dir):
    """Packets with the day of their stream."""
    return packets(spark, sf_dir).selectExpr("idx", "pts div 86400000000 as day", "keyframe")


def _durations(spark, sf_dir):
    return ops.sample_durations(packets(spark, sf_dir).withColumn("pts", F.expr("if(idx % 11 = 5 and ordinal = 1, null, pts)")), F.lit(33333).cast("bigint"))


_DU = f"""{_PK}, p0 as (select * replace (case when idx % 11 = 5 and ordinal = 1 then null else pts end as pts) from pk),
p1 as (select *, lead(pts) over (partition by idx order by ordinal) - pts as step from p0),
p2 as (select *, count(*) over s as n, count(pts) over s as np, min(step) over s as ms, max(pts) over s as a, min(pts) over s as z,
 last_value(case when step > 0 then step end ignore nulls) over (partition by idx order by ordinal rows between unbounded preceding and current row) as tail from p1 window s as (partition by idx)),
du as (select file, idx, ordinal, size, case when n >= 2 and np = n and coalesce(ms >= 0, false) and a > z then coalesce(step, tail) else 33333 end as duration from p2)"""


def _interleaved(spark, sf_dir):
    d = _durations(spark, sf_dir).withColumn("timescale", F.expr("if(idx % 2 = 0, 1000000L, 1000000L)"))
    return ops.interleave(d.select("file", "idx", "ordinal", "duration", "timescale", "size"), 36)


_IL = f"""{_DU}, i0 as (select *, coalesce(sum(duration) over (partition by file, idx order by ordinal rows between unbounded preceding and 1 preceding), 0)::double / 1000000 as start_s from du),
i1 as (select *, row_number() over w as position, cast(36 + sum(size) over (partition by file order by start_s, idx, ordinal rows unbounded preceding) - size as bigint) as offs, coalesce((lag(idx) over w <> idx)::bigint, 1) as opens from i0 window w as (partition by file order by start_s, idx, ordinal)),
il as (select file, idx, ordinal, position, offs, cast(sum(opens) over (partition by file, idx order by position rows unbounded preceding) as bigint) as chunk from i1)"""


def _segments(spark, sf_dir):
    """Lacing values of each user's file: pages of up to 12 segments."""
    return _users(spark, sf_dir).select("file", F.explode(F.expr("sequence(0L, 39L)")).alias("page")).select("file", "page", F.explode(F.expr("sequence(0L, page % 12)")).alias("seg")).selectExpr(
        "file", "page", "seg", "if((page * 5 + seg * 3 + file) % 4 = 0, 255L, (page * 37 + seg * 91) % 256) as lace"
    )


_SG = """sg as (select file, page, seg, case when (page * 5 + seg * 3 + file) % 4 = 0 then 255 else (page * 37 + seg * 91) % 256 end as lace
 from (select distinct user_id as file from events) f, range(40) p(page), range(12) s(seg) where seg <= page % 12)"""


def _ts(spark, sf_dir):
    """Events as transport packets of eight PIDs; clicks start a unit."""
    return _read(spark, sf_dir, "events").selectExpr(
        "user_id % 3 as file", "event_id as ord", "user_id % 8 as pid", "event_type = 'click' as pusi", "event_id % 5 = 0 as rai", "if(event_id % 3 = 0, 40L, 0L) as expect", "cast(length(props) as bigint) as len"
    )


_TS = """ts as (select user_id % 3 as file, event_id as ord, user_id % 8 as pid, event_type = 'click' as pusi, event_id % 5 = 0 as rai, case when event_id % 3 = 0 then 40 else 0 end as expect, length(props) as len from events)"""

_SEGS = f"""recursive {_PK}, ref as (select file, idx, ordinal, pts, keyframe, row_number() over (partition by idx order by ordinal) as rn from pk),
seg(file, idx, rn, ordinal, pts, segment, start_pts) as (
 select file, idx, rn, ordinal, pts, 0::bigint, pts from ref where rn = 1
 union all
 select r.file, r.idx, r.rn, r.ordinal, r.pts, case when (r.pts - s.start_pts) / 1e6 >= {TARGET} and r.keyframe then s.segment + 1 else s.segment end,
  case when (r.pts - s.start_pts) / 1e6 >= {TARGET} and r.keyframe then r.pts else s.start_pts end
 from seg s join ref r on r.idx = s.idx and r.rn = s.rn + 1),
g as (select idx as file, segment, min(start_pts) as start_pts, max(pts) as last_pts, count(*) as packets from seg group by 1, 2),
hd as (select file, segment, start_pts, packets, coalesce(lead(start_pts) over (partition by file order by segment), last_pts) as e from g),
hdur as (select file, segment, start_pts, packets, case when e > start_pts then (e - start_pts)::double / 1000000 else {TARGET} end as duration from hd)"""


def _hls(spark, sf_dir):
    return ops.hls_segments(packets(spark, sf_dir).withColumn("file", F.col("idx")), TARGET)


def _blocks(spark, sf_dir):
    s = _read(spark, sf_dir, "events").selectExpr("event_id as n", "cast(floor(value * 60) as bigint) as v")
    return ops.frame_blocks(s, 1024, 512, s.selectExpr("max(n) + 1").scalar()).groupBy("block").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("n").alias("first"))


def _warm(spark, sf_dir):
    s = _read(spark, sf_dir, "events").selectExpr("event_id as n")
    return ops.warmup_chunks(s, 50, 8, s.selectExpr("max(n) + 1").scalar()).groupBy("chunk").agg(F.count("*").alias("frames"), F.count_if("warmup").alias("warmups"), F.min("n").alias("first"))


def _mkv(spark, sf_dir):
    blocks = _read(spark, sf_dir, "events").selectExpr("user_id % 4 as file", "event_id", "user_id % 6 as track_number", "event_id % 100 * 1000 as cluster", "event_id % 61 - 30 as rel")
    tracks = spark.sql("select * from values (0L, 1L, 0L), (0L, 2L, 1L), (0L, 2L, 2L), (1L, 3L, 0L), (2L, 0L, 0L), (2L, 5L, 1L), (3L, 4L, 0L) as t(file, track_number, idx)")
    return ops.join_track(blocks, tracks).selectExpr("file", "event_id", "idx", "cluster + rel as pts")


def _av(spark, sf_dir):
    p = packets(spark, sf_dir).select("idx", "ordinal", "pts", "size")
    sel = spark.sql("select * from values (0L, 2L, 0L), (0L, 4L, 1L), (1L, 3L, 2L), (0L, 2L, 3L), (1L, 99999L, 4L) as t(input, idx, out_idx)")
    return ops.map_streams([p.where("idx % 2 = 0"), p.where("idx % 2 = 1")], sel)


def _streams(spark, sf_dir):
    s = _read(spark, sf_dir, "events").selectExpr("user_id % 10 as file", "user_id as idx").distinct().where("idx % 5 <> 2")
    return ops.join_streams(packets(spark, sf_dir), s.withColumn("codec", F.expr("if(idx % 2 = 0, 'vp9', 'opus')"))).select("file", "idx", "ordinal", "codec")


def _mp4_pts(spark, sf_dir):
    return ops.running_pts(packets(spark, sf_dir).withColumn("duration", F.expr("1152 + size % 3"))).select("file", "idx", "ordinal", "pts")


def _dedup(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), "event_type")
    return ops.dedup_consecutive(e, ["user_id"], ["us", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def _sorted(spark, sf_dir):
    s = ops.mp4_samples(*_tables(spark, sf_dir))
    return s.select("file", "sample", "offset", F.expr("cast(row_number() over (partition by file order by offset) as bigint)").alias("place"))


QUERIES = {
    "join_streams": _streams,
    "join_pid": lambda s, d: _ts(s, d).join(s.sql("select * from values (0L, 0L), (1L, 1L), (4L, 2L), (7L, 3L) as t(pid, stream)"), "pid").select("file", "ord", "stream", "len"),
    "join_mkv_track": _mkv,
    "mp4_stsc": lambda s, d: ops.chunk_runs(*_tables(s, d)[:2]),
    "mp4_samples": lambda s, d: ops.mp4_samples(*_tables(s, d)),
    "src_mp4": lambda s, d: ops.mp4_samples(*_tables(s, d)[:4], None).select("file", "sample", "offset", "size", "pts", "keyframe"),
    "mp4_durations": lambda s, d: _durations(s, d).select("file", "idx", "ordinal", "duration"),
    "mp4_interleave": lambda s, d: _interleaved(s, d).select("file", "idx", "ordinal", "position", F.col("offset").alias("offs"), "chunk"),
    "sink_mp4": lambda s, d: ops.chunk_table(_interleaved(s, d)).withColumnRenamed("offset", "offs"),
    "sort_time": lambda s, d: _interleaved(s, d).select("file", "position", "idx", "ordinal"),
    "sort_offset": _sorted,
    "av_mux": _av,
    "src_ogg": lambda s, d: ops.lace_packets(_segments(s, d)),
    "src_ts": lambda s, d: _ts(s, d).groupBy("file", "pid").agg(F.count("*").alias("packets"), F.count_if("pusi").alias("units"), F.sum("len").alias("bytes")),
    "st_pes": lambda s, d: ops.pes_packets(_ts(s, d)),
    "hls_segments": lambda s, d: _hls(s, d).select("file", "ordinal", "segment", "start_pts"),
    "hls_duration": lambda s, d: ops.hls_durations(_hls(s, d), TARGET).withColumn("duration", F.round("duration", 6)),
    "hls_playlist": lambda s, d: ops.hls_playlist(ops.hls_durations(_hls(s, d), TARGET), TARGET),
    "win_running": _mp4_pts,
    "win_lag": lambda s, d: packets(s, d).selectExpr("idx", "ordinal", "pts - lag(pts) over (partition by idx order by ordinal) as delta"),
    "win_frame_blocks": _blocks,
    "win_warmup": _warm,
    "win_lookahead": lambda s, d: ops.lookahead(packets(s, d), 25).select("idx", "ordinal", "release_pts"),
    "st_bounded_scan": lambda s, d: ops.bounded_scan(packets(s, d), 200),
    "limit_frames": lambda s, d: ops.limit_frames(packets(s, d), 3).select("file", "idx", "ordinal", "pts"),
    "key_only": lambda s, d: packets(s, d).where("keyframe").select("file", "idx", "ordinal", "pts"),
    "dedup_consecutive": _dedup,
    "set_union_time": lambda s, d: packets(s, d).where("idx % 2 = 0").select("idx", "ordinal", F.lit(0).cast("bigint").alias("input")).unionByName(packets(s, d).where("idx % 2 = 1").select("idx", "ordinal", F.lit(1).cast("bigint").alias("input"))),
    "set_except": lambda s, d: _days(s, d).select("idx", "day").distinct().join(_days(s, d).where("keyframe").select("idx", "day").distinct(), ["idx", "day"], "left_anti"),
    "sink_ivf": lambda s, d: packets(s, d).selectExpr("idx", "cast(row_number() over (partition by idx order by ordinal) - 1 as bigint) as pts", "size"),
}

_SAMPLES = f"""with {_TB}, pl as (select file, chunk, coalesce(sum(spc) over (partition by file order by chunk rows between unbounded preceding and 1 preceding), 0) as first, spc from runs),
e as (select file, chunk, cast(first + k as bigint) as sample from pl, range(1, 20) r(k) where k <= spc),
s as (select e.file, e.chunk, e.sample, z.size, c.offs + coalesce(sum(z.size) over (partition by e.file, e.chunk order by e.sample rows between unbounded preceding and 1 preceding), 0) as offs from e join sizes z using (file, sample) join chunks c on c.file = e.file and c.chunk = e.chunk),
tt as (select file, row_number() over (partition by file order by entry, k) as sample, delta from stts, range(100) r(k) where k < cnt),
tp as (select file, sample, sum(delta) over (partition by file order by sample rows unbounded preceding) - delta as pts from tt),
sm as (select s.file, s.sample, s.chunk, cast(s.offs as bigint) as offset, s.size, cast(coalesce(tp.pts, 0) as bigint) as pts, (s.file not in (select file from stss)) or exists (select 1 from stss k where k.file = s.file and k.sample = s.sample) as keyframe from s left join tp using (file, sample))"""

SQL = {
    "join_streams": f"with {_PK}, st as (select distinct user_id % 10 as file, user_id as idx from events where user_id % 5 <> 2) select file, idx, ordinal, case when idx % 2 = 0 then 'vp9' else 'opus' end as codec from pk join st using (file, idx)",
    "join_pid": f"with {_TS} select file, ord, stream::bigint as stream, len from ts join (values (0, 0), (1, 1), (4, 2), (7, 3)) t(pid, stream) using (pid)",
    "join_mkv_track": "with t as (select file, track_number, min(idx)::bigint as idx from (values (0, 1, 0), (0, 2, 1), (0, 2, 2), (1, 3, 0), (2, 0, 0), (2, 5, 1), (3, 4, 0)) t(file, track_number, idx) group by 1, 2)"
    " select user_id % 4 as file, event_id, idx, event_id % 100 * 1000 + event_id % 61 - 30 as pts from events join t on t.file = user_id % 4 and t.track_number = user_id % 6",
    "mp4_stsc": f"with {_TB} select file, chunk, cast(spc as bigint) as spc from runs",
    "mp4_samples": _SAMPLES + " select * from sm",
    "src_mp4": _SAMPLES + ' select file, sample, "offset", size, pts, true as keyframe from sm',
    "mp4_durations": f"with {_DU} select file, idx, ordinal, duration from du",
    "mp4_interleave": f"with {_IL} select * from il",
    "sink_mp4": f"with {_IL} select file, idx, chunk, min(offs) as offs, count(*) as samples from il group by 1, 2, 3",
    "sort_time": f"with {_IL} select file, position, idx, ordinal from il",
    "sort_offset": _SAMPLES + ' select file, sample, "offset", row_number() over (partition by file order by "offset") as place from sm',
    "av_mux": f"with {_PK} select input::bigint as input, out_idx::bigint as idx, ordinal, pts, size from pk join (values (0, 2, 0), (0, 4, 1), (1, 3, 2), (0, 2, 3), (1, 99999, 4)) t(input, i, out_idx) on t.i = pk.idx and t.input = pk.idx % 2",
    "src_ogg": f"with {_SG}, p as (select *, coalesce(sum((lace < 255)::int) over (partition by file order by page, seg rows between unbounded preceding and 1 preceding), 0) as packet from sg)"
    " select file, cast(packet as bigint) as packet, cast(sum(lace) as bigint) as size, count(*) as segments, min(page) as first_page, max(page) as last_page from p group by 1, 2 having min(lace) < 255",
    "src_ts": f"with {_TS} select file, pid, count(*) as packets, count(*) filter (pusi) as units, cast(sum(len) as bigint) as bytes from ts group by 1, 2",
    "st_pes": f"with {_TS}, a as (select *, cast(sum(pusi::int) over (partition by file, pid order by ord rows unbounded preceding) as bigint) as pes from ts),"
    " b as (select *, coalesce(sum(len) over (partition by file, pid, pes order by ord rows between unbounded preceding and 1 preceding), 0) as had, first_value(expect) over w as want, first_value(rai) over w as k from a where pes > 0 window w as (partition by file, pid, pes order by ord))"
    " select file, pid, pes, cast(sum(len) as bigint) as size, count(*) as parts, bool_and(k) as keyframe, min(ord) as first_ord from b where want = 0 or had < want group by 1, 2, 3",
    "hls_segments": f"with {_SEGS} select idx as file, ordinal, segment, start_pts from seg",
    "hls_duration": f"with {_SEGS} select file, segment, start_pts, packets, round(duration, 6) as duration from hdur",
    "hls_playlist": f"with {_SEGS} select file, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || cast(greatest(ceil(greatest(max(duration), {TARGET})), 1) as bigint) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)"
    " || string_agg('#EXTINF:' || printf('%.3f', floor(duration * 1000 + 0.5) / 1000) || ',' || chr(10) || file || segment || '.ts' || chr(10), '' order by segment) || '#EXT-X-ENDLIST' || chr(10) as playlist from hdur group by file",
    "win_running": f"with {_PK} select file, idx, ordinal, cast(coalesce(sum(1152 + size % 3) over (partition by idx order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as pts from pk",
    "win_lag": f"with {_PK} select idx, ordinal, pts - lag(pts) over (partition by idx order by ordinal) as delta from pk",
    "win_frame_blocks": "select k as block, count(*) as n, cast(sum(cast(floor(value * 60) as bigint)) as bigint) as total, min(event_id) as first from events, (select unnest(range((select max(event_id) // 512 + 1 from events))) as k) b where event_id >= k * 512 and event_id < k * 512 + 1024 and k * 512 + 1024 <= (select max(event_id) + 1 from events) group by 1",
    "win_warmup": "select c as chunk, count(*) as frames, count(*) filter (event_id < c * 50) as warmups, min(event_id) as first from (select unnest(range((select max(event_id) // 50 + 1 from events))) as c) t, events where event_id >= c * 50 - (case when c > 0 then 8 else 0 end) and event_id < c * 50 + 50 group by 1",
    "win_lookahead": f"with {_PK} select idx, ordinal, coalesce(lead(pts, 25) over w, last_value(pts) over (w rows between unbounded preceding and unbounded following)) as release_pts from pk window w as (partition by file, idx order by ordinal)",
    "st_bounded_scan": f"with {_PK}, r as (select *, row_number() over (partition by file order by pts, idx, ordinal) as r from pk) select file, idx, count(*) as packets, min(pts) as first_pts from r where r <= 200 group by 1, 2",
    "limit_frames": f"with {_PK} select file, idx, ordinal, pts from pk where ordinal < 3",
    "key_only": f"with {_PK} select file, idx, ordinal, pts from pk where keyframe",
    "dedup_consecutive": "select user_id, event_id, event_type from (select *, lag(event_type) over w as p, row_number() over w as i from events window w as (partition by user_id order by epoch_us(ts), event_id)) where i = 1 or event_type is distinct from p",
    "set_union_time": f"with {_PK} select idx, ordinal, 0::bigint as input from pk where idx % 2 = 0 union all select idx, ordinal, 1 from pk where idx % 2 = 1",
    "set_except": f"with {_PK} select idx, pts // 86400000000 as day from pk except select idx, pts // 86400000000 from pk where keyframe",
    "sink_ivf": f"with {_PK} select idx, ordinal as pts, size from pk",
}
