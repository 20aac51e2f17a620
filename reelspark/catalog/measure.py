"""Measurement queries, bound to the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measure as ops
from . import frames as fx


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate ladder: clip = return flag and line status, arm = parity of the
    supplier, rung = discount in percent."""
    return (
        _read(spark, sf_dir, "lineitem")
        .selectExpr("concat(l_returnflag, l_linestatus) as clip", "l_suppkey % 2 as arm", "cast(round(l_discount * 100) as bigint) as rung", "l_extendedprice as p", "l_quantity as q")
        .groupBy("clip", "arm", "rung").agg(F.avg("p").alias("p"), F.avg("q").alias("q"))
        .selectExpr("clip", "arm", "30 + rung + 0.25D * arm as psnr", "round(p * (1 + rung), 3) as kbps", "round(q * (12 - rung), 3) as wall_ms")
    )


_LADDER = """lad as (select clip, arm, 30 + rung + 0.25::double * arm as psnr, round(p * (1 + rung), 3) as kbps, round(q * (12 - rung), 3) as wall_ms
 from (select l_returnflag || l_linestatus as clip, l_suppkey % 2 as arm, cast(round(l_discount * 100) as bigint) as rung, avg(l_extendedprice) as p, avg(l_quantity) as q from lineitem group by 1, 2, 3)),
ov as (select clip, max(a) as lo, min(b) as hi from (select clip, arm, min(psnr) as a, max(psnr) as b from lad group by 1, 2) group by 1 having count(*) = 2)"""


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stage_facts(spark, sf_dir):
    """Stages of a month of ship dates; one scope in three is inclusive."""
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) as clip", "concat('m', month(l_shipdate)) as stage",
        "if(month(l_shipdate) % 3 = 0, 'incl', 'self') as scope", "cast(round(l_extendedprice * 100) as bigint) / 100 as ms", "cast(l_quantity as bigint) as calls",
    )


_STAGES = """st as (select l_returnflag || l_linestatus as clip, 'm' || month(l_shipdate) as stage, case when month(l_shipdate) % 3 = 0 then 'incl' else 'self' end as scope,
 cast(round(l_extendedprice * 100) as bigint) / 100 as ms, cast(l_quantity as bigint) as calls from lineitem)"""


def rounds(spark, sf_dir):
    """Timing rounds: priority is the key, an order's parity the arm, its rank the round."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as clip", "o_orderkey % 2 as arm", "cast(row_number() over (partition by o_orderpriority, o_orderkey % 2 order by o_orderkey) as bigint) as round", "o_totalprice as ms"
    )


_ROUNDS = """ro as (select o_orderpriority as clip, o_orderkey % 2 as arm, row_number() over (partition by o_orderpriority, o_orderkey % 2 order by o_orderkey) as round, o_totalprice as ms from orders),
pa as (select a.clip, a.round, a.ms as a, b.ms as b from ro a join ro b on a.clip = b.clip and a.round = b.round and a.arm = 0 and b.arm = 1)"""


def vectors(spark, sf_dir):
    """Vector i against vector i + 1, element by element."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    e = e.select("vec_id", "label", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("v").alias("b"))
    return e.withColumnRenamed("v", "a").join(nxt, ["vec_id", "i"])


_VECTORS = """e as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
vp as (select x.vec_id, x.label, x.i, x.v as a, y.v as b from e x join e y on y.vec_id = x.vec_id + 1 and y.i = x.i)"""


def frame_pairs(spark, sf_dir):
    """Clip A against clip B as its decoded version."""
    p = fx.planes(spark, sf_dir)
    return ops.frame_pairs(p.where("clip = 'A'"), p.where("clip = 'B'").withColumn("clip", F.lit("A")))


_FP = f"{fx._pix_sql()}, fp as (select a.frame_no, a.y, a.x, a.v as a, b.v as b from pix a join pix b on a.clip = 'A' and b.clip = 'B' and a.plane = 0 and b.plane = 0 and a.frame_no = b.frame_no and a.y = b.y and a.x = b.x)"


def bench(spark, sf_dir):
    """Benchmark facts from orders: one row a clip, codec, kind and bitstream."""
    o = _read(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_custkey % 20) as clip", "element_at(array('ours', 'libvpx', 'ffmpeg'), cast(o_orderkey % 3 as int) + 1) as codec",
        "if(o_orderkey div 3 % 2 = 0, 'encode', 'decode') as kind", "if(o_orderkey div 6 % 2 = 0, 'libvpx', 'ours') as source", "o_totalprice as v",
    )
    return o.groupBy("clip", "codec", "kind", "source").agg(F.max("v").alias("mpx_s"))


_BENCH = """be as (select 'c' || (o_custkey % 20) as clip, (['ours', 'libvpx', 'ffmpeg'])[o_orderkey % 3 + 1] as codec, case when o_orderkey // 3 % 2 = 0 then 'encode' else 'decode' end as kind,
 case when o_orderkey // 6 % 2 = 0 then 'libvpx' else 'ours' end as source, max(o_totalprice) as mpx_s from orders group by 1, 2, 3, 4)"""


def palette_pixels(spark, sf_dir):
    """Colours of parts, one pixel a part; clips by brand."""
    return _read(spark, sf_dir, "part").selectExpr(
        "p_brand as clip", "p_partkey div 32 as y", "p_partkey % 32 as x", "cast(p_size * 5 % 256 as bigint) as r",
        "cast(if(p_brand < 'Brand#3', p_size * 5 % 256, p_size * 3) as bigint) as g", "cast(p_size * 5 % 256 as bigint) as b", "cast(if(p_brand like '%1', 255, 128) as bigint) as a",
    )


_PAL = """pp as (select p_brand as clip, p_partkey // 32 as y, p_partkey % 32 as x, cast(p_size * 5 % 256 as bigint) as r,
 cast(case when p_brand < 'Brand#3' then p_size * 5 % 256 else p_size * 3 end as bigint) as g, cast(p_size * 5 % 256 as bigint) as b, cast(case when p_brand like '%1' then 255 else 128 end as bigint) as a from part)"""


def calib(spark, sf_dir):
    """Quality label, length and source of labelled documents as metric rows."""
    l, d = _read(spark, sf_dir, "labels"), _read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return l.join(d, "doc_id").selectExpr("lang as enc", "doc_id", "cast(quality as double) + doc_id % 7 as odg", "cast(n_chars as double) as nmr")


_CAL = "ca as (select lang as enc, doc_id, quality::double + doc_id % 7 as odg, n_chars::double as nmr from labels join documents using (doc_id))"


def _census(spark, sf_dir):
    return ops.colour_census(palette_pixels(spark, sf_dir))


def _kmeans(spark, sf_dir):
    pts = ops.colour_census(palette_pixels(spark, sf_dir)).select(*[F.col(c).cast("double").alias(c) for c in ("r", "g", "b")], F.col("n").cast("double").alias("w"))
    cs = spark.createDataFrame([(k, 40.0 * k, 30.0 * k, 40.0 * k) for k in range(6)], "k bigint, r double, g double, b double")
    return _round(ops.kmeans_step(pts, cs, ["r", "g", "b"]))


def _percentiles(spark, sf_dir):
    e = _read(spark, sf_dir, "events").where("value is not null")
    return ops.order_statistics(e, ["event_type"], "value", {f"p{int(q * 100)}": ops.nearest_rank(q) for q in (0.1, 0.5, 0.95)}).drop("n")


def _medians(spark, sf_dir):
    return ops.order_statistics(stage_facts(spark, sf_dir), ["clip", "stage"], "ms", {"ms": ops.UPPER_MEDIAN}).withColumnRenamed("n", "passes")


def _throughput(spark, sf_dir):
    r = _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "16 * (1 + o_custkey % 80) as width", "16 * (1 + o_custkey % 45) as height", "1 + o_orderkey % 300 as frames", "o_totalprice / 100 as wall_ms", "o_custkey * 1000 as bytes", "25D as rate"
    )
    return _round(ops.throughput(r).select("o_orderkey", "fps", "mpx_s", "kbps"), 4)


def _conformance(spark, sf_dir):
    """First frame whose hash differs between two clips' planes."""
    h = fx.planes(spark, sf_dir).groupBy("clip", "frame_no").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plane", "y", "x", "v"))), lambda s: s["v"]), ",")).alias("md5"))
    got, want = h.where("clip = 'A'").select("frame_no", F.col("md5").alias("got")), h.where("clip = 'B' or frame_no = 0").where("clip = 'B'").select("frame_no", F.col("md5").alias("want"))
    extra = want.unionByName(want.limit(0)).unionByName(spark.createDataFrame([(-1, "none")], "frame_no bigint, want string"))
    j = got.join(extra, "frame_no", "full")
    return j.agg(F.count("*").alias("frames"), F.count_if(F.expr("got <=> want")).alias("equal"), F.min(F.expr("if(not got <=> want, frame_no, null)")).alias("first_mismatch"))


def _null_identity(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("h"))
    g = d.groupBy("source", "h").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.sum(F.expr("if(n > 1, n, 0)")).alias("identical"), F.count_if(F.expr("n = 1")).alias("divergent"))


def _report(spark, sf_dir):
    p = _read(spark, sf_dir, "events")
    return p.agg(F.count("*").alias("packets_written"), F.count_if(F.expr("event_type = 'purchase'")).alias("frames_decoded"))


def _speed_summary(spark, sf_dir):
    b = ops.bd_pchip(ladder(spark, sf_dir))
    return _round(b.where("bd_rate is not null").agg(F.avg("bd_rate").alias("mean"), F.max("bd_rate").alias("worst"), ops.geomean(F.col("speed")).alias("speed")), 4)


def _calib_pair(spark, sf_dir):
    c = calib(spark, sf_dir).selectExpr("doc_id div 4 as clip", "doc_id div 2 % 2 as br", "if(doc_id % 2 = 0, 'ours', 'lame') as enc", "odg", "nmr")
    pick = lambda e, v: F.max(F.expr(f"if(enc = '{e}', {v}, null)")).alias(f"{e}_{v}")
    g = c.groupBy("clip", "br").agg(*[pick(e, v) for e in ("ours", "lame") for v in ("odg", "nmr")]).where("ours_odg is not null and lame_odg is not null")
    return g.selectExpr("clip", "br", "if(ours_odg > lame_odg, 'ours', 'lame') as winner", "if(ours_nmr < lame_nmr, 'ours', 'lame') as metric_says", "(ours_odg > lame_odg) = (ours_nmr < lame_nmr) as agree")


def _merge(spark, sf_dir):
    return _round(ops.merge_error_stats(ops.error_stats(vectors(spark, sf_dir), ["label", "vec_id"]), ["label"]))


def _markdown(spark, sf_dir):
    """A table of nations for each region."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    by_nation = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.floor(F.max("c_acctbal")).cast("bigint").alias("largest"))
    return ops.markdown_tables(read("nation").join(by_nation, "n_nationkey"), ["n_regionkey"], ["n_name", "customers", "largest"], ["n_name"])


QUERIES = {
    "agg_bd_pchip": lambda s, d: _round(ops.bd_pchip(ladder(s, d)), 4),
    "agg_bd_summary": _speed_summary,
    "agg_bd_cubic": lambda s, d: _round(ops.bd_cubic(ladder(s, d)), 3),
    "agg_bd_linear": lambda s, d: _round(ops.bd_linear(ladder(s, d)), 4),
    "agg_iso": lambda s, d: _round(ops.iso_quality(ladder(s, d)), 5),
    "set_intersect": lambda s, d: ladder(s, d).where("arm = 0").select("clip").intersect(ladder(s, d).where("arm = 1").select("clip")),
    "agg_psnr_frame": lambda s, d: _round(ops.psnr_by_frame(frame_pairs(s, d)).drop("clip")),
    "agg_psnr_pooled": lambda s, d: _round(ops.psnr_pooled(frame_pairs(s, d))),
    "agg_ssim": lambda s, d: _round(ops.ssim(frame_pairs(s, d), fx.W, fx.H).drop("clip")),
    "agg_psnr_channel": lambda s, d: _round(frame_pairs(s, d).groupBy(F.expr("(y * 32 + x) % 3").alias("ch")).agg(ops.psnr(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("psnr"))),
    "frame_pair": lambda s, d: frame_pairs(s, d).drop("clip"),
    "agg_rmse": lambda s, d: _round(ops.error_stats(vectors(s, d), ["vec_id"])),
    "agg_rmse_merge": _merge,
    "agg_stage": lambda s, d: _round(ops.stage_report(stage_facts(s, d), ["clip"]), 4),
    "agg_ns_call": lambda s, d: _round(stage_facts(s, d).groupBy("clip", "stage").agg(F.sum("ms").alias("ms"), F.sum(F.expr("if(stage = 'm1', 0, calls)")).alias("calls")).select("clip", "stage", ops.ns_per_call().alias("ns_per_call")), 2),
    "topk_stage": lambda s, d: _round(ops.top_stages(ops.stage_report(stage_facts(s, d), ["clip"]), ["clip"], 3).select("clip", "rank", "stage", "pct"), 4),
    "agg_throughput": _throughput,
    "agg_profile_median": _medians,
    "agg_percentile": _percentiles,
    "agg_mean_of": lambda s, d: _round(_read(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))),
    "agg_best_of": lambda s, d: _round(ops.best_of(rounds(s, d), ["clip", "arm"], 900.0)),
    "ab_pair": lambda s, d: ops.paired(rounds(s, d), ["clip"]),
    "agg_win_z": lambda s, d: _round(ops.win_z(ops.paired(rounds(s, d), ["clip"]), ["clip"])),
    "agg_null_arm": lambda s, d: _round(ops.null_arm(ops.paired(rounds(s, d), ["clip"]), ["clip"])),
    "agg_null_median": lambda s, d: _round(ops.null_median(ops.paired(rounds(s, d), ["clip"]), ["clip"])),
    "agg_null_identity": _null_identity,
    "agg_split": lambda s, d: _read(s, d, "customer").select("c_name", ops.split_of(F.col("c_name")).alias("split")),
    "agg_corr": lambda s, d: _round(ops.correlations(calib(s, d), ["enc"], "odg", "nmr")),
    "agg_eval": lambda s, d: _round(calib(s, d).groupBy("enc").agg(F.avg("odg").alias("mean"), F.count("*").alias("n"), F.min("odg").alias("worst"))),
    "agg_rate_error": lambda s, d: _round(ladder(s, d).selectExpr("clip", "arm", "psnr", "kbps / (20000 * (psnr - 28)) - 1 as rate_error")),
    "calib_pair": _calib_pair,
    "arm_pivot": lambda s, d: _round(ops.head_to_head(bench(s, d))),
    "conformance": _conformance,
    "agg_census": _census,
    "agg_kmeans": _kmeans,
    "agg_kind": lambda s, d: ops.colour_kind(palette_pixels(s, d), ["clip"]),
    "agg_repeat": lambda s, d: _round(ops.repeat_fraction(palette_pixels(s, d).withColumn("r", F.expr("r div 100")).withColumn("g", F.lit(0)).withColumn("b", F.lit(0)), ["a"], 64)),
    "agg_vartree": lambda s, d: ops.variance_tree(fx.planes(s, d, 64, 64)),
    "agg_report": _report,
    "sink_report": _markdown,
    "lab_ladder": lambda s, d: _read(s, d, "events").select(F.col("event_type").alias("class")).distinct().select("class", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (48000, 64000, 96000, 128000, 192000)])).alias("bitrate")),
}

_SQUARE = "(a - b) * (a - b)"
_PSNR = "case when {0} <= 0 then 99 else 10 * log10(65025 / ({0})) end"
_BD = f"""with {_LADDER},
p0 as (select *, log10(kbps) as lg from lad where kbps > 0),
p1 as (select *, lead(psnr) over w as nx, lead(lg) over w as ny, coalesce(lead(kbps) over w > kbps, true) as rises from p0 window w as (partition by clip, arm order by psnr, kbps)),
p2 as (select *, nx - psnr as h, (ny - lg) / (nx - psnr) as d from p1),
p3 as (select *, lag(h) over w as ph, lag(d) over w as pd from p2 window w as (partition by clip, arm order by psnr, kbps)),
p4 as (select *, case when pd is null then d when d is null then pd when pd * d <= 0 then 0 else ((2 * h + ph) + (h + 2 * ph)) / ((2 * h + ph) / pd + (h + 2 * ph) / d) end as m from p3),
p5 as (select *, lead(m) over (partition by clip, arm order by psnr, kbps) as nm from p4),
side as (select clip, cast(sum(inside) as bigint) as points_inside, bool_and(mono or arm <> 0) as anchor_monotone, bool_and(mono or arm <> 1) as cand_monotone, sum(case when arm = 0 then ms else 0 end) / sum(case when arm = 1 then ms else 0 end) as speed
 from (select clip, arm, count(*) filter (psnr between lo and hi) as inside, bool_and(rises) as mono, sum(wall_ms) as ms from p5 join ov using (clip) group by 1, 2) group by 1),
grid as (select clip, i, lo + (hi - lo) * i / 200::double as t from ov, range(201) r(i) where hi - lo >= 0.5),
at0 as (select clip, i, arm, psnr, lg, h, m, ny, nm, (t - psnr) / h as s from grid join p5 using (clip) where nx is not null and psnr <= t and t <= nx),
v as (select clip, i, arm, arg_min((2 * s**3 - 3 * s**2 + 1) * lg + (s**3 - 2 * s**2 + s) * h * m + (-2 * s**3 + 3 * s**2) * ny + (s**3 - s**2) * h * nm, psnr) as y from at0 group by 1, 2, 3),
df as (select clip, sum(case when arm = 1 then y else -y end) / 201 as mean from v group by 1 having count(*) = 402),
bd as (select clip, (pow(10, mean) - 1) * 100 as bd_rate, hi - lo as overlap_db, points_inside, anchor_monotone, cand_monotone, speed from ov join side using (clip) left join df using (clip))"""
_CUBIC = ops.cubic_coefficients()
_PT = "with " + _ROUNDS

SQL = {
    "agg_bd_pchip": _BD + " select clip, round(bd_rate, 4) as bd_rate, round(overlap_db, 4) as overlap_db, points_inside, anchor_monotone, cand_monotone, round(speed, 4) as speed from bd",
    "agg_bd_summary": _BD + " select round(avg(bd_rate), 4) as mean, round(max(bd_rate), 4) as worst, round(exp(avg(ln(speed))), 4) as speed from bd where bd_rate is not null",
    "agg_bd_cubic": f"with {_LADDER}, z as (select clip, arm, lo, hi, psnr - (lo + hi) / 2 as z, log10(greatest(kbps, 1)) as y from lad join ov using (clip)),"
    f" m as (select clip, arm, max(lo) as lo, max(hi) as hi, {', '.join(f'sum(z ** {k}) as s{k}' for k in range(7))}, {', '.join(f'sum(z ** {k} * y) as t{k}' for k in range(4))} from z group by 1, 2),"
    f" c as (select clip, arm, hi - lo as w, 2 * (({_CUBIC[0]}) * (hi - lo) / 2 + ({_CUBIC[2]}) * ((hi - lo) / 2) ** 3 / 3) as area from m)"
    " select clip, round(case when max(w) <= 0 then 0 else (pow(10, sum(case when arm = 1 then area else -area end) / max(w)) - 1) * 100 end, 3) as bd_rate from c group by clip",
    "agg_bd_linear": f"with {_LADDER}, p as (select clip, arm, psnr, ln(kbps) as l, lead(psnr) over w as nx, lead(ln(kbps)) over w as nl from lad window w as (partition by clip, arm order by psnr, kbps)),"
    " g as (select clip, i, lo + (hi - lo) * i / 64::double as q, case when i in (0, 64) then 0.5 else 1 end::double as wt from ov, range(65) r(i) where hi > lo),"
    " y as (select clip, i, arm, arg_min(case when nx - psnr < 1e-12 then l else l + (q - psnr) / (nx - psnr) * (nl - l) end, psnr) as y, max(wt) as wt from g join p using (clip) where nx is not null and psnr <= q and q <= nx group by 1, 2, 3),"
    " d as (select clip, sum(case when arm = 1 then wt * y else -wt * y end) as s from y group by 1 having count(*) = 130)"
    " select clip, round((exp(s / 64) - 1) * 100, 4) as bd_rate from ov left join d using (clip)",
    "agg_iso": f"with {_LADDER}, p as (select *, lead(psnr) over w as nx, lead(wall_ms) over w as nms, lead(kbps) over w as nk from lad window w as (partition by clip, arm order by psnr, kbps)),"
    " q as (select clip, lo + 0.5::double * (hi - lo) as q from ov where hi > lo),"
    " a as (select clip, q, arm, arg_min(wall_ms + (q - psnr) / (nx - psnr) * (nms - wall_ms), psnr) as ms, arg_min(kbps + (q - psnr) / (nx - psnr) * (nk - kbps), psnr) as k from q join p using (clip) where nx is not null and psnr <= q and q <= nx group by 1, 2, 3)"
    " select clip, round(q, 5) as q, round(max(case when arm = 1 then ms end) / max(case when arm = 0 then ms end), 5) as time_ratio, round(max(case when arm = 1 then k end) / max(case when arm = 0 then k end), 5) as rate_ratio from a group by clip, q having count(*) = 2",
    "set_intersect": f"with {_LADDER} select clip from lad where arm = 0 intersect select clip from lad where arm = 1",
    "agg_psnr_frame": f"with {_FP} select frame_no, sse, round({_PSNR.format('sse / n')}, 6) as psnr from (select frame_no, cast(sum({_SQUARE}) as bigint) as sse, count(*) as n from fp group by 1)",
    "agg_psnr_pooled": f"with {_FP} select sse, n, round({_PSNR.format('sse / n')}, 6) as psnr from (select cast(sum({_SQUARE}) as bigint) as sse, count(*) as n from fp)",
    "agg_psnr_channel": f"with {_FP} select ch, round({_PSNR.format('mse')}, 6) as psnr from (select (y * 32 + x) % 3 as ch, avg({_SQUARE}) as mse from fp group by 1)",
    "agg_ssim": f"with {_FP}, m as (select frame_no, y // 8 as by, x // 8 as bx, avg(a) as ma, avg(b) as mb, avg(a * a) as aa, avg(b * b) as bb, avg(a * b) as ab from fp group by 1, 2, 3)"
    " select frame_no, round(avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 6) as ssim from m group by 1",
    "frame_pair": f"with {_FP} select frame_no, y, x, a, b from fp",
    "agg_rmse": f"with {_VECTORS} select vec_id, count(*) as n, round(max(abs(a - b)), 6) as max_abs_err, round(sqrt(avg((a - b) * (a - b))), 6) as rmse, round(case when sqrt(avg((a - b) * (a - b))) > 0 then 20 * log10(1 / sqrt(avg((a - b) * (a - b)))) end, 6) as psnr_db from vp group by 1",
    "agg_rmse_merge": f"with {_VECTORS}, t as (select label, count(*) as n, max(abs(a - b)) as m, sqrt(avg((a - b) * (a - b))) as r from vp group by 1) select label, n, round(m, 6) as max_abs_err, round(r, 6) as rmse, round(case when r > 0 then 20 * log10(1 / r) end, 6) as psnr_db from t",
    "agg_stage": f"with {_STAGES}, s as (select clip, stage, min(scope) as scope, sum(ms) as ms, cast(sum(calls) as bigint) as calls from st group by 1, 2)"
    " select clip, stage, scope, round(ms, 4) as ms, calls, round(100 * ms / greatest(sum(case when scope = 'self' then ms else 0 end) over (partition by clip), 1e-9), 4) as pct, round(case when calls > 0 then ms * 1e6 / calls else 0 end, 4) as ns_per_call from s",
    "topk_stage": f"with {_STAGES}, s as (select clip, stage, min(scope) as scope, sum(ms) as ms from st group by 1, 2),"
    " r as (select *, row_number() over (partition by clip order by ms desc, stage) as rank, 100 * ms / sum(case when scope = 'self' then ms else 0 end) over (partition by clip) as pct from s) select clip, rank, stage, round(pct, 4) as pct from r where rank <= 3",
    "agg_ns_call": f"with {_STAGES} select clip, stage, round(case when sum(case when stage = 'm1' then 0 else calls end) > 0 then sum(ms) * 1e6 / sum(case when stage = 'm1' then 0 else calls end) else 0 end, 2) as ns_per_call from st group by 1, 2",
    "agg_throughput": "with r as (select o_orderkey, 16 * (1 + o_custkey % 80) as width, 16 * (1 + o_custkey % 45) as height, 1 + o_orderkey % 300 as frames, greatest(o_totalprice / 100 / 1e3, 1e-9) as secs, o_custkey * 1000 as bytes from orders)"
    " select o_orderkey, round(frames / secs, 4) as fps, round(width * height * frames / secs / 1e6, 4) as mpx_s, round(case when bytes > 0 then bytes * 8.0::double / (frames / 25::double) / 1e3 else 0 end, 4) as kbps from r",
    "agg_profile_median": f"with {_STAGES} select clip, stage, list_sort(list(ms))[count(*) // 2 + 1] as ms, count(*) as passes from st group by 1, 2",
    "agg_percentile": "select event_type, " + ", ".join(f"list_sort(list(value))[cast(floor((count(*) - 1) * {q}::double + 0.5) as bigint) + 1] as p{int(q * 100)}" for q in (0.1, 0.5, 0.95)) + " from events where value is not null group by 1",
    "agg_mean_of": "select event_type, round(avg(value), 6) as mean from events group by 1",
    "agg_best_of": _PT + " select clip, arm, round(greatest(min(ms) - 900, 1e-3), 6) as best_ms from ro group by 1, 2",
    "ab_pair": _PT + " select clip, round, a, b from pa",
    "agg_win_z": _PT + " select clip, wins, rounds, round(z, 6) as z, case when z > 2 then 'A faster' when z < -2 then 'B faster' else 'noise' end as verdict from (select clip, count(*) filter (a < b) as wins, count(*) as rounds, (count(*) filter (a < b) - count(*) / 2) / (0.5 * sqrt(count(*))) as z from pa group by 1)",
    "agg_null_arm": _PT + " select clip, round((min(b) - min(a)) / min(a) * 100, 6) as delta_pct, round(greatest(max(a), max(b)) / least(min(a), min(b)), 6) as worst_by_best from pa group by 1",
    "agg_null_median": _PT + " select clip, round(list_sort(list(abs(a - b) / greatest(a, 1e-9) * 100))[count(*) // 2 + 1], 6) as median_pct, round(max(abs(a - b) / greatest(a, 1e-9) * 100), 6) as worst_pct from pa group by 1",
    "agg_null_identity": "with g as (select source, text, count(*) as n from documents group by 1, 2) select source, cast(sum(case when n > 1 then n else 0 end) as bigint) as identical, count(*) filter (n = 1) as divergent from g group by 1",
    "agg_split": "select c_name, case when list_reduce([0::bigint] || list_transform(range(1, len(c_name) + 1), lambda i: ascii(c_name[i])::bigint), lambda a, b: (a * 31 + b) % 4294967296) % 2 = 0 then 'train' else 'holdout' end as split from customer",
    "agg_corr": f"with {_CAL}, r as (select *, rank() over (partition by enc order by odg) + (count(*) over (partition by enc, odg) - 1) / 2 as rx, rank() over (partition by enc order by nmr) + (count(*) over (partition by enc, nmr) - 1) / 2 as ry from ca)"
    " select enc, round(corr(odg, nmr), 6) as pearson, round(corr(rx, ry), 6) as spearman, count(*) as n from r group by 1",
    "agg_eval": f"with {_CAL} select enc, round(avg(odg), 6) as mean, count(*) as n, min(odg) as worst from ca group by 1",
    "agg_rate_error": f"with {_LADDER} select clip, arm, psnr, round(kbps / (20000 * (psnr - 28)) - 1, 6) as rate_error from lad",
    "calib_pair": f"with {_CAL}, c as (select doc_id // 4 as clip, doc_id // 2 % 2 as br, doc_id % 2 as e, odg, nmr from ca)"
    " select o.clip, o.br, case when o.odg > l.odg then 'ours' else 'lame' end as winner, case when o.nmr < l.nmr then 'ours' else 'lame' end as metric_says, (o.odg > l.odg) = (o.nmr < l.nmr) as agree from c o join c l on o.clip = l.clip and o.br = l.br and o.e = 0 and l.e = 1",
    "arm_pivot": f"with {_BENCH}, g as (select clip, kind, max(case when codec = 'ours' then mpx_s end) as ours, max(case when codec = 'libvpx' then mpx_s end) as libvpx, max(case when codec = 'ffmpeg' then mpx_s end) as ffmpeg from be where kind = 'encode' or source = 'libvpx' group by 1, 2)"
    " select clip, kind, ours, libvpx, ffmpeg, round(case when libvpx > 0 then ours / libvpx end, 6) as ratio from g where ours is not null or libvpx is not null",
    "conformance": f"with {fx._pix_sql()}, h as (select clip, frame_no, md5(string_agg(v::varchar, ',' order by plane, y, x)) as md5 from pix group by 1, 2), w as (select frame_no, md5 as want from h where clip = 'B' union all select -1, 'none'), g as (select frame_no, md5 as got from h where clip = 'A')"
    " select count(*) as frames, count(*) filter (got is not distinct from want) as equal, min(case when got is distinct from want then coalesce(g.frame_no, w.frame_no) end) as first_mismatch from g full join w on g.frame_no = w.frame_no",
    "agg_census": f"with {_PAL} select r, g, b, a, count(*) as n from pp group by 1, 2, 3, 4",
    "agg_kmeans": f"with {_PAL}, c as (select r, g, b, sum(n) as w from (select r, g, b, a, count(*) as n from pp group by 1, 2, 3, 4) group by 1, 2, 3), k as (select k, 40 * k as kr, 30 * k as kg, 40 * k as kb from range(6) t(k)),"
    " o as (select r, g, b, any_value(w) as w, arg_min(k, (d2, k)) as k, min(d2) as d2 from (select *, (r - kr) ** 2 + (g - kg) ** 2 + (b - kb) ** 2 as d2 from c, k) group by 1, 2, 3)"
    " select k, round(sum(r * w) / sum(w), 6) as r, round(sum(g * w) / sum(w), 6) as g, round(sum(b * w) / sum(w), 6) as b, sum(w)::double as w, sum(d2 * w)::double as sse from o group by 1",
    "agg_kind": f"with {_PAL}, t as (select clip, bool_and(r = g and g = b) as gray, bool_and(a = 255) as op, count(distinct (r, g, b, a)) as colours from pp group by 1) select clip, colours, case when gray and op then 'gray' when gray then 'gray_alpha' when colours <= 256 then 'indexed' else 'truecolour' end as kind from t",
    "agg_repeat": f"with {_PAL}, t as (select a, r // 100 = lag(r // 100) over w as same, row_number() over w as i from pp window w as (partition by a, y order by x)) select a, round(avg(same::int), 6) as repeated, avg(same::int) >= 0.35 as graphics from t where i > 1 group by 1",
    "agg_vartree": f"with {fx._pix_sql(64, 64)}, t as (select clip, frame_no, size, y // size as r, x // size as c, cast(sum(v) as bigint) as total, cast(sum(v * v) as bigint) as squares from pix, (values (8), (16), (32), (64)) z(size) where plane = 0 group by all)"
    " select clip, frame_no, size::bigint as size, r, c, total, squares, cast(256 * (squares - total * total // (size * size)) // (size * size) as bigint) as variance from t",
    "sink_report": "with n as (select n_regionkey, n_name, count(*) as customers, cast(floor(max(c_acctbal)) as bigint) as largest from customer join nation on c_nationkey = n_nationkey group by 1, 2) select n_regionkey, '| n_name | customers | largest |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || customers || ' | ' || largest || ' |', chr(10) order by n_name) || chr(10) as report from n group by 1",
    "agg_report": "select count(*) as packets_written, count(*) filter (event_type = 'purchase') as frames_decoded from events",
    "lab_ladder": "select event_type as class, bitrate::bigint as bitrate from (select distinct event_type from events), (values (48000), (64000), (96000), (128000), (192000)) b(bitrate)",
}
