"""Measurement layer: frame quality, rate-distortion, stage and timing statistics.

Inputs are ordinary fact tables; every function is grouped aggregation, windows
partitioned by clip and small per-key joins, so cost follows the number of rows
and no key's rows have to fit one place except ladders (a few points a clip).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- frame quality -----------------------------------------------------------


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """dB; 99 where nothing differs."""
    return F.when(mse <= 0, F.lit(99.0)).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


def frame_pairs(ref: DataFrame, dec: DataFrame) -> DataFrame:
    """Luma samples ``a`` (reference) and ``b`` (decoded), paired by frame number."""
    key = ["clip", "frame_no", "y", "x"]
    side = lambda df, n: df.where("plane = 0").select(*key, F.col("v").alias(n))
    return side(ref, "a").join(side(dec, "b"), key)


def psnr_by_frame(pairs: DataFrame) -> DataFrame:
    sse = pairs.groupBy("clip", "frame_no").agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("sse"), F.count("*").alias("n"))
    return sse.select("clip", "frame_no", "sse", psnr(F.col("sse") / F.col("n")).alias("psnr"))


def psnr_pooled(pairs: DataFrame) -> DataFrame:
    """One PSNR over the squared error of all frames, from per-frame partial sums."""
    part = pairs.groupBy("clip", "frame_no").agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("sse"), F.count("*").alias("n"))
    return part.agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).select("sse", "n", psnr(F.col("sse") / F.col("n")).alias("psnr"))


def ssim(pairs: DataFrame, w: int, h: int, block: int = 8) -> DataFrame:
    """Mean SSIM of whole non-overlapping luma windows; cut-off ones are left out."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    n = float(block * block)
    m = (
        pairs.where(f"y < {h // block * block} and x < {w // block * block}")
        .groupBy("clip", "frame_no", F.expr(f"y div {block}").alias("by"), F.expr(f"x div {block}").alias("bx"))
        .agg(*[F.sum(F.expr(e)).alias(k) for k, e in (("sa", "a"), ("sb", "b"), ("saa", "a * a"), ("sbb", "b * b"), ("sab", "a * b"))])
        .selectExpr("clip", "frame_no", *[f"{k} / {n}D as {k[1:]}" for k in ("sa", "sb", "saa", "sbb", "sab")])
    )
    one = F.expr(
        f"((2D * a * b + {c1}D) * (2D * (ab - a * b) + {c2}D)) / ((a * a + b * b + {c1}D) * (aa - a * a + bb - b * b + {c2}D))"
    )
    return m.select("clip", "frame_no", one.alias("s")).groupBy("clip", "frame_no").agg(F.avg("s").alias("ssim"))


def error_stats(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``n, max_abs_err, rmse, psnr_db`` of ``a`` against ``b``, peak 1.0; PSNR is
    null where nothing differs."""
    e = F.abs(F.col("a") - F.col("b"))
    return _with_db(pairs.groupBy(*key).agg(F.count("*").alias("n"), F.max(e).alias("max_abs_err"), F.sqrt(F.avg(e * e)).alias("rmse")))


def merge_error_stats(parts: DataFrame, key: list[str]) -> DataFrame:
    """Sample-weighted merge of partial :func:`error_stats` rows."""
    g = parts.groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("max_abs_err").alias("max_abs_err"), F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * F.col("n")) / F.sum("n")).alias("rmse")
    )
    return _with_db(g)


def _with_db(df: DataFrame) -> DataFrame:
    return df.withColumn("psnr_db", F.when(F.col("rmse") > 0, 20 * F.log10(1 / F.col("rmse"))))


# --- rate-distortion ---------------------------------------------------------


def _curve(points: DataFrame) -> tuple[DataFrame, Window]:
    w = Window.partitionBy("clip", "arm").orderBy("psnr", "kbps")
    return points, w


def overlap(points: DataFrame) -> DataFrame:
    """Quality range both arms (0 anchor, 1 candidate) cover, for clips in both."""
    ends = points.groupBy("clip", "arm").agg(F.min("psnr").alias("a"), F.max("psnr").alias("b"))
    return ends.groupBy("clip").agg(F.max("a").alias("lo"), F.min("b").alias("hi"), F.count("*").alias("arms")).where("arms = 2").drop("arms")


def bd_pchip(points: DataFrame, samples: int = 200, least: float = 0.5) -> DataFrame:
    """Mean log-rate difference over the shared quality range, in percent, with
    monotone cubic interpolation of log10 rate over PSNR.

    ``points(clip, arm, psnr, kbps, wall_ms)``, positive rates.  Returns a row
    per clip in both arms: ``bd_rate`` (null where less than ``least`` dB
    overlap), ``overlap_db``, ``points_inside``, ``anchor_monotone``,
    ``cand_monotone`` and ``speed`` (anchor time by candidate time).
    """
    p, w = _curve(points.where("kbps > 0 and not isnan(psnr)"))
    p = p.withColumns({"lg": F.log10("kbps")}).withColumns({
        "nx": F.lead("psnr").over(w), "ny": F.lead("lg").over(w), "rises": F.coalesce(F.lead("kbps").over(w) > F.col("kbps"), F.lit(True)),
    })
    p = p.withColumn("h", F.col("nx") - F.col("psnr")).withColumn("d", (F.col("ny") - F.col("lg")) / F.col("h"))
    p = p.withColumns({"ph": F.lag("h").over(w), "pd": F.lag("d").over(w)})
    slope = (
        F.when(F.col("pd").isNull(), F.col("d")).when(F.col("d").isNull(), F.col("pd")).when(F.col("pd") * F.col("d") <= 0, F.lit(0.0))
        .otherwise(F.expr("((2 * h + ph) + (h + 2 * ph)) / ((2 * h + ph) / pd + (h + 2 * ph) / d)"))
    )
    p = p.withColumn("m", slope).withColumn("nm", F.lead("m").over(w))
    o = overlap(points)
    side = (
        p.join(o, "clip").groupBy("clip", "arm")
        .agg(F.count_if(F.expr("psnr between lo and hi")).alias("inside"), F.min("rises").alias("mono"), F.sum("wall_ms").alias("ms"))
        .groupBy("clip")
        .agg(
            F.sum("inside").alias("points_inside"), F.bool_and(F.expr("mono or arm <> 0")).alias("anchor_monotone"), F.bool_and(F.expr("mono or arm <> 1")).alias("cand_monotone"),
            (F.sum(F.expr("if(arm = 0, ms, 0)")) / F.sum(F.expr("if(arm = 1, ms, 0)"))).alias("speed"),
        )
    )
    grid = o.where(f"hi - lo >= {least}").select("clip", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i")).selectExpr("clip", "i", f"lo + (hi - lo) * i / {samples}D as t")
    at = grid.join(p.where("nx is not null"), "clip").where("psnr <= t and t <= nx")
    s = "((t - psnr) / h)"
    value = F.expr(
        f"(2 * pow({s}, 3) - 3 * pow({s}, 2) + 1) * lg + (pow({s}, 3) - 2 * pow({s}, 2) + {s}) * h * m"
        f" + (-2 * pow({s}, 3) + 3 * pow({s}, 2)) * ny + (pow({s}, 3) - pow({s}, 2)) * h * nm"
    )
    first = at.groupBy("clip", "i", "arm").agg(F.min_by(value, "psnr").alias("y"))
    diff = first.groupBy("clip").agg((F.sum(F.expr("if(arm = 1, y, -y)")) / (samples + 1)).alias("mean"), F.count("*").alias("k")).where(f"k = {2 * (samples + 1)}")
    return (
        o.join(side, "clip").join(diff, "clip", "left")
        .selectExpr("clip", "(pow(10D, mean) - 1) * 100 as bd_rate", "hi - lo as overlap_db", "points_inside", "anchor_monotone", "cand_monotone", "speed")
    )


def _det(m: list[list[str]]) -> str:
    """SQL of the determinant of a matrix of SQL terms."""
    n = len(m)
    terms = []
    for perm in itertools.permutations(range(n)):
        sign = sum(perm[i] > perm[j] for i in range(n) for j in range(i + 1, n)) % 2
        terms.append(("-" if sign else "+") + " * ".join(m[i][perm[i]] for i in range(n)))
    return "(" + " ".join(terms) + ")"


def cubic_coefficients() -> list[str]:
    """SQL of the least-squares cubic's coefficients from the moments s0..s6 of
    z and t0..t3 of z^k * y (Cramer's rule)."""
    a = [[f"s{i + j}" for j in range(4)] for i in range(4)]
    out = []
    for c in range(4):
        b = [[f"t{i}" if j == c else a[i][j] for j in range(4)] for i in range(4)]
        out.append(f"{_det(b)} / {_det(a)}")
    return out


def bd_cubic(points: DataFrame) -> DataFrame:
    """BD-rate with one cubic fitted to log10 rate over PSNR, integrated in
    closed form; 0 where nothing overlaps.  PSNR is centred on the overlap, which
    does not change the fit and keeps its equations well conditioned."""
    o = overlap(points)
    z = points.join(o, "clip").selectExpr("clip", "arm", "lo", "hi", "psnr - (lo + hi) / 2 as z", "log10(greatest(kbps, 1D)) as y")
    m = z.groupBy("clip", "arm").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(F.expr(f"pow(z, {k})")).alias(f"s{k}") for k in range(7)], *[F.sum(F.expr(f"pow(z, {k}) * y")).alias(f"t{k}") for k in range(4)]
    )
    c = m.selectExpr("clip", "arm", "lo", "hi", *[f"{e} as c{i}" for i, e in enumerate(cubic_coefficients())])
    # over [-r, r] odd powers vanish
    area = c.selectExpr("clip", "arm", "lo", "hi", "2 * (c0 * (hi - lo) / 2 + c2 * pow((hi - lo) / 2, 3) / 3) as area")
    g = area.groupBy("clip").agg(F.max(F.expr("hi - lo")).alias("w"), F.sum(F.expr("if(arm = 1, area, -area)")).alias("d"))
    return g.selectExpr("clip", "case when w <= 0 then 0D else (pow(10D, d / w) - 1) * 100 end as bd_rate")


def bd_linear(points: DataFrame, steps: int = 64) -> DataFrame:
    """BD-rate with linear interpolation of ln rate and the trapezoid rule; null
    where nothing overlaps."""
    p, w = _curve(points)
    p = p.withColumns({"ln": F.log("kbps")}).withColumns({"nx": F.lead("psnr").over(w), "nl": F.lead("ln").over(w)}).where("nx is not null")
    o = overlap(points)
    grid = o.where("hi > lo").select("clip", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).selectExpr("clip", "i", f"lo + (hi - lo) * i / {steps}D as q", f"if(i in (0, {steps}), 0.5D, 1D) as wt")
    y = F.expr("if(nx - psnr < 1e-12, ln, ln + (q - psnr) / (nx - psnr) * (nl - ln))")
    first = grid.join(p, "clip").where("psnr <= q and q <= nx").groupBy("clip", "i", "arm").agg(F.min_by(y, "psnr").alias("y"), F.max("wt").alias("wt"))
    d = first.groupBy("clip").agg(F.sum(F.expr("if(arm = 1, wt * y, -wt * y)")).alias("s"), F.count("*").alias("k")).where(f"k = {2 * (steps + 1)}")
    return o.join(d, "clip", "left").selectExpr("clip", f"expm1(s / {steps}) * 100 as bd_rate")


def iso_quality(points: DataFrame) -> DataFrame:
    """Time and rate of both arms at the middle of the shared quality range, by
    linear interpolation: ``clip, q, time_ratio, rate_ratio`` (arm 1 by arm 0)."""
    p, w = _curve(points)
    p = p.withColumns({"nx": F.lead("psnr").over(w), "nms": F.lead("wall_ms").over(w), "nk": F.lead("kbps").over(w)}).where("nx is not null")
    o = overlap(points).where("hi > lo").selectExpr("clip", "lo + 0.5D * (hi - lo) as q")
    f = "if(nx = psnr, 0D, (q - psnr) / (nx - psnr))"
    at = (
        o.join(p, "clip").where("psnr <= q and q <= nx").groupBy("clip", "q", "arm")
        .agg(F.min_by(F.expr(f"wall_ms + {f} * (nms - wall_ms)"), "psnr").alias("ms"), F.min_by(F.expr(f"kbps + {f} * (nk - kbps)"), "psnr").alias("k"))
    )
    pick = lambda c, a: F.max(F.expr(f"if(arm = {a}, {c}, null)"))
    return at.groupBy("clip", "q").agg((pick("ms", 1) / pick("ms", 0)).alias("time_ratio"), (pick("k", 1) / pick("k", 0)).alias("rate_ratio")).where("time_ratio is not null")


def geomean(c: Column) -> Column:
    return F.exp(F.avg(F.log(c)))


# --- stages and timing -------------------------------------------------------


def stage_report(stages: DataFrame, key: list[str]) -> DataFrame:
    """Time, calls and share of each stage of ``stages(stage, scope, ms, calls)``.

    The whole is the ``TOTAL`` stage where it has time, else the sum of the
    ``self`` stages; at least 1e-9."""
    s = stages.groupBy(*key, "stage").agg(F.min("scope").alias("scope"), F.sum("ms").alias("ms"), F.sum("calls").alias("calls"))
    w = Window.partitionBy(*key)
    named = F.max(F.when(F.col("stage") == "TOTAL", F.col("ms"))).over(w)
    own = F.sum(F.when((F.col("scope") == "self") & (F.col("stage") != "TOTAL"), F.col("ms")).otherwise(0.0)).over(w)
    total = F.greatest(F.when(named > 0, named).otherwise(own), F.lit(1e-9))
    return s.select(*key, "stage", "scope", "ms", "calls", (100 * F.col("ms") / total).alias("pct"), ns_per_call().alias("ns_per_call"))


def ns_per_call() -> Column:
    return F.when(F.col("calls") > 0, F.col("ms") * 1e6 / F.col("calls")).otherwise(0.0)


def top_stages(report: DataFrame, key: list[str], k: int) -> DataFrame:
    """The ``k`` largest stages of each key; ties by name."""
    w = Window.partitionBy(*key).orderBy(F.desc("ms"), "stage")
    return report.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def throughput(runs: DataFrame) -> DataFrame:
    """``fps, mpx_s, kbps`` of ``runs(width, height, frames, wall_ms, bytes, rate)``."""
    secs = F.greatest(F.col("wall_ms") / 1e3, F.lit(1e-9))
    dur = F.col("frames") / F.greatest(F.col("rate"), F.lit(1e-9))
    return runs.withColumns({
        "fps": F.col("frames") / secs, "mpx_s": F.col("width") * F.col("height") * F.col("frames") / secs / 1e6,
        "kbps": F.when((F.col("bytes") > 0) & (dur > 0), F.col("bytes") * 8.0 / dur / 1e3).otherwise(0.0),
    })


#: zero-based index of a sorted list of ``n`` values
UPPER_MEDIAN = "n div 2"


def nearest_rank(q: float) -> str:
    """Index expression of the nearest-rank quantile: round((n - 1) * q)."""
    return f"cast(floor((n - 1) * {q}D + 0.5D) as bigint)"


def order_statistics(df: DataFrame, key: list[str], value: str, at: dict[str, str]) -> DataFrame:
    """Exact order statistics of each key, null values left out.

    ``at`` maps result names to index expressions over ``n``, the number of
    values.  Equal values are counted map-side first and the running count is a
    window that can spill, so a hot key is never gathered in memory.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    up_to = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"_c": F.sum("_k").over(up_to), "n": F.sum("_k").over(Window.partitionBy(*key))})
    return c.groupBy(*key).agg(*[F.min(F.expr(f"if(_c > {i}, _v, null)")).alias(name) for name, i in at.items()], F.max("n").alias("n"))


def best_of(samples: DataFrame, key: list[str], startup_ms: float = 0.0) -> DataFrame:
    """Fastest repetition, net of start-up time, at least one microsecond."""
    return samples.groupBy(*key).agg(F.greatest(F.min("ms") - startup_ms, F.lit(1e-3)).alias("best_ms"))


def paired(samples: DataFrame, key: list[str]) -> DataFrame:
    """Rounds of both arms of ``samples(round, arm, ms)``: ``a, b`` by round."""
    g = samples.groupBy(*key, "round").agg(F.max(F.when(F.col("arm") == 0, F.col("ms"))).alias("a"), F.max(F.when(F.col("arm") == 1, F.col("ms"))).alias("b"))
    return g.where("a is not null and b is not null")


def win_z(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Rounds arm A won and the sign test's z = (w - n/2) / (0.5 sqrt n)."""
    g = pairs.groupBy(*key).agg(F.count_if(F.expr("a < b")).alias("wins"), F.count("*").alias("rounds"))
    g = g.withColumn("z", (F.col("wins") - F.col("rounds") / 2) / (0.5 * F.sqrt("rounds")))
    return g.withColumn("verdict", F.when(F.col("z") > 2, "A faster").when(F.col("z") < -2, "B faster").otherwise("noise"))


def null_arm(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Best-of difference of two equal arms in percent and worst by best."""
    return pairs.groupBy(*key).agg(
        ((F.min("b") - F.min("a")) / F.min("a") * 100).alias("delta_pct"), (F.greatest(F.max("a"), F.max("b")) / F.least(F.min("a"), F.min("b"))).alias("worst_by_best")
    )


def null_median(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Upper median and worst of |a - b| in percent of a."""
    d = F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("a"), F.lit(1e-9)) * 100
    return order_statistics(pairs.withColumn("d", d), key, "d", {"median_pct": UPPER_MEDIAN, "worst_pct": "n - 1"}).drop("n")


def split_of(name: Column) -> Column:
    """Train or holdout by the parity of a 31-fold byte hash of the name."""
    h = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.octet_length(name)), lambda i: F.conv(F.hex(F.substring(F.encode(name, "utf-8"), i, F.lit(1))), 16, 10).cast("bigint")),
        F.lit(0).cast("bigint"), lambda a, b: (a * 31 + b) % 4294967296,
    )
    return F.when(F.octet_length(name) == 0, "train").when(h % 2 == 0, "train").otherwise("holdout")


def average_rank(value: str, partition: list[str]) -> Column:
    """1-based rank, ties sharing their mean rank."""
    w, same = Window.partitionBy(*partition).orderBy(value), Window.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def correlations(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns within each key.

    Ranks need one sort of each key's rows; keys are ordinary shuffle keys."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, x, y)
    r = r.withColumns({"rx": average_rank(x, key), "ry": average_rank(y, key)})
    return r.groupBy(*key).agg(F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def head_to_head(bench: DataFrame) -> DataFrame:
    """Throughput of three codecs side by side per clip and kind; decode rows
    count only on the common bitstream; clips with none of the first two drop."""
    b = bench.where("kind = 'encode' or source = 'libvpx'")
    pick = lambda c: F.max(F.when(F.col("codec") == c, F.col("mpx_s"))).alias(c)
    g = b.groupBy("clip", "kind").agg(pick("ours"), pick("libvpx"), pick("ffmpeg")).where("ours is not null or libvpx is not null")
    return g.withColumn("ratio", F.when(F.col("libvpx") > 0, F.col("ours") / F.col("libvpx")))


# --- image content -----------------------------------------------------------


def colour_census(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("r", "g", "b", "a").agg(F.count("*").alias("n"))


def kmeans_step(points: DataFrame, centres: DataFrame, dims: list[str]) -> DataFrame:
    """One weighted assign-and-mean step of ``points(*dims, w)`` against a
    palette ``centres(k, *dims)`` of at most 256 rows, which is broadcast."""
    if centres.count() > 256:
        raise ValueError("a palette has at most 256 entries")
    c = F.broadcast(centres.select(F.collect_list(F.struct("k", *dims)).alias("cs")))
    dist = " + ".join(f"(p.{d} - c.{d}) * (p.{d} - c.{d})" for d in dims)
    own = F.expr(f"array_min(transform(cs, c -> struct({dist.replace('p.', '')} as d2, c.k as k)))")
    near = points.crossJoin(c).select(*dims, "w", own.alias("o"))
    return near.groupBy(F.col("o.k").alias("k")).agg(*[(F.sum(F.col(d) * F.col("w")) / F.sum("w")).alias(d) for d in dims], F.sum("w").alias("w"), F.sum(F.col("o.d2") * F.col("w")).alias("sse"))


def colour_kind(pixels: DataFrame, key: list[str]) -> DataFrame:
    """gray, gray_alpha, indexed (up to 256 colours) or truecolour."""
    g = pixels.groupBy(*key).agg(F.bool_and(F.expr("r = g and g = b")).alias("gray"), F.bool_and(F.expr("a = 255")).alias("opaque"), F.count_distinct("r", "g", "b", "a").alias("colours"))
    kind = F.when(F.col("gray") & F.col("opaque"), "gray").when(F.col("gray"), "gray_alpha").when(F.col("colours") <= 256, "indexed").otherwise("truecolour")
    return g.select(*key, "colours", kind.alias("kind"))


def repeat_fraction(pixels: DataFrame, key: list[str], height: int, least: float = 0.35) -> DataFrame:
    """Share of pixels equal to their left neighbour on every (height / 64)-th
    row; at least ``least`` means graphics."""
    step = max(height // 64, 1)
    w = Window.partitionBy(*key, "y").orderBy("x")
    c = F.struct("r", "g", "b", "a")
    r = pixels.where(F.col("y") % step == 0).select(*key, c.eqNullSafe(F.lag(c).over(w)).cast("double").alias("same"), F.row_number().over(w).alias("i")).where("i > 1")
    return r.groupBy(*key).agg(F.avg("same").alias("repeated")).withColumn("graphics", F.col("repeated") >= least)


def variance_tree(pixels: DataFrame) -> DataFrame:
    """Sum, sum of squares and variance of luma blocks of 8, 16, 32 and 64; each
    level is aggregated from the one below."""
    out, level = None, None
    for size in (8, 16, 32, 64):
        src = pixels.where("plane = 0").select("clip", "frame_no", "y", "x", F.col("v").alias("s"), (F.col("v") * F.col("v")).alias("q")) if level is None else level
        step = 8 if level is None else 2
        level = src.groupBy("clip", "frame_no", F.expr(f"y div {step}").alias("y"), F.expr(f"x div {step}").alias("x")).agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
        rows = level.selectExpr("clip", "frame_no", f"{size}L as size", "y as r", "x as c", "s as total", "q as squares", f"256 * (q - s * s div {size * size}) div {size * size} as variance")
        out = rows if out is None else out.unionByName(rows)
    return out


def markdown_tables(rows: DataFrame, key: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """``key, report``: the rows of each key as a Markdown table, sorted by ``order``
    and then by their text; nulls are empty cells and bars are escaped.  For
    summaries: a key's rows become one string."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    sorted_lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.array_join(F.transform(sorted_lines, lambda s: s["_line"]), "\n")
    return rows.groupBy(*key).agg(F.concat(F.lit(head + "\n"), body, F.lit("\n")).alias("report"))
