"""Audio samples ``(clip, ch, n, v)``: conversion, resampling, lossless-coding
cost kernels and content signals.

Weight tables are small (bounded by phases x taps) and broadcast; sums over a
window are partial aggregates; per-block work is keyed by block, so a long clip
spreads over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import deal
from .scan import affine_scan

TAPS = 32
WIDTH = 2 * TAPS
MAX_PHASES = 8192
#: Samples of a clip in a row that are resampled in one task.
STRETCH = 1 << 14
TWO_PI = 2 * math.pi


# --- conversion --------------------------------------------------------------


def s16_to_f32(v: Column) -> Column:
    return v / 32768.0


def f32_to_s16(v: Column) -> Column:
    """Scale by 32768, round half away from zero, clamp."""
    x = v * 32768.0
    r = F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5))
    return F.greatest(F.least(r, F.lit(32767)), F.lit(-32768)).cast("bigint")


def deinterleave(samples: DataFrame, channels: int) -> DataFrame:
    return samples.select("clip", F.expr(f"n % {channels}").alias("ch"), F.expr(f"n div {channels}").alias("n"), "v")


def nearest_rate(rate: Column, accepted: list[int]) -> Column:
    """The accepted rate closest to ``rate``; ties go to the first listed."""
    options = F.array(*[F.struct(F.abs(rate - r).alias("gap"), F.lit(i).alias("place"), F.lit(r).cast("bigint").alias("rate")) for i, r in enumerate(accepted)])
    return F.array_min(options)["rate"]


def rescale_pts(pts: Column, in_rate: int, out_rate: int) -> Column:
    return F.floor(pts * out_rate / in_rate).cast("bigint")


# --- resampling --------------------------------------------------------------


def kernel(x: Column, cutoff: float) -> Column:
    """Windowed sinc: 4-term Blackman-Harris over [-TAPS, TAPS]."""
    t = (x + TAPS) / (2.0 * TAPS)
    # fixed values: the four terms of the window
    window = 0.35875 - 0.48829 * F.cos(TWO_PI * t) + 0.14128 * F.cos(2 * TWO_PI * t) - 0.01168 * F.cos(3 * TWO_PI * t)
    px = F.lit(math.pi) * (2 * cutoff) * x
    sinc = F.when(x == 0, 1.0).otherwise(F.sin(px) / px)
    return F.when(F.abs(x) > TAPS, 0.0).otherwise(2 * cutoff * sinc * window)


def poly_table(spark: SparkSession, in_rate: int, out_rate: int) -> tuple[DataFrame, int, int]:
    """Normalised weights ``phase, k, w`` of each phase, with the steps num and
    den of the reduced rate ratio.  Few rows (den x WIDTH): broadcast it."""
    g = math.gcd(in_rate, out_rate)
    num, den = in_rate // g, out_rate // g
    if den > MAX_PHASES:
        raise ValueError(f"{in_rate} to {out_rate} needs {den} phases")
    cutoff = 0.5 * min(1.0, out_rate / in_rate)
    t = spark.range(den * WIDTH).selectExpr(f"id div {WIDTH} as phase", f"id % {WIDTH} as k")
    t = t.withColumn("w", kernel(F.col("phase") / float(den) + (TAPS - 1 - F.col("k")), cutoff))
    total = F.sum("w").over(Window.partitionBy("phase"))
    return t.withColumn("w", F.col("w") / F.when(total == 0, 1.0).otherwise(total)), num, den


def resample(samples: DataFrame, in_rate: int, out_rate: int) -> DataFrame:
    """``clip, ch, m, y`` at ``out_rate``.

    Every input sample contributes to the outputs whose window covers it: input
    n reaches output m where n - q(m) lies within the taps, q(m) = m num div den.
    Samples are joined with the weight table by phase after each finds its few
    outputs, so nothing is joined by range and zero padding needs no rows.
    """
    if in_rate == out_rate:
        return samples.select("clip", "ch", F.col("n").alias("m"), F.col("v").cast("double").alias("y"))
    spark = samples.sparkSession
    table, num, den = poly_table(spark, in_rate, out_rate)
    # each stretch of a clip meets the clip's last place, so a long clip is many keys
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = samples.groupBy("clip", "ch").agg(F.max("n").alias("last")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    part = F.pmod(F.floor(F.col("n") / STRETCH), F.lit(spread)).cast("bigint")
    s = samples.withColumn("_part", part).join(last, ["clip", "ch", "_part"]).drop("_part")
    # q(m) between n - TAPS and n + TAPS - 1
    lo = F.greatest(F.ceil((F.col("n") - TAPS) * den / num), F.lit(0)).cast("bigint")
    hi = F.floor(((F.col("n") + TAPS) * den - 1) / num).cast("bigint")
    m = s.withColumn("m", F.explode(F.sequence(lo, hi)))
    m = m.withColumns({"q": F.expr(f"m * {num} div {den}"), "phase": F.expr(f"m * {num} % {den}")})
    m = m.withColumn("k", F.col("n") - F.col("q") + TAPS - 1).where(f"k between 0 and {WIDTH - 1}").where("q <= last")
    return m.join(F.broadcast(table), ["phase", "k"]).groupBy("clip", "ch", "m").agg(F.sum(F.col("v") * F.col("w")).alias("y"))


# --- lossless coding costs ---------------------------------------------------

BLOCK = 4096
RICE = range(15)


def quantise(v: Column, bps: int) -> Column:
    scale = float(1 << (bps - 1))
    x = v * scale
    r = F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5))
    return F.greatest(F.least(r, F.lit(scale - 1)), F.lit(-scale)).cast("bigint")


def blocks(samples: DataFrame, size: int = BLOCK) -> DataFrame:
    return samples.withColumns({"block": F.expr(f"n div {size}"), "i": F.expr(f"n % {size}")})


_BLOCK_KEY = ["clip", "ch", "block"]


def residuals(blocked: DataFrame, most: int = 4) -> DataFrame:
    """``clip, ch, block, i, ord, e``: finite differences of order 0 to ``most``
    within each block, without the first ``ord`` samples."""
    w = Window.partitionBy(*_BLOCK_KEY).orderBy("i")
    d = blocked.withColumn("e0", F.col("v"))
    for o in range(1, most + 1):
        d = d.withColumn(f"e{o}", F.col(f"e{o - 1}") - F.lag(f"e{o - 1}").over(w))
    each = F.explode(F.array(*[F.struct(F.lit(o).cast("bigint").alias("ord"), F.col(f"e{o}").alias("e")) for o in range(most + 1)])).alias("r")
    return d.select(*_BLOCK_KEY, "i", each).select(*_BLOCK_KEY, "i", "r.ord", "r.e").where("e is not null")


def zigzag(v: Column) -> Column:
    """Signed to unsigned by folding: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def rice_sums(e: str = "e") -> list[Column]:
    """For each parameter the sum of folded residuals shifted by it."""
    return [F.sum(F.shiftright(zigzag(F.col(e)), k)).alias(f"q{k}") for k in RICE]


def best_rice(count: str = "cnt") -> Column:
    """struct(bits, k) of the cheapest parameter from its sums; the lowest wins ties."""
    return F.array_min(F.array(*[F.struct((F.col(f"q{k}") + F.col(count) * (1 + k)).alias("bits"), F.lit(k).cast("bigint").alias("k")) for k in RICE]))


def rice(res: DataFrame, key: list[str]) -> DataFrame:
    g = res.groupBy(*key).agg(*rice_sums(), F.count("*").alias("cnt"))
    return g.select(*key, "cnt", best_rice().alias("r")).select(*key, "cnt", F.col("r.k").alias("k"), F.col("r.bits").alias("bits"))


def best_fixed(res: DataFrame, bps: int) -> DataFrame:
    """The predictor order of each block with the least warm-up plus Rice bits."""
    r = rice(res, [*_BLOCK_KEY, "ord"])
    # a block of n samples allows orders up to n - 1
    r = r.withColumn("pick", F.struct((F.col("ord") * bps + F.col("bits")).alias("cost"), F.col("ord").alias("ord")))
    g = r.groupBy(*_BLOCK_KEY).agg(F.min("pick").alias("p"), F.max(F.when(F.col("ord") == 0, F.col("cnt"))).alias("n"))
    return g.select(*_BLOCK_KEY, "n", F.col("p.ord").alias("ord"), F.col("p.cost").alias("cost"))


def partitions(res: DataFrame, chosen: DataFrame) -> DataFrame:
    """Partition order and residual bits of each block's chosen predictor.

    Sums are taken once at the finest partition a block allows and merged up the
    tree, so each residual is read once, not once for every partition order.
    """
    # orders are tried one by one, so the first that does not fit ends the search
    top = "coalesce(array_min(filter(sequence(1, 8), p -> n % shiftleft(1L, p) <> 0 or shiftright(n, p) <= ord)) - 1, 8)"
    c = chosen.select(*_BLOCK_KEY, "n", "ord", F.expr(top).alias("top"))
    fine = (
        res.join(c, [*_BLOCK_KEY, "ord"]).withColumn("part", F.expr("i div shiftright(n, top)"))
        .groupBy(*_BLOCK_KEY, "ord", "n", "top", "part").agg(*rice_sums(), F.count("*").alias("cnt"))
    )
    up = fine.withColumn("po", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("part", F.expr("shiftright(part, top - po)"))
    up = up.groupBy(*_BLOCK_KEY, "ord", "n", "po", "part").agg(*[F.sum(f"q{k}").alias(f"q{k}") for k in RICE], F.sum("cnt").alias("cnt"))
    cost = up.withColumn("b", best_rice()["bits"] + 4).groupBy(*_BLOCK_KEY, "ord", "n", "po").agg(F.sum("b").alias("bits"))
    g = cost.groupBy(*_BLOCK_KEY, "ord", "n").agg(F.min(F.struct("bits", "po")).alias("p"))
    return g.select(*_BLOCK_KEY, "ord", "n", F.col("p.po").cast("bigint").alias("po"), F.col("p.bits").alias("bits"))


def subframes(blocked: DataFrame, bps: Column) -> DataFrame:
    """``clip, ch, block, kind, bits`` without linear prediction: constant, fixed
    or verbatim.  ``bps`` may depend on ``ch``."""
    b = blocked.groupBy(*_BLOCK_KEY).agg(F.count("*").alias("n"), (F.min("v") == F.max("v")).alias("same")).withColumn("bps", bps)
    res = residuals(blocked)
    r = rice(res, [*_BLOCK_KEY, "ord"]).join(b.select(*_BLOCK_KEY, "bps", "n"), _BLOCK_KEY).where("ord = 0 or ord <= n - 1")
    pick = r.groupBy(*_BLOCK_KEY, "bps", "n").agg(F.min(F.struct((F.col("ord") * F.col("bps") + F.col("bits")).alias("cost"), F.col("ord").alias("ord"))).alias("p"))
    plan = partitions(res, pick.select(*_BLOCK_KEY, "n", F.col("p.ord").alias("ord"))).select(*_BLOCK_KEY, "ord", F.col("bits").alias("body"))
    j = b.join(plan, _BLOCK_KEY)
    fixed, verbatim = F.expr("8 + ord * bps + 6 + body"), F.expr("8 + n * bps")
    kind = F.when(F.col("same"), "constant").when(fixed <= verbatim, "fixed").otherwise("verbatim")
    bits = F.when(F.col("same"), F.expr("8 + bps")).when(fixed <= verbatim, fixed).otherwise(verbatim)
    return j.select(*_BLOCK_KEY, kind.alias("kind"), bits.cast("bigint").alias("bits"))


def stereo_mode(pairs: DataFrame, bps: int, size: int = BLOCK) -> DataFrame:
    """Cheapest stereo mode of each block of ``pairs(clip, n, l, r)``: ``clip,
    block, code, bits``; codes 1, 8, 9 and 10 are tried in order."""
    four = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("ch"), e.alias("v")) for i, e in enumerate((F.col("l"), F.col("r"), F.shiftright(F.col("l") + F.col("r"), 1), F.col("l") - F.col("r")))])).alias("e")
    s = subframes(blocks(pairs.select("clip", "n", four).select("clip", "n", "e.ch", "e.v"), size), F.when(F.col("ch") == 3, bps + 1).otherwise(bps))
    b = s.groupBy("clip", "block").agg(*[F.max(F.when(F.col("ch") == i, F.col("bits"))).alias(c) for i, c in enumerate("lrms")])
    modes = F.array(*[F.struct(F.expr(e).alias("bits"), F.lit(i).alias("place"), F.lit(code).cast("bigint").alias("code")) for i, (code, e) in enumerate(((1, "l + r"), (8, "l + s"), (9, "s + r"), (10, "m + s")))])
    return b.select("clip", "block", F.array_min(modes).alias("m")).select("clip", "block", F.col("m.code").alias("code"), F.col("m.bits").alias("bits"))


def tukey(i: Column, n: int, alpha: float) -> Column:
    """Tapered cosine window of ``n`` points."""
    edge = alpha * (n - 1) / 2
    up = 0.5 * (1 + F.cos(math.pi * (i / edge - 1)))
    down = 0.5 * (1 + F.cos(math.pi * ((i - (n - 1)) / edge + 1)))
    return F.when(i < edge, up).when(i > n - 1 - edge, down).otherwise(1.0)


def autocorrelation(windowed: DataFrame, lags: int) -> DataFrame:
    """``clip, ch, block, lag, r`` from ``(clip, ch, block, i, x)``: the sample a lag
    later is a window frame of the block, so rows are shuffled once by block and
    neither copied for each lag nor joined."""
    w = Window.partitionBy(*_BLOCK_KEY).orderBy("i")
    later = windowed.select(*_BLOCK_KEY, "x", *[F.sum("x").over(w.rangeBetween(k, k)).alias(f"_y{k}") for k in range(lags + 1)])
    r = F.array(*[F.sum(F.col("x") * F.col(f"_y{k}")) for k in range(lags + 1)])
    g = later.groupBy(*_BLOCK_KEY).agg(r.alias("_r")).select(*_BLOCK_KEY, F.posexplode("_r").alias("lag", "r"))
    return g.select(*_BLOCK_KEY, F.col("lag").cast("bigint").alias("lag"), "r").where("r is not null")


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Predictor coefficients and error of an autocorrelation sequence."""
    a, err = np.zeros(order), float(r[0])
    for i in range(order):
        if err <= 0:
            break
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err *= 1 - k * k
    return a, err


def lpc(autoc: DataFrame, order: int) -> DataFrame:
    """``clip, ch, block, coefficients, gain`` from :func:`autocorrelation`; one
    small array a block."""
    g = autoc.groupBy(*_BLOCK_KEY).agg(F.array_sort(F.collect_list(F.struct("lag", "r"))).alias("a"))
    g = g.select(*_BLOCK_KEY, F.transform("a", lambda s: s["r"]).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [levinson(np.array(x), order) if x[0] > 0 else (np.zeros(order), 0.0) for x in b.column("r").to_pylist()]
            first = [x[0] for x in b.column("r").to_pylist()]
            gain = [f / e if e > 0 else 1.0 for f, (_, e) in zip(first, got)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _BLOCK_KEY), pa.array([c.tolist() for c, _ in got]), pa.array(gain)], [*_BLOCK_KEY, "coefficients", "gain"])

    kinds = dict(g.dtypes)
    return g.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in _BLOCK_KEY) + ", coefficients array<double>, gain double")


# --- content signals ---------------------------------------------------------


def attack_ratio(energies: DataFrame, blocks: int | None = None) -> DataFrame:
    """Energy of each sub-block over a running average (3/4 old, 1/4 new) that
    is at least a thousandth of the clip's mean: ``clip, b, e, ratio``.

    ``energies(clip, b, e)``.  The average runs on from block to block, so sorted
    partitions are streamed with one number a clip in memory; with ``blocks`` a long
    clip is spread over so many tasks."""
    floor = energies.groupBy("clip").agg((F.avg("e") * 1e-3).alias("least"))
    if blocks:
        run = affine_scan(energies.select("clip", "b", F.col("e").cast("double").alias("e")), ["clip"], ["b"], F.lit(0.75), F.col("e") * 0.25, "_after", "_avg", blocks=blocks)
        return run.join(floor, "clip").select("clip", "b", "e", (F.col("e") / F.greatest("_avg", "least", F.lit(2.2250738585072014e-308))).alias("ratio"))
    dealt = energies.join(floor, "clip").select("clip", "b", F.col("e").cast("double").alias("e"), "least")
    dealt = deal(dealt, "clip").sortWithinPartitions("clip", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, avg = object(), 0.0
        for batch in batches:
            out = []
            for clip, e, least in zip(*(batch.column(c).to_pylist() for c in ("clip", "e", "least"))):
                if clip != now:
                    now, avg = clip, 0.0
                base = max(avg, least, 2.2250738585072014e-308)
                out.append(e / base)
                avg = 0.75 * avg + 0.25 * e
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("b"), batch.column("e"), pa.array(out, pa.float64())], ["clip", "b", "e", "ratio"])

    kind = dict(energies.dtypes)
    return dealt.mapInArrow(run, f"clip {kind['clip']}, b bigint, e double, ratio double")


def tonality(spectrum: DataFrame, key: list[str]) -> DataFrame:
    """Spectral flatness of ``(key, x)`` mapped to [0, 1]; 1 is a pure tone."""
    p = F.greatest(F.col("x") * F.col("x"), F.lit(1e-10))
    g = spectrum.groupBy(*key).agg(F.exp(F.avg(F.log(p))).alias("g"), F.avg(p).alias("a"))
    sfm = 10 * F.log10(F.col("g") / F.greatest(F.col("a"), F.lit(1e-30)))
    return g.select(*key, F.greatest(F.least(sfm / -60.0, F.lit(1.0)), F.lit(0.0)).alias("tonality"))


def perceptual_entropy(bands: DataFrame, key: list[str]) -> DataFrame:
    """Sum over bands ``(key, lines, energy, threshold)`` of lines x log2(1 + E/T)."""
    return bands.groupBy(*key).agg(F.sum(F.col("lines") * F.log2(1 + F.col("energy") / F.greatest(F.col("threshold"), F.lit(1e-20)))).alias("pe"))


def _dbfs(x: Column) -> Column:
    return F.when(x <= 1e-9, -180.0).otherwise(20 * F.log10(x))


def loudness(samples: DataFrame, key: list[str]) -> DataFrame:
    g = samples.groupBy(*key).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.max(F.abs("v")).alias("peak"))
    return g.select(*key, _dbfs(F.col("rms")).alias("loudness_dbfs"), _dbfs(F.col("peak")).alias("peak_dbfs"))


def rolloff(spectrum: DataFrame, key: list[str], share: float = 0.95) -> DataFrame:
    """First bin ``i`` up to which ``share`` of the energy lies."""
    w = Window.partitionBy(*key).orderBy("i")
    e = F.col("x") * F.col("x")
    s = spectrum.withColumns({"run": F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(e).over(Window.partitionBy(*key))})
    return s.groupBy(*key).agg(F.min(F.when(F.col("run") >= F.col("total") * share, F.col("i"))).alias("bin"))


def cross_correlation(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Normalised dot product of ``l`` and ``r``, not centred on the mean."""
    g = pairs.groupBy(*key).agg(F.sum(F.col("l") * F.col("r")).alias("d"), F.sum(F.col("l") * F.col("l")).alias("a"), F.sum(F.col("r") * F.col("r")).alias("b"))
    return g.select(*key, (F.col("d") / F.greatest(F.sqrt("a") * F.sqrt("b"), F.lit(1e-20))).alias("corr"))


#: Samples of a block in which delays are tried.
DELAY_BLOCK = 64


def align_delay(ref: DataFrame, dec: DataFrame, shifts: list[int], key: list[str]) -> DataFrame:
    """The shift of ``dec`` (a few dozen candidates) with the least mean squared
    error against ``ref``; ties go to the smallest.

    Both are dealt by short blocks of ``ref``: a sample of ``dec`` goes to the one to
    three blocks that neighbouring shifts take it to, and is tried with all of them
    there, so pairs are made within tasks and neither shuffled nor broadcast."""
    block = lambda n: F.floor(n / DELAY_BLOCK).cast("bigint")
    reached = F.array_distinct(F.array(*[block(F.col("n") - s) for s in sorted(set(shifts))]))
    d = dec.select(*key, F.col("n").alias("_n"), F.col("v").alias("d"), F.explode(reached).alias("_block"))
    r = ref.select(*key, "n", "v", block(F.col("n")).alias("_block"))
    pairs = r.join(d.hint("merge"), [*key, "_block"]).withColumn("shift", F.col("_n") - F.col("n")).where(F.col("shift").isin(sorted(set(shifts))))
    g = pairs.groupBy(*key, "shift").agg(F.avg((F.col("v") - F.col("d")) * (F.col("v") - F.col("d"))).alias("mse"))
    return g.groupBy(*key).agg(F.min(F.struct("mse", "shift")).alias("p")).select(*key, F.col("p.shift").alias("shift"), F.col("p.mse").alias("mse"))


def power_quantise(x: Column) -> Column:
    """nint(|x| ** 0.75 - 0.0946) with the sign of x, at most 8206."""
    return (F.signum(x) * F.greatest(F.least(F.floor(F.pow(F.abs(x), 0.75) - 0.0946 + 0.5), F.lit(8206.0)), F.lit(0.0))).cast("bigint")


def power_dequantise(level: Column) -> Column:
    return F.signum(level.cast("double")) * F.pow(F.abs(level).cast("double"), 4 / 3)


def mdct(blocked: DataFrame, n: int) -> DataFrame:
    """``clip, block, k, x`` of blocks of ``2 n`` samples ``(clip, block, i, v)``
    by a basis table of 2 n x n rows, which is broadcast: for small n."""
    if n > 256:
        raise ValueError("use a NumPy transform for long blocks")
    basis = blocked.sparkSession.range(2 * n * n).selectExpr(f"id div {n} as i", f"id % {n} as k").withColumn("c", F.cos(F.lit(math.pi / n) * (F.col("i") + 0.5 + n / 2) * (F.col("k") + 0.5)))
    return blocked.join(F.broadcast(basis), "i").groupBy("clip", "block", "k").agg(F.sum(F.col("v") * F.col("c")).alias("x"))


def power_spectrum(frames: DataFrame) -> DataFrame:
    """Frames ``(clip, block, xs ARRAY<DOUBLE>)`` as Hann-windowed power spectra
    ``clip, block, bin, p``: one NumPy transform a batch, rows independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                x = np.array(b.column("xs")[at].as_py(), np.float64)
                p = np.abs(np.fft.rfft(x * np.hanning(len(x) + 1)[:-1])) ** 2
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("clip")[at].as_py()] * n), pa.array([b.column("block")[at].as_py()] * n, pa.int64()), pa.array(np.arange(n)), pa.array(p)], ["clip", "block", "bin", "p"]
                )

    return frames.mapInArrow(run, "clip string, block bigint, bin bigint, p double")


def tone(spark: SparkSession, clip: str, rate: int, hz: float, amplitude: float, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(clip).alias("clip"), F.lit(0).cast("bigint").alias("ch"), F.col("id").alias("n"), (F.lit(amplitude) * F.sin(F.lit(TWO_PI * hz / rate) * F.col("id"))).alias("v"))


def tones(voices: DataFrame, rate: int, n: int) -> DataFrame:
    """``n`` samples ``clip, ch, n, v`` of a sine for each of ``voices (clip, hz,
    amplitude)``."""
    v = voices.withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return v.select("clip", F.lit(0).cast("bigint").alias("ch"), "n", (F.col("amplitude") * F.sin(F.lit(TWO_PI / rate) * F.col("hz") * F.col("n"))).alias("v"))


def nmr_summary(bands: DataFrame, key: list[str]) -> DataFrame:
    """Noise-to-mask summary of ``(key, noise, mask)`` energies in frames and
    bands: mean and largest dB and the share of audible bands; the mask is at
    least 1e-5 of the largest in the group."""
    floor = F.max("mask").over(Window.partitionBy(*key)) * 1e-5
    b = bands.withColumn("db", 10 * F.log10(F.greatest(F.col("noise"), F.lit(1e-20)) / F.greatest(F.col("mask"), floor, F.lit(1e-20))))
    return b.groupBy(*key).agg(F.avg("db").alias("mean_db"), F.max("db").alias("max_db"), (F.count_if(F.col("db") > 0) * 100.0 / F.count("*")).alias("audible_pct"))


def quantiser_lab(samples: DataFrame, steps: list[float]) -> DataFrame:
    """Every uniform quantiser step against every signal: ``clip, step, n,
    max_abs_err, rmse``.  Variants are an array exploded on each row, so there is
    no join."""
    v = samples.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    e = F.abs(F.col("v") - F.floor(F.col("v") / F.col("step") + 0.5) * F.col("step"))
    return v.withColumn("e", e).groupBy("clip", "step").agg(F.count("*").alias("n"), F.max("e").alias("max_abs_err"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
