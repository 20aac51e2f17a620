"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells source x language x topic are raked until their sums
over each dimension meet the targets, with no cell giving more tokens than it
has; documents are then sampled with the probability that gives their cell its
raked share.  DataFrame operations only.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Workspace

DIMS = ("source", "lang", "topic")


def word_count(text: str = "text") -> Column:
    """Number of pieces between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text: str = "text") -> Column:
    """Coarse topic of a text by its form: table, licence, contact, listing or
    prose; empty for null and blank texts."""
    t = F.col(text)
    return (
        F.when(t.isNull() | (F.trim(t) == ""), "empty")
        .when(t.contains(" | "), "table")
        .when(t.contains("License") | t.contains("Copyright"), "licence")
        .when(t.contains("@"), "contact")
        .when(F.length(t) < 60 * (F.length(t) - F.length(F.translate(t, "\n", "")) + 1), "listing")
        .otherwise("prose")
    )


def tempered_targets(cells: DataFrame, power: float) -> DataFrame:
    """``dim, value, share``: marginal shares proportional to tokens ** power
    (1 keeps the data's own, 0 is uniform) over every value that has tokens."""
    out = None
    for dim in DIMS:
        t = (
            cells.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("value"))
            .agg(F.sum("tokens").alias("t"))
            .where("t > 0")
            .select("dim", "value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("share"))
        )
        out = t if out is None else out.unionByName(t)
    return out


def _keyed(df: DataFrame, names) -> DataFrame:
    """Adds ``k_<name>``: the value as text that is never null, so that a null is
    a value of its own in joins."""
    return df.select("*", *[F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")).alias(f"k_{n}") for n in names])


def feasible_targets(cells: DataFrame, targets: DataFrame, mass: float, work: Workspace) -> DataFrame:
    """``dim, value, share, available, target, full``: the expected tokens that
    each marginal can get when ``mass`` tokens are drawn without repetition.

    A value gets its share of the mass, but no more than the tokens it has; what
    it cannot take goes to the dimension's other values in proportion to their
    shares (water filling).  ``full``: every document of the value is needed.
    Values without tokens are left out.
    """
    have = None
    for dim in DIMS:
        t = cells.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("available"))
        have = t if have is None else have.unionByName(t)
    wanted = targets.where("share > 0").groupBy("dim", "value").agg(F.sum("share").cast("double").alias("share"))
    a, b = _keyed(have, ["value"]), _keyed(wanted, ["value"]).drop("value")
    values = work.table(a.join(b, ["dim", "k_value"]).where("available > 0"))
    # The filled mass is concave in the level, so Newton's steps rise to the
    # solution and end as soon as no further value fills up.
    level = {r["dim"]: mass / r["s"] for r in values.groupBy("dim").agg(F.sum("share").alias("s")).collect()}  # three rows at most
    at = lambda: F.element_at(F.create_map(*[F.lit(x) for kv in level.items() for x in kv]), F.col("dim")) * F.col("share")
    filled: dict = {}
    while level:
        over = at() >= F.col("available")
        sums = values.groupBy("dim").agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("available")).otherwise(0.0)).alias("c"), F.sum(F.when(over, 0.0).otherwise(F.col("share"))).alias("s")
        )
        now = {r["dim"]: (r["n"], r["c"], r["s"]) for r in sums.collect()}
        if now == filled:
            break
        filled = now
        level = {d: (mass - c) / s if s > 0 else level[d] for d, (_, c, s) in now.items()}
    if not level:
        return values.select("dim", "value", "k_value", "share", "available", F.lit(0.0).alias("target"), F.lit(False).alias("full"))
    return work.table(
        values.select("dim", "value", "k_value", "share", "available", F.least(at(), "available").alias("target"), (at() >= F.col("available")).alias("full"))
    )


#: Up to so many cells a round is a chain of windows; beyond it each dimension's
#: sums are aggregated map-side and joined back, so no value is one task.
WINDOW_CELLS = 200_000


def rake(cells: DataFrame, targets: DataFrame, work: Workspace, rate: float = 0.5, rounds: int = 120, tolerance: float = 1e-4, block: int = 3):
    """(``cells`` with ``probability``, feasible targets, largest gap).

    Finds the probabilities ``min(1, a[source] * b[lang] * c[topic])`` under which
    ``rate`` of all tokens are expected to be kept with the marginals of
    :func:`feasible_targets`: iterative proportional fitting in which cells that
    reach 1 stay there and the rest of their value carries the remainder.
    Cells of a value that is needed in full have probability 1.

    ``targets(dim, value, share)`` are normalised within a dimension.  Cells of a
    value that a dimension's targets do not name get 0; a dimension without any
    target is left free; cells without tokens get 1.  Ends when no marginal is
    off by more than ``tolerance`` of the kept mass, when the gap no longer
    shrinks (marginals that no sample meets together), or after ``rounds``; the
    gap left (as a share of the kept mass) is returned and warned about.
    """
    named = {r["dim"] for r in targets.where("share > 0").select("dim").distinct().collect()}
    dims = [d for d in DIMS if d in named]
    w = _keyed(cells, DIMS)
    wanted = _keyed(targets.where("share > 0").select("dim", "value").distinct(), ["value"])
    w = w.withColumn("allowed", F.lit(True))
    for d in dims:
        t = wanted.where(F.col("dim") == d).select(F.col("k_value").alias(f"k_{d}"), F.lit(True).alias("in_"))
        w = w.join(t, f"k_{d}", "left").withColumn("allowed", F.col("allowed") & F.coalesce("in_", F.lit(False))).drop("in_")
    w = work.table(w)
    open_ = w.where("allowed and tokens > 0")
    n, whole, free = w.agg(F.count("*"), F.sum("tokens"), F.sum(F.when(F.col("allowed"), F.col("tokens")).otherwise(0))).first()
    mass = float(min(rate * (whole or 0), free or 0))
    goal = feasible_targets(open_, targets.where(F.col("dim").isin(dims)), mass, work)
    w = w.withColumn("full", F.lit(mass >= (free or 0))).withColumn("ratio", F.lit(mass / free if free else 0.0))
    for d in dims:
        t = goal.where(F.col("dim") == d).select(F.col("k_value").alias(f"k_{d}"), F.col("target").alias(f"to_{d}"), F.col("full").alias("f_"))
        w = w.join(t, f"k_{d}", "left").withColumn("full", F.col("full") | F.coalesce("f_", F.lit(False))).drop("f_")
    w = work.table(w)
    wide = n > WINDOW_CELLS
    live = F.col("allowed") & (F.col("tokens") > 0)
    at_one = F.col("full") | (F.col("ratio") >= 1)
    fixed, loose = F.when(live & at_one, F.col("tokens")).otherwise(0.0), F.when(live & ~at_one, F.col("tokens") * F.col("ratio")).otherwise(0.0)

    def fit(df, d):
        if wide:
            sums = df.groupBy(f"k_{d}").agg(F.sum(fixed).alias("fixed"), F.sum(loose).alias("loose"))
            df = df.join(sums, f"k_{d}")
        else:
            over = Window.partitionBy(f"k_{d}")
            df = df.withColumns({"fixed": F.sum(fixed).over(over), "loose": F.sum(loose).over(over)})
        left = F.col(f"to_{d}") - F.col("fixed")
        # Newton's step; where even the cells at 1 are too much, all shrink.
        step = F.when((F.col("loose") > 0) & (left > 0), left / F.col("loose")).when(left < 0, F.col(f"to_{d}") / (F.col("fixed") + F.col("loose"))).otherwise(1.0)
        df = df.withColumn("ratio", F.when(F.col("full"), F.col("ratio")).otherwise(F.col("ratio") * F.coalesce(step, F.lit(1.0)))).drop("fixed", "loose")
        return work.table(df) if wide else df

    gap, done, stuck = 0.0, 0, 0
    while dims and mass > 0 and done < rounds:
        new = w
        for _ in range(block):
            for d in dims:
                new = fit(new, d)
        done += block
        new = work.table(new)
        kept = F.sum(F.when(live, F.col("tokens") * F.when(F.col("full"), 1.0).otherwise(F.least("ratio", F.lit(1.0)))).otherwise(0.0))
        gaps = [new.where(live).groupBy(f"k_{d}").agg(F.abs(kept - F.first(f"to_{d}")).alias("gap")).agg(F.max("gap").alias("gap")) for d in dims]
        for g in gaps[1:]:
            gaps[0] = gaps[0].unionByName(g)
        last, gap = gap, (gaps[0].agg(F.max("gap")).first()[0] or 0.0) / mass
        stuck = stuck + 1 if done > block and gap > 0.95 * last else 0
        work.drop(w)
        w = new
        if gap <= tolerance or stuck == 2:
            break
    if gap > tolerance:
        warnings.warn(f"raking stopped after {done} rounds with a marginal off by {gap:.4g} of the kept tokens", stacklevel=2)
    p = F.when(F.col("tokens") == 0, 1.0).when(~F.col("allowed"), 0.0).when(F.col("full"), 1.0).otherwise(F.least("ratio", F.lit(1.0)))
    return w.select(*DIMS, "tokens", "docs", p.alias("probability")), goal, gap


def _unit(seed: int, text: str = "text") -> Column:
    """A number in [0, 1) from the id (a null id: from the text) and ``seed``."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col(text), F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def calibrate(work: Workspace, rows: DataFrame, targets: DataFrame | None, power: float, rate: float) -> DataFrame:
    """``source, lang, topic, tokens, docs, probability`` of each cell of
    ``rows(source, lang, topic, n_tokens)``."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    cells = work.table(rows.groupBy(*DIMS).agg(F.sum(n).alias("tokens"), F.count("*").alias("docs")))
    return work.table(rake(cells, tempered_targets(cells, power) if targets is None else targets, work, rate)[0])


def margins(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """``dim, value, wanted, target, expected``: shares of the kept tokens that
    were asked for, that are feasible, and that ``cells`` are expected to give."""
    out = None
    for dim in DIMS:
        t = cells.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("value")).agg(F.sum(F.col("tokens") * F.col("probability")).alias("e"))
        out = t if out is None else out.unionByName(t)
    by_dim = Window.partitionBy("dim")
    joined = _keyed(out, ["value"]).join(goal.select("dim", "k_value", "share", "target"), ["dim", "k_value"])
    part = lambda c: F.col(c) / F.sum(c).over(by_dim)
    return joined.select("dim", "value", part("share").alias("wanted"), part("target").alias("target"), part("e").alias("expected"))


def decide(documents: DataFrame, chance: DataFrame) -> DataFrame:
    """``documents`` with the ``probability`` of their cell; a column of that name
    is replaced.  The cells are broadcast when counted to be at most 100,000,
    else shuffled."""
    small = chance.count() <= 100_000
    tag = f"cell_{uuid.uuid4().hex}"
    c = chance.select(F.struct(*DIMS, "probability").alias(tag))
    on = None
    for d in DIMS:
        same = documents[d].eqNullSafe(F.col(f"{tag}.{d}"))
        on = same if on is None else on & same
    names = [n for n in documents.columns if n.lower() != "probability"]
    return documents.join(F.broadcast(c) if small else c, on).select(*[documents[n] for n in names], F.col(f"{tag}.probability").alias("probability"))


def mix(
    spark: SparkSession,
    documents: DataFrame,
    targets: DataFrame | None = None,
    power: float = 0.5,
    rate: float = 0.5,
    seed: int = 17,
) -> DataFrame:
    """Sampling decision of every row of ``documents(doc_id, text, source, lang,
    topic, n_tokens)``.

    Returns ``doc_id, source, lang, topic, n_tokens, probability, kept``.  The
    probabilities keep ``rate`` of all tokens in expectation and meet the target
    marginals, as far as a sample without repetition can (:func:`rake`).  Without
    ``targets`` the marginals are tempered by ``power``.  A row is kept when a
    hash of its id (a null id: of its text) and ``seed`` falls under the
    probability, so equal rows are decided alike and a rerun after a lost
    executor repeats the decision.

    Null sources, languages and topics are values of their own; a null count is
    0.  Rows without tokens get their cell's probability, and are kept in a cell
    without any tokens.  An empty table gives an empty result; extra columns are
    ignored.  Cell sums are aggregated map-side, so a hot source costs nothing.
    """
    work = Workspace(spark, "mixing")
    rows = work.table(
        documents.select(
            "doc_id", *[F.col(d).cast("string").alias(d) for d in DIMS], F.col("n_tokens").cast("bigint").alias("n_tokens"), _unit(seed).alias("unit")
        )
    )
    out = decide(rows, calibrate(work, rows, targets, power, rate))
    return out.select("doc_id", *DIMS, "n_tokens", "probability", (F.col("unit") < F.col("probability")).alias("kept"))


def sample(spark: SparkSession, documents: DataFrame, power: float = 0.5, rate: float = 0.5, seed: int = 17) -> DataFrame:
    """The kept rows of ``documents(doc_id, text, source, lang, topic, n_tokens,
    ...)`` with all their columns and ``probability`` (an input column of that
    name is replaced); decided as by :func:`mix`, with its treatment of nulls,
    ties and empty tables.  Repeated rows are kept or dropped together.  Texts
    are not shuffled while the cells fit a broadcast."""
    work = Workspace(spark, "mixing")
    chance = calibrate(work, documents.select(*DIMS, "n_tokens"), None, power, rate)
    return decide(documents, chance).where(_unit(seed) < F.col("probability"))
