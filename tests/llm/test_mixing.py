"""Raking with capped cells against a plain loop, and expected marginals of the
test tables against their feasible targets."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelspark.llm import mixing
from reelspark.llm.queries import mixing_input
from reelspark.llm.runtime import Workspace

CELLS = "source string, lang string, topic string, tokens bigint, docs bigint"


def _fill(have, share, mass):
    """Water filling by halving: what each value gets of ``mass``."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(have[v], mid * share[v]) for v in have) < mass else (lo, mid)
    return {v: min(have[v], hi * share[v]) for v in have}


def _rake(cells, targets, rounds=80):
    """Probability of each cell; every factor is found by halving."""
    f = [defaultdict(lambda: 1.0) for _ in range(3)]
    p = lambda k: min(1.0, f[0][k[0]] * f[1][k[1]] * f[2][k[2]])
    for _ in range(rounds):
        for d in range(3):
            for v, t in targets[d].items():
                lo, hi = 0.0, 1e4
                for _ in range(70):
                    f[d][v] = (lo + hi) / 2
                    lo, hi = (f[d][v], hi) if sum(n * p(k) for k, n in cells.items() if k[d] == v) < t else (lo, f[d][v])
    return {k: p(k) for k in cells}


def _targets(cells, power, mass):
    out = []
    for d in range(3):
        have = defaultdict(float)
        for k, n in cells.items():
            have[k[d]] += n
        out.append(_fill(have, {v: n**power for v, n in have.items()}, mass))
    return out


@pytest.mark.parametrize("rate,wide", [(0.6, False), (0.3, True)])
def test_raking_equals_a_plain_loop(spark, monkeypatch, rate, wide):
    if wide:
        monkeypatch.setattr(mixing, "WINDOW_CELLS", 0)
    rng = random.Random(8)
    cells = {(s, la, t): rng.choice((20, 300, 2000)) + rng.randrange(50) for s in ("a", "b", None) for la in ("x", "y") for t in ("p", "q") if rng.random() < 0.95}
    df = spark.createDataFrame([(*k, v, 1) for k, v in cells.items()], CELLS)
    out, _, gap = mixing.rake(df, mixing.tempered_targets(df, 0.5), Workspace(spark, "t"), rate, tolerance=1e-6)
    got = {(r.source, r.lang, r.topic): r.probability for r in out.collect()}
    want = _rake(cells, _targets(cells, 0.5, rate * sum(cells.values())))
    assert gap <= 1e-6 and all(abs(got[k] - want[k]) < 1e-4 for k in cells)


def test_targets_that_cannot_be_met_are_filled_up(spark):
    """A rare value is wanted more than it has: it is kept whole and the rest of
    its share goes to the others; unnamed values go, empty cells stay."""
    rows = [("a", "x", "p", 1000, 9), ("a", "x", "q", 10, 1), ("b", "x", "p", 800, 9), ("b", "x", "q", 5, 1), ("c", "x", "p", 50, 1), ("b", "x", "e", 0, 3)]
    df = spark.createDataFrame(rows, CELLS)
    targets = spark.createDataFrame(
        [("source", "a", 0.5), ("source", "b", 0.5), ("topic", "p", 0.5), ("topic", "q", 0.5), ("topic", "e", 0.1)], "dim string, value string, share double"
    )
    out, goal, gap = mixing.rake(df, targets, Workspace(spark, "t"), 0.4)
    got = {(r.source, r.topic): r.probability for r in out.collect()}
    assert got[("a", "q")] == got[("b", "q")] == 1.0 and got[("c", "p")] == 0.0 and got[("b", "e")] == 1.0
    kept = {s: sum(n * got[(a, t)] for a, _, t, n, _ in rows if a == s) for s in "ab"}
    assert abs(kept["a"] - kept["b"]) < 1 and abs(sum(kept.values()) - 0.4 * 1865) < 1 and gap < 1e-3
    assert {(r.value, r.full) for r in goal.where("dim = 'topic'").collect()} == {("p", False), ("q", True)}


def test_clashing_columns(spark):
    names = ("probability", "c_source", "c_lang", "k_source", "ratio", "tokens", "full", "allowed", "dim", "value")
    df = spark.createDataFrame([(i, "t", "s", "en", "p", 3) for i in range(50)], "doc_id bigint, text string, source string, lang string, topic string, n_tokens bigint")
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    got = mixing.sample(spark, df, rate=0.5)
    assert sorted(got.columns) == sorted(df.columns)
    rows = got.collect()
    assert 0 < len(rows) < 50 and all(r.c_source == r.k_source == r.tokens == "mine" and abs(r.probability - 0.5) < 1e-9 for r in rows)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_expected_marginals_meet_their_targets(spark, sf):
    """What the query's probabilities are expected to keep, margin by margin."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    rows = mixing_input(spark.read.parquet(f"{path}/documents.parquet"))
    work = Workspace(spark, "t")
    cells = work.table(rows.groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    out, goal, gap = mixing.rake(cells, mixing.tempered_targets(cells, 0.5), work, 0.5)
    whole, kept = out.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert abs(kept / whole - 0.5) < 0.01
    seen = mixing.margins(out, goal).collect()
    assert len(seen) > 20 and max(abs(r.expected - r.target) for r in seen) < 0.01
