"""Carry scans against plain windows and folds; one hot key over many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import scan

ROWS = "k string, t bigint, u string, v bigint, x double, name string"


def rows(n=3000, seed=3):
    rng = random.Random(seed)
    out = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(n * 4), f"u{i}", rng.choice([None, 1, 5, -3]), rng.uniform(-1, 1), "n") for i in range(n)]
    return [*out, ("hot", None, "v", 7, 0.5, "n"), (None, None, "w", 7, None, "n")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), ROWS).repartition(5).cache()


@pytest.mark.parametrize("key,reverse,exclusive,blocks", [(["k"], False, False, 1), (["k"], False, False, 13), (["k"], True, True, 13), (["k"], False, True, 13), ([], True, False, 13), ([], False, True, 13)])
def test_equals_the_window(table, key, reverse, exclusive, blocks):
    order = ["t", "u"]
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() if reverse else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = table.select("k", "t", "u", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.last("v", ignorenulls=True).over(w).alias("l"))
    got = scan.carry_scan(table, key, order, {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "l": ("last", "v")}, blocks, reverse, exclusive)
    assert got.columns == [*table.columns, "s", "n", "lo", "hi", "l"]
    a, b = got.select("k", "t", "u", "s", "n", "lo", "hi", "l").collect(), want.collect()
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("blocks", [1, 17])
def test_affine_equals_the_fold(table, blocks):
    got = scan.affine_scan(table, ["k"], ["t", "u"], F.when(F.col("v") == 5, 0.25).otherwise(0.75), F.col("x") * 0.25, "y", "y0", 2.0, blocks)
    have = {r.u: (r.y0, r.y) for r in got.collect()}
    state, want = {}, {}
    for k, t, u, v, x, _ in sorted(rows(), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        before = state.get(k, 2.0)
        state[k] = (0.25 if v == 5 else 0.75) * before + (x or 0.0) * 0.25
        want[u] = (before, state[k])
    assert set(have) == set(want) and all(have[u] == pytest.approx(want[u], rel=1e-9, abs=1e-12) for u in want)


def test_empty_table(spark):
    none = spark.createDataFrame([], ROWS)
    assert scan.carry_scan(none, ["k"], ["t"], {"s": ("sum", "v")}, 8).collect() == []
    assert scan.affine_scan(none, ["k"], ["t"], F.lit(1.0), F.lit(1.0), "y", blocks=8).collect() == []


def test_equal_order_stays_in_one_block(spark):
    same = spark.range(500).selectExpr("'k' as k", "7L as t", "id")
    assert scan.blocked(same, ["k"], ["t"], 8).select("_block").distinct().count() == 1


def test_one_key_is_even_over_blocks_and_shuffled_once(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("'one' as k", "l_orderkey", "l_linenumber", "l_quantity")
    sizes = sorted(r["count"] for r in scan.blocked(lines, ["k"], ["l_orderkey", "l_linenumber"], 16).groupBy("_block").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    out = scan.carry_scan(lines, ["k"], ["l_orderkey", "l_linenumber"], {"s": ("sum", "l_quantity")}, 16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    full = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_block" in line and "l_quantity" not in line]
    assert plan.count("SortMergeJoin") == 0 and "BroadcastHashJoin" in plan and len(full) <= 2


def test_compositions():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.uniform(-1, 1, 300), rng.uniform(-1, 1, 300)
    a[::17] = 0
    sa, sb = scan._compose(a, b)
    y = 1.5
    for i in range(300):
        y = a[i] * y + b[i]
        assert sa[i] * 1.5 + sb[i] == pytest.approx(y, abs=1e-12)


@pytest.mark.parametrize("video,target", [(True, 0.0), (False, 2.0), (True, 7.3)])
def test_spread_segments_equal_the_fold(spark, video, target):
    from reelspark.operators import containers

    rng = random.Random(8)
    out = []
    for f, n in enumerate((400, 30, 1, 2)):
        t = rng.randrange(1000)
        for i in range(n):
            t += rng.choice([0, 1, 20, 90, 400]) if i != n // 2 else 9000
            # times jitter as with reordered frames, one packet has none
            out.append((f, i * 3, None if i == 5 else t + rng.choice([0, -300, 250, 700]), 1, 90 + f, rng.random() < 0.4))
    p = spark.createDataFrame(out, "file bigint, ordinal bigint, pts bigint, tb_num bigint, tb_den bigint, keyframe boolean").repartition(3)
    want = sorted(containers.hls_segments(p, target, video).collect())
    assert sorted(containers.hls_segments_spread(p, target, video, blocks=9).collect()) == want
    assert len({(r.file, r.segment) for r in want}) > 8


def test_attack_ratio_spread_equals_the_fold(spark):
    from reelspark.operators import audio

    e = spark.range(900).selectExpr("concat('c', id % 2) as clip", "id div 2 as b", "cast((id * 7919) % 1013 as double) as e")
    want = {(r.clip, r.b): r.ratio for r in audio.attack_ratio(e).collect()}
    got = {(r.clip, r.b): r.ratio for r in audio.attack_ratio(e, 7).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
