"""Audio operators whose work must not be copied to the driver or into one task."""

from collections import Counter
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from reelspark.catalog import audio as queries
from reelspark.operators import audio


def plan_of(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["flac_autoc", "flac_levinson", "sig_lpc"])
def test_lags_are_not_broadcast(name, spark, sf):
    assert "Broadcast" not in plan_of(queries.QUERIES[name](spark, sf))


def test_autocorrelation_meets_by_place(spark):
    # a gap, a place held twice, and a block too short for the last lag
    rows = [(0, i, float(v)) for i, v in ((0, 1), (1, 2), (3, 5), (3, 7), (4, -1))] + [(1, 0, 3.0), (1, 2, 4.0)]
    want = Counter()
    for b, i, x in rows:
        for c, j, y in rows:
            if b == c and 0 <= j - i <= 3:
                want[b, j - i] += x * y
    df = spark.createDataFrame(rows, "block bigint, i bigint, x double").selectExpr("'A' as clip", "0L as ch", "*")
    assert {(r.block, r.lag): r.r for r in audio.autocorrelation(df, 3).collect()} == want


def test_delay_tries_are_not_broadcast(spark, sf):
    text = plan_of(queries.QUERIES["align_delay"](spark, sf))
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text


def test_delay_equals_all_pairs(spark):
    ref = [(n, (n * 7919) % 101) for n in range(0, 300) if n % 50 != 3]
    dec = [(n + 70, v + n % 2) for n, v in ref] + [(5, 9)]
    shifts = [-200, -3, 0, 1, 64, 70, 71, 250]
    held, found = dict(dec), []
    for s in shifts:
        gaps = [(v - held[n + s]) ** 2 for n, v in ref if n + s in held]
        found += [(sum(gaps) / len(gaps), s)] if gaps else []
    frame = lambda rows: spark.createDataFrame(rows, "n bigint, v bigint").withColumn("clip", F.lit("A"))
    r = audio.align_delay(frame(ref), frame(dec), shifts, ["clip"]).first()
    assert (round(r.mse, 9), r["shift"]) == (round(min(found)[0], 9), min(found)[1])


def test_a_long_clip_is_resampled_by_many_tasks(spark):
    # the join with the clip's end is by stretches, and before rows are made for taps
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = spark.range(100).selectExpr("concat('A', id % 1) as clip", "0L as ch", "id as n", "1D as v")
        text = plan_of(audio.resample(t, 8000, 12000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = next(line for line in text.splitlines() if "SortMergeJoin" in line)
    assert "_part" in join and text.index("sequence(") < text.index(join)


def test_sample_tables_are_not_broadcast(spark):
    from reelspark.operators import containers

    f = spark.range(3).selectExpr("id as file")
    s = containers.mp4_samples(f.selectExpr("file", "1L as first_chunk", "2L as spc"), f.selectExpr("file", "1L as chunk", "9L as offset"), f.selectExpr("file", "1L as sample", "5L as size"), f.selectExpr("file", "1L as entry", "1L as count", "7L as delta"), None)
    assert "BroadcastExchange" not in plan_of(s)
