from pyspark.sql import functions as F

from reelspark.catalog import containers as cc
from reelspark.operators import audio, containers
from reelspark.streaming import stateful


def _run(spark, stream, name, folder):
    """Everything there is now, in several triggers; state left open stays open."""
    # else processing-time time-outs ask for another trigger for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}")
        .trigger(availableNow=True).start()
    )
    try:
        assert q.awaitTermination(60), "the stream did not end"
    finally:
        q.stop()
    return spark.table(name)


def test_pes_stream_equals_batch(spark, sf, tmp_path):
    ts = cc._ts(spark, sf).withColumn("file", F.lit(0).cast("bigint"))
    for i in range(3):  # three triggers
        ts.where(f"ord % 3 >= 0 and ord >= {i} * 400 and ord < {i + 1} * 400 + if({i} = 2, 100000000, 0)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(ts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(spark, stateful.pes_stream(live), "pes", tmp_path)
    want = {(r.pid, r.first_ord, r["size"], r.parts) for r in containers.pes_packets(ts).collect()}
    have = {(r.pid, r.first_ord, r["size"], r.parts) for r in got.collect()}
    assert have <= want and len(want - have) <= 8  # at most one open packet a PID


def test_windows_on_tables(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (1, "2024-01-01 05:00:00", "a", 4.0)], "user_id bigint, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in stateful.tumbling(e, "1 hour", "1 hour").collect()) == [1, 2]
    assert sorted(r.n for r in stateful.sessions(e, "1 hour", "1 hour").collect()) == [1, 2]


def test_hls_stream_equals_batch(spark, sf, tmp_path):
    p = cc.packets(spark, sf).withColumn("file", F.col("idx")).select("file", "ordinal", "pts", "tb_num", "tb_den", "keyframe")
    p.where("ordinal < 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    p.where("ordinal >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.file, r.segment, r.start_pts) for r in _run(spark, stateful.hls_stream(live, cc.TARGET), "hls", tmp_path).collect()}
    batch = containers.hls_durations(containers.hls_segments(p, cc.TARGET), cc.TARGET).collect()
    want = {(r.file, r.segment, r.start_pts) for r in batch}
    assert got <= want and len(want) - len(got) == len({r.file for r in batch})  # the last segment of each is open


def test_resample_stream_equals_batch(spark, tmp_path):
    t = audio.tone(spark, "t", 8000, 300.0, 0.5, 900)
    for i in range(3):
        t.where(f"n >= {i * 300} and n < {i * 300 + 300}").select("clip", "n", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("clip string, n bigint, v double").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    got = {r.m: r.y for r in _run(spark, stateful.resample_stream(live, 8000, 12000), "rs", tmp_path).collect()}
    want = {r.m: r.y for r in audio.resample(t, 8000, 12000).collect()}
    assert len(got) > 1200 and all(abs(want[m] - y) < 1e-9 for m, y in got.items())
