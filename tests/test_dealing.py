"""Rows dealt behind a join that may turn into a broadcast join while it runs."""

import pyarrow as pa
from pyspark.sql import functions as F

from reelspark.catalog import containers
from reelspark.operators import audio
from reelspark.operators.lineage import deal
from reelspark.sources import files, mux

from .test_audio_scale import plan_of


def test_rows_of_a_key_stay_together(spark):
    left = spark.range(0, 4000, 1, 8).selectExpr("id % 7 as k", "id")
    parts = deal(left.join(left.groupBy("k").count(), "k"), "k").withColumn("p", F.spark_partition_id())
    assert max(r.n for r in parts.groupBy("k").agg(F.countDistinct("p").alias("n")).collect()) == 1


def test_files_and_clips_have_a_shuffle_of_their_own(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # sizes are not known before the run
    try:
        p = spark.range(10).selectExpr("concat('f', id) as file", "0 as idx", "id as ordinal", "id as pts", "id as dts", "1L as duration", "1 as tb_num", "8 as tb_den", "true as keyframe", "cast('x' as binary) as data")
        names = "media_type codec pixfmt color_range sample_fmt".split()
        s = spark.range(1).selectExpr("concat('f', id) as file", "0 as idx", *[f"'' as {c}" for c in names], "1 as tb_num", "8 as tb_den", "1 as width", "1 as height", "8 as sample_rate", "1 as channels", "cast(null as binary) as extradata")
        assert "hashpartitioning(xxhash64(file" in plan_of(mux.write_files(p, s, "wav"))
        e = spark.range(10).selectExpr("concat('A', id) as clip", "id as b", "id as e")
        assert "hashpartitioning(xxhash64(clip" in plan_of(audio.attack_ratio(e))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_files_of_users_are_made_in_several_tasks(spark, tmp_path):
    n, f = 2_500, str(tmp_path)
    spark.range(n).selectExpr("id as event_id", "id as user_id").write.parquet(f"{f}/events.parquet")
    for made in (containers._segments(spark, f), containers._tables(spark, f)[2]):
        tasks = made.groupBy(F.spark_partition_id()).agg(F.countDistinct("file").alias("n")).collect()
        assert sum(r.n for r in tasks) == n and max(r.n for r in tasks) < 1.5 * containers.FILES


def test_few_rows_of_a_batch_are_objects_at_once():
    sizes = []

    class Column(list):
        def slice(self, at, n):
            return Column(self[at : at + n])

        def to_pylist(self):
            sizes.append(len(self))
            return list(self)

    assert list(mux.values(Column(range(1_000)))) == list(range(1_000))
    assert max(sizes) == mux.ROWS


def test_packets_and_files_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setitem(files.PARSERS, "ivf", lambda b: ([{"idx": 0, "tb_num": 1, "tb_den": 25}], [(0, i, i, 1, True, b"x") for i in range(5_000)]))
    limits = [files.BATCH_ROWS, files.BATCH_BYTES]

    class Files:
        sparkSession = spark

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    one = pa.RecordBatch.from_pydict({"file": ["a"], "format": ["ivf"], "content": [b""]})
    out = list(files.parse_packets(Files()).run([one]))
    assert [x for b in out for x in b.column("ordinal").to_pylist()] == list(range(5_000)) and max(b.num_rows for b in out) <= limits[0]
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}, pa.schema([("n", pa.int64())])) for b in batches)
    seen = spark.range(0, 6_000, 1, 1).selectExpr("cast(repeat('x', 4000) as binary) as content").mapInArrow(count, "n bigint").collect()
    assert sum(r.n for r in seen) > 6_000 * 4_000 and max(r.n for r in seen) < 1.1 * limits[1]
