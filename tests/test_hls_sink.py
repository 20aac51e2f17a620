"""The segment sink: whole segments behind a playlist that changes in one step."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import containers
from reelspark.sources import demux, hls

PACKETS = "file string, idx int, ordinal bigint, pts bigint, dts bigint, tb_num int, tb_den int, keyframe boolean, data binary"


def table(spark, video=True):
    rng = random.Random(2)
    rows = [(f, idx, i, 40 * i, 40 * i, 1, 1000, (i % 6 == 0) if idx == 0 and video else True, rng.randbytes(rng.randrange(1, 400))) for f, n in (("a", 90), ("b", 7)) for idx in (0, 1) for i in range(n)]
    kinds = (("video", "h264") if video else ("audio", "mp3"), ("audio", "aac"))
    streams = spark.createDataFrame([(f, i, *kinds[i]) for f in "ab" for i in (0, 1)], "file string, idx int, media_type string, codec string")
    return rows, spark.createDataFrame(rows, PACKETS), streams


def names(folder, file):
    return [n for _, n in hls.read_playlist(folder, file)[0]]


@pytest.mark.parametrize("video,blocks", [(True, None), (True, 4), (False, None)])
def test_segments_hold_all_packets(spark, tmp_path, video, blocks):
    rows, packets, streams = table(spark, video)
    folder = f"file://{tmp_path}"
    hls.write_hls(packets, streams, folder, 1.0, blocks)
    ref = packets.where("idx = 0").select("file", "ordinal", "pts", F.lit(1).cast("bigint").alias("tb_num"), F.lit(1000).cast("bigint").alias("tb_den"), "keyframe")
    want = {(r.file, r.segment): r.duration for r in containers.hls_durations(containers.hls_segments(ref, 1.0, video), 1.0).collect()}
    for f in "ab":
        items, _ = hls.read_playlist(folder, f)
        assert [round(s, 3) for s, _ in items] == [round(want[f, i], 3) for i in range(len(items))] and len(items) == sum(k == f for k, _ in want)
        got = {0: [], 1: []}
        for n in names(folder, f):
            _, found = demux.ts((tmp_path / n).read_bytes())
            assert not video or next(key for idx, _, _, _, key, _ in found if idx == 0)
            for idx, pts, _, _, key, data in found:
                got[idx].append((pts, key, data))
        for idx in (0, 1):
            assert got[idx] == [(r[3] * 90, r[7], r[8]) for r in rows if r[0] == f and r[1] == idx]
    text = (tmp_path / "a.m3u8").read_text()
    assert text.startswith("#EXTM3U\n") and text.endswith("#EXT-X-ENDLIST\n") and hls.vacuum(folder) == 0


def test_a_failed_task_leaves_the_old_playlist(spark, tmp_path):
    _, packets, streams = table(spark)
    folder = f"file://{tmp_path}"
    hls.write_hls(packets, streams, folder, 1.0)
    before = {f: open(f).read() for f in glob.glob(f"{tmp_path}/*.m3u8")}
    files = set(os.listdir(tmp_path))
    pieces = hls.segment_pieces(packets, streams, 0.5)
    bad = pieces.withColumn("data", F.expr("if(file = 'a' and segment = 3 and position > 0, cast(raise_error('lost') as binary), data)"))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("hls").mode("overwrite").save(folder)
    assert {f: open(f).read() for f in before} == before and set(os.listdir(tmp_path)) == files
    pieces.write.format("hls").mode("overwrite").save(folder)
    assert not set(names(folder, "a")) & files and hls.vacuum(folder) > 0
    assert all((tmp_path / n).exists() for f in "ab" for n in names(folder, f))


def test_stream_appends_and_skips_what_it_has(spark, tmp_path):
    _, packets, streams = table(spark)
    folder, source = f"file://{tmp_path}/out", str(tmp_path / "in")
    spark.dataSource.register(hls.HlsSink)
    pieces = hls.segment_pieces(packets, streams, 1.0)
    for low, high in ((0, 2), (2, 99)):
        pieces.where(f"segment >= {low} and segment < {high}").coalesce(1).sortWithinPartitions("file", "segment", "position").write.mode("append").parquet(source)
    live = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = live.writeStream.format("hls").option("path", folder).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    items, batch = hls.read_playlist(folder, "a")
    want = pieces.where("file = 'a'").select("segment").distinct().count()
    assert len(items) == want and batch == 1 and [int(n.split("-")[1]) for _, n in items] == list(range(want))
    again = hls._StreamWriter({"path": folder}, False)
    again.commit([hls._Written([["a", 99, 1.0, "x.ts", 0]])], 1)
    assert hls.read_playlist(folder, "a") == (items, 1)
    again.commit([hls._Written([["a", 99, 1.0, "x.ts", 0]])], 2)
    assert len(hls.read_playlist(folder, "a")[0]) == want + 1


def test_rows_out_of_order_or_of_two_tasks_are_refused(tmp_path):
    from pyspark.sql import Row

    w = hls._Writer({"path": f"file://{tmp_path}"}, True)
    row = lambda seg, at: Row(file="a", segment=seg, duration=1.0, position=at, data=b"x")
    with pytest.raises(ValueError, match="order"):
        w.write(iter([row(0, 5), row(0, 5)]))
    with pytest.raises(ValueError, match="two tasks"):
        w.commit([w.write(iter([row(0, 0)])), w.write(iter([row(0, 1)])), None])
    w.abort([])
    assert os.listdir(tmp_path) == []
