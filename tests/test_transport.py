"""Transport streams in ranges: any split gives the same packets, also of damaged
files; written by many tasks and read back by either reader."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reelspark.sources import demux, ranges, transport

PACKETS = "file string, idx int, ordinal bigint, pts bigint, dts bigint, tb_num int, tb_den int, keyframe boolean, data binary"


def make(n=300, seed=1):
    rng = random.Random(seed)
    rows, count = [], {}
    for i in range(n):
        f, idx = rng.choice(["a.ts", "sub/b.ts"]), rng.randrange(2)
        k = count[f, idx] = count.get((f, idx), -1) + 1
        size = rng.choice([0, 1, 150, 165, 166, 167, 168, 169, 170, 171, 175, 176, 177, 178, 184, 185, 400, 3000, 70000])
        rows.append((f, idx, k, 40 * k + (80 if idx == 0 and k % 3 else 0), 40 * k, 1, 1000, k % 4 == 0 or idx == 1, rng.choice([b"G", b"\x47\x40", b"x"]) * size))
    return rows


def streams_of(spark):
    return spark.createDataFrame([(f, i, m, c) for f in ("a.ts", "sub/b.ts") for i, m, c in ((0, "video", "h264"), (1, "audio", "aac"))], "file string, idx int, media_type string, codec string")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ts"))
    rows = make()
    manifest = transport.write_transport(spark.createDataFrame(rows, PACKETS), streams_of(spark), f"file://{folder}", blocks=5, partitions=7)
    return folder, rows, {r.file: r for r in manifest.collect()}


def test_written_by_many_tasks_without_gaps(written):
    folder, rows, manifest = written
    for f in ("a.ts", "sub/b.ts"):
        data = open(f"{folder}/{f}", "rb").read()
        assert len(data) == manifest[f].bytes and len(data) % 188 == 0 and set(data[::188]) == {0x47}
        assert manifest[f].pieces == 1 + sum(r[0] == f for r in rows)
        last = {}
        for at in range(0, len(data), 188):
            pid = (data[at + 1] & 31) << 8 | data[at + 2]
            if pid >= 256:
                assert data[at + 3] & 15 == (last.get(pid, -1) + 1) & 15
                last[pid] = data[at + 3] & 15
    assert not [x for _, _, names in os.walk(folder) for x in names if x.startswith(".")]


def test_the_whole_file_parser_agrees(written):
    folder, rows, _ = written
    for f in ("a.ts", "sub/b.ts"):
        streams, packets = demux.ts(open(f"{folder}/{f}", "rb").read())
        assert [s["codec"] for s in streams] == ["h264", "aac"]
        for idx in (0, 1):
            want = [(r[3] * 90, r[4] * 90, r[7], r[8]) for r in rows if r[0] == f and r[1] == idx]
            assert [(p, d, k, x) for i, p, d, _, k, x in packets if i == idx] == want


@pytest.mark.parametrize("split", [1 << 30, 90_000])
def test_any_split_gives_the_same_rows(spark, written, split):
    folder, rows, _ = written
    ts = transport.read_transport(spark, folder, split)
    size = sum(os.path.getsize(f"{folder}/{f}") for f in ("a.ts", "sub/b.ts"))
    assert ts.count() == size // 188 and (ts.rdd.getNumPartitions() > 16) == (split < 1 << 30)
    got = (transport.read_packets(spark, folder, split, 4) if split == 90_000 else transport.elementary_packets(ts, 4)).withColumn("file", F.regexp_extract("file", r"(a|sub/b)\.ts$", 0)).collect()
    want = {(r[0], r[1], r[2]): (r[3] * 90, r[4] * 90, r[7], r[8]) for r in rows}
    assert len(got) == len(want) and all(want[r.file, r.idx, r.ordinal] == (r.pts, r.dts, r.keyframe, bytes(r.data)) for r in got)


def test_only_rows_of_wanted_identifiers(spark, written):
    assert transport.read_transport(spark, written[0], pids=[0, 4096]).count() == 4
    assert transport.read_transport(spark, written[0], pids=[256]).where("unit_start").count() == sum(r[1] == 0 for r in written[1])
    assert transport.read_transport(spark, written[0], pids=[]).count() == 0


def places(path, split):
    with ranges.RangeReader(path) as f:
        first = transport.find_packet(f, 0, None)
        phase = first % 188 if first < f.size else None
        return [int(x) for a in range(0, f.size, split) for at, _ in transport.packets_of(f, a, min(a + split, f.size), phase) for x in at]


@pytest.mark.parametrize("seed", range(6))
def test_damage_is_the_same_for_any_split(tmp_path, seed):
    rng = random.Random(seed)
    packet = lambda: bytes([0x47, 1, 0, 0x10]) + bytes(rng.randrange(256) for _ in range(184))
    data = b""
    for _ in range(120):
        p = packet()
        kind = rng.random()
        data += p[: rng.randrange(1, 188)] if kind < 0.04 else p + bytes(rng.randrange(256) for _ in range(rng.randrange(1, 400))) if kind < 0.08 else p
    path = str(tmp_path / "d.ts")
    open(path, "wb").write(bytes(rng.randrange(256) for _ in range(rng.randrange(300))) + data + packet()[: rng.randrange(187)])
    want = places(path, 1 << 30)
    assert len(want) > 60 and want == sorted(set(want))
    for split in (200, 517, 4_000, 9_999):
        assert places(path, split) == want


def test_empty_folder_and_noise(spark, tmp_path):
    assert transport.read_transport(spark, str(tmp_path)).count() == 0
    open(tmp_path / "noise.ts", "wb").write(bytes(range(250)) * 40)
    open(tmp_path / "none.ts", "wb").write(b"")
    ts = transport.read_transport(spark, str(tmp_path), 4_000)
    assert transport.elementary_packets(ts).count() == 0


def test_no_names_without_success(spark, tmp_path):
    def build(b):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ranges.write_ranges(spark.range(3).selectExpr("'f' as file", "id as offset"), str(tmp_path), build)
    assert not os.path.exists(tmp_path / "f")
