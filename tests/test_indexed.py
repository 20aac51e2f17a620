"""MP4 read index first: the rows of the whole-file parser, and only the bytes needed."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from reelspark.sources import demux, indexed, mux, ranges


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three files; video with few key frames and large samples, audio between."""
    rng = random.Random(4)
    at = tmp_path_factory.mktemp("mp4")
    os.makedirs(at / "sub")
    for k, n in enumerate((400, 31, 1)):
        streams = [dict(idx=0, media_type="video", codec="h264", tb_num=1, tb_den=1000, width=64, height=48), dict(idx=1, media_type="audio", codec="aac", tb_num=1, tb_den=48000, sample_rate=48000, channels=2)]
        packets = [(0, 40 * i, 40 * i, 40, i % 12 == 0, rng.randbytes(rng.randrange(20_000))) for i in range(n)]
        packets += [(1, 1024 * i, 1024 * i, 1024, True, rng.randbytes(rng.randrange(300))) for i in range(2 * n)]
        (at / ("sub" if k else ".") / f"{k}.mp4").write_bytes(mux.mp4(streams, packets))
    (at / "broken.mp4").write_bytes(b"\0\0\0\x10ftypisom\0\0\0\0" + bytes(range(256)) * 9)
    (at / "empty.mp4").write_bytes(b"")
    return str(at)


def short(c="file"):
    return F.regexp_extract(c, r"(\w+\.mp4)$", 1).alias("file")


def wanted(folder):
    out = {}
    for d, name in ((".", "0.mp4"), ("sub", "1.mp4"), ("sub", "2.mp4")):
        _, packets = demux.mp4(open(f"{folder}/{d}/{name}", "rb").read())
        count = {}
        for idx, pts, dts, _, key, data in packets:
            n = count[idx] = count.get(idx, -1) + 1
            out[name, idx, n] = (pts, dts, key, data)
    return out


@pytest.mark.parametrize("cut", [1 << 16, 50])
def test_same_rows_as_the_whole_file_parser(spark, folder, monkeypatch, cut):
    monkeypatch.setattr(indexed, "SLICE", cut)
    tracks, samples = indexed.mp4_table(spark, folder)
    got = indexed.fetch(samples).select(short(), "track", "ordinal", "pts", "dts", "keyframe", "data").collect()
    want = wanted(folder)
    assert len(got) == len(want) and all(want[r.file, r.track, r.ordinal] == (r.pts, r.dts, r.keyframe, bytes(r.data)) for r in got)
    known = {(r.file, r.track): (r.media_type, r.codec, r.timescale, r.error) for r in tracks.select(short(), "track", "media_type", "codec", "timescale", "error").collect()}
    assert known["1.mp4", 0] == ("video", "h264", 1000, None) and known["0.mp4", 1] == ("audio", "aac", 48000, None)
    assert known["broken.mp4", None][3] == "no moov box" and ("empty.mp4", None) not in known  # Spark lists no empty files


def test_only_the_bytes_that_are_needed(spark, folder):
    _, samples = indexed.mp4_table(spark, folder)
    some = samples.where("track = 0 and keyframe")
    size = sum(os.path.getsize(f"{folder}/{f}") for f in ("0.mp4", "sub/1.mp4", "sub/2.mp4"))
    need, got = some.agg(F.sum("size")).first()[0], indexed.fetch(some, gap=500)
    read = got.agg(F.sum("fetched")).first()[0]
    assert need <= read < 1.1 * need < 0.2 * size
    near = indexed.fetch(samples)  # all samples: the content once, in few ranges
    n, read = near.agg(F.count("fetched"), F.sum("fetched")).first()
    assert n <= 4 and read == samples.agg(F.sum("size")).first()[0]


def test_the_index_costs_a_few_bytes(folder):
    with ranges.RangeReader(f"{folder}/0.mp4") as f:
        rows = list(indexed.tracks_of(f))
        assert len(rows) == 9 and f.taken < 1000 < f.size / 1000


def test_windows_cap_ranges(spark):
    s = spark.range(2000).selectExpr("'f' as file", "id * 1000 as offset", "900L as size")
    out = indexed.islands(s, window=100_000).select("_start", "_stop").distinct().collect()
    assert len(out) == 20 and max(r._stop - r._start for r in out) <= 100_000
    assert indexed.islands(s, gap=50).select("_start").distinct().count() == 2000


def full(name, *parts):
    body = b"\0\0\0\0" + b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def test_large_offsets_equal_sizes_composition_and_configuration(spark, tmp_path):
    """co64, one size for all, ctts with negative shifts, a box with a 64-bit size."""
    box = lambda name, *p: struct.pack(">I", 8 + sum(map(len, p))) + name + b"".join(p)
    data = bytes(range(60))
    head = box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    at = len(head) - len(data)
    entry = box(b"avc1", b"\0" * 78, box(b"avcC", b"config"))
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stsz", struct.pack(">II", 10, 6)), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"co64", struct.pack(">IQQ", 2, at, at + 30)), full(b"stts", struct.pack(">III", 1, 6, 5)), full(b"ctts", struct.pack(">IIiIi", 2, 2, 7, 4, -3)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIII", 0, 0, 600, 30, 0)), full(b"hdlr", b"\0\0\0\0vide", b"\0" * 12), box(b"minf", stbl))
    (tmp_path / "x.mp4").write_bytes(head + box(b"moov", box(b"trak", mdia)))
    tracks, samples = indexed.mp4_table(spark, str(tmp_path))
    assert bytes(tracks.first().config) == b"config" and tracks.first().timescale == 600
    rows = sorted((r.ordinal, r.dts, r.pts, bytes(r.data)) for r in indexed.fetch(samples).collect())
    assert rows == [(i, 5 * i, 5 * i + (7 if i < 2 else -3), data[10 * i : 10 * i + 10]) for i in range(6)]


def test_written_by_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for f, n in (("a.mp4", 200), ("sub/b.mp4", 20), ("c.mp4", 1)):
        for idx, k, d in ((0, n, 40), (1, 2 * n, 1000)):
            for i in range(k):
                rows.append((f, idx, 3 * i, d * i + (40 if idx == 0 and i % 3 == 1 and n > 1 else 0), d, i % 10 == 0 or idx == 1, rng.randbytes(rng.choice([0, 1, 30, 5000]))))
    p = spark.createDataFrame(rows, "file string, idx int, ordinal bigint, pts bigint, duration bigint, keyframe boolean, data binary").repartition(3)
    s = spark.createDataFrame(
        [(f, i, m, c, t, 64, 48, r, 2, x) for f in ("a.mp4", "sub/b.mp4", "c.mp4", "none.mp4") for i, m, c, t, r, x in ((0, "video", "h264", 1000, None, b"cfg"), (1, "audio", "aac", 48000, 48000, None))],
        "file string, idx int, media_type string, codec string, timescale bigint, width int, height int, sample_rate int, channels int, config binary",
    )
    manifest = {r.file: r for r in indexed.write_mp4(p, s, f"file://{tmp_path}", 5, 6).collect()}
    want = {(os.path.basename(r[0]), r[1], r[2] // 3): r for r in rows}
    for f in ("a.mp4", "sub/b.mp4", "c.mp4", "none.mp4"):
        data = (tmp_path / f).read_bytes()
        assert len(data) == manifest[f].bytes  # no gaps and nothing written twice
        streams, packets = demux.mp4(data)
        assert [(x["codec"], x["tb_den"]) for x in streams] == [("h264", 1000), ("aac", 48000)]
        count = {}
        for idx, _, dts, _, key, x in packets:
            n = count[idx] = count.get(idx, -1) + 1
            r = want[os.path.basename(f), idx, n]
            assert (dts, key, x) == (r[4] * n, r[5], r[6])
        assert sum(v + 1 for v in count.values()) == sum(r[0] == f for r in rows)
    tracks, samples = indexed.mp4_table(spark, f"file://{tmp_path}")
    got = indexed.fetch(samples).select(short(), "track", "ordinal", "pts", "keyframe", "data").collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.file, r.track, r.ordinal]
        assert (r.pts, r.keyframe, bytes(r.data)) == (w[3], w[5], w[6])
    assert bytes(tracks.where("track = 0").first().config) == b"cfg"
