"""Linear prediction, the clip's MD5 and the file header of FLAC encoding."""

import hashlib

import duckdb
import numpy as np
import pytest

from reelspark import catalog
from reelspark.operators import lossless as ll
from reelspark.sources import demux


def _tone(n=4096, seed=3):
    t = np.arange(n)
    return (9000 * np.sin(t / 5) + 6000 * np.sin(t / 3.1) + np.random.default_rng(seed).normal(0, 20, n)).astype(np.int64)


def test_the_query_predicts_and_has_a_header(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"copy (select i as event_id, timestamp '2024-01-01' + interval (i * 7) second as ts, 270 + 260 * sin(i / 3::double) * cos(i / 41::double) as value from range(9000) t(i)) to '{tmp_path}/events.parquet'")
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(catalog.queries()["codec_flac_enc"](spark, str(tmp_path)).select("block", "size", "code", "header").collect())
    assert got == sorted(db.execute(f"select block, size, code, header from ({catalog.oracle_sql()['codec_flac_enc']})").fetchall())
    pcm = [r.v for r in catalog.audio.s16(spark, str(tmp_path)).orderBy("n", "ch").collect()]
    fixed = [len(ll.encode_frame([np.array(pcm[c::2][b : b + 4096]) for c in (0, 1)], b // 4096, 0)) for b in (0, 4096, 8192)]
    assert all(r["size"] < f for r, f in zip(got, fixed))
    assert {r.header[-32:] for r in got} == {hashlib.md5(np.array(pcm, "<i2").tobytes()).hexdigest()}
    stream = demux.flac(bytes.fromhex(got[0].header))[0][0]
    assert (stream["sample_rate"], stream["channels"], stream["duration"]) == (44100, 2, 9000)


def test_prediction_wins_ties_and_takes_the_better_window():
    x = _tone()
    bits, kind, order, _ = ll.subframe(x, 16, 12)
    alone = []
    for taper in ll.TAPERS:
        top, _, _, e = ll.linear_prediction(x, 16, 12, taper)
        alone.append(8 + top * (16 + ll.PRECISION) + 15 + ll._partitions(ll._zigzag(e), len(x), top)[0])
    assert kind == "lpc" and bits == min(alone) and alone[0] != alone[1]
    assert ll.subframe(x, 16, 12)[0] < ll.subframe(x, 16, 8)[0] < ll.subframe(x, 16, 0)[0]


def test_a_tie_goes_to_prediction(monkeypatch):
    x = _tone(600)
    fixed = ll.subframe(x, 16, 0)
    # a candidate as long as the fixed order's: its 9 + 14 * order bits fewer in the residual
    part = ll._partitions
    monkeypatch.setattr(ll, "linear_prediction", lambda x, bps, top, taper: (fixed[2], np.zeros(fixed[2], np.int64), 0, np.full(len(x) - fixed[2], -1)))
    length = fixed[0] - (8 + fixed[2] * 16 + 6) - (9 + fixed[2] * ll.PRECISION)
    monkeypatch.setattr(ll, "_partitions", lambda u, n, order: (length, 0, [0]) if (u == 1).all() else part(u, n, order))
    assert ll.subframe(x, 16, 12)[:2] == (fixed[0], "lpc")


def test_coefficients_round_away_from_zero_and_carry():
    # 0.5 has the shift 13; half a step is rounded up and the rest taken from the next one
    c, shift = ll.quantise([0.5, 1.5 / 8192, 1 / 8192, -2.5 / 8192])
    assert shift == 13 and c.tolist() == [4096, 2, 1, -3]
    assert ll.quantise([0.0, 0.0]) is None and ll.quantise([float("inf")]) is None
    assert ll.quantise([20000.0])[0].tolist() == [8191] and ll.quantise([20000.0])[1] == 0


@pytest.mark.parametrize("n, order", [(4096, 0), (4096, 12), (1000, 3), (77, 2), (48, 11), (256, 1)])
def test_partitions_equal_every_order_tried(n, order):
    u = np.random.default_rng(n).geometric(0.01, n - order) * (np.arange(n - order) % 97 < 40)
    tried = []
    for po in range(9):
        if n % (1 << po) or n >> po <= order:
            break
        ends = [max(0, j * (n >> po) - order) for j in range((1 << po) + 1)]
        costs = [[int((u[a:b] >> k).sum()) + (1 + k) * (b - a) for k in range(15)] for a, b in zip(ends, ends[1:])]
        tried.append((sum(4 + min(c) for c in costs), po, [c.index(min(c)) for c in costs]))
    assert ll._partitions(u, n, order) == min(tried, key=lambda t: t[:2])


def test_digests_of_clips_in_many_partitions(spark):
    rng, rows = np.random.default_rng(9), []
    clips = {c: [rng.integers(-32768, 32768, 5 * 16 + 3).tolist() for _ in range(w)] for c, w in (("a", 1), ("b", 2), ("c", 3))}
    for c, chans in clips.items():
        rows += [(c, b, [x[b * 16 : b * 16 + 16] for x in chans]) for b in range(6)]
    blocks = spark.createDataFrame(rows, "clip string, block bigint, pcm array<array<int>>").repartition(7)
    got = {r.clip: (r.channels, r.samples, r.least, r.most, r.md5) for r in ll.flac_digests(blocks).collect()}
    assert got == {c: (len(x), 83, 3, 16, hashlib.md5(np.array(x, "<i2").T.tobytes()).hexdigest()) for c, x in clips.items()}
    sizes = ll.flac_frames(blocks).selectExpr("clip", "block", "cast(octet_length(frame) as bigint) as size")
    for r in ll.flac_headers(sizes, ll.flac_digests(blocks), 48000).groupBy("clip").agg({"header": "max", "size": "max", "block": "count"}).collect():
        header = r["max(header)"]
        assert r["count(block)"] == 6 and len(header) == 42 and int.from_bytes(header[15:18], "big") == r["max(size)"]
        assert int.from_bytes(header[18:26], "big") == 48000 << 44 | len(clips[r.clip]) - 1 << 41 | 15 << 36 | 83


def test_levels_and_channels():
    assert [ll.compression_order(level) for level in range(9)] == [4, 4, 4, 8, 8, 8, 12, 12, 12]
    with pytest.raises(ValueError):
        ll.encode_frame([_tone(16)] * 9, 0, 12)
