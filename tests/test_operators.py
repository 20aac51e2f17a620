import binascii
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import binary as bn
from reelspark.functions import text as tx
from reelspark.operators import audio, containers, frames, measure, packed, probe
from reelspark.operators import lossless as ll
from reelspark.operators.frames import FilterError, Geometry
from reelspark.plans.builder import MapSpec, PlanError, Spec, Stream, auto_setrange, conform_pixels, parse_overlay, plan
from reelspark.plans.cli import parse_args
from reelspark.sources import demux, files, mux


def test_checksums(spark):
    words = [b"123456789", b"\x00", b"reel"]
    df = spark.createDataFrame([(w,) for w in words], "d binary")
    r = df.select("d", bn.crc32_mpeg(F.col("d")).alias("m"), bn.crc32_ogg(F.col("d")).alias("o"), bn.crc8_flac(F.col("d")).alias("c8"), bn.crc16_flac(F.col("d")).alias("c16"), bn.adler32(F.col("d")).alias("a")).collect()
    by = {bytes(x.d): x for x in r}
    assert by[b"123456789"].m == 0x0376E6E7 and by[b"123456789"].c8 == 0xF4 and by[b"123456789"].c16 == 0xFEE8
    for w in words:
        assert by[w].a == zlib.adler32(w) and by[w].o == mux.ogg_crc(w)
        assert by[w].m == mux._crc_mpeg(w)
    assert binascii.hexlify(b"a") == b"61"


def test_timestamps_round_trip(spark):
    df = spark.createDataFrame([(0,), (999,), (3_600_000,), (359_999_999,), (-5,), (None,)], "ms bigint")
    r = df.select("ms", tx.parse_timestamp(tx.format_timestamp(F.col("ms"))).alias("b")).collect()
    assert all(x.b == (None if x.ms is None else max(x.ms, 0)) for x in r)


def test_cues_handle_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no cues here")], "k bigint, t string")
    assert tx.parse_cues(df, ["k"], "t").count() == 0


@pytest.mark.parametrize("bad", ["crop=100:2:0:0", "crop=3:2:0:0", "pad=4:4:0:0", "nothing", "scale=-1:-1", "transpose=7", "scale=a:b"])
def test_bad_filters_raise(spark, bad):
    px = spark.createDataFrame([("A", 0, 0, 0, 0, 1)], "clip string, frame_no bigint, plane bigint, y bigint, x bigint, v bigint")
    with pytest.raises(FilterError):
        frames.apply_chain(px, Geometry(16, 8), bad)


def test_transpose_needs_square_chroma(spark):
    px = spark.createDataFrame([("A", 0, 0, 0, 0, 1)], "clip string, frame_no bigint, plane bigint, y bigint, x bigint, v bigint")
    with pytest.raises(FilterError):
        frames.transpose(px, Geometry(16, 8, "yuv422p"), 1)


@pytest.mark.parametrize("spec", ["hflip", "vflip,gray", "transpose=3", "setrange=limited", "setrange=full,negate", "scale=30:-1,crop=10:10:4:6"])
def test_packed_equals_exploded(spark, sf, spec):
    from reelspark.catalog import frames as fx

    px = fx.planes(spark, sf)
    a = frames.apply_chain(px, fx.G420, spec)[0].select(*frames.PIXEL).collect()
    b = packed.explode(packed.filter_frames(packed.pack(px, fx.G420), spec)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_resampler_keeps_a_tone(spark):
    t = audio.tone(spark, "t", 8000, 300.0, 0.5, 1200)
    out = {r.m: r.y for r in audio.resample(t, 8000, 12000).collect()}
    mid = range(200, 1500)
    err = max(abs(out[m] - 0.5 * np.sin(2 * np.pi * 300 * m / 12000)) for m in mid)
    assert len(out) == 1800 and err < 1e-3


def test_levinson_finds_a_recursion():
    rng, x = np.random.default_rng(3), [0.0, 0.0]
    for e in rng.normal(size=20_000):
        x.append(1.2 * x[-1] - 0.5 * x[-2] + e)
    x = np.array(x)
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(3)])
    a, _ = audio.levinson(r, 2)
    assert np.allclose(a, [1.2, -0.5], atol=0.03)


def test_order_statistics_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 1.0, 1.0, None, 9.0)] + [("b", None)], "k string, v double")
    r = measure.order_statistics(df, ["k"], "v", {"m": measure.UPPER_MEDIAN, "q": measure.nearest_rank(0.95)}).collect()
    assert [(x.k, x.m, x.q, x.n) for x in r] == [("a", 5.0, 9.0, 4)]


def test_stage_total_row_wins(spark):
    df = spark.createDataFrame([("c", "x", "self", 30.0, 3), ("c", "TOTAL", "self", 60.0, 0), ("c", "y", "incl", 6.0, 0)], "clip string, stage string, scope string, ms double, calls bigint")
    r = {x.stage: x for x in measure.stage_report(df, ["clip"]).collect()}
    assert r["x"].pct == 50 and r["x"].ns_per_call == 1e7 and r["y"].ns_per_call == 0


def test_bd_rate_of_equal_curves_is_zero(spark):
    rows = [("c", arm, 30.0 + i, 100.0 * 1.3**i, 1.0) for arm in (0, 1) for i in range(5)] + [("lone", 0, 30.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "clip string, arm bigint, psnr double, kbps double, wall_ms double")
    (r,) = measure.bd_pchip(p).collect()
    assert abs(r.bd_rate) < 1e-9 and r.points_inside == 10 and r.anchor_monotone and r.speed == 1
    assert abs(measure.bd_cubic(p).first().bd_rate) < 1e-6 and abs(measure.bd_linear(p).first().bd_rate) < 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "file bigint, page bigint, seg bigint, lace bigint")
    assert containers.lace_packets(none).count() == 0
    ts = spark.createDataFrame([], "file bigint, ord bigint, pid bigint, pusi boolean, rai boolean, expect bigint, len bigint")
    assert containers.pes_packets(ts).count() == 0
    p = spark.createDataFrame([], "file bigint, ordinal bigint, pts bigint, tb_num bigint, tb_den bigint, keyframe boolean")
    assert containers.hls_segments(p, 4.0).count() == 0


def test_probe_prefers_scores_and_names(spark):
    df = spark.createDataFrame([("both", b"\xff\xfb\x90d 00:00:01,000 --> 00:00:02,000"), ("null", None), ("empty", b"")], "file string, content binary")
    r = {x.file: x.format for x in probe.probe(df, ["file"], "content").collect()}
    assert r == {"both": "mp3", "null": None, "empty": None}


def test_plan_rules():
    s = [Stream(0, 0, "video", "h264", 64, 48, color_range=None), Stream(0, 1, "audio", "aac"), Stream(0, 2, "data", "none")]
    (v, a) = plan(Spec(("a.mp4",), "b.mp4"), s, "mp4")
    assert v.action == a.action == "copy"
    (v, _) = plan(Spec(("a.mp4",), "b.jpg", video_codec="mjpeg", video_filter="scale=32:-1"), s, "jpeg")
    assert v.filters == "setrange=full,scale=32:-1" and (v.width, v.height) == (32, 24)
    assert plan(Spec(("a",), "b.webp", maps=(MapSpec(0, "video"),)), s, "webp")[0].codec == "webp"
    twice = plan(Spec(("a",), "b", maps=(MapSpec(0, "video"), MapSpec(0, "index", 0))), s, "mp4")
    assert [o.out_idx for o in twice] == [0, 1]
    for bad in (Spec((), "b"), Spec(("a",), "b", maps=(MapSpec(3),)), Spec(("a",), "b", video_codec="nope"), Spec(("a",), "b", video_filter="hflip"), Spec(("a",), "b", filter_complex="overlay=x:y")):
        with pytest.raises(PlanError):
            plan(bad, s, "mp4")
    assert conform_pixels("yuv444p", ["rgb24"]) == "rgb24" and conform_pixels("rgb24", ["rgb24"]) is None
    assert auto_setrange("limited", "png") and not auto_setrange("full", "png") and not auto_setrange("limited", "vp9")
    assert parse_overlay("[0][1]overlay=10:y=4") == (10, 4)


def test_command_line():
    s = parse_args("-y -i a.mp4 -i b.png -map 0:v -map 1:2 -c:v vp9 -b:a 128k -vf scale=10:-1 -frames:v 5 out.webm".split())
    assert s.inputs == ("a.mp4", "b.png") and s.maps == (MapSpec(0, "video"), MapSpec(1, "index", 2)) and s.audio_bitrate == 128_000 and s.frames == 5 and s.overwrite
    for bad in ("out", "-i a", "-i a -zzz b", "-i a -map x b", "-i a b c", "-i a -b:v 1q b"):
        with pytest.raises(PlanError):
            parse_args(bad.split())


def test_parsers_survive_noise():
    import struct

    magics = [b"RIFF\x10\0\0\0WAVEfmt ", b"RIFF\x10\0\0\0AVI LIST", b"YUV4MPEG2 W9 H9\nFRAME\n", b"DKIF\0\0 \0VP90", b"OggS", b"fLaC", b"\xff\xfb\x90\x64", b"\0\0\0\x18ftypisom", b"\x1aE\xdf\xa3", b"\x47@\0\x10", b"FLV\1\5\0\0\0\t", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xc0"]
    for name, parse in demux.PARSERS.items():
        for seed in range(60):
            r = random.Random(f"{name}{seed}")
            data = r.choice(magics) + bytes(r.randrange(256) for _ in range(r.randrange(400)))
            try:
                parse(data)
            except (demux.FormatError, struct.error, IndexError, ValueError, OverflowError):
                pass


def test_unreadable_files_are_reported(spark):
    df = spark.createDataFrame([("a", "png", b"junk"), ("b", None, b""), ("c", "wav", None)], "file string, format string, content binary")
    r = files.parse_streams(df).collect()
    assert len(r) == 3 and all(x.error for x in r)
    assert files.parse_packets(df).count() == 0


def test_media_source(spark, tmp_path):
    frames_ = [(0, i, i, 1, True, bytes([i]) * demux.frame_size("yuv420p", 4, 4)) for i in range(3)]
    s = [{"idx": 0, "media_type": "video", "codec": "rawvideo", "tb_num": 1, "tb_den": 25, "width": 4, "height": 4, "pixfmt": "yuv420p"}]
    (tmp_path / "a.y4m").write_bytes(mux.y4m(s, frames_))
    files.register(spark)
    got = spark.read.format("media").load(str(tmp_path)).orderBy("ordinal").collect()
    assert [bytes(r.data) for r in got] == [f[5] for f in frames_]
    opened = files.parse_packets(files.open_media(spark, str(tmp_path)))
    assert opened.count() == 3
    from reelspark.plans.builder import Engine

    assert Engine(spark).probe(str(tmp_path)).first().format == "yuv4mpegpipe"


def _flac_cases():
    rng, t = np.random.default_rng(5), np.arange(4096)
    yield "tonal stereo", [(3000 * np.sin(t / 9) + rng.normal(0, 30, 4096)).astype(np.int64), (2500 * np.sin(t / 9) + rng.normal(0, 30, 4096)).astype(np.int64)]
    yield "noise", [rng.integers(-32768, 32768, 1000), rng.integers(-32768, 32768, 1000)]
    yield "extremes", [np.array([-32768, 32767] * 300), np.array([32767, -32768] * 300)]
    yield "one channel", [np.full(77, 5)]
    yield "one sample", [np.array([-1])]


@pytest.mark.parametrize("order", [0, 8, 12])
def test_flac_frames_round_trip(order):
    sizes = {}
    for name, pcm in _flac_cases():
        for number in (0, 127, 128, 2047, 2048, 70_000):
            frame = ll.encode_frame(pcm, number, order)
            got = ll.decode_frame(frame)
            assert len(got) == len(pcm) and all(np.array_equal(a, b) for a, b in zip(got, pcm)), (name, number)
        sizes[name] = len(frame)
        damaged = bytearray(frame)
        damaged[-3] ^= 1
        with pytest.raises(ValueError):
            ll.decode_frame(bytes(damaged))
    assert sizes["noise"] <= 4100
    if order:
        assert sizes["tonal stereo"] < 8000  # fixed orders alone take 8,362


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    px = np.random.default_rng(channels).integers(0, 256, (9, 13, channels)).astype(np.uint8)
    px[3:6] = 7
    for pred in (*ll.PNG_FILTERS, "mixed"):
        assert np.array_equal(ll.png_pixels(ll.png_bytes(px, pred)), px)


def test_damaged_media_rows_are_null(spark):
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"\x89PNG\r\n\x1a\n"), (4, b"\xff\xf8")], "id bigint, image binary")
    assert [r.pixels for r in ll.decode_png(bad).collect()] == [None] * 4
    frames = bad.selectExpr("'c' as clip", "id as block", "image as frame")
    assert [r.pcm for r in ll.flac_samples(frames).collect()] == [None] * 4


def test_parameter_set_with_escapes_and_noise(spark):
    def ue(v):
        b = bin(v + 1)[2:]
        return "0" * (len(b) - 1) + b

    def unit(bits):
        bits += "1"
        bits += "0" * (-len(bits) % 8)
        return b"\x67" + int(bits, 2).to_bytes(len(bits) // 8, "big")

    # A long offset gives zero bytes, which are escaped; a scaling list is skipped.
    lists = "1" + "1" + "".join("1" if i % 3 else "00111" for i in range(16)) + "0" * 7
    high = "01100100" + "00000000" + "00000000" + ue(0) + ue(1) + ue(0) + ue(0) + "0" + lists
    tail = ue(0) + ue(1) + "0" + ue(2**24 - 1) + ue(0) + ue(0) + ue(1) + "0" + ue(79) + ue(44) + "1" + "1" + "0"
    raw = unit(high + tail)
    escaped, zeros = bytearray(), 0
    for x in raw:
        if zeros >= 2 and x <= 3:
            escaped.append(3)
            zeros = 0
        escaped.append(x)
        zeros = zeros + 1 if x == 0 else 0
    assert len(escaped) > len(raw)
    rows = [(bytes(escaped),), (None,), (b"",), (b"\x67",), (b"\x68\x42",), (raw[:6],)]
    got = spark.createDataFrame(rows, "b binary").select(bn.sps_size("b").alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [(1280, 720)] + [(None, None)] * 5


def test_markdown_cells(spark):
    rows = spark.createDataFrame([(1, "b|c", 2), (1, "a", None), (2, None, 3)], "k int, name string, n int")
    got = {r.k: r.report for r in measure.markdown_tables(rows, ["k"], ["name", "n"], ["name"]).collect()}
    assert got == {1: "| name | n |\n| --- | --- |\n| a |  |\n| b\\|c | 2 |\n", 2: "| name | n |\n| --- | --- |\n|  | 3 |\n"}
