"""Audio queries over the samples that ``events`` hold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio as ops
from ..operators import lossless as ll


def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one recording of 16 bits, ``event_id`` the sample's number:
    channel 0 goes up and down with the time and carries the value as noise,
    channel 1 is the value alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id as n", "abs(unix_micros(cast(ts as timestamp)) div 1000000 % 60000 - 30000) - 15000 + cast(floor(value) as bigint) as a", "least(cast(floor(value * 60) as bigint), 32767L) as b"
    )
    return e.select(F.lit("A").alias("clip"), "n", F.posexplode(F.array("a", "b")).alias("ch", "v")).selectExpr("clip", "cast(ch as bigint) as ch", "n", "v")


_S = """s as (select 'A' as clip, ch, event_id as n, case ch when 0 then abs(epoch_us(ts) // 1000000 % 60000 - 30000) - 15000 + cast(floor(value) as bigint)
 else least(cast(floor(value * 60) as bigint), 32767) end as v from events, range(2) b(ch))"""
_B = _S + ", bl as (select *, n // 4096 as block, n % 4096 as i from s)"
_RES = _B + """, d0 as (select clip, ch, block, i, v as e0, v - lag(v) over w as e1 from bl window w as (partition by clip, ch, block order by i)),
d1 as (select *, e1 - lag(e1) over w as e2 from d0 window w as (partition by clip, ch, block order by i)), d2 as (select *, e2 - lag(e2) over w as e3 from d1 window w as (partition by clip, ch, block order by i)),
d3 as (select *, e3 - lag(e3) over w as e4 from d2 window w as (partition by clip, ch, block order by i)),
res as (select clip, ch, block, i, 0::bigint as ord, e0 as e from d3 union all select clip, ch, block, i, 1, e1 from d3 where e1 is not null union all select clip, ch, block, i, 2, e2 from d3 where e2 is not null
 union all select clip, ch, block, i, 3, e3 from d3 where e3 is not null union all select clip, ch, block, i, 4, e4 from d3 where e4 is not null),
zz as (select *, case when e < 0 then -2 * e - 1 else 2 * e end as z from res),
rk as (select clip, ch, block, ord, k, cast(sum((z >> k::bigint) + 1 + k) as bigint) as bits, count(*) as cnt from zz, range(15) t(k) group by all),
ri as (select clip, ch, block, ord, any_value(cnt) as cnt, arg_min(k, (bits, k)) as k, min(bits) as bits from rk group by all),
fb as (select clip, ch, block, arg_min(ord, (ord * 16 + bits, ord)) as ord, min(ord * 16 + bits) as cost, max(cnt) filter (ord = 0) as n from ri group by all)"""


def _part_sql(src: str, key: str, zz: str = "zz") -> str:
    """CTEs of the partition search over ``src(key, ord, n)`` and its residuals."""
    return f"""po0 as (select {key}, ord, n, coalesce((select min(p) from range(1, 9) t(p) where n % (1 << p) <> 0 or (n >> p) <= ord) - 1, 8) as top from {src}),
po1 as (select {key}, ord, n, po from po0, range(9) t(po) where po <= top),
pk as (select {key}, z.ord, n, po, i // (n >> po) as part, k, sum((z >> k::bigint) + 1 + k) as bits from po1 join {zz} z using ({key}, ord), range(15) t(k) group by all),
pp as (select {key}, ord, n, po, part, 4 + min(bits) as bits from pk group by all),
pb as (select {key}, ord, n, po, cast(sum(bits) as bigint) as bits from pp group by all),
pt as (select {key}, ord, n, arg_min(po, (bits, po)) as po, min(bits) as bits from pb group by all)"""


def tones(spark, sf_dir):
    return s16(spark, sf_dir).where("ch = 0").withColumn("v", F.col("v") / 32768.0)


_T = _S + ", tn as (select clip, ch, n, v / 32768::double as v from s where ch = 0)"


def _poly(i: int, o: int) -> str:
    g = math.gcd(i, o)
    num, den = i // g, o // g
    cut = 0.5 * min(1.0, o / i)
    return f"""w0 as (select phase, k, phase / {den}::double + 31 - k as x from range({den}) a(phase), range(64) b(k)),
w1 as (select phase, k, case when abs(x) > 32 then 0 else 2 * {cut}::double * (case when x = 0 then 1 else sin(pi() * (2 * {cut}::double) * x) / (pi() * (2 * {cut}::double) * x) end)
 * (0.35875::double - 0.48829::double * cos(2 * pi() * (x + 32) / 64) + 0.14128::double * cos(4 * pi() * (x + 32) / 64) - 0.01168::double * cos(6 * pi() * (x + 32) / 64)) end as w from w0),
pw as (select phase, k, w / sum(w) over (partition by phase) as w from w1),
rs as (select m, sum(v * w) as y from (select m, m * {num} // {den} as q, m * {num} % {den} as phase from (select unnest(range((select (max(n) + 1) * {den} // {num} + 2 from tn))) as m)) o join pw using (phase) join tn on tn.n = q - 31 + k where q <= (select max(n) from tn) group by 1)"""


def _round(df, digits=6):
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _lpc_input(spark, sf_dir):
    b = ops.blocks(s16(spark, sf_dir), 256)
    return b.select("clip", "ch", "block", "i", (ops.tukey(F.col("i"), 256, 0.5) * F.col("v")).alias("x"))


_AC = """sb as (select clip, ch, n // 256 as block, n % 256 as i, v from s),
ax as (select clip, ch, block, i, v * (case when i < 63.75 then 0.5 * (1 + cos(pi() * (i / 63.75::double - 1))) when i > 191.25 then 0.5 * (1 + cos(pi() * ((i - 255) / 63.75::double + 1))) else 1 end) as x from sb),
ac as (select a.clip, a.ch, a.block, lag, sum(a.x * b.x) as r from ax a, range(9) t(lag), ax b where b.clip = a.clip and b.ch = a.ch and b.block = a.block and b.i = a.i + lag group by 1, 2, 3, 4)"""


def _energies(spark, sf_dir):
    return s16(spark, sf_dir).where("ch = 0").groupBy("clip", F.expr("n div 128").alias("b")).agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("e"))


def _bands(spark, sf_dir):
    return s16(spark, sf_dir).where("ch = 0").select("clip", F.expr("n div 100").alias("band"), F.expr("n % 100").alias("i"), F.col("v").cast("double").alias("x"))


_BD = "bd as (select clip, n // 100 as band, n % 100 as i, v::double as x from s where ch = 0)"


def _delay(spark, sf_dir):
    t = s16(spark, sf_dir).where("ch = 0")
    return ops.align_delay(t, t.withColumn("n", F.col("n") + 37), list(range(0, 65)), ["clip"])


def _stereo(spark, sf_dir):
    s = s16(spark, sf_dir)
    return s.where("ch = 0").select("clip", "n", F.col("v").alias("l")).join(s.where("ch = 1").select("clip", "n", F.col("v").alias("r")), ["clip", "n"])


def _rates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "p_size * 1000L as rate").withColumn("nearest", ops.nearest_rate(F.col("rate"), [8000, 12000, 16000, 24000, 48000]))


def _opus(spark, sf_dir):
    return s16(spark, sf_dir).groupBy("clip", F.expr("n div 960").alias("frame")).agg(F.count("*").alias("samples"), F.min("n").alias("pts")).where("samples = 1920")


def _spectrum(spark, sf_dir):
    f = s16(spark, sf_dir).where("ch = 0").groupBy("clip", F.expr("n div 32").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("v").cast("double").alias("v")))).alias("s"))
    return ops.power_spectrum(f.where("size(s) = 32").select("clip", "block", F.transform("s", lambda e: e["v"]).alias("xs")))


def _nmr(spark, sf_dir):
    b = _bands(spark, sf_dir).groupBy("clip", "band").agg(F.sum(F.col("x") * F.col("x")).alias("mask"), (F.sum(F.abs("x")) * 1e4).alias("noise"))
    return ops.nmr_summary(b, ["clip"])


def _flac_enc(spark, sf_dir):
    blocks = ll.pack_blocks(s16(spark, sf_dir))
    size, code = F.octet_length("frame").cast("bigint"), F.shiftright(F.conv(F.hex(F.substring("frame", 4, 1)), 16, 10).cast("bigint"), 4)
    frames = ll.flac_frames(blocks).select("clip", "block", size.alias("size"), code.alias("code"))
    return ll.flac_headers(frames, ll.flac_digests(blocks)).withColumn("header", F.lower(F.hex("header")))


def _flac_trip(spark, sf_dir):
    """Samples through encoded frames, linear prediction among them, and back."""
    b = ll.flac_samples(ll.flac_frames(ll.pack_blocks(s16(spark, sf_dir))))
    c = b.select("clip", "block", F.posexplode("pcm").alias("ch", "xs"))
    return c.select("clip", F.col("ch").cast("bigint").alias("ch"), "block", F.posexplode("xs").alias("i", "v")).selectExpr("clip", "ch", "4096 * block + i as n", "cast(v as bigint) as v")


def _lab(spark, sf_dir):
    t = s16(spark, sf_dir).select(F.concat(F.lit("c"), "ch").alias("clip"), "ch", "n", (F.col("v") / 7.0).alias("v"))
    return ops.quantiser_lab(t, [1.0, 4.0, 32.0])


def _signals(spark, sf_dir):
    """A tone for each part, its pitch from the size."""
    voices = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as clip", "110D + 10 * p_size as hz", "16384D as amplitude")
    return ops.tones(voices, 44100, 64).select("clip", "n", F.expr("cast(round(v) as bigint)").alias("v"))


QUERIES = {
    "power_spectrum": lambda s, d: _round(_spectrum(s, d).select("block", "bin", (F.col("p") / 1e6).alias("p")), 4),
    "agg_nmr_mp3": lambda s, d: _round(_nmr(s, d)),
    "lab_run": lambda s, d: _round(_lab(s, d), 5),
    "codec_pcm": lambda s, d: s16(s, d).groupBy("clip", "ch").agg(F.count("*").alias("samples"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")),
    "codec_opus": _opus,
    "smp_s16_f32": lambda s, d: s16(s, d).select("ch", "n", ops.s16_to_f32(F.col("v")).alias("v")),
    "smp_f32_s16": lambda s, d: s16(s, d).select("ch", "n", ops.f32_to_s16(F.col("v") / F.lit(1777.0)).alias("v")),
    "smp_deint": lambda s, d: ops.deinterleave(s16(s, d).where("ch = 0"), 3),
    "rs_nearest": lambda s, d: _rates(s, d),
    "rs_pts": lambda s, d: s16(s, d).where("ch = 0").select(F.col("n").alias("pts"), ops.rescale_pts(F.col("n"), 44100, 48000).alias("out_pts")),
    "rs_kernel": lambda s, d: _round(s16(s, d).where("ch = 1").selectExpr("n", "v % 661 - 330 as i").select("n", "i", ops.kernel(F.col("i") / 10.0, 0.5).alias("w")), 8),
    "rs_poly_table": lambda s, d: _round(ops.poly_table(s, 8000, 12000)[0], 8),
    "resample": lambda s, d: _round(ops.resample(tones(s, d), 8000, 12000).select("m", "y")),
    "rs_scalar": lambda s, d: _round(ops.resample(tones(s, d), 8000, 6000).select("m", "y")),
    "flac_block": lambda s, d: ops.blocks(s16(s, d)).groupBy("ch", "block").agg(F.count("*").alias("n"), F.max("i").alias("last")),
    "flac_fixed": lambda s, d: ops.residuals(ops.blocks(s16(s, d))).groupBy("ch", "block", "ord").agg(F.count("*").alias("n"), F.sum("e").alias("total"), F.sum(F.abs("e")).alias("absolute")),
    "flac_zigzag": lambda s, d: s16(s, d).select("ch", "n", "v", ops.zigzag(F.col("v")).alias("u")),
    "flac_rice": lambda s, d: ops.rice(ops.residuals(ops.blocks(s16(s, d))), ["clip", "ch", "block", "ord"]),
    "flac_fixed_best": lambda s, d: ops.best_fixed(ops.residuals(ops.blocks(s16(s, d))), 16),
    "flac_partition": lambda s, d: ops.partitions(ops.residuals(ops.blocks(s16(s, d))), ops.best_fixed(ops.residuals(ops.blocks(s16(s, d))), 16)),
    "flac_subframe": lambda s, d: ops.subframes(ops.blocks(s16(s, d)), F.lit(16)),
    "flac_stereo": lambda s, d: ops.stereo_mode(_stereo(s, d), 16),
    "flac_window": lambda s, d: _round(ops.blocks(s16(s, d), 256).select("ch", "block", "i", (F.col("v") * ops.tukey(F.col("i"), 256, 0.5)).alias("a"), (F.col("v") * ops.tukey(F.col("i"), 256, 0.2)).alias("b")), 9),
    "flac_autoc": lambda s, d: _round(ops.autocorrelation(_lpc_input(s, d), 8).withColumn("r", F.col("r") / 1e6), 3),
    "flac_levinson": lambda s, d: _round(ops.lpc(ops.autocorrelation(_lpc_input(s, d), 8), 8).select("ch", "block", F.posexplode("coefficients").alias("k", "c")).select("ch", "block", F.col("k").cast("bigint").alias("k"), "c"), 5),
    "sig_lpc": lambda s, d: _round(ops.lpc(ops.autocorrelation(_lpc_input(s, d), 8), 8).select("ch", "block", (10 * F.log10("gain")).alias("gain_db")), 4),
    "codec_flac_enc": _flac_enc,
    "codec_flac_dec": _flac_trip,
    "flac_lpc": lambda s, d: ll.flac_choices(ll.pack_blocks(s16(s, d))),
    "ms_transform": lambda s, d: _round(_stereo(s, d).selectExpr("n", "(l + r) / sqrt(2D) as mid", "(l - r) / sqrt(2D) as side")),
    "ms_energy": lambda s, d: _stereo(s, d).groupBy(F.expr("n div 576").alias("granule")).agg(F.expr("2 * sum((l - r) * (l - r)) < sum((l + r) * (l + r))").alias("mid_side")),
    "mp3_quant": lambda s, d: _round(s16(s, d).select("ch", "n", ops.power_quantise(F.col("v") * 7.25).alias("level"), ops.power_dequantise(F.col("v")).alias("value")), 4),
    "sig_attack": lambda s, d: _round(ops.attack_ratio(_energies(s, d)).select("b", "ratio")),
    "sig_tonality": lambda s, d: _round(ops.tonality(_bands(s, d), ["band"])),
    "sig_pe": lambda s, d: _round(ops.perceptual_entropy(_bands(s, d).groupBy("clip", "band").agg(F.count("*").alias("lines"), F.sum(F.col("x") * F.col("x")).alias("energy"), (F.max(F.abs("x")) * 100.0).alias("threshold")), ["clip"])),
    "sig_loudness": lambda s, d: _round(ops.loudness(s16(s, d).select(F.expr("n div 1024").alias("frame"), "ch", (F.col("v") / 32768.0).alias("v")), ["frame", "ch"])),
    "sig_rolloff": lambda s, d: ops.rolloff(_bands(s, d), ["band"]),
    "sig_xcorr": lambda s, d: _round(ops.cross_correlation(_stereo(s, d).select(F.expr("n div 500").alias("band"), F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r")), ["band"])),
    "align_delay": lambda s, d: _delay(s, d),
    "mdct": lambda s, d: _round(ops.mdct(s16(s, d).where("ch = 0").select("clip", F.expr("n div 32").alias("block"), F.expr("n % 32").alias("i"), F.col("v").cast("double").alias("v")), 16).select("block", "k", "x"), 4),
    "gen_signals": _signals,
}

_ST = "sp as (select a.n, a.v as l, b.v as r from s a join s b on a.n = b.n and a.ch = 0 and b.ch = 1)"
_LPC = f"""with recursive {_S}, {_AC}, rr as (select clip, ch, block, list(r order by lag) as r from ac group by 1, 2, 3),
lv(clip, ch, block, r, i, a, err) as (select clip, ch, block, r, 0, []::double[], r[1] from rr union all
 select clip, ch, block, r, i + 1, list_append(list_transform(list_zip(a, list_reverse(a)), lambda x: x[1] - k * x[2]), k), err * (1 - k * k) from
 (select *, (r[i + 2] - coalesce(list_sum(list_transform(list_zip(a, list_reverse(r[2:i + 1])), lambda x: x[1] * x[2])), 0)) / err as k from lv where i < 8))"""
_STEREO = f"""with {_S}, {_ST},
bl as (select ch, n // 4096 as block, n % 4096 as i, v from (select n, 0::bigint as ch, l as v from sp union all select n, 1, r from sp union all select n, 2, (l + r) >> 1::bigint from sp union all select n, 3, l - r from sp)), """.replace("(l + r) >> 1::bigint", "cast(floor((l + r) / 2) as bigint)") + _RES.replace(_B, "x as (select 1)").replace("clip, ch", "ch") + """,
bp as (select ch, block, case when ch = 3 then 17 else 16 end as bps, count(*) as n, min(v) = max(v) as same from bl group by 1, 2),
pick as (select ch, block, any_value(bps) as bps, any_value(n) as n, arg_min(ord, (ord * bps + bits, ord)) as ord from ri join bp using (ch, block) where ord = 0 or ord <= n - 1 group by 1, 2), """ + _part_sql("pick", "ch, block") + """,
sf as (select ch, block, case when same then 8 + bps when 8 + ord * bps + 6 + bits <= 8 + bp.n * bps then 8 + ord * bps + 6 + bits else 8 + bp.n * bps end as bits from bp join pt using (ch, block)),
pv as (select block, max(bits) filter (ch = 0) as l, max(bits) filter (ch = 1) as r, max(bits) filter (ch = 2) as m, max(bits) filter (ch = 3) as sd from sf group by 1)
select 'A' as clip, block, case least(l + r, l + sd, sd + r, m + sd) when l + r then 1 when l + sd then 8 when sd + r then 9 else 10 end::bigint as code, cast(least(l + r, l + sd, sd + r, m + sd) as bigint) as bits from pv"""

_LAGS = range(1, 13)
_LOWER = ("cast(floor((l + r) / 2) as bigint)", _RES.replace(_B, "x as (select 1)").replace("clip, ch", "ch"))
_FLAC = f"""with recursive {_S}, {_ST},
bl as (select ch, block, row_number() over (partition by ch, block order by n) - 1 as i, v from (select n // 4096 as block, n, 0::bigint as ch, l as v from sp union all select n // 4096, n, 1, r from sp
 union all select n // 4096, n, 2, {_LOWER[0]} from sp union all select n // 4096, n, 3, l - r from sp)), {_LOWER[1]},
bp as (select ch, block, case when ch = 3 then 17 else 16 end as bps, count(*) as n, min(v) = max(v) as same, list(v order by i) as x from bl group by 1, 2),
pick as (select ch, block, any_value(bps) as bps, any_value(n) as n, arg_min(ord, (ord * bps + bits, ord)) as ord from ri join bp using (ch, block) where ord = 0 or ord <= n - 1 group by 1, 2),
wx as (select ch, block, bps, n, tap, list_transform(x, lambda v, i: v * (case when (i - 1) / (n - 1) < alpha / 2 then 0.5::double * (1 + cos(pi() * (2 * ((i - 1) / (n - 1)) / alpha - 1)))
 when (i - 1) / (n - 1) > 1 - alpha / 2 then 0.5::double * (1 + cos(pi() * (2 * ((i - 1) / (n - 1)) / alpha - 2 / alpha + 1))) else 1 end)) as w from bp, (values (1, 0.5::double), (2, 0.2::double)) t(tap, alpha) where n > 1 and not same),
ac as (select ch, block, bps, n, tap, list_transform(range(least(12, n // 2) + 1), lambda k: list_sum(list_transform(list_zip(w[k + 1:], w[:n - k]), lambda p: p[1] * p[2]))) as r from wx),
lv(ch, block, bps, n, tap, r, i, a, err) as (select ch, block, bps, n, tap, r, 0::bigint, []::double[], r[1] from ac where r[1] > 0 union all
 select ch, block, bps, n, tap, r, i + 1, list_append(list_transform(list_zip(a, list_reverse(a)), lambda p: p[1] - k * p[2]), k), err * (1 - k * k) from
 (select *, list_sum(list_prepend(r[i + 2], list_transform(list_zip(a, list_reverse(r[2:i + 1])), lambda p: -(p[1] * p[2])))) / err as k from lv where i < len(r) - 1 and err > 0)),
lo as (select ch, block, tap, any_value(n) as n, arg_min(i, (est, i)) as ord, arg_min(a, (est, i)) as a from
 (select *, i * (bps + 14) + case when err > 0 then greatest(0, 0.5::double * log2(err / n)) else 0 end * (n - i) as est from lv where i > 0) group by 1, 2, 3),
lq as (select *, greatest(0, least(15, 12 - floor(log2(top))::int)) as shift from (select *, list_max(list_transform(a, lambda c: abs(c))) as top from lo) where top > 0 and isfinite(top)),
qz(ch, block, tap, n, ord, a, shift, j, q, err) as (select ch, block, tap, n, ord, a, shift, 0::bigint, []::bigint[], 0::double from lq union all
 select ch, block, tap, n, ord, a, shift, j + 1, list_append(q, v), y - v from (select *, cast(greatest(-8192, least(8191, round(y))) as bigint) as v from (select *, a[j + 1] * (1 << shift) + err as y from qz where j < ord))),
lx as (select ch, block, i, v, {", ".join(f"lag(v, {j}) over w as p{j}" for j in _LAGS)} from bl window w as (partition by ch, block order by i)),
le as (select ch, block, tap, n, ord, i, v - cast(floor(({" + ".join(f"coalesce(q[{j}] * p{j}, 0)" for j in _LAGS)}) / (1 << shift)) as bigint) as e from lx join qz using (ch, block)
 where j = ord and i >= ord and list_sum(list_transform(q, lambda c: abs(c))) > 0 qualify max(abs(e)) over (partition by ch, block, tap) < 1 << 30),
lz as (select ch, block, 0 as tap, ord, i, z from zz union all select ch, block, tap, ord, i, case when e < 0 then -2 * e - 1 else 2 * e end from le),
cand as (select ch, block, 0 as tap, ord, n from pick union all select distinct ch, block, tap, ord, n from le), {_part_sql("cand", "ch, block, tap", "lz")},
sf as (select ch, block, any_value(case when same then 8 + bps end) as flat, min(8 + bp.n * bps) as verbatim, min(14 + ord * bps + case tap when 0 then 0 else 9 + ord * 14 end + bits) as coded from bp join pt using (ch, block) group by 1, 2),
pv as (select block, max(bits) filter (ch = 0) as l, max(bits) filter (ch = 1) as r, max(bits) filter (ch = 2) as m, max(bits) filter (ch = 3) as sd from (select ch, block, coalesce(flat, least(coded, verbatim)) as bits from sf) group by 1),
fr as (select block, case least(l + r, l + sd, sd + r, m + sd) when l + r then 1 when l + sd then 8 when sd + r then 9 else 10 end::bigint as code, cast(7 + case when block < 128 then 1 else (select min(m) + 1 from range(1, 7) c(m) where block < 1::bigint << (5 * m + 6)) end
 + ceil(least(l + r, l + sd, sd + r, m + sd) / 8) + 2 as bigint) as size from pv),
md as (select md5(unhex(string_agg(printf('%02x%02x%02x%02x', l & 255, (l + 65536) % 65536 // 256, r & 255, (r + 65536) % 65536 // 256), '' order by n))) as md5, count(*) as total from sp),
hd as (select '664c614380000022' || printf('%04x%04x%06x%06x%016x', min(n), max(n), min(size), max(size), (44100::bigint << 44) + (1::bigint << 41) + (15::bigint << 36) + any_value(total)) || any_value(md5) as header from fr join bp using (block), md where ch = 0)
select 'A' as clip, block, size, code, header from fr, hd"""

SQL = {
    "power_spectrum": f"with {_S}, x as (select n // 32 as block, n % 32 as i, v * (0.5 - 0.5 * cos(2 * pi() * (n % 32) / 32)) as v from s where ch = 0 and n < (select (max(n) + 1) // 32 * 32 from s)), c as (select block, k, sum(v * cos(2 * pi() * k * i / 32)) as re, sum(v * sin(2 * pi() * k * i / 32)) as im from x, range(17) t(k) group by 1, 2) select block, k as bin, round((re * re + im * im) / 1e6, 4) + 0 as p from c",
    "agg_nmr_mp3": f"with {_S}, {_BD}, b as (select clip, band, sum(x * x) as mask, sum(abs(x)) * 1e4 as noise from bd group by 1, 2), d as (select clip, 10 * log10(greatest(noise, 1e-20) / greatest(mask, max(mask) over (partition by clip) * 1e-5, 1e-20)) as db from b) select clip, round(avg(db), 6) as mean_db, round(max(db), 6) as max_db, round(count(*) filter (db > 0) * 100 / count(*), 6) as audible_pct from d group by 1",
    "lab_run": f"with {_S}, t as (select 'c' || ch as clip, v / 7::double as v from s), e as (select clip, step, abs(v - floor(v / step + 0.5) * step) as e from t, (values (1::double), (4::double), (32::double)) s(step)) select clip, step, count(*) as n, round(max(e), 5) as max_abs_err, round(sqrt(avg(e * e)), 5) as rmse from e group by 1, 2",
    "codec_pcm": f"with {_S} select clip, ch, count(*) as samples, cast(sum(v) as bigint) as total, min(v) as low, max(v) as high from s group by 1, 2",
    "codec_opus": f"with {_S} select clip, n // 960 as frame, count(*) as samples, min(n) as pts from s group by 1, 2 having count(*) = 1920",
    "smp_s16_f32": f"with {_S} select ch, n, v / 32768::double as v from s",
    "smp_f32_s16": f"with {_S}, x as (select ch, n, v / 1777::double * 32768::double as x from s) select ch, n, cast(greatest(-32768, least(32767, case when x < 0 then ceil(x - 0.5) else floor(x + 0.5) end)) as bigint) as v from x",
    "smp_deint": f"with {_S} select clip, n % 3 as ch, n // 3 as n, v from s where ch = 0",
    "rs_nearest": "select p_partkey, p_size * 1000::bigint as rate, arg_min(a, (abs(p_size * 1000 - a), i))::bigint as nearest from part, (values (0, 8000), (1, 12000), (2, 16000), (3, 24000), (4, 48000)) v(i, a) group by all",
    "rs_pts": "select event_id as pts, event_id * 48000 // 44100 as out_pts from events",
    "rs_kernel": f"with {_S} select n, i, round(case when abs(i / 10::double) > 32 then 0 else (case when i = 0 then 1 else sin(pi() * i / 10::double) / (pi() * i / 10::double) end)"
    " * (0.35875::double - 0.48829::double * cos(2 * pi() * (i / 10::double + 32) / 64) + 0.14128::double * cos(4 * pi() * (i / 10::double + 32) / 64) - 0.01168::double * cos(6 * pi() * (i / 10::double + 32) / 64)) end, 8) + 0 as w from (select n, v % 661 - 330 as i from s where ch = 1)",
    "rs_poly_table": f"with {_T}, {_poly(8000, 12000)} select phase, k, round(w, 8) + 0 as w from pw",
    "resample": f"with {_T}, {_poly(8000, 12000)} select m, round(y, 6) + 0 as y from rs",
    "rs_scalar": f"with {_T}, {_poly(8000, 6000)} select m, round(y, 6) + 0 as y from rs",
    "flac_block": f"with {_B} select ch, block, count(*) as n, max(i) as last from bl group by 1, 2",
    "flac_fixed": f"with {_RES} select ch, block, ord, count(*) as n, cast(sum(e) as bigint) as total, cast(sum(abs(e)) as bigint) as absolute from res group by 1, 2, 3",
    "flac_zigzag": f"with {_S} select ch, n, v, case when v < 0 then -2 * v - 1 else 2 * v end as u from s",
    "flac_rice": f"with {_RES} select clip, ch, block, ord, cnt, k, bits from ri",
    "flac_fixed_best": f"with {_RES} select clip, ch, block, n, ord, cost from fb",
    "flac_partition": f"with {_RES}, {_part_sql('fb', 'clip, ch, block')} select clip, ch, block, ord, n, po, bits from pt",
    "flac_subframe": f"with {_RES}, bp as (select clip, ch, block, min(v) = max(v) as same from bl group by 1, 2, 3), {_part_sql('fb', 'clip, ch, block')}"
    " select clip, ch, block, case when same then 'constant' when 14 + ord * 16 + bits <= 8 + n * 16 then 'fixed' else 'verbatim' end as kind, cast(case when same then 24 when 14 + ord * 16 + bits <= 8 + n * 16 then 14 + ord * 16 + bits else 8 + n * 16 end as bigint) as bits from bp join pt using (clip, ch, block)",
    "flac_stereo": _STEREO,
    "flac_window": f"with {_S}, bl as (select ch, n // 256 as block, n % 256 as i, v from s) select ch, block, i, round(v * case when i < 63.75 then 0.5 * (1 + cos(pi() * (i / 63.75::double - 1))) when i > 191.25 then 0.5 * (1 + cos(pi() * ((i - 255) / 63.75::double + 1))) else 1 end, 9) + 0 as a,"
    " round(v * case when i < 25.5 then 0.5 * (1 + cos(pi() * (i / 25.5::double - 1))) when i > 229.5 then 0.5 * (1 + cos(pi() * ((i - 255) / 25.5::double + 1))) else 1 end, 9) + 0 as b from bl",
    "flac_autoc": f"with {_S}, {_AC} select clip, ch, block, lag, round(r / 1e6::double, 3) as r from ac",
    "flac_levinson": _LPC + " select ch, block, k, round(a[k + 1], 5) + 0 as c from lv, range(8) t(k) where i = 8",
    "sig_lpc": _LPC + " select ch, block, round(10 * log10(r[1] / err), 4) as gain_db from lv where i = 8",
    "codec_flac_enc": _FLAC,
    "codec_flac_dec": f"with {_S} select clip, ch, n, v from s",
    "ms_transform": f"with {_S}, {_ST} select n, round((l + r) / sqrt(2), 6) as mid, round((l - r) / sqrt(2), 6) as side from sp",
    "ms_energy": f"with {_S}, {_ST} select n // 576 as granule, 2 * sum((l - r) * (l - r)) < sum((l + r) * (l + r)) as mid_side from sp group by 1",
    "mp3_quant": f"with {_S} select ch, n, cast(sign(v) * greatest(0, least(8206, floor(abs(v * 7.25::double) ** 0.75 - 0.0946 + 0.5))) as bigint) as level, round(sign(v) * abs(v)::double ** (4::double / 3), 4) as value from s",
    "sig_attack": f"""with recursive {_S}, e as (select n // 128 as b, sum(v::double * v) as e from s where ch = 0 group by 1), f as (select avg(e) * 1e-3 as least from e),
     r(b, e, avg, ratio) as (select b, e, 0.25 * e, e / f.least from e, f where b = 0 union all select e.b, e.e, 0.75 * r.avg + 0.25 * e.e, e.e / greatest(r.avg, f.least) from r join e on e.b = r.b + 1, f)
     select b, round(ratio, 6) as ratio from r""",
    "sig_tonality": f"with {_S}, {_BD} select band, round(greatest(0, least(1, 10 * log10(exp(avg(ln(greatest(x * x, 1e-10)))) / greatest(avg(greatest(x * x, 1e-10)), 1e-30)) / -60)), 6) as tonality from bd group by 1",
    "sig_pe": f"with {_S}, {_BD}, b as (select clip, count(*) as l, sum(x * x) as e, max(abs(x)) * 100 as t from bd group by clip, band) select clip, round(sum(l * log2(1 + e / greatest(t, 1e-20))), 6) as pe from b group by 1",
    "sig_loudness": f"with {_S} select n // 1024 as frame, ch, round(20 * log10(sqrt(avg((v / 32768::double) ** 2))), 6) as loudness_dbfs, round(20 * log10(max(abs(v / 32768::double))), 6) as peak_dbfs from s group by 1, 2",
    "sig_rolloff": f"with {_S}, {_BD}, r as (select band, i, sum(x * x) over (partition by band order by i rows unbounded preceding) as run, sum(x * x) over (partition by band) as total from bd) select band, min(i) as bin from r where run >= total * 0.95 group by 1",
    "sig_xcorr": f"with {_S}, {_ST} select n // 500 as band, round(sum(l::double * r) / greatest(sqrt(sum(l::double * l)) * sqrt(sum(r::double * r)), 1e-20), 6) as corr from sp group by 1",
    "align_delay": "select 'A' as clip, 37::bigint as shift, 0::double as mse",
    "mdct": f"with {_S} select n // 32 as block, k, round(sum(v * cos(pi() / 16 * (n % 32 + 0.5 + 8) * (k + 0.5))), 4) as x from s, range(16) t(k) where ch = 0 group by 1, 2",
    "gen_signals": "select p_partkey as clip, n, cast(round(16384 * sin(2 * pi() * (110::double + 10 * p_size) / 44100 * n)) as bigint) as v from part, range(64) t(n)",
}
