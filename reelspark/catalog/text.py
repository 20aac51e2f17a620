"""Subtitle, address, integer and checksum queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as bn
from ..functions import text as tx


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark, sf_dir):
    """Conversation turns as cues: two seconds apart, 40 ms a character."""
    return _read(spark, sf_dir, "conversations").selectExpr("conv_id as file", "turn as ordinal", "turn * 2000 as start_ms", "turn * 2000 + 40 * length(text) as end_ms", "regexp_replace(text, '\\n+', '\\n') as text")


_CUES = r"cu as (select conv_id as file, turn as ordinal, turn * 2000 as start_ms, turn * 2000 + 40 * length(text) as end_ms, regexp_replace(text, '\n+', chr(10), 'g') as text from conversations)"
_TS = "lpad(({0} // 3600000)::varchar, greatest(2, length(({0} // 3600000)::varchar))::int, '0') || ':' || lpad(({0} // 60000 % 60)::varchar, 2, '0') || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0') || '{1}' || lpad(({0} % 1000)::varchar, 3, '0')"


def _stamp(e: str, sep: str = ",") -> str:
    return _TS.format(e, sep)


#: Stamps of each turn in four spellings, the third not a time, and lines of two.
_SPELLINGS = [
    ("concat(' ', conv_id % 30, ':', turn, ':', conv_id % 60, ',', turn * 7, ' ')", "(conv_id % 30 * 3600 + turn * 60 + conv_id % 60) * 1000 + turn * 7"),
    ("concat(lpad(cast(turn as varchar(9)), 2, '0'), ':', lpad(cast(conv_id % 60 as varchar(9)), 2, '0'), '.', conv_id % 10)", "(turn * 60 + conv_id % 60) * 1000 + conv_id % 10"),
    ("concat('a:', turn, ':', conv_id, ',5')", "cast(null as bigint)"),
    ("concat('10', turn, ':00:59,', lpad(cast(conv_id % 1000 as varchar(9)), 3, '0'))", "((case when turn < 10 then 100 else 1000 end + turn) * 3600 + 59) * 1000 + conv_id % 1000"),
]
_STAMP = "case " + " ".join(f"when (conv_id + turn) % 4 = {i} then {e}" for i, (e, _) in enumerate(_SPELLINGS)) + " end"
_STAMP_MS = "case " + " ".join(f"when (conv_id + turn) % 4 = {i} then {e}" for i, (_, e) in enumerate(_SPELLINGS)) + " end"
_LINE = f"concat({_STAMP}, case when conv_id % 3 = 0 then '-->' when conv_id % 3 = 1 then ' --> ' else ' to ' end, '00:0', turn % 10, '.', turn, case when turn % 2 = 0 then ' align:left' else '' end)"


def _parsed(spark, sf_dir):
    return tx.parse_cues(tx.render_cues(cues(spark, sf_dir), ["file"], "srt"), ["file"], "content")


def _messy(spark, sf_dir):
    """Files with a mark, mixed line ends, a note, identifiers, settings and a
    line that is no time, a cue for each turn."""
    end = "if(turn % 2 = 0, '\\r\\n', '\\r')"
    time = lambda t: f"concat('00:', lpad(cast({t} as string), 2, '0'), '.000')"
    cue = f"concat(if(turn % 3 = 0, concat('cue', {end}), ''), {time('turn % 60')}, ' --> ', {time('(turn + 1) % 60')}, ' align:left', {end}, 'turn ', turn, {end}, 'of ', conv_id, {end}, {end}, if(turn % 4 = 1, concat('00:01.000 --> bad', {end}), ''))"
    c = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file")).agg(F.array_sort(F.collect_list(F.struct("turn", F.expr(cue).alias("cue")))).alias("cues"))
    c = c.select("file", F.concat(F.lit("\ufeffWEBVTT\r\n\r\nNOTE skip\r\n\r\n"), F.array_join(F.transform("cues", lambda e: e["cue"]), "")).alias("content"))
    return tx.parse_cues(c, ["file"], "content")


#: A number under 4096 of each event, from its value.
_NUMBER = "cast(floor(value * 8) as bigint) % 4096"
_NUMBERS = f"(select {_NUMBER} as id from events)"


def _numbers(spark, sf_dir):
    return _read(spark, sf_dir, "events").selectExpr(f"{_NUMBER} as id")


def _from_id(spark, sf_dir, expr):
    return _numbers(spark, sf_dir).select("id", F.unhex(F.expr(expr)).alias("data"))


def _mp3(spark, sf_dir):
    h = _read(spark, sf_dir, "events").selectExpr("event_id as id", "224 + event_id % 32 as b1", "event_id * 37 % 256 as b2", "event_id * 11 % 256 as b3")
    d = h.select("id", F.unhex(F.concat(F.lit("FF"), *[F.lpad(F.hex(c), 2, "0") for c in ("b1", "b2", "b3")])).alias("data"))
    return d.select("id", bn.mp3_header(F.col("data")).alias("h")).where("h is not null").select("id", "h.*")


_KB = lambda xs: "[" + ", ".join(map(str, xs)) + "]"
_PAD = lambda n, k: f"lpad(hex({n}), {2 * k}, '0')"


def _src_mp3(spark, sf_dir):
    """Frames of each stream by header, with their running time."""
    f = _mp3(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.partitionBy("rate", "channels").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return f.select("rate", "channels", "id", "size", F.coalesce(F.sum("samples").over(w), F.lit(0)).alias("pts"))


def _units(spark, sf_dir):
    return _read(spark, sf_dir, "events").selectExpr("event_id", "encode(props, 'utf-8') as a", "encode(event_type, 'utf-8') as b")


# Bit strings of Exp-Golomb codes and of parameter sets by formula.
_UE = lambda v: f"concat(repeat('0', cast(floor(log2({v} + 1)) as int)), bin({v} + 1))"
_SPS_BITS = f"""concat(if(id % 2 = 0, '01000010', '01100100'), '00000000', '00011110', '1', if(id % 2 = 0, '', concat({_UE('1')}, '11', '00')), '1', {_UE('2')}, {_UE('3')}, '0',
 {_UE('id % 120')}, {_UE('id % 68')}, if(id % 5 = 0, '00', '1'), '1', if(id % 3 = 0, concat('1', {_UE('0')}, {_UE('id % 4')}, {_UE('0')}, {_UE('id % 3 + 1')}), '0'), '01')"""


def _sps(spark, sf_dir):
    b = _numbers(spark, sf_dir).selectExpr("id", f"{_SPS_BITS} as bits").selectExpr("id", "rpad(concat(bits, '1'), 8 * cast(ceil((length(bits) + 1) / 8) as int), '0') as bits")
    nibbles = "array_join(transform(sequence(0, cast(length(bits) div 4 as int) - 1), i -> conv(substr(bits, i * 4 + 1, 4), 2, 16)), '')"
    return b.select("id", bn.sps_size(F.expr(f"unhex(concat('67', {nibbles}))")).alias("d")).select("id", "d.*")


def _esds(spark, sf_dir):
    """Descriptors with sizes of one and of four bytes, and optional fields."""
    size = lambda n: f"if(id % 2 = 0, {_PAD(n, 1)}, concat('808080', {_PAD(n, 1)}))"
    more = "if(id % 3 = 0, 'AABB', '')"
    body = f"concat('00000000', '03', {size('40')}, '0001', if(id % 3 = 0, '80', '00'), {more}, '04', {size('20')}, repeat('40', 13), if(id % 7 = 0, '06', '05'), {size('2')}, {_PAD('id', 2)})"
    return _from_id(spark, sf_dir, body).select("id", F.hex(bn.decoder_config(F.col("data"))).alias("config"))


LOCATIONS = ["http://other.example.org/x", "/root/rel", "bare", "https://s.example.org/"]

QUERIES = {
    "fn_ts_format": lambda s, d: _read(s, d, "conversations").selectExpr("conv_id", "turn", "conv_id * 1234567 + turn * 777 - 500 as ms").select("conv_id", "turn", tx.format_timestamp(F.col("ms")).alias("srt"), tx.format_timestamp(F.col("ms"), ".").alias("vtt")),
    "fn_ts_parse": lambda s, d: _read(s, d, "conversations").selectExpr("conv_id", "turn", f"{_STAMP} as stamp").select("conv_id", "turn", tx.parse_timestamp(F.col("stamp")).alias("ms")),
    "fn_cue_timing": lambda s, d: _read(s, d, "conversations").selectExpr("conv_id", "turn", f"{_LINE} as line").select("conv_id", "turn", tx.cue_timing(F.col("line")).alias("t")).select("conv_id", "turn", "t.*"),
    "fn_cues": _messy,
    "src_srt": _parsed,
    "src_vtt": lambda s, d: tx.parse_cues(tx.render_cues(cues(s, d), ["file"], "vtt"), ["file"], "content"),
    "sink_srt": lambda s, d: tx.render_cues(cues(s, d), ["file"], "srt"),
    "sink_vtt": lambda s, d: tx.render_cues(cues(s, d), ["file"], "vtt"),
    "fn_srt_vtt": lambda s, d: tx.render_cues(_parsed(s, d), ["file"], "vtt"),
    "fn_url_parts": lambda s, d: _read(s, d, "pages").select("page_id", tx.url_parts(F.col("url")).alias("u")).select("page_id", "u.*"),
    "fn_redirect": lambda s, d: _read(s, d, "pages").select("page_id", tx.resolve_redirect(F.col("url"), F.element_at(F.array(*[F.lit(x) for x in LOCATIONS]), (F.col("page_id") % 4 + 1).cast("int"))).alias("target")),
    "fn_json_escape": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", tx.json_escape(F.concat(F.lit('"\\'), F.col("text"), F.lit('"'))).alias("escaped")),
    "fn_le_be": lambda s, d: _from_id(s, d, _PAD("id * 7919 % 16777216", 4)).select("id", bn.big_endian(F.col("data"), 0, 4).alias("be"), bn.little_endian(F.col("data"), 0, 4).alias("le"), bn.big_endian(F.col("data"), 2, 2).alias("be16"), bn.big_endian(F.col("data"), 3, 2).alias("past")),
    "fn_syncsafe": lambda s, d: _from_id(s, d, "concat(" + ", ".join(_PAD(f"shiftright(id * 70001, {7 * i}) & 127", 1) for i in (3, 2, 1, 0)) + ")").select("id", bn.syncsafe(F.col("data"), 0).alias("size")),
    "fn_leb128": lambda s, d: _from_id(s, d, f"if(id * 7 < 128, {_PAD('id * 7', 1)}, if(id * 7 < 16384, concat({_PAD('128 + (id * 7) % 128', 1)}, {_PAD('id * 7 div 128', 1)}), concat({_PAD('128 + (id * 7) % 128', 1)}, {_PAD('128 + (id * 7) div 128 % 128', 1)}, {_PAD('id * 7 div 16384', 1)}, 'FF')))").select("id", bn.leb128(F.col("data")).alias("v")).select("id", "v.value", F.col("v.size").cast("bigint").alias("size")),
    "fn_ts33": lambda s, d: _numbers(s, d).selectExpr("id", "id * 98765432 as pts").select("id", F.hex(bn.ts33_bytes(F.col("pts"))).alias("bytes"), bn.ts33(bn.ts33_bytes(F.col("pts"))).alias("pts")),
    "fn_mp3_header": _mp3,
    "src_mp3": _src_mp3,
    "fn_bits": lambda s, d: _from_id(s, d, _PAD("id * 791987 % 4294967296", 4)).select("id", bn.bits(F.col("data"), (F.col("id") % 13).cast("int"), 11).alias("mid"), bn.bits(F.col("data"), 3, 29).alias("tail"), bn.bits(F.col("data"), 30, 3).alias("past")),
    "fn_exp_golomb": lambda s, d: _from_id(s, d, _PAD("shiftleft(id + 1, cast(31 - 2 * floor(log2(id + 1)) as int))", 4)).select("id", bn.exp_golomb(F.col("data"), 0).alias("g")).select("id", "g.value", "g.next"),
    "fn_asc": lambda s, d: _from_id(s, d, _PAD("(1 + id % 30) * 2048 + (id % 13) * 128 + (id % 8) * 8", 2)).select("id", bn.audio_config(F.col("data")).alias("c")).select("id", "c.*"),
    "fn_annexb_split": lambda s, d: _units(s, d).select("event_id", F.posexplode(bn.annexb_units(F.expr("concat(x'00000001', a, x'000001', b, x'00', x'00000001', a)"))).alias("n", "unit")).select("event_id", F.col("n").cast("bigint").alias("n"), F.md5("unit").alias("md5")),
    "fn_avcc_annexb": lambda s, d: _units(s, d).select("event_id", F.md5(bn.avcc_to_annexb(F.expr("concat(unhex(lpad(hex(octet_length(a)), 8, '0')), a, unhex(lpad(hex(octet_length(b)), 8, '0')), b)"), F.lit(4))).alias("md5")),
    "fn_sps_dims": _sps,
    "fn_esds": _esds,
    "fn_ebml_vint": lambda s, d: _from_id(s, d, f"concat(if(id < 127, {_PAD('128 + id', 1)}, {_PAD('16384 + id', 2)}), 'FF')").select("id", bn.ebml_vint(F.col("data")).alias("v")).select("id", F.col("v.id").alias("whole"), "v.value", "v.size"),
    "fn_crc32_ogg": lambda s, d: _read(s, d, "nation").select("n_nationkey", bn.crc32_ogg(F.encode("n_name", "utf-8")).alias("crc")),
    "fn_crc32_mpeg": lambda s, d: _read(s, d, "nation").select("n_nationkey", bn.crc32_mpeg(F.encode("n_name", "utf-8")).alias("crc")),
    "fn_crc8": lambda s, d: _read(s, d, "nation").select("n_nationkey", bn.crc8_flac(F.encode("n_name", "utf-8")).alias("crc")),
    "fn_crc16": lambda s, d: _read(s, d, "nation").select("n_nationkey", bn.crc16_flac(F.encode("n_name", "utf-8")).alias("crc")),
    "fn_adler32": lambda s, d: _read(s, d, "nation").select("n_nationkey", bn.adler32(F.encode("n_name", "utf-8")).alias("adler")),
    "fn_md5": lambda s, d: _read(s, d, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("md5")),
    "fn_hash_hex": lambda s, d: _read(s, d, "nation").select("n_nationkey", F.hex(F.encode("n_name", "utf-8")).alias("h")),
    "fn_png16to8": lambda s, d: _read(s, d, "events").selectExpr("cast(floor(value * 200) as bigint) % 65536 as id").select(F.col("id").alias("v"), bn.png_16_to_8(F.col("id")).cast("bigint").alias("b")),
}


def _crc_sql(bits: int, poly: int, start: int, name: str = "crc") -> str:
    """A recursive fold over bits, most significant first."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    feed = f"xor(c, case when i % 8 = 0 then ascii(n_name[i // 8 + 1])::bigint << {bits - 8} else 0 end)"
    return (
        f"with recursive f(n_nationkey, n_name, i, c) as (select n_nationkey, n_name, 0::bigint, {start}::bigint from nation union all"
        f" select n_nationkey, n_name, i + 1, case when ({feed}) & {top} <> 0 then xor(({feed}) << 1, {poly}) & {mask} else (({feed}) << 1) & {mask} end from f where i < 8 * length(n_name))"
        f" select n_nationkey, c as {name} from f where i = 8 * length(n_name)"
    )


_MP3 = f"""with h as (select id, 224 + id % 32 as b1, id * 37 % 256 as b2, id * 11 % 256 as b3 from (select event_id as id from events)),
p as (select id, b1 // 8 % 4 as v, b1 // 2 % 4 as l, b2 // 16 as br, b2 // 4 % 4 as sr, b2 // 2 % 2 as pad, b3 // 64 as cm from h),
q as (select id, v, pad, case when v = 3 then ({_KB(bn.MP3_KBPS_V1)})[br + 1] else ({_KB(bn.MP3_KBPS_V2)})[br + 1] end as kbps,
 (case v when 3 then {_KB(bn.MP3_RATES[3])} when 2 then {_KB(bn.MP3_RATES[2])} else {_KB(bn.MP3_RATES[0])} end)[sr + 1] as rate, case when cm = 3 then 1 else 2 end as channels, case when v = 3 then 1152 else 576 end as samples
 from p where v <> 1 and l = 1 and br between 1 and 14 and sr < 3),
m as (select id, kbps::bigint as kbps, rate::bigint as rate, channels::bigint as channels, samples::bigint as samples, cast(samples // 8 * kbps * 1000 // rate + pad as bigint) as size from q)"""
_RENDER = f"with {_CUES}, r as (select *, row_number() over (partition by file order by ordinal) as k, regexp_replace(text, '\\s+$', '') as body from cu)"
_SRT = f"string_agg(k || chr(10) || {_stamp('start_ms')} || ' --> ' || {_stamp('end_ms')} || chr(10) || body || chr(10) || chr(10), '' order by ordinal)"
_VTT = f"'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('start_ms', '.')} || ' --> ' || {_stamp('end_ms', '.')} || chr(10) || body || chr(10) || chr(10), '' order by ordinal)"
_MS = "greatest(conv_id * 1234567 + turn * 777 - 500, 0)"
_PARSED = f"{_RENDER} select file, k - 1 as ordinal, start_ms, end_ms, body as text from r"

SQL = {
    "fn_ts_format": f"select conv_id, turn, {_stamp(_MS)} as srt, {_stamp(_MS, '.')} as vtt from conversations",
    "fn_ts_parse": f"select conv_id, turn, {_STAMP_MS} as ms from conversations",
    "fn_cue_timing": f"select conv_id, turn, case when ok then s end as start_ms, case when ok then turn % 10 * 1000 + turn end as end_ms from (select *, {_STAMP_MS} as s, conv_id % 3 <> 2 and s is not null as ok from conversations)",
    "fn_cues": "select conv_id as file, row_number() over (partition by conv_id order by turn) - 1 as ordinal, turn % 60 * 1000 as start_ms, (turn + 1) % 60 * 1000 as end_ms, 'turn ' || turn || chr(10) || 'of ' || conv_id as text from conversations",
    "src_srt": _PARSED,
    "src_vtt": _PARSED,
    "sink_srt": f"{_RENDER} select file, {_SRT} as content from r group by file",
    "sink_vtt": f"{_RENDER} select file, {_VTT} as content from r group by file",
    "fn_srt_vtt": f"{_RENDER} select file, {_VTT} as content from r group by file",
    "fn_url_parts": "select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, regexp_extract(url, '^https?://([^/]*)', 1) as host, case when url like 'https:%' then 443 else 80 end as port, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) as path from pages",
    "fn_redirect": f"select page_id, case when l like 'http%' then l else regexp_extract(url, '^(https?)://', 1) || '://' || regexp_extract(url, '^https?://([^/]*)', 1) || ':' || (case when url like 'https:%' then 443 else 80 end) || '/' || ltrim(l, '/') end as target from (select *, ({LOCATIONS!r})[page_id % 4 + 1] as l from pages)",
    "fn_json_escape": "select conv_id, turn, '\\\"\\\\' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\\\"' as escaped from conversations",
    "fn_le_be": f"select id, n as be, (n & 255) * 16777216 + (n // 256 & 255) * 65536 + (n // 65536 & 255) * 256 + n // 16777216 as le, n % 65536 as be16, null::bigint as past from (select id, id * 7919 % 16777216 as n from {_NUMBERS})",
    "fn_bits": f"select id, n >> (21 - id % 13) & 2047 as mid, n & 536870911 as tail, null::bigint as past from (select id, id * 791987 % 4294967296 as n from {_NUMBERS})",
    "fn_exp_golomb": f"select id, id as value, cast(2 * floor(log2(id + 1)) + 1 as bigint) as next from {_NUMBERS}",
    "fn_asc": f"select id, 1 + id % 30 as object_type, cast(([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350])[id % 13 + 1] as bigint) as rate, cast(case when id % 8 = 7 then 8 else id % 8 end as bigint) as channels from {_NUMBERS}",
    "fn_annexb_split": "select event_id, 0::bigint as n, md5(props) as md5 from events union all select event_id, 1, md5(event_type) from events union all select event_id, 2, md5(props) from events",
    "fn_avcc_annexb": "select event_id, md5(unhex('00000001') || encode(props) || unhex('00000001') || encode(event_type)) as md5 from events",
    "fn_sps_dims": f"select id, cast(16 * (id % 120 + 1) - case when id % 3 = 0 then 2 * (id % 4) else 0 end as int) as width, cast(16 * (id % 68 + 1) * m - case when id % 3 = 0 then 2 * m * (id % 3 + 1) else 0 end as int) as height from (select id, case when id % 5 = 0 then 2 else 1 end as m from {_NUMBERS})",
    "fn_esds": f"select id, case when id % 7 <> 0 then printf('%04X', id) end as config from {_NUMBERS}",
    "fn_ebml_vint": f"select id, id + case when id < 127 then 128 else 16384 end as whole, id as value, cast(case when id < 127 then 1 else 2 end as bigint) as size from {_NUMBERS}",
    "fn_syncsafe": f"select id, id * 70001 % 268435456 as size from {_NUMBERS}",
    "fn_leb128": f"select id, id * 7 as value, case when id * 7 < 128 then 1 when id * 7 < 16384 then 2 else 3 end::bigint as size from {_NUMBERS}",
    "fn_ts33": f"select id, printf('%02X%02X%02X%02X%02X', 33 + (p >> 30 & 7) * 2, p >> 22 & 255, (p >> 15 & 127) * 2 + 1, p >> 7 & 255, (p & 127) * 2 + 1) as bytes, p as pts from (select id, id * 98765432 % 8589934592 as p from {_NUMBERS})",
    "fn_mp3_header": _MP3 + " select id, kbps, rate, channels, samples, size from m",
    "src_mp3": _MP3 + " select rate, channels, id, size, cast(coalesce(sum(samples) over (partition by rate, channels order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as pts from m",
    "fn_crc32_ogg": _crc_sql(32, 0x04C11DB7, 0),
    "fn_crc32_mpeg": _crc_sql(32, 0x04C11DB7, 0xFFFFFFFF),
    "fn_crc8": _crc_sql(8, 0x07, 0),
    "fn_crc16": _crc_sql(16, 0x8005, 0),
    "fn_adler32": "with recursive f(n_nationkey, n_name, i, a, b) as (select n_nationkey, n_name, 0::bigint, 1::bigint, 0::bigint from nation union all select n_nationkey, n_name, i + 1, (a + ascii(n_name[i + 1])) % 65521, (b + a + ascii(n_name[i + 1])) % 65521 from f where i < length(n_name)) select n_nationkey, b * 65536 + a as adler from f where i = length(n_name)",
    "fn_md5": "select doc_id, md5(text) as md5 from documents",
    "fn_hash_hex": "select n_nationkey, to_hex(encode(n_name)) as h from nation",
    "fn_png16to8": "select v, least((v + 128) >> 8, 255) as b from (select cast(floor(value * 200) as bigint) % 65536 as v from events)",
}
