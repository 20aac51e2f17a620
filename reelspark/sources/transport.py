"""Transport streams in byte ranges.

``spark.read.format("mpegts")`` cuts files into ranges that are parsed side by side
with NumPy; packets, programmes and streams are then ordinary rows.  The writer
works out every packet's place by prefix sums before any bytes are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.binary import big_endian, byte_at, crc32_mpeg, ts33, ts33_bytes
from ..operators.lineage import cut
from ..operators.scan import carry_scan
from .ranges import RangeReader, list_files, write_ranges

PACKET, SYNC = 188, 0x47
#: Packets in a row that begin with a sync byte where the reader takes up a stream.
LOCK = 5
#: Bytes read at once.
STEP = 4096 * PACKET
#: Tasks that short files are dealt to, at least.
TASKS = 64

TRANSPORT = "file string, at bigint, pid int, unit_start boolean, random_access boolean, continuity int, pcr bigint, payload binary"


# --- reading -------------------------------------------------------------------


def _locks(data: np.ndarray, end: bool) -> np.ndarray:
    """Where ``LOCK`` packets could follow each other in ``data``; past its end
    anything fits if the file ends there."""
    n = len(data) - PACKET + 1 if end else len(data) - LOCK * PACKET
    if n <= 0:
        return np.empty(0, np.int64)
    sync = np.concatenate((data == SYNC, np.ones(LOCK * PACKET, bool)))
    ok = sync[:n].copy()
    for k in range(1, LOCK):
        ok &= sync[k * PACKET : k * PACKET + n]
    return np.flatnonzero(ok)


def find_packet(f: RangeReader, start: int, phase: int | None) -> int:
    """The first packet at or after ``start``: on the grid of ``phase`` if packets lie
    there, else wherever they do; the file's size if nowhere.  It depends on the
    file alone, so neighbouring ranges agree on their border."""
    if phase is not None:
        at = start + (phase - start) % PACKET
        data = np.frombuffer(f.read(at, LOCK * PACKET), np.uint8)
        if len(data) >= PACKET and (data[::PACKET] == SYNC).all():
            return at
    while start < f.size:
        data = np.frombuffer(f.read(start, STEP), np.uint8)
        found = _locks(data, start + len(data) >= f.size)
        if len(found):
            return start + int(found[0])
        if start + len(data) >= f.size:
            break
        start += len(data) - LOCK * PACKET
    return f.size


def packets_of(f: RangeReader, start: int, stop: int, phase: int | None):
    """Blocks of packets that begin in ``[start, stop)``: their places and bytes
    (a row each).  A packet counts if the next one begins with a sync byte or the
    file ends behind it; else the stream is taken up again after its first byte."""
    at, end = find_packet(f, start, phase), find_packet(f, stop, phase) if stop < f.size else f.size
    while at < end:
        data = np.frombuffer(f.read(at, STEP + PACKET), np.uint8)
        n = min(len(data) // PACKET, STEP // PACKET, -(-(end - at) // PACKET))
        if not n:
            return
        rows = data[: n * PACKET].reshape(n, PACKET)
        after = np.ones(n, bool)
        follows = data[PACKET : (n + 1) * PACKET : PACKET]
        # what is left behind a last packet may be a packet that is cut off
        whole = at + PACKET * (np.arange(len(follows)) + 2) <= f.size
        after[: len(follows)] = (follows == SYNC) | ~whole
        good = (rows[:, 0] == SYNC) & after
        k = n if good.all() else int(np.argmin(good))
        if k:
            yield at + PACKET * np.arange(k, dtype=np.int64), rows[:k]
        at += k * PACKET
        if k < n:
            at = find_packet(f, at + 1, None)


def _batch(file: str, at: np.ndarray, p: np.ndarray, pids: set[int] | None) -> pa.RecordBatch | None:
    head = p[:, :12].astype(np.int64)
    pid = (head[:, 1] & 31) << 8 | head[:, 2]
    if pids is not None:
        mine = np.isin(pid, list(pids))
        if not mine.any():
            return None
        at, p, head, pid = at[mine], p[mine], head[mine], pid[mine]
    field = head[:, 3] >> 4 & 3
    adapted = (field & 2 > 0) & (head[:, 4] > 0)
    start = np.where(field & 2, 5 + head[:, 4], 4)
    start = np.where((field & 1 == 0) | (start >= PACKET), PACKET, start)
    clock = adapted & (head[:, 5] & 16 > 0) & (head[:, 4] >= 7)
    pcr = head[:, 6] << 25 | head[:, 7] << 17 | head[:, 8] << 9 | head[:, 9] << 1 | head[:, 10] >> 7
    inside = np.arange(PACKET)[None, :] >= start[:, None]
    ends = np.concatenate(([0], np.cumsum(PACKET - start))).astype(np.int32)
    payload = pa.BinaryArray.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(p[inside].tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(p)), pa.array(at), pa.array(pid.astype(np.int32)), pa.array(head[:, 1] & 64 > 0), pa.array(adapted & (head[:, 5] & 64 > 0)), pa.array((head[:, 3] & 15).astype(np.int32)), pa.array(pcr, mask=~clock), payload],
        ["file", "at", "pid", "unit_start", "random_access", "continuity", "pcr", "payload"],
    )


class _Ranges(InputPartition):
    """Ranges ``(file, start, stop)`` that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def deal_ranges(files: list[tuple[str, int]], split: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of at most ``split`` bytes of ``files(file, size)``; those of short files
    go together, up to ``split`` or ``TASKS``-th of all bytes, so that neither a task
    nor a look from the driver falls to each of them."""
    goal = max(PACKET, min(split, sum(size for _, size in files) // TASKS))
    out, held = [], 0
    for file, size in files:
        for a in range(0, size, split):
            n = min(split, size - a)
            if not out or held + n > goal:
                out.append([])
                held = 0
            out[-1].append((file, a, a + n))
            held += n
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")
        self.split = max(int(options.get("split_bytes", 64 << 20)), PACKET)
        some = options.get("pids", "")
        self.pids = {int(x) for x in some.split(",")} if some else None

    def partitions(self):
        return [_Ranges(r) for r in deal_ranges(list_files(self.path), self.split)] or [_Ranges([])]

    def read(self, part):
        for file, start, stop in part.ranges:
            with RangeReader(file) as f:
                first = find_packet(f, 0, None)
                phase = first % PACKET if first < f.size else None
                for at, rows in packets_of(f, start, stop, phase):
                    if (b := _batch(file, at, rows, self.pids)) is not None:
                        yield b


class TransportSource(DataSource):
    """``spark.read.format("mpegts").load(path)``: the packets of transport streams
    with their places, in ranges of ``split_bytes`` (64 MiB); a task holds a few
    megabytes.  Of packets whose identifier is not in the option ``pids`` (comma
    separated) no rows are made.  That is an option and not a pushed filter, as Spark
    keeps what was pushed with the loaded table, so that two filters on one table in a
    query, as in a self-join, would undo each other."""

    @classmethod
    def name(cls):
        return "mpegts"

    def schema(self):
        return TRANSPORT

    def reader(self, schema):
        return _Reader(self.options)


def read_transport(spark: SparkSession, path: str, split_bytes: int = 64 << 20, pids: list[int] | None = None) -> DataFrame:
    """Rows of :class:`TransportSource`."""
    spark.dataSource.register(TransportSource)
    return spark.read.format("mpegts").option("split_bytes", split_bytes).option("pids", "" if pids is None else ",".join(map(str, pids or [-1]))).load(path)


# fixed values: stream types of a programme map
KINDS = {0x1B: ("video", "h264"), 0x24: ("video", "hevc"), 0x0F: ("audio", "aac"), 0x03: ("audio", "mp3"), 0x04: ("audio", "mp3")}


def programmes(ts: DataFrame) -> DataFrame:
    """``file, pid`` of the programme maps named by the programme tables."""
    p = ts.where("pid = 0 and unit_start").select("file", F.expr("substring(payload, 2 + conv(hex(substring(payload, 1, 1)), 16, 10))").alias("s")).distinct()
    # an entry is two bytes of number and two of identifier; four bytes of checksum end the section
    end = big_endian(F.col("s"), 1, 2).bitwiseAND(0x0FFF) - 1
    entries = F.when(end >= 12, F.sequence(F.lit(8), (end - 4).cast("int"), F.lit(4))).otherwise(F.array().cast("array<int>"))
    e = p.where(F.octet_length("s") >= 12).select("file", "s", F.explode(entries).alias("i"))
    two = lambda i: byte_at(F.col("s"), i) * 256 + byte_at(F.col("s"), i + 1)
    return e.where(two(F.col("i")) != 0).select("file", two(F.col("i") + 2).bitwiseAND(0x1FFF).cast("int").alias("pid")).distinct()


def streams(ts: DataFrame) -> DataFrame:
    """``file, pid, idx, media_type, codec`` of the known streams of the programme
    maps, numbered by identifier."""
    maps = ts.where("unit_start and pid <> 0").select("file", "pid", "payload").join(programmes(ts), ["file", "pid"])
    p = maps.select("file", F.expr("substring(payload, 2 + conv(hex(substring(payload, 1, 1)), 16, 10))").alias("s")).distinct().where(F.octet_length("s") >= 12)
    # entries have a length of their own: a fold over the section's bytes finds where they begin
    end = (big_endian(F.col("s"), 1, 2).bitwiseAND(0x0FFF) - 1).cast("int")
    first = (12 + big_endian(F.col("s"), 10, 2).bitwiseAND(0x0FFF)).cast("int")
    own = lambda i: (byte_at(F.col("s"), i + 3).bitwiseAND(15) * 256 + byte_at(F.col("s"), i + 4)).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.octet_length("s") / 5).cast("int")), F.struct(first.alias("i"), F.array().cast("array<int>").alias("seen")),
        lambda a, _: F.when(a["i"] + 5 <= end, F.struct((a["i"] + 5 + own(a["i"])).alias("i"), F.concat(a["seen"], F.array(a["i"])).alias("seen"))).otherwise(a), lambda a: a["seen"],
    )
    e = p.select("file", "s", F.explode(walk).alias("i"))
    kinds = F.create_map(*[F.lit(x) for k, (m, c) in KINDS.items() for x in (k, f"{m} {c}")])
    e = e.select("file", (byte_at(F.col("s"), F.col("i") + 1).bitwiseAND(31) * 256 + byte_at(F.col("s"), F.col("i") + 2)).cast("int").alias("pid"), F.element_at(kinds, byte_at(F.col("s"), F.col("i")).cast("int")).alias("kind"))
    e = e.where("kind is not null").groupBy("file", "pid").agg(F.min("kind").alias("kind"))
    idx = F.expr("cast(row_number() over (partition by file order by pid) - 1 as int)")
    return e.select("file", "pid", idx.alias("idx"), F.split("kind", " ")[0].alias("media_type"), F.split("kind", " ")[1].alias("codec"))


def read_packets(spark: SparkSession, path: str, split_bytes: int = 64 << 20, blocks: int | None = None) -> DataFrame:
    """:func:`elementary_packets` of the streams under ``path``.  Tables and maps are
    found first, so that rows are only made of the packets that matter; their
    identifiers are at most 8,192."""
    tables = read_transport(spark, path, split_bytes, [0])
    maps = [r.pid for r in programmes(tables).select("pid").distinct().collect()]
    known = cut(streams(tables.unionByName(read_transport(spark, path, split_bytes, maps))))
    pids = [r.pid for r in known.select("pid").distinct().collect()]
    return elementary_packets(read_transport(spark, path, split_bytes, pids), blocks, known)


def elementary_packets(ts: DataFrame, blocks: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """``file, idx, ordinal, pts, dts, keyframe, data`` of the known streams.

    A packet begins at a unit start; what follows up to the next one belongs to it, as
    far as the length it states.  Its pieces may come from different ranges: a carry
    scan numbers the units over all of them, and one unit is put together at a time.
    Units without a valid head are dropped.  Times are the 33 bits that the stream
    holds and begin again at 0 after 2**33 - 1."""
    known = (streams(ts) if known is None else known).select("file", "pid", "idx")
    mine = ts.where(F.octet_length("payload") > 0).join(known, ["file", "pid"]).withColumn("opens", F.when(F.col("unit_start"), 1))
    counted = carry_scan(mine.select("file", "idx", "at", "opens", "random_access", "payload"), ["file", "idx"], ["at"], {"unit": ("count", "opens")}, blocks).where("unit > 0")
    piece = F.struct("at", F.hex("payload").alias("x"))
    unit = counted.groupBy("file", "idx", "unit").agg(F.min_by("random_access", "at").alias("keyframe"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda e: e["x"]), "")).alias("u"))
    u = F.col("u")
    unit = unit.where((F.octet_length(u) >= 9) & (F.hex(F.substring(u, 1, 3)) == "000001"))
    flags, n = F.shiftright(byte_at(u, 7), 6), F.octet_length(u)
    stated = big_endian(u, 4, 2)
    shown = F.when((flags.bitwiseAND(2) > 0) & (n >= 14), ts33(u, 9))
    start = 10 + byte_at(u, 8)
    data = F.expr("substring(u, _start, greatest(_stop - _start, 0))")
    out = unit.withColumns({"pts": shown, "dts": F.when((flags == 3) & (n >= 19), ts33(u, 14)).otherwise(shown), "_start": start.cast("int"), "_stop": F.when(stated > 0, F.least(stated + 7, n + 1)).otherwise(n + 1).cast("int")})
    out = out.select("file", "idx", "unit", "pts", "dts", "keyframe", data.alias("data"))
    one = out.withColumn("_one", F.lit(1))
    return carry_scan(one, ["file", "idx"], ["unit"], {"ordinal": ("count", "_one")}, blocks, exclusive=True).select("file", "idx", "ordinal", "pts", "dts", "keyframe", "data")


# --- writing -------------------------------------------------------------------


def _transport_bytes(pid: int, unit: bytes, key: bool, clock: int | None, continuity: int) -> bytes:
    """The packets of one unit; ``clock`` is the time base written with it."""
    field = b""
    if key or clock is not None:
        field = bytes([(64 if key else 0) | (16 if clock is not None else 0)])
        field += (clock << 15 | 0x7E00).to_bytes(6, "big") if clock is not None else b""
    out, at = [], 0
    while at < len(unit):
        room = 184 - (1 + len(field) if field else 0)
        body = unit[at : at + room]
        spare = room - len(body)
        if spare and not field:  # a field of length 0 fills one byte, its flags another
            extra = bytes([spare - 1]) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
        else:
            extra = bytes([len(field) + spare]) + field + b"\xff" * spare if field else b""
        out.append(bytes([SYNC, (64 if not at else 0) | pid >> 8, pid & 255, (0x30 if extra else 0x10) | continuity & 15]) + extra + body)
        at, continuity, field = at + len(body), continuity + 1, b""
    return b"".join(out)


def _table_packets(streams: DataFrame) -> DataFrame:
    """``file, data``: the packets of the two programme tables."""
    types = F.create_map(*[F.lit(x) for k, (_, c) in KINDS.items() if k != 0x04 for x in (c, f"{k:02X}")])
    entry = F.concat(F.coalesce(F.element_at(types, F.col("codec")), F.lit("06")), F.lpad(F.hex((0xE000 + 256 + F.col("idx")).cast("bigint")), 4, "0"), F.lit("F000"))
    s = streams.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", entry.alias("e")))), lambda x: x["e"]), "").alias("es"), F.min(F.struct(F.col("media_type") != "video", "idx"))["idx"].alias("clock"))

    def packet(pid: int, section):
        whole = F.concat(section, F.lpad(F.hex(crc32_mpeg(F.unhex(section))), 8, "0"))
        return F.concat(F.lit(f"47{0x4000 | pid:04X}1000"), F.rpad(whole, 366, "F"))

    length = F.lpad(F.hex((0xB000 + 13 + F.length("es") / 2).cast("bigint")), 4, "0")
    table = F.concat(F.lit("02"), length, F.lit("0001C10000"), F.lpad(F.hex((0xE000 + 256 + F.col("clock")).cast("bigint")), 4, "0"), F.lit("F000"), F.col("es"))
    return s.select("file", "clock", F.unhex(F.concat(packet(0, F.lit("00B00D0001C100000001F000")), packet(4096, table))).alias("data"))


def transport_rows(packets: DataFrame, streams: DataFrame, blocks: int | None = None) -> DataFrame:
    """What :func:`unit_bytes` makes the bytes of ``file`` at ``offset`` from; see
    :func:`write_transport`."""
    s = streams.select("file", "idx", "media_type", "codec")
    tables = _table_packets(s)
    p = packets.join(s, ["file", "idx"]).join(tables.select("file", "clock"), "file")
    scaled = lambda c: F.expr(f"cast(cast({c} as decimal(20,0)) * 90000 * tb_num div greatest(tb_den, 1) as bigint)")
    p = p.withColumns({"_shown": scaled("coalesce(pts, 0)"), "_t": scaled("coalesce(dts, pts, 0)"), "_pcr": F.col("idx") == F.col("clock")})
    head = F.when(F.col("_shown") == F.col("_t"), F.concat(F.unhex(F.lit("808005")), ts33_bytes(F.col("_shown"), 2))).otherwise(F.concat(F.unhex(F.lit("80C00A")), ts33_bytes(F.col("_shown"), 3), ts33_bytes(F.col("_t"), 1)))
    p = p.withColumn("_head", head).withColumn("_size", F.octet_length("_head") + F.octet_length("data"))
    video = F.col("media_type") == "video"
    stated = F.when(video | (F.col("_size") > 65535), F.lit(0)).otherwise(F.col("_size"))
    first = 184 - F.when(F.col("_pcr"), 8).when(F.col("keyframe"), 2).otherwise(0)
    p = p.withColumn("_n", 1 + F.ceil(F.greatest(F.col("_size") + 6 - first, F.lit(0)) / 184))
    order = ["_t", "idx", "ordinal"]
    p = carry_scan(p, ["file"], order, {"_place": ("sum", "_n")}, blocks, exclusive=True)
    p = carry_scan(p, ["file", "idx"], order, {"_count": ("sum", "_n")}, blocks, exclusive=True)
    unit = F.concat(F.unhex(F.concat(F.when(video, F.lit("000001E0")).otherwise(F.lit("000001C0")), F.lpad(F.hex(stated.cast("bigint")), 4, "0"))), "_head", "data")
    rows = p.select("file", (188 * (2 + F.coalesce("_place", F.lit(0)))).cast("bigint").alias("offset"), (256 + F.col("idx")).cast("int").alias("pid"), unit.alias("data"), "keyframe", F.when(F.col("_pcr"), F.pmod("_t", F.lit(1 << 33))).alias("clock"), F.pmod(F.coalesce("_count", F.lit(0)), F.lit(16)).cast("int").alias("continuity"))
    front = tables.select("file", F.lit(0).cast("bigint").alias("offset"), F.lit(-1).alias("pid"), "data", F.lit(False).alias("keyframe"), F.lit(None).cast("bigint").alias("clock"), F.lit(0).alias("continuity"))
    return rows.unionByName(front)


def unit_bytes(b: pa.RecordBatch) -> list[bytes]:
    """Transport packets of rows of :func:`transport_rows`."""
    columns = (b.column(c).to_pylist() for c in ("pid", "data", "keyframe", "clock", "continuity"))
    return [d if pid < 0 else _transport_bytes(pid, d, bool(key), clock, cc) for pid, d, key, clock, cc in zip(*columns)]


def write_transport(packets: DataFrame, streams: DataFrame, folder: str, blocks: int | None = None, partitions: int | None = None) -> DataFrame:
    """Writes ``packets(file, idx, ordinal, pts, dts, tb_num, tb_den, keyframe, data)`` of
    ``streams(file, idx, media_type, codec)`` as transport streams ``folder/file``, in
    order of decoding time, stream and ordinal; returns ``file, bytes, pieces``.

    How many transport packets a unit takes follows from its size, so a carry scan
    gives each unit's place in its file and its continuity counter, and any number
    of tasks write a file.  At most 30 streams a file, as its map is one packet."""
    return write_ranges(transport_rows(packets, streams, blocks), folder, unit_bytes, partitions)
