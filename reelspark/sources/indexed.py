"""MP4 files read index first, and written by many tasks.

Listing reads no content; the boxes are walked with a few bytes each; sample tables
are read in slices by tasks and joined; and only the byte ranges of the samples
that are left after filters are fetched, near ones together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.containers import mp4_samples
from ..operators.lineage import cut
from ..operators.scan import carry_scan
from .ranges import RangeReader, write_ranges

#: Entries of a sample table that one task reads at once.
SLICE = 1 << 16
#: Ranges with a gap of at most ``GAP`` bytes are fetched together, up to ``WINDOW`` bytes.
GAP, WINDOW = 1 << 16, 8 << 20
#: A sample description may have so many bytes.
DESCRIPTION = 1 << 20

INDEX = "file string, track int, media_type string, codec string, timescale bigint, config binary, name string, at bigint, entries bigint, fixed bigint, error string"

# Fields of a table's entry, sample entry names, handler names, and the
# bytes of a sample entry before its own boxes.
FIELDS = {"stsz": ">I", "stco": ">I", "co64": ">Q", "stsc": ">III", "stts": ">II", "ctts": ">Ii", "stss": ">I"}
CODECS = {b"avc1": "h264", b"avc3": "h264", b"hvc1": "hevc", b"vp09": "vp9", b"av01": "av1", b"Opus": "opus", b"mp4a": "aac", b"fLaC": "flac"}
HANDLERS = {b"vide": "video", b"soun": "audio", b"text": "subtitle"}
ENTRY = {"video": 86, "audio": 36}


def boxes(f: RangeReader, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the content of each box; a size past ``end`` ends the walk."""
    while start + 8 <= end:
        head = f.read(start, 16)
        size, name = struct.unpack_from(">I", head)[0], head[4:8]
        body = start + 8
        if size == 1 and len(head) == 16:
            size, body = struct.unpack_from(">Q", head, 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield name, body, stop
        start = stop


def _inside(f: RangeReader, where: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for name in path:
        where = next(((s, e) for n, s, e in boxes(f, *where) if n == name), None)
        if where is None:
            return None
    return where


def tracks_of(f: RangeReader) -> Iterator[dict]:
    """Rows of ``INDEX`` (without ``file``) of one file: where its tables lie."""
    moov = _inside(f, (0, f.size), b"moov")
    if moov is None:
        raise ValueError("no moov box")
    track = -1
    for name, s, e in boxes(f, *moov):
        mdia = _inside(f, (s, e), b"mdia") if name == b"trak" else None
        stbl = mdia and _inside(f, mdia, b"minf", b"stbl")
        mdhd, hdlr = (mdia and _inside(f, mdia, n) for n in (b"mdhd", b"hdlr"))
        stsd = stbl and _inside(f, stbl, b"stsd")
        if not (mdhd and hdlr and stsd):
            continue
        track += 1
        head = f.read(mdhd[0], 24)
        scale = struct.unpack_from(">I", head, 20 if head[:1] == b"\1" else 12)[0] if len(head) == 24 else 1000
        kind = HANDLERS.get(f.read(hdlr[0] + 8, 4), "data")
        entry = stsd[0] + 8
        config = None
        if stsd[1] - stsd[0] <= DESCRIPTION and kind in ENTRY:
            own = next((b for n, *b in boxes(f, entry + ENTRY[kind], stsd[1]) if n in (b"avcC", b"hvcC", b"vpcC", b"esds", b"dOps", b"av1C")), None)
            config = f.read(own[0], own[1] - own[0]) if own else None
        row = {"track": track, "media_type": kind, "codec": CODECS.get(f.read(entry + 4, 4), "none"), "timescale": max(scale, 1), "config": config}
        for table, at, end in boxes(f, *stbl):
            table = table.decode("latin-1")
            if table not in FIELDS or end - at < 8:
                continue
            first, fixed = at + 8, None
            n = struct.unpack(">I", f.read(at + 4, 4))[0]
            if table == "stsz":
                if end - at < 12:
                    continue
                fixed, n = struct.unpack(">II", f.read(at + 4, 8))
                fixed, first = fixed or None, at + 12
            if fixed is None:
                n = min(n, (end - first) // struct.calcsize(FIELDS[table]))
            else:
                n = min(n, f.size)
            yield row | {"name": table, "at": first, "entries": n, "fixed": fixed}


def mp4_index(spark: SparkSession, path: str) -> DataFrame:
    """``INDEX``: a row for each sample table of each track of the files under
    ``path``; a file that cannot be read gives a row with ``error``.  Files are listed
    by Spark without their content (empty ones are not listed); a few bytes of each box
    are read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                try:
                    with RangeReader(file) as f:
                        rows = list(tracks_of(f))
                except (OSError, ValueError, struct.error, pa.ArrowException) as e:
                    rows = [{"error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist([dict.fromkeys(kind.names) | {"file": file} | r for r in rows], kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return files.mapInArrow(run, INDEX)


def _entries(index: DataFrame, *names: str) -> DataFrame:
    """``id, n, a, b, c``: the entries of tables, numbered from 1, with up to three
    fields; ``id`` is file and track.  Tasks read slices."""
    some = index.where(F.col("name").isin(*names) & F.col("fixed").isNull() & (F.col("entries") > 0))
    cuts = some.select("file", "track", "name", "at", "entries", F.explode(F.expr(f"sequence(0L, (entries - 1) div {SLICE})")).alias("slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for r in b.to_pylist():
                fmt = FIELDS[r["name"]]
                kinds = [{"I": ">u4", "i": ">i4", "Q": ">u8"}[c] for c in fmt[1:]]
                first = r["slice"] * SLICE
                n, step = min(SLICE, r["entries"] - first), struct.calcsize(fmt)
                with RangeReader(r["file"]) as f:
                    data = np.frombuffer(f.read(r["at"] + first * step, n * step), np.dtype([(f"f{i}", k) for i, k in enumerate(kinds)]))
                fields = [pa.array(data[f"f{i}"].astype(np.int64)) if i < len(kinds) else pa.nulls(n, pa.int64()) for i in range(3)]
                id_ = pa.array([f"{r['file']}#{r['track']}"]).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([id_, pa.array(np.arange(first + 1, first + n + 1)), *fields], ["id", "n", "a", "b", "c"])

    spread = cuts.repartition(max(8, 2 * index.sparkSession.sparkContext.defaultParallelism), "file", "track", "name", "slice")
    return spread.mapInArrow(run, "id string, n bigint, a bigint, b bigint, c bigint")


def mp4_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tracks and samples of the files under ``path``, without any payload read.

    Tracks: ``file, track, media_type, codec, timescale, config, error``.  Samples:
    ``file, track, ordinal, offset, size, dts, pts, keyframe``, times in the track's
    scale.  Filter samples before :func:`fetch`, which reads what is left."""
    index = cut(mp4_index(spark, path))
    tracks = index.groupBy("file", "track").agg(*[F.first(c).alias(c) for c in ("media_type", "codec", "timescale", "config", "error")])
    named = lambda df, **c: df.select(F.col("id").alias("file"), *[F.col(v).alias(k) for k, v in c.items()])
    same = index.where("fixed is not null").select(F.format_string("%s#%d", "file", "track").alias("file"), F.explode(F.expr("sequence(1L, entries)")).alias("sample"), F.col("fixed").alias("size"))
    sizes = named(_entries(index, "stsz"), sample="n", size="a").unionByName(same)
    stts = named(_entries(index, "stts"), entry="n", count="a", delta="b")
    s = mp4_samples(named(_entries(index, "stsc"), first_chunk="a", spc="b"), named(_entries(index, "stco", "co64"), chunk="n", offset="a"), sizes, stts, named(_entries(index, "stss"), sample="a"))
    w = Window.partitionBy("file").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    most = sizes.groupBy("file").agg(F.max("sample").alias("most"))
    shift = named(_entries(index, "ctts"), entry="n", count="a", shift="b").where("count > 0").withColumn("s0", F.coalesce(F.sum("count").over(w), F.lit(0).cast("bigint")))
    shift = shift.hint("merge").join(most, "file").where("s0 < most").select("file", "shift", F.explode(F.expr("sequence(s0 + 1, least(s0 + count, most))")).alias("sample"))
    s = s.join(shift.hint("merge"), ["file", "sample"], "left")
    back = F.regexp_extract("file", r"(?s)^(.*)#(\d+)$", 1), F.regexp_extract("file", r"(?s)^(.*)#(\d+)$", 2).try_cast("int")
    return tracks, s.select(back[0].alias("file"), back[1].alias("track"), (F.col("sample") - 1).alias("ordinal"), "offset", "size", F.col("pts").alias("dts"), (F.col("pts") + F.coalesce("shift", F.lit(0).cast("bigint"))).alias("pts"), "keyframe")


def islands(samples: DataFrame, gap: int = GAP, window: int = WINDOW) -> DataFrame:
    """``samples`` with ``_start`` and ``_stop`` of the range that each is fetched in.

    Samples that begin in the same ``window`` bytes of a file and have at most ``gap``
    bytes between them share a range, so no window's work depends on another's."""
    part = samples.withColumn("_window", F.floor(F.col("offset") / window))
    order = Window.partitionBy("file", "_window").orderBy("offset")
    upto = F.max(F.col("offset") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = part.withColumn("_new", F.coalesce((F.col("offset") > upto + gap).cast("int"), F.lit(1)))
    part = part.withColumn("_island", F.sum("_new").over(order))
    whole = Window.partitionBy("file", "_window", "_island")
    return part.withColumns({"_start": F.min("offset").over(whole), "_stop": F.max(F.col("offset") + F.col("size")).over(whole)}).drop("_new")


def fetch(samples: DataFrame, gap: int = GAP, window: int = WINDOW) -> DataFrame:
    """``samples(file, offset, size, ...)`` with ``data``, and ``fetched``: the bytes read
    for a range, stated at its first sample.  Null data: the range lies past the end
    of the file.  A task holds one range: ``window`` bytes and what its last sample
    reaches beyond."""
    import copy

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    dealt = islands(samples, gap, window)
    dealt = dealt.repartition("file", "_window").sortWithinPartitions("file", "_window", "_island", "offset").drop("_window", "_island")
    kind = StructType([*copy.deepcopy(samples.schema.fields), StructField("data", BinaryType()), StructField("fetched", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, f = (None, 0, b""), None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                data, taken = [], []
                for file, at, size, start, stop in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "size", "_start", "_stop"))):
                    n = None
                    if held[:2] != (file, start):
                        if f is None or held[0] != file:
                            if f is not None:
                                f.file.close()
                            f = RangeReader(file)
                        held = (file, start, f.read(start, stop - start))
                        n = len(held[2])
                    piece = held[2][at - start : at - start + size]
                    data.append(piece if len(piece) == size else None)
                    taken.append(n)
                out = part.drop_columns(["_start", "_stop"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(data, pa.binary()), pa.array(taken, pa.int64())], [*out.schema.names, "data", "fetched"])

    return dealt.mapInArrow(run, kind)


# --- writing -------------------------------------------------------------------

#: Bytes before the first sample: the file type and a sample box of 64-bit size.
FRONT = 40
# Bytes of an entry of each table that is written.
STEPS = {"stts": 8, "ctts": 8, "stsz": 4, "stsc": 12, "co64": 8, "stss": 4}
SAMPLE_ENTRIES = {"h264": (b"avc1", b"avcC"), "hevc": (b"hvc1", b"hvcC"), "vp9": (b"vp09", b"vpcC"), "aac": (b"mp4a", b"esds"), "opus": (b"Opus", b"dOps")}


def _box(name: bytes, *parts) -> list:
    """A box as bytes and holes ``(track, table, size)`` that tasks fill."""
    inside = [p for part in parts for p in (part if isinstance(part, list) else [part])]
    size = 8 + sum(len(p) if isinstance(p, bytes) else p[2] for p in inside)
    head = struct.pack(">I4s", size, name) if size < 1 << 32 else struct.pack(">I4sQ", 1, name, size + 8)
    return [head, *inside]


def _layout(tracks: list[dict], total: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, str, int]]]:
    """Of a file whose samples have ``total`` bytes: pieces ``(offset, bytes)`` and
    the places ``(track, table, offset)`` of the tables' first entries."""
    full = lambda name, *parts: _box(name, b"\0\0\0\0", *parts)
    unity = struct.pack(">9I", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    traks, longest = [], 0
    for t in tracks:
        video = t["media_type"] == "video"
        shown = t["length"] * 1000 // max(t["timescale"], 1)
        longest = max(longest, shown)
        code, own = SAMPLE_ENTRIES.get(t["codec"], (b"none", b"conf"))
        config = _box(own, t["config"]) if t["config"] else []
        if video:
            entry = _box(code, b"\0" * 6 + b"\0\1" + b"\0" * 16 + struct.pack(">HHIIIH", t["width"] or 0, t["height"] or 0, 0x480000, 0x480000, 0, 1) + b"\0" * 32 + struct.pack(">Hh", 24, -1), config)
        else:
            entry = _box(code, b"\0" * 6 + b"\0\1" + b"\0" * 8 + struct.pack(">HHII", t["channels"] or 0, 16, 0, (t["sample_rate"] or 0) << 16), config)
        counts = {"stts": t["n"], "ctts": t["n"] if t["shifted"] else 0, "stsc": t["chunks"], "stsz": t["n"], "co64": t["chunks"], "stss": t["keys"] if t["keys"] < t["n"] else 0}
        tables = [full(b"stsd", struct.pack(">I", 1), entry)]
        for name, n in counts.items():
            if n or name not in ("ctts", "stss") or (name == "stss" and t["keys"] < t["n"]):
                tables.append(full(name.encode(), struct.pack(">II", 0, n) if name == "stsz" else struct.pack(">I", n), (t["idx"], name, n * STEPS[name])))
        minf = _box(b"minf", full(b"vmhd", b"\0" * 8) if video else full(b"smhd", b"\0" * 4), _box(b"stbl", *tables))
        hdlr = full(b"hdlr", b"\0\0\0\0", b"vide" if video else b"soun", b"\0" * 13)
        mdia = _box(b"mdia", _box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQHH", 0, 0, t["timescale"], t["length"], 0x55C4, 0)), hdlr, minf)
        traks.append(_box(b"trak", _box(b"tkhd", b"\1\0\0\7", struct.pack(">QQIIQ", 0, 0, t["idx"] + 1, 0, shown), b"\0" * 16, unity, struct.pack(">II", (t["width"] or 0) << 16, (t["height"] or 0) << 16)), mdia))
    mvhd = _box(b"mvhd", b"\1\0\0\0", struct.pack(">QQIQIH", 0, 0, 1000, longest, 65536, 256), b"\0" * 10, unity, b"\0" * 24, struct.pack(">I", len(tracks) + 1))
    pieces, places = [(0, struct.pack(">I", 24) + b"ftypisom\0\0\2\0isomiso2" + struct.pack(">I4sQ", 1, b"mdat", 16 + total))], []
    at = FRONT + total
    for part in _box(b"moov", mvhd, *traks):
        if isinstance(part, bytes):
            pieces.append((at, part))
            at += len(part)
        else:
            places.append((part[0], part[1], at))
            at += part[2]
    return pieces, places


def write_mp4(packets: DataFrame, streams: DataFrame, folder: str, blocks: int | None = None, partitions: int | None = None) -> DataFrame:
    """Writes ``packets(file, idx, ordinal, pts, duration, keyframe, data)`` of
    ``streams(file, idx, media_type, codec, timescale, width, height, sample_rate,
    channels, config)`` as MP4 files ``folder/file``; returns ``file, bytes, pieces``.

    Times are in the stream's scale.  A sample begins where the durations before it
    end and is shown at its ``pts`` (null: then); samples lie in order of that time,
    stream and ordinal, a run of one stream is a chunk.  Carry scans over rows without
    payload give each sample's place, chunk and key number, so samples and the entries
    of all tables are written to their places by any number of tasks; only the headers
    of a file are made in one.  Tables are not run-length coded."""
    s = streams.select("file", "idx", "media_type", "codec", F.greatest("timescale", F.lit(1)).cast("bigint").alias("timescale"), "width", "height", "sample_rate", "channels", "config")
    p = packets.select("file", "idx", "ordinal", F.greatest(F.coalesce("duration", F.lit(0)), F.lit(0)).cast("bigint").alias("duration"), "pts", "keyframe", F.octet_length("data").cast("bigint").alias("size"))
    p = p.join(F.broadcast(s.select("file", "idx", "timescale")), ["file", "idx"])
    p = carry_scan(p, ["file", "idx"], ["ordinal"], {"_begin": ("sum", "duration")}, blocks, exclusive=True).withColumn("_begin", F.coalesce("_begin", F.lit(0).cast("bigint")))
    p = p.withColumns({"_second": F.col("_begin") / F.col("timescale"), "_shift": F.coalesce(F.col("pts") - F.col("_begin"), F.lit(0).cast("bigint"))})
    p = carry_scan(cut(p), ["file"], ["_second", "idx", "ordinal"], {"_at": ("sum", "size"), "_prev": ("last", "idx")}, blocks, exclusive=True)
    p = p.withColumns({"_opens": F.when(F.coalesce(F.col("_prev") != F.col("idx"), F.lit(True)), 1), "_key": F.when(F.col("keyframe"), 1), "_offset": FRONT + F.coalesce("_at", F.lit(0))})
    p = cut(carry_scan(p, ["file", "idx"], ["ordinal"], {"_chunk": ("count", "_opens"), "_number": ("count", "_key")}, blocks))
    chunks = p.groupBy("file", "idx", F.col("_chunk").alias("chunk")).agg(F.min("_offset").alias("offset"), F.count("*").alias("spc"))
    # ordinals may have gaps: an entry's place is its rank
    p = carry_scan(p.withColumn("_one", F.lit(1)), ["file", "idx"], ["ordinal"], {"_rank": ("count", "_one")}, blocks, exclusive=True)
    totals = p.groupBy("file", "idx").agg(F.count("*").alias("n"), F.max("_chunk").alias("chunks"), F.max("_number").alias("keys"), F.sum("duration").alias("length"), F.sum("size").alias("bytes"), F.bool_or(F.col("_shift") != 0).alias("shifted"))
    blank = {"n": 0, "chunks": 0, "keys": 0, "length": 0, "bytes": 0}
    tracks = s.join(totals, ["file", "idx"], "left").fillna(blank).withColumn("shifted", F.coalesce("shifted", F.lit(False)))
    names = [c for c in tracks.columns if c != "file"]
    files = cut(tracks.groupBy("file").agg(F.sum("bytes").alias("total"), F.array_sort(F.collect_list(F.struct(*sorted(names, key=lambda c: c != "idx")))).alias("tracks")))

    def laid(want_pieces: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(r["file"], *x) for r in b.to_pylist() for x in _layout(r["tracks"], r["total"])[0 if want_pieces else 1]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "offset", "data"] if want_pieces else ["file", "idx", "name", "base"])

        return run

    heads = files.mapInArrow(laid(True), "file string, offset bigint, data binary")
    bases = files.mapInArrow(laid(False), "file string, idx bigint, name string, base bigint").withColumn("idx", F.col("idx").cast("int"))
    base = cut(bases.groupBy("file", "idx").pivot("name", list(STEPS)).agg(F.first("base")))
    be = lambda v, n: F.lpad(F.right(F.hex(v.cast("bigint")), F.lit(2 * n)), 2 * n, "0")
    put = lambda df, name, i, *fields: df.where(F.col(name).isNotNull()).select("file", (F.col(name) + STEPS[name] * i).alias("offset"), F.unhex(F.concat(*fields)).alias("data"))
    # a row for each track; samples and chunks may look smaller than they are
    q, c = p.join(F.broadcast(base), ["file", "idx"]), chunks.join(F.broadcast(base), ["file", "idx"])
    one = F.lit("00000001")
    tables = [
        put(q, "stts", F.col("_rank"), one, be(F.col("duration"), 4)), put(q, "ctts", F.col("_rank"), one, be(F.col("_shift"), 4)), put(q, "stsz", F.col("_rank"), be(F.col("size"), 4)),
        put(q.where("keyframe"), "stss", F.col("_number") - 1, be(F.col("_rank") + 1, 4)), put(c.withColumnRenamed("offset", "_o"), "co64", F.col("chunk") - 1, be(F.col("_o"), 8)),
        put(c, "stsc", F.col("chunk") - 1, be(F.col("chunk"), 4), be(F.col("spc"), 4), one),
    ]
    rows = packets.select("file", "idx", "ordinal", "data").join(p.select("file", "idx", "ordinal", F.col("_offset").alias("offset")).hint("merge"), ["file", "idx", "ordinal"]).select("file", "offset", "data").unionByName(heads)
    for t in tables:
        rows = rows.unionByName(t)
    return write_ranges(rows.where(F.octet_length("data") > 0), folder, lambda b: b.column("data").to_pylist(), partitions)
