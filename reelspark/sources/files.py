"""Files as DataFrames: heads for probing, streams and packets for everything
else, and a registered data source.

``binaryFile`` lists and reads through Hadoop, so any store Spark reaches works.
A file is one row and is parsed in one task; many files spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .demux import PARSERS, FormatError

STREAMS = (
    "file string, format string, idx int, media_type string, codec string, tb_num int, tb_den int, width int, height int, pixfmt string, color_range string,"
    " sample_rate int, channels int, sample_fmt string, extradata binary, duration bigint, nb_frames bigint, error string"
)
#: Bytes of a batch of files that Spark hands to Python at once (a longer file is a
#: batch by itself), and bytes and packets of a batch that the packet reader gives out.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1_024
PACKETS = "file string, idx int, ordinal bigint, pts bigint, dts bigint, duration bigint, tb_num int, tb_den int, keyframe boolean, data binary"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")


def read_heads(spark: SparkSession, path: str, n: int = 4096) -> DataFrame:
    return read_files(spark, path).select("file", F.substring("content", 1, n).alias("content"))


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _small_batches(spark: SparkSession) -> None:
    """Lowers the bytes of the session's Arrow batches to ``BATCH_BYTES`` where they
    still are Spark's 64 MB; a value the user has set is kept.  They stay lowered, as
    plans are only made when a result is read."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, f"{BATCH_BYTES}b")


def parse_streams(files: DataFrame) -> DataFrame:
    """``STREAMS`` rows of ``files(file, format, content)``; a file that cannot
    be read gives one row with ``error``."""
    kind = _arrow(STREAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                file, fmt = b.column("file")[i].as_py(), b.column("format")[i].as_py()
                base = dict.fromkeys(kind.names) | {"file": file, "format": fmt}
                try:
                    if fmt not in PARSERS:
                        raise FormatError(f"no reader for {fmt}")
                    streams, _ = PARSERS[fmt](b.column("content")[i].as_py() or b"")
                    rows += [base | s for s in streams]
                except (FormatError, IndexError, ValueError, OverflowError) as e:
                    rows.append(base | {"error": str(e) or type(e).__name__})
                except Exception as e:  # struct.error of a cut-off header
                    rows.append(base | {"error": type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, kind)

    _small_batches(files.sparkSession)
    return files.select("file", "format", "content").mapInArrow(run, STREAMS)


def parse_packets(files: DataFrame) -> DataFrame:
    """``PACKETS`` rows of ``files(file, format, content)``; unreadable files
    have none (see :func:`parse_streams` for the reason)."""
    kind = _arrow(PACKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, fmt = b.column("file")[i].as_py(), b.column("format")[i].as_py()
                try:
                    streams, packets = PARSERS[fmt](b.column("content")[i].as_py() or b"")
                except Exception:
                    continue
                tb = {s["idx"]: (s["tb_num"], s["tb_den"]) for s in streams}
                seen: dict[int, int] = {}
                rows, size = [], 0
                for idx, pts, dts, dur, key, data in packets:
                    n = seen[idx] = seen.get(idx, -1) + 1
                    rows.append(dict(zip(kind.names, (file, idx, n, pts, dts, dur, *tb[idx], key, data))))
                    size += len(data)
                    if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    _small_batches(files.sparkSession)
    return files.select("file", "format", "content").mapInArrow(run, PACKETS)


def open_media(spark: SparkSession, path: str, format_name: str | None = None) -> DataFrame:
    """``file, format, content`` of the files under ``path``: given, by content
    or by extension, in that order."""
    from ..operators.probe import format_by_extension, probe

    files = read_files(spark, path)
    if format_name:
        return files.withColumn("format", F.lit(format_name))
    p = probe(files.select("file", "content"), ["file", "content"], "content")
    return p.select("file", F.coalesce("format", format_by_extension(F.regexp_extract("file", r"\.([^./]*)$", 1))).alias("format"), "content")


class _Part(InputPartition):
    def __init__(self, path):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob
        import os

        path = self.options.get("path", "")
        files = sorted(glob.glob(os.path.join(path, "**"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_Part(f) for f in files if os.path.isfile(f)]

    def read(self, part):
        with open(part.path, "rb") as f:
            content = f.read()
        fmt = self.options.get("media") or part.path.rsplit(".", 1)[-1]
        fmt = {"y4m": "yuv4mpegpipe", "mkv": "matroska", "webm": "matroska", "ts": "mpegts", "vtt": "webvtt", "jpg": "jpeg", "opus": "ogg", "m4a": "mp4"}.get(fmt, fmt)
        if fmt not in PARSERS:
            return
        streams, packets = PARSERS[fmt](content)
        tb = {s["idx"]: (s["tb_num"], s["tb_den"]) for s in streams}
        seen: dict[int, int] = {}
        for idx, pts, dts, dur, key, data in packets:
            n = seen[idx] = seen.get(idx, -1) + 1
            yield (part.path, idx, n, pts, dts, dur, *tb[idx], key, data)


class MediaSource(DataSource):
    """``spark.read.format("media").load(path)``: packets of files on a file
    system every executor mounts; for other stores use :func:`open_media`."""

    @classmethod
    def name(cls):
        return "media"

    def schema(self):
        return PACKETS

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)
