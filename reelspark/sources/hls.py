"""Segmented streams as a transactional sink.

Packets get their segment by scans, each segment's transport packets are laid out as
rows, and ``df.write.format("hls")`` or ``writeStream`` writes segment files under
names that no playlist knows until the job commits; the commit puts one new
playlist in place of the old.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..operators.containers import hls_durations, hls_segments, hls_segments_spread
from ..operators.lineage import cut, deal
from ..operators.scan import carry_scan
from .ranges import store_of
from .transport import transport_rows, unit_bytes

PIECES = "file string, segment bigint, duration double, position bigint, data binary"
#: Marks the last micro-batch that a playlist holds.
BATCH = "#REEL-BATCH:"


# --- segments as rows ------------------------------------------------------------


def segment_packets(packets: DataFrame, streams: DataFrame, target: float, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``packets(file, idx, ordinal, pts, dts, tb_num, tb_den, keyframe, data)`` with
    ``segment``, and ``file, segment, duration``.

    The first video stream, else the first stream, is cut (see ``hls_segments``; with
    ``blocks`` a stream is spread over tasks); packets of the others belong to the
    segment that is open in order of decoding time, stream and ordinal."""
    first = streams.groupBy("file").agg(F.min(F.struct((F.col("media_type") != "video").alias("late"), "idx")).alias("r"), F.bool_or(F.col("media_type") == "video").alias("video")).select("file", F.col("r.idx").alias("idx"), "video")
    ref = packets.join(first, ["file", "idx"])
    wide = lambda df: df.select("file", "ordinal", "pts", F.col("tb_num").cast("bigint").alias("tb_num"), F.col("tb_den").cast("bigint").alias("tb_den"), "keyframe")
    make = (lambda df: hls_segments_spread(wide(df), target, blocks=blocks)) if blocks else (lambda df: hls_segments(wide(df), target))
    # without video any packet may begin a segment
    segmented = cut(make(ref.withColumn("keyframe", F.col("keyframe") | ~F.col("video"))))
    marks = segmented.select("file", "ordinal", F.col("segment").alias("_segment")).join(first.select("file", "idx"), "file")
    time = F.expr("coalesce(dts, pts, 0) * tb_num / greatest(tb_den, 1)")
    p = packets.join(marks, ["file", "idx", "ordinal"], "left").withColumn("_t", time)
    p = carry_scan(p, ["file"], ["_t", "idx", "ordinal"], {"segment": ("last", "_segment")}, blocks)
    return p.withColumn("segment", F.coalesce("segment", F.lit(0).cast("bigint"))).drop("_segment", "_t"), hls_durations(segmented, target).select("file", "segment", "duration")


def segment_pieces(packets: DataFrame, streams: DataFrame, target: float, blocks: int | None = None) -> DataFrame:
    """``PIECES``: each segment's transport packets in pieces, dealt by segment and in
    order, as the sink takes them."""
    p, durations = segment_packets(packets, streams, target, blocks)
    p = cut(p)
    name = F.format_string("%s/%d", "file", "segment")
    held = p.select("file", "segment").distinct()
    per = streams.join(held, "file").select(name.alias("file"), "idx", "media_type", "codec")
    rows = transport_rows(p.select(name.alias("file"), "idx", "ordinal", "pts", "dts", "tb_num", "tb_den", "keyframe", "data"), per, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("offset"), pa.array(unit_bytes(b), pa.binary())], ["name", "position", "data"])

    made = rows.mapInArrow(run, "name string, position bigint, data binary")
    parts = made.select(F.regexp_extract("name", r"(?s)^(.*)/(\d+)$", 1).alias("file"), F.regexp_extract("name", r"(?s)^(.*)/(\d+)$", 2).cast("bigint").alias("segment"), "position", "data")
    out = parts.join(durations, ["file", "segment"], "left").select("file", "segment", F.coalesce("duration", F.lit(float(target))).alias("duration"), "position", "data")
    return deal(out, "file", "segment").sortWithinPartitions("file", "segment", "position")


# --- sink ------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    """Segments that a task has written: file, number, seconds, name, bytes."""

    segments: list


class _Sink:
    """Shared by the batch and the stream writer."""

    def __init__(self, options, fresh: bool):
        self.path, self.fresh, self.run = options["path"], fresh, uuid.uuid4().hex
        self.live = options.get("live", "false").lower() == "true"

    def _at(self):
        return store_of(self.path)

    def write(self, rows):
        """Writes each segment that comes by under a name of this run and try; rows
        of a segment follow each other in order of ``position``."""
        store, root = self._at()
        out, key, done, size, last = None, None, [], 0, -1
        for r in rows:
            if (r.file, r.segment) != key:
                if out:
                    out.close()
                    done[-1][-1] = size
                key, size, last = (r.file, r.segment), 0, -1
                name = f"{r.file}-{r.segment:06d}-{self.run}-{uuid.uuid4().hex[:8]}.ts"
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                done.append([r.file, r.segment, float(r.duration), name, 0])
            if r.position <= last:
                raise ValueError("the rows of a segment are not in order")
            out.write(r.data)
            size, last = size + len(r.data), r.position
        if out:
            out.close()
            done[-1][-1] = size
        return _Written(done)

    def _finish(self, messages, batch: int | None) -> None:
        store, root = self._at()
        by: dict[str, list] = {}
        for m in messages:
            for s in m.segments if m else []:
                by.setdefault(s[0], []).append(s)
        for file, new in by.items():
            new.sort(key=lambda s: s[1])
            old, seen = ([], -1) if self.fresh else read_playlist(self.path, file)
            if batch is not None and batch <= seen:
                continue  # sent again after it was committed
            numbers = [s[1] for s in new]
            if len(set(numbers)) < len(numbers):
                raise ValueError(f"a segment of {file} was written by two tasks")
            text = playlist([*old, *[(s[2], s[3].rsplit("/", 1)[-1]) for s in new]], self.live or batch is not None, batch)
            aside = f"{root}/{file}.m3u8.{self.run}"
            with store.open_output_stream(aside) as out:
                out.write(text.encode())
            store.move(aside, f"{root}/{file}.m3u8")

    def _undo(self) -> None:
        """Deletes what any task of this run has written."""
        from pyarrow import fs

        store, root = self._at()
        if store.get_file_info([root])[0].type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if self.run in f.base_name:
                    store.delete_file(f.path)


class _Writer(_Sink, DataSourceWriter):
    def commit(self, messages):
        self._finish(messages, None)

    def abort(self, messages):
        self._undo()


class _StreamWriter(_Sink, DataSourceStreamWriter):
    def commit(self, messages, batchId):  # noqa: N803
        self._finish(messages, batchId)

    def abort(self, messages, batchId):  # noqa: N803
        # segments of earlier batches are listed; of this one none is
        for m in messages:
            for s in m.segments if m else []:
                store, root = self._at()
                store.delete_file(f"{root}/{s[3]}")


class HlsSink(DataSource):
    """``df.write.format("hls").mode(...).save(folder)`` of ``PIECES``: segment files and
    ``folder/<file>.m3u8``; ``overwrite`` begins playlists anew, ``append`` goes on.

    A playlist changes in one step once all tasks are done; after a failure it is the
    old one, and what was written is deleted.  A micro-batch that is sent again is
    skipped.  Each file has its own playlist and commit.  Files that no playlist
    names any more stay for readers of the old one until :func:`vacuum`."""

    @classmethod
    def name(cls):
        return "hls"

    def schema(self):
        return PIECES

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return _StreamWriter(self.options, False)


def playlist(items: list[tuple[float, str]], live: bool, batch: int | None) -> str:
    """Text of a playlist of ``(seconds, name)``."""
    goal = max([1, *[-(-int(s * 1000 + 0.5) // 1000) for s, _ in items]])
    head = f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:{goal}\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:{'EVENT' if live else 'VOD'}\n"
    mark = f"{BATCH}{batch}\n" if batch is not None else ""
    return head + mark + "".join(f"#EXTINF:{s:.3f},\n{n}\n" for s, n in items) + ("" if live else "#EXT-X-ENDLIST\n")


def read_playlist(path: str, file: str) -> tuple[list[tuple[float, str]], int]:
    """``(seconds, name)`` of the segments of a playlist, and its last micro-batch."""
    from pyarrow import fs

    store, root = store_of(path)
    if store.get_file_info([f"{root}/{file}.m3u8"])[0].type != fs.FileType.File:
        return [], -1
    with store.open_input_stream(f"{root}/{file}.m3u8") as f:
        lines = f.read().decode().splitlines()
    batch = next((int(x[len(BATCH) :]) for x in lines if x.startswith(BATCH)), -1)
    return [(float(a[8:-1]), b) for a, b in zip(lines, lines[1:]) if a.startswith("#EXTINF:")], batch


def vacuum(path: str) -> int:
    """Deletes the segment files under ``path`` that no playlist names."""
    from pyarrow import fs

    store, root = store_of(path)
    files = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    named = {f"{f.path.rsplit('/', 1)[0]}/{n}" for f in files if f.extension == "m3u8" for _, n in read_playlist(path, f.path[len(root.rstrip("/")) + 1 : -5])[0]}
    gone = [f.path for f in files if f.extension == "ts" and f.path not in named]
    for f in gone:
        store.delete_file(f)
    return len(gone)


def write_hls(packets: DataFrame, streams: DataFrame, folder: str, target: float, blocks: int | None = None) -> None:
    """Cuts packets into segments and writes them with their playlists, anew."""
    spark: SparkSession = packets.sparkSession
    spark.dataSource.register(HlsSink)
    segment_pieces(packets, streams, target, blocks).write.format("hls").mode("overwrite").save(folder)
