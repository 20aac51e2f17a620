"""Files by byte ranges: listing, reading a few bytes, and writing many tasks' bytes
to their places in one file.

Paths are URIs (``file:``, ``hdfs:``, ``s3:``, ``gs:``) or local paths that all
machines see.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "file string, bytes bigint, pieces bigint"


def store_of(path: str):
    """The file system of ``path`` and its path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def list_files(path: str) -> list[tuple[str, int]]:
    """URI and size of the file ``path`` or of the files in the folder, by name."""
    from pyarrow import fs

    store, at = store_of(path)
    scheme = path.split(":", 1)[0] + "://" if "://" in path and not path.startswith("file:") else "file://"
    found = store.get_file_info([at])
    if found[0].type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class RangeReader:
    """Reads of ``(start, length)`` of one file; ``taken`` counts their bytes."""

    def __init__(self, path: str):
        store, at = store_of(path)
        self.file, self.taken = store.open_input_file(at), 0
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        length = max(0, min(length, self.size - start))
        data = self.file.read_at(length, start) if length else b""
        self.taken += len(data)
        return data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


class _Place:
    """A file that is written by position and gets its name at the end."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.fd = os.open(path, os.O_RDWR | os.O_CREAT)
        self.start, self.held, self.n = 0, [], 0

    def put(self, offset: int, data: bytes) -> None:
        if self.held and (offset != self.start + self.n or self.n > 4 << 20):
            self.flush()
        if not self.held:
            self.start = offset
        self.held.append(data)
        self.n += len(data)

    def flush(self) -> None:
        data, at = memoryview(b"".join(self.held)), self.start
        while data:
            n = os.pwrite(self.fd, data, at)
            data, at = data[n:], at + n
        self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        os.fsync(self.fd)
        os.close(self.fd)


def write_ranges(rows: DataFrame, folder: str, build: Callable[[pa.RecordBatch], list[bytes]], partitions: int | None = None) -> DataFrame:
    """Writes ``rows(file, offset, ...)``, of which ``build`` makes the bytes, to their
    offsets in ``folder/file``; returns ``file, bytes, pieces``.

    Rows are dealt by ranges of file and offset, so a file is written by many tasks,
    each holding a few megabytes.  A task that is repeated writes the same bytes to the
    same places.  Files get their names once all tasks are done; until then, and after
    a failure, only names with a dot in front are there.  ``folder`` is a ``file:`` URI
    or path on a disk that all machines share, as other stores cannot write in place.
    Offsets must not overlap; gaps are zero bytes.
    """
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("writing in place needs a folder on a shared disk")
    at = store_of(folder)[1]
    run_id = uuid.uuid4().hex
    temporary = lambda f: os.path.join(at, os.path.dirname(f), f".{os.path.basename(f)}-{run_id}")
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, place, pieces, size = None, None, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([pieces], pa.int64())], ["file", "bytes", "pieces"])
        for b in batches:
            for file, offset, data in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), build(b)):
                if file != name:
                    if place:
                        place.close()
                        yield done()
                    name, place, pieces, size = file, _Place(temporary(file)), 0, 0
                place.put(offset, data)
                pieces, size = pieces + 1, size + len(data)
        if place:
            place.close()
            yield done()

    written = dealt.mapInArrow(run, MANIFEST).groupBy("file").agg(F.sum("bytes").alias("bytes"), F.sum("pieces").alias("pieces"))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column("file").to_pylist():
                end = os.path.join(at, f)
                if os.path.exists(temporary(f)):  # else an earlier try of this task did it
                    os.replace(temporary(f), end)
            yield b

    from ..operators.lineage import cut

    return cut(cut(written).mapInArrow(rename, MANIFEST))
