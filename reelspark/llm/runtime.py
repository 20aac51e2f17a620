"""Shared-folder tables and text hashing used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of 8-byte ids that is ever broadcast (16 MB); beyond it the
#: same step runs as a shuffled join.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary
    folder is made and set as checkpoint folder; on a cluster that is an error,
    as its machines would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts lineage: losing an executor costs a reread, never a
    recomputation from the start.  An operator's result reads from its tables, so
    they stay until :func:`close_workspaces` is called, once results are saved.
    """

    _open: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        Workspace._open.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return it read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this workspace that no later step reads."""
        self._delete(df._workspace_path)

    def close(self) -> None:
        """Delete all tables of this workspace."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def close_workspaces() -> None:
    """Delete the intermediate tables of every operator call so far; results that
    were not saved can no longer be read."""
    while Workspace._open:
        Workspace._open.pop().close()


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", size: int | None = None) -> DataFrame:
    """Semi, anti or inner join of ``df`` with a table of ids.

    The id table is broadcast only when it is counted to hold at most
    ``BROADCAST_IDS`` rows; otherwise Spark shuffles both sides.
    """
    n = ids.count() if size is None else size
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), key, how)


#: Rows that Spark hands to Python at once.  Texts can be long, and Spark's own
#: default of 10,000 makes batches of tens of megabytes on both sides.
ARROW_ROWS = 128


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``ARROW_ROWS`` where it still has
    Spark's default; a value the user has set is kept.  It stays lowered, as
    plans are only made when a result is read."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with a per-task factory: ``make()`` runs once in each task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser with full avalanche (vectorised)."""
    x = x ^ (x >> S33)
    x = x * M1
    x = x ^ (x >> S33)
    x = x * M2
    return x ^ (x >> S33)


_POW = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: invertible modulo 2**64


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _POW = np.multiply.accumulate(p)
    return _POW


#: lower-cases A-Z; 0 for the six ASCII white-space bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 ``data`` in order; words are the
    pieces between ASCII white space (0x09-0x0D, 0x20), A-Z lower-cased."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    word = ~SPACE[raw]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    # Value of a word: sum of byte * base^(offset from its end), modulo 2**64.
    low = LOWER[raw].astype(np.uint64) + np.uint64(1)
    powers = _powers(len(raw))
    acc = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(low * powers[len(raw) - 1 :: -1][: len(raw)], out=acc[1:])
    value = (acc[end] - acc[start]) * _inverse_powers(len(raw))[len(raw) - end]
    return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48)))


_INV = np.ones(1, np.uint64)
_INV_BASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _inverse_powers(n: int) -> np.ndarray:
    global _INV
    if len(_INV) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        p = np.full(size, _INV_BASE, np.uint64)
        p[0] = 1
        _INV = np.multiply.accumulate(p)
    return _INV


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of ``data``; fewer
    words form one shingle, no words none."""
    w = word_hashes(data)
    n = len(w)
    if not n:
        return w
    k = min(width, n)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * _BASE + w[i : n - k + 1 + i])
    return np.unique(h)


class Shared:
    """A broadcast object, pickled by value so that its class travels along."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        """The object, read anew at each call: once in each task."""
        from pyspark import cloudpickle

        return cloudpickle.loads(self._bytes.value)
