"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or checkpoint folder; only on a local
    master, where none is named, a temporary one is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder: a lost executor costs a
    reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with all rows of equal ``keys`` in one partition, also where ``df`` comes
    out of a join by them.

    ``repartition`` by the keys of a join is left out of the plan, as the join's own
    shuffle deals alike; should the join then be made a broadcast join while it runs,
    that shuffle is read by map task and the rows of a key are in many partitions.  A
    hash of the keys is another expression, so its shuffle stays."""
    return df.repartition(F.xxhash64(*keys))
