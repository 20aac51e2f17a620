"""Scans of ordered rows whose carry is spread over tasks.

A window over one key runs in one task.  Here a key with many rows is cut into
blocks at sampled values of its order; each block's total is a small partial
aggregate, the totals before a block give its carry-in, and the window runs inside
the blocks.  The rows are shuffled once, as for the plain window.  What is
broadcast (bounds and carries) has at most two rows for each block, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Rows sampled for each block to lay its bound.
SAMPLE = 60


def _search(chunks: Column, at: Column, width: int) -> Column:
    """Number of bounds at or before ``at``; the sorted bounds lie in chunks of
    ``width``, so about twice the root of their number is compared."""
    chunk = F.size(F.filter(chunks, lambda c: c[0] <= at))
    inside = F.size(F.filter(F.get(chunks, chunk - 1), lambda b: b <= at))
    return F.when(chunk > 0, (chunk - 1) * width + inside).otherwise(0)


def blocked(df: DataFrame, key: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``_block``, which rises with ``order`` within each key, and
    ``_cut``: whether the key has more than one block.

    ``key`` and ``order`` are column names; nulls are a key of their own and come
    first in order.  Bounds are quantiles of a sample of all rows in order of key
    and ``order``, so only keys with about ``1 / blocks`` of the rows or more are
    cut; rows with equal ``order`` stay in one block.  A row's block depends only on
    its own values and the bounds.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one pass, of which each task hands on as many rows as are wanted
    few = df.select(*key, *order).orderBy(F.rand(11)).limit(SAMPLE * blocks if blocks > 1 else 0)
    rows = few.orderBy(*key, *order).collect()
    found: dict[tuple, list[tuple]] = {}
    for i in range(1, blocks if rows else 1):
        r = rows[len(rows) * i // blocks]
        mine = found.setdefault(tuple(r[: len(key)]), [])
        if (at := tuple(r[len(key) :])) not in mine[-1:]:
            mine.append(at)
    width = max(1, round(max(map(len, found.values()), default=1) ** 0.5))
    of = df.schema
    bound = StructType([StructField(c, of[c].dataType) for c in order])
    kind = StructType([*[StructField(f"_k{i}", of[c].dataType) for i, c in enumerate(key)], StructField("_chunks", ArrayType(ArrayType(bound)))])
    table = df.sparkSession.createDataFrame([(*k, [b[i : i + width] for i in range(0, len(b), width)]) for k, b in found.items()], kind)
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & df[c].eqNullSafe(table[f"_k{i}"])
    out = df.join(F.broadcast(table), same, "left") if key else df.crossJoin(F.broadcast(table)) if found else df.withColumn("_chunks", F.lit(None).cast(kind["_chunks"].dataType))
    block = F.when(F.col("_chunks").isNull(), 0).otherwise(_search(F.col("_chunks"), F.struct(*order), width))
    return out.withColumns({"_block": block.cast(LongType()), "_cut": F.col("_chunks").isNotNull()}).drop("_chunks", *[f"_k{i}" for i in range(len(key))])


def _on(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    same = left["_block"] == right["_to"]
    for i, c in enumerate(key):
        same = same & left[c].eqNullSafe(right[f"_k{i}"])
    return same


#: What a scan can carry: the aggregate, its window form, and how a carry joins a value.
KINDS = {
    "sum": (F.sum, F.sum, lambda before, here: F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)),
    "count": (F.count, F.count, lambda before, here: F.coalesce(before, F.lit(0)) + here),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "last": (None, lambda c: F.last(c, ignorenulls=True), lambda before, here: F.coalesce(here, before)),
}


def carry_scan(df: DataFrame, key: list[str], order: list[str], values: dict[str, tuple[str, str]], blocks: int | None = None, reverse: bool = False, exclusive: bool = False) -> DataFrame:
    """``df`` with a running value for each ``name: (kind, column)`` of ``values``.

    ``kind`` is one of ``sum``, ``count``, ``min``, ``max`` and ``last`` (the last
    value that is not null); nulls count for none.  The scan is by ``order`` within
    ``key`` (an empty list: all rows are one key), backwards if ``reverse``; a row's
    own value is left out if ``exclusive``, and a first row then has null (0 for
    counts).  Equal to the window of that frame; among rows with equal ``order`` the
    sequence is arbitrary, as it is there.
    """
    cut = blocked(df, key, order, blocks)
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    frame = Window.partitionBy(*key, "_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    pick = F.min_by if reverse else F.max_by
    at = F.struct(*order)
    total = lambda kind, c: KINDS[kind][0](c) if kind != "last" else pick(F.col(c), F.when(F.col(c).isNotNull(), at))
    totals = cut.where("_cut").groupBy(*key, "_block").agg(*[total(kind, c).alias(f"_t_{name}") for name, (kind, c) in values.items()])
    before = Window.partitionBy(*key).orderBy(F.col("_block").desc() if reverse else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    again = {"count": F.sum, "last": KINDS["last"][1]}
    carries = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_block").alias("_to"), *[again.get(kind, KINDS[kind][1])(f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()])
    run = cut.withColumns({f"_w_{name}": KINDS[kind][1](c).over(frame) for name, (kind, c) in values.items()})
    both = run.join(F.broadcast(carries), _on(run, carries, key), "left")
    return both.select(*df.columns, *[KINDS[kind][2](F.col(f"_c_{name}"), F.col(f"_w_{name}")).alias(name) for name, (kind, _) in values.items()])


def _compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of the maps y -> a y + b in order, by doubling."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        late, old = a[step:].copy(), b[:-step].copy()
        # a map that forgets what came before it stays as it is, also after infinities
        b[step:] = np.where(late == 0, b[step:], late * old + b[step:])
        a[step:] = late * a[:-step]
        step *= 2
    return a, b


def _fold(totals: bool):
    """Kernel over batches sorted by key, block and order, with ``_first`` and
    ``_last`` row marks; the carry over batches is one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ca, cb = 1.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("_a").to_numpy(zero_copy_only=False), batch.column("_b").to_numpy(zero_copy_only=False)
            first = batch.column("_first").to_numpy(zero_copy_only=False)
            if totals:
                slope, value = np.empty(len(a)), np.empty(len(a))
                edges = sorted({0, *np.flatnonzero(first).tolist(), len(a)})
                for lo, hi in zip(edges, edges[1:]):
                    if first[lo]:  # a block's map begins anew with it
                        ca, cb = 1.0, 0.0
                    sa, sb = _compose(a[lo:hi], b[lo:hi])
                    slope[lo:hi], value[lo:hi] = sa * ca, sa * cb + sb
                    ca, cb = slope[hi - 1], value[hi - 1]
                keep = batch.column("_last").to_numpy(zero_copy_only=False)
                out = batch.drop_columns(["_a", "_b", "_first", "_last"]).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(slope[keep]), pa.array(value[keep])], [*out.schema.names, "_slope", "_value"])
            else:
                y0 = batch.column("_y0").to_numpy(zero_copy_only=False)
                b = np.where(first, a * y0 + b, b)
                sa, sb = _compose(np.where(first, 0.0, a), b)
                y = np.where(sa == 0, sb, sa * cb + sb)
                before = np.where(first, y0, np.concatenate(([cb], y[:-1])))
                cb = y[-1]
                out = batch.drop_columns(["_a", "_b", "_first", "_last", "_y0"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(before), pa.array(y)], [*out.schema.names, "_before", "_after"])

    return run


def affine_scan(df: DataFrame, key: list[str], order: list[str], a: Column, b: Column, name: str, before: str | None = None, start: float = 0.0, blocks: int | None = None) -> DataFrame:
    """``df`` with ``name``: y = a y' + b in doubles, where y' is the row before's y in
    ``order`` within ``key``, or ``start``; ``before`` names a column for y'.

    The maps of a block compose to one map, so a key with many rows runs in many
    tasks: a first pass gives each block's map, the second its values.  Null
    coefficients count as 0.
    """
    cut = blocked(df.withColumns({"_a": F.coalesce(a.cast("double"), F.lit(0.0)), "_b": F.coalesce(b.cast("double"), F.lit(0.0))}), key, order, blocks)
    w = Window.partitionBy(*key, "_block").orderBy(*order)
    marks = {"_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull()}
    fields = lambda names: [cut.schema[c] for c in names]
    ends = cut.where("_cut").select(*key, "_block", "_a", "_b", *order).withColumns(marks).select(*key, "_block", "_a", "_b", "_first", "_last")
    kind = StructType([*fields([*key, "_block"]), StructField("_slope", DoubleType()), StructField("_value", DoubleType())])
    totals = ends.mapInArrow(_fold(True), kind)
    whole = totals.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_block", "_slope", "_value"))).alias("_maps"))
    carried = F.aggregate(F.filter("_maps", lambda m: m["_block"] < F.col("_m._block")), F.lit(float(start)), lambda y, m: m["_slope"] * y + m["_value"])
    carries = whole.select("*", F.explode("_maps").alias("_m")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_m._block").alias("_to"), carried.alias("_y0"))
    run = cut.join(F.broadcast(carries), _on(cut, carries, key), "left").select(*df.columns, "_block", "_a", "_b", F.coalesce("_y0", F.lit(float(start))).alias("_y0"))
    run = run.withColumns(marks).select(*df.columns, "_a", "_b", "_y0", "_first", "_last")
    kind = StructType([*df.schema.fields, StructField("_before", DoubleType()), StructField("_after", DoubleType())])
    out = run.mapInArrow(_fold(False), kind)
    return out.select(*df.columns, *([F.col("_before").alias(before)] if before else []), F.col("_after").alias(name))

