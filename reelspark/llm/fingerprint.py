"""Document fingerprints by an invertible Bloom lookup sketch.

A text is the set of digests of its paragraphs (lines).  Each digest goes into
one cell of each of three tables; a cell keeps a count, the XOR of its digests
and the XOR of their check hashes.  Two sketches of one size subtract cell by
cell, what is common cancels, and peeling cells that hold a single digest
recovers the digests that differ.  Where peeling gets stuck both sketches are
built again twice as large.

A stored fingerprint is large enough that peeling it alone recovers all of its
text's digests.  Two of them can be subtracted directly, after cells of the
larger are added up pairwise down to the size of the smaller (cell i of m holds
cells i and i + m of 2m); where that does not peel, each is peeled alone and both
are built again larger.  So a likeness needs the two fingerprints and no text.

Everything is a Spark SQL expression over arrays inside one row: no Python, no
explode, no shuffle of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: cells of each of the three tables at the first attempt
FIRST = 4
#: paragraphs a segment holds on average in texts of more than one segment
SEGMENT = 48
#: attempts, each with cells twice as many; the last has at least 4 * 2**19 per table
ATTEMPTS = 20

# An element is struct(d, c): digest and check hash.
_DIGESTS = (
    "transform(array_distinct(transform(filter(split({0}, '\\n'), p -> p <> ''), p -> xxhash64(p))),"
    " d -> struct(d as d, xxhash64(d, 'check') as c))"
)


def _place(e: str, table: int, cells: str) -> str:
    return f"pmod(xxhash64({e}.d, {table}), {cells})"


_CELLS = "array<array<struct<n: bigint, d: bigint, c: bigint>>>"
_EMPTY = "struct(0L as n, 0L as d, 0L as c)"


def _fold(items: str, sign: str, start: str = _EMPTY) -> str:
    return (
        f"aggregate({items}, {start},"
        f" (a, e) -> struct(a.n {sign} 1L as n, a.d ^ e.d as d, a.c ^ e.c as c))"
    )


def _table(elements: str, table: int, cells: str) -> str:
    """Cells of one table of a sketch."""
    placed = f"transform({elements}, e -> struct(e.d as d, e.c as c, {_place('e', table, cells)} as i))"
    return (
        f"transform(array({placed}), q -> transform(sequence(0L, {cells} - 1L),"
        f" j -> {_fold('filter(q, e -> e.i = j)', '+')}))[0]"
    )


def sketch(elements: str, cells: str) -> str:
    """SQL: the three tables of a sketch of an array of elements."""
    return f"array({', '.join(_table(elements, t, cells) for t in range(3))})"


def _subtract(a: str, b: str) -> str:
    cell = "(x, y) -> struct(x.n - y.n as n, x.d ^ y.d as d, x.c ^ y.c as c)"
    return f"zip_with({a}, {b}, (s, t) -> zip_with(s, t, {cell}))"


def _peel_step(s: str, cells: str) -> str:
    """One round: all pure cells at once, then their digests leave every table."""
    pure = (
        f"array_distinct(transform(filter(flatten({s}.t), z -> (z.n = 1 or z.n = -1) and z.c = xxhash64(z.d, 'check')),"
        " z -> struct(z.n as n, z.d as d, z.c as c)))"
    )
    minus = lambda i: (
        f"transform({s}.t[{i}], (z, j) -> aggregate(filter(u, e -> {_place('e', i, cells)} = j), z,"
        " (a, e) -> struct(a.n - e.n as n, a.d ^ e.d as d, a.c ^ e.c as c)))"
    )
    after = f"struct(array({minus(0)}, {minus(1)}, {minus(2)}) as t, {s}.got + size(u) as got, size(u) > 0 as on)"
    return f"if({s}.on, transform(array({pure}), u -> {after})[0], {s})"


def _peel(diff: str, cells: str) -> str:
    """Number of digests recovered from a difference, null if some stay stuck.
    A random sketch that can be peeled empties within a few dozen rounds."""
    state = f"aggregate(sequence(1, 40), struct({diff} as t, 0 as got, true as on), (s, r) -> {_peel_step('s', cells)})"
    clean = "forall(flatten(z.t), c -> c.n = 0 and c.d = 0 and c.c = 0)"
    return f"transform(array({state}), z -> if({clean}, z.got, cast(null as int)))[0]"


def _difference(a: str, b: str) -> str:
    """Digests that differ between two element arrays, retrying larger."""
    attempt = f"transform(array(cast({FIRST} << k as bigint)), m -> {_peel(_subtract(sketch(a, 'm'), sketch(b, 'm')), 'm')})[0]"
    return f"aggregate(sequence(0, {ATTEMPTS - 1}), cast(null as int), (r, k) -> coalesce(r, {attempt}))"


def _segments(elements: str, n: str) -> str:
    """``n * n`` arrays that an element array is dealt to by digest, in two
    steps, so that cost grows with n and not with n * n for each element."""
    inner = f"transform(sequence(0L, {n} - 1L), j -> filter(part, e -> pmod(shiftright(e.d, 24), {n}) = j))"
    return (
        f"if({n} = 1L, array({elements}), flatten(transform(sequence(0L, {n} - 1L), i ->"
        f" transform(array(filter({elements}, e -> pmod(e.d, {n}) = i)), part -> {inner})[0])))"
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness (0 to 1) of two element arrays from the peeled difference
    of their sketches; 1 for two empty ones."""
    n = f"cast(ceil(sqrt(greatest(size({a}), size({b})) / {SEGMENT}D)) as bigint)"
    segs = lambda x: _segments(x, "g")
    total = (
        f"transform(array(greatest({n}, 1L)), g -> aggregate(zip_with({segs(a)}, {segs(b)}, (x, y) -> {_difference('x', 'y')}),"
        " 0, (t, v) -> t + v))[0]"
    )
    return F.expr(
        f"case when size({a}) + size({b}) = 0 then 1D else"
        f" transform(array({total}), v -> (size({a}) + size({b}) - v) / cast(size({a}) + size({b}) + v as double))[0] end"
    )


def elements(text: str) -> Column:
    return F.expr(_DIGESTS.format(text))


def _alone(segment: str) -> str:
    """The smallest sketch of an element array that peels to all its elements, of
    one and a half cells an element at first."""
    none = f"cast(null as {_CELLS})"
    first = f"cast(greatest({FIRST}, shiftleft(1, cast(ceil(log2(greatest(size({segment}), 1) / 2D)) as int))) as bigint)"
    attempt = f"transform(array({sketch(segment, 'm')}), z -> if({_peel('z', 'm')} is null, {none}, z))[0]"
    return (
        f"transform(array({first}), f -> aggregate(sequence(0, {ATTEMPTS - 1}), {none},"
        f" (r, k) -> coalesce(r, transform(array(shiftleft(f, k)), m -> {attempt})[0])))[0]"
    )


def encoded(elements_col: str) -> Column:
    """The fingerprint as text: the number of paragraphs, ``|``, then the sketch of
    each segment, joined by ``;``.  A sketch is the cells of its three tables in
    order, joined by ``,``; a cell is its count, digest XOR and check XOR in
    hexadecimal, joined by ``:``.  Texts of up to ``SEGMENT`` paragraphs have one
    segment, larger ones n * n by digest, n a power of two."""
    cell = "concat(hex(z.n), ':', hex(z.d), ':', hex(z.c))"
    n = f"if(size({elements_col}) <= {SEGMENT}, 1L, shiftleft(1L, cast(ceil(log2(sqrt(size({elements_col}) / {SEGMENT}D))) as int)))"
    segment = f"array_join(transform(flatten({_alone('e')}), z -> {cell}), ',')"
    return F.expr(
        f"concat(size({elements_col}), '|', transform(array({n}), g -> array_join(transform({_segments(elements_col, 'g')}, e -> {segment}), ';'))[0])"
    )


def with_next(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Every row of ``documents(id, text)`` with ``next_text``: the text of the
    next document in descending id, the first one's after the last.

    Ids are dealt to ranges of about equal size, so that texts move once; each
    range also receives the first row of the range after it.  Rows with a null
    id come last; equal ids follow each other by text.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, 8)
    at = [i / parts for i in range(1, parts)]
    cuts = documents.select(F.percentile_approx(-F.col("id"), at, 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]).cast("array<bigint>")
    docs = documents.select("id", F.coalesce("text", F.lit("")).alias("text"))
    # number of cuts at or below -id; null ids go behind all of them
    part = F.when(F.col("id").isNull(), F.size(cuts) + 1).otherwise(F.size(F.filter(cuts, lambda c: c <= -F.col("id"))))
    dealt = docs.withColumn("part", part)
    # one row a range at most: few, whatever the input's size
    heads = dealt.groupBy("part").agg(F.max("id").alias("id")).collect()
    order = sorted((r["part"], r["id"]) for r in heads) if heads else []
    follow = {order[i][0]: order[i - 1][0] for i in range(len(order))}
    ghosts = spark.createDataFrame(
        [(p, i, follow[p]) for p, i in order] or [(0, None, 0)], "part int, id bigint, to int"
    )
    head = dealt.join(F.broadcast(ghosts), (dealt.part == ghosts.part) & dealt.id.eqNullSafe(ghosts.id)).select(
        dealt.id, dealt.text, ghosts["to"].alias("part")
    )
    head = head.groupBy("part", "id").agg(F.min("text").alias("text"))
    rows = dealt.select("id", "text", "part", F.lit(0).alias("ghost")).unionByName(head.select("id", "text", "part", F.lit(1).alias("ghost")))
    in_order = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("id"), "text")
    return rows.withColumn("next_text", F.lead("text").over(in_order))


def fingerprints(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited version.

    The edited text is the text with its last floor(n / 2) code points replaced
    by as many first ones (or all) of the next document's, in descending id.
    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; the near columns are the Jaccard likeness of the
    paragraph sets that the fingerprints hold, from the peeled difference of
    sketches.

    A null text is empty: no paragraphs, and likeness 1 with another empty one.
    Repeated paragraphs count once, blank lines not.  Rows with a null id come
    last in the order, equal ids go by text, so every row has one next; a single
    row is its own next.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    in_order = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("id"), "text")
    half = F.expr("cast(length(text) div 2 as int)")
    rows = (
        with_next(spark, src)
        .select("id", "part", "ghost", "text", F.length("text").cast("bigint").alias("n_chars"),
                F.concat(F.expr("left(text, length(text) - cast(length(text) div 2 as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"))
        .select("id", "part", "ghost", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), elements("text").alias("own"), elements("edited").alias("edit"))
        .withColumn("next", F.lead("own").over(in_order))
        .where("ghost = 0")
    )
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        encoded("own").alias("fingerprint"), encoded("edit").alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
