"""N-gram Jaccard join by a token-group matrix.

Documents are partitioned into groups of similar ones, each group stores its
token union (a row of a group x hashed-token bit matrix), a query document's
overlap with a group is bounded by that row, and only groups whose bound
qualifies are opened for exact comparison.

The join is exact.  Which (document, group) cells of the matrix are looked at
comes from a pigeonhole index: two sets with Jaccard >= t whose smaller one has
``a`` tokens differ in at most ``a(1-t)/t`` tokens, so when tokens are hashed
into more segments than that, the sets agree completely on some segment.  A
segment's content is one signature; it holds several tokens, so one common
passage does not make a hot key the way a single common token would.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components, forest_roots
from .runtime import BROADCAST_IDS, Workspace, keep_ids, map_rows, mix, shingle_set

#: Hashed token columns of the matrix; a bound from hashed columns never
#: undercounts, it only opens a few more groups.
COLUMNS = 4096


def _class_bounds(top: int) -> list[int]:
    out = [1]
    while out[-1] <= top:
        out.append(-(-out[-1] * 3 // 2))
    return out


BOUNDS = np.array(_class_bounds(1 << 40), np.int64)
_B = np.uint64(0x9E3779B97F4A7C15)


def signatures(tokens: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(which, spare, signatures) of a sorted distinct token set, for each size
    class that the smaller set of a similar pair can have: 0 its own class, 1 the
    one below, and so on.

    Two different sets with ``100 * |A & B| >= percent * |A | B|`` have more than
    ``spare`` signatures in common, for the larger ``spare`` of the two.  Sets
    that can only be similar to an equal set give none.
    """
    n = len(tokens)
    own = int(np.searchsorted(BOUNDS, n, "right")) - 1
    rest = 100 - percent
    out = []
    for scheme in range(own, -1, -1):
        if scheme < own and 100 * (int(BOUNDS[scheme + 1]) - 1) < percent * n:
            break
        smaller = min(int(BOUNDS[scheme + 1]) - 1, n)
        if rest * smaller // percent == 0:
            continue
        differ = rest * (int(BOUNDS[scheme + 1]) - 1) // percent
        slack = 4 + differ // 6
        k = differ + 1 + slack
        seg = (tokens % np.uint64(k)).astype(np.int64)
        count = np.bincount(seg, minlength=k)
        low = np.bincount(seg, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), k).astype(np.uint64)
        high = np.bincount(seg, (tokens >> np.uint64(32)).astype(np.float64), k).astype(np.uint64)
        tag = mix(np.arange(k, dtype=np.uint64) + np.uint64((scheme + 1) << 40))
        sig = mix(low + high * _B + tag)
        # An empty segment agrees with any other empty one.  Of the segments on
        # which two similar sets agree at most `slack` may be empty in a set
        # that skips its empty ones, and more than `slack` agree.
        empty = k - int(np.count_nonzero(count))
        out.append((own - scheme, 0, sig) if empty > slack else (own - scheme, slack - empty, sig[count > 0]))
    return out


def _texts(batch: pa.RecordBatch):
    col = batch.column("text").cast(pa.large_binary())
    for i in range(batch.num_rows):
        yield i, (col[i].as_py() or b"")


def _digests(width):
    def make():
        def step(batch):
            size, d1, d2 = [], [], []
            for _, text in _texts(batch):
                s = shingle_set(text, width)
                h = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                size.append(len(s)), d1.append(h[0]), d2.append(h[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())],
                ["id", "n", "d1", "d2"],
            )

        return step

    return make


def _signature_rows(width, percent):
    def make():
        def step(batch):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            part: list = []
            at: list = []
            size: list = []
            total = 0

            def flush():
                reps = [len(p) for p in part]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(part).view(np.int64)),
                        pa.array(np.repeat(np.array(at, np.int64), reps)),
                        pa.array(np.repeat(np.array(size, np.int64), reps)),
                    ],
                    ["sig", "id", "packed"],
                )

            for i, text in _texts(batch):
                s = shingle_set(text, width)
                for which, spare, sig in signatures(s, percent) if len(s) else ():
                    part.append(sig), at.append(ids[i]), size.append(len(s) << 28 | spare << 4 | which)
                    total += len(sig)
                if total > 200_000:
                    yield flush()
                    part, at, size, total = [], [], [], 0
            if total:
                yield flush()

        return step

    return make


def _bits(tokens: np.ndarray) -> np.ndarray:
    """The matrix columns of a token set as 64-bit words, lowest bit first."""
    flag = np.zeros(COLUMNS, np.uint8)
    flag[tokens & (COLUMNS - 1)] = 1
    return np.packbits(flag, bitorder="little").view(np.int64)


def _sets(width, extra, bits=False):
    def make():
        def step(batch):
            rows, keep = [], []
            for i, text in _texts(batch):
                s = shingle_set(text, width)
                if len(s):
                    keep.append(i), rows.append(s.view(np.int64))
            if keep:
                idx = pa.array(keep, pa.int64())
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                sets = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))]
                if bits:
                    words = np.concatenate([_bits(r) for r in rows])
                    sets.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, COLUMNS // 64, dtype=np.int32)), pa.array(words)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(idx) for c in ("id", *extra)] + sets, ["id", *extra, "tokens", *["bits"] * bits]
                )

        return step

    return make


def _similar(a: str, b: str, percent: int):
    """Column: exact test of two token arrays."""
    both = F.size(F.array_intersect(a, b))
    return (100 * both) >= percent * (F.size(a) + F.size(b) - both)


def _token_group_matrix(sets: DataFrame) -> DataFrame:
    """``group, row``: for each group the hashed columns any member sets, as
    ``COLUMNS / 64`` words in order; OR-ed map-side before the shuffle."""
    return (
        sets.select("group", F.posexplode("bits").alias("word", "w"))
        .groupBy("group", "word")
        .agg(F.bit_or("w").alias("w"))
        .groupBy("group")
        .agg(F.expr("transform(array_sort(collect_list(struct(word, w))), x -> x.w)").alias("row"))
    )


def jaccard_components(
    spark: SparkSession,
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
) -> DataFrame:
    """Exact similarity classes under Jaccard of ``width``-word shingles, for any
    ``percent`` from 1 to 100.

    Words are the pieces between ASCII white space, A-Z lower-cased.  Two
    documents link when ``100 * |A & B| >= percent * |A | B|``.  Returns a row
    per input row: ``id_col``, ``n_shingles`` (distinct shingles),
    ``component_id`` (smallest id reachable by links, itself included).

    Null or empty or wordless texts have an empty set and link with nothing.
    Rows with a null id keep their size and get a null component.  Repeated
    rows are one node; rows that share an id but not the text are one node
    that links through any of its texts.  Extra columns are ignored.  An empty
    table gives an empty result.  Shingles are compared by 64-bit hash.

    Plan.  One pass makes a size and a 128-bit digest per set; equal sets
    collapse to their smallest id.  A second pass explodes signatures of the
    remaining sets and the only large shuffle deals them by signature.
    Documents that share most signatures form groups.  Within a group they are
    compared by their differences from the group's pivot, which lists few of the
    pairs of a large family of copies; pairs that both link to the pivot are not
    listed at all.  Between groups the matrix bound decides what is opened.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    work = Workspace(spark, "ngram")
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = work.table(map_rows(docs, _digests(width), "id bigint, n bigint, d1 bigint, d2 bigint"))
    real = sized.where("n > 0 and id is not null")
    reps = work.table(real.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("k")))
    copied = real.join(reps.where("k > 1").select("d1", "d2", "rep"), ["d1", "d2"]).where("id <> rep")
    # An id that repeats with several texts may stand for one set and copy another,
    # or copy several.
    rep_ids = reps.select(F.col("rep").alias("id"))
    ends = work.table(copied.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")))
    several = copied.join(ends.where("low <> high"), "id").where("rep <> low").select(F.col("low").alias("id"), "rep")
    both = work.table(copied.join(rep_ids, "id", "left_semi").select("id", "rep").unionByName(several))
    skip = work.table(ends.select("id").join(rep_ids, "id", "left_anti"))
    alive = keep_ids(docs.where("id is not null"), skip, "id", "left_anti")

    rows = map_rows(alive, _signature_rows(width, percent), "sig bigint, id bigint, packed bigint")
    by_sig = Window.partitionBy("sig")
    hot_first = Window.partitionBy("id", "which").orderBy(F.desc("k"), "sig")
    common = (
        rows.select("*", F.min("id").over(by_sig).alias("lead"), F.max("id").over(by_sig).alias("last"), F.count("*").over(by_sig).alias("k"))
        .where("lead <> last")
        .select("sig", "id", "k", F.expr("packed >> 28").alias("n"), F.expr("(packed >> 4) & 16777215").alias("spare"), F.expr("packed & 15").alias("which"))
    )
    kept = common.select("*", F.row_number().over(hot_first).alias("r")).where("r > spare")
    shared = work.table(
        kept.select("sig", "id", "n", F.min("id").over(by_sig).alias("lead"), F.max("id").over(by_sig).alias("last")).where("lead <> last").drop("last")
    )

    # Groups: trees of "shares most signatures with"; a leader has the smaller id.
    lead = work.table(
        shared.where("id <> lead")
        .groupBy("id", "lead")
        .agg(F.count("*").alias("k"))
        .groupBy("id")
        .agg(F.max_by("lead", F.struct("k", -F.col("lead"))).alias("v"))
        .select(F.col("id").alias("u"), "v")
    )
    # A document that leads all its signatures and is nobody's best leader has no
    # edge; it is a tree of its own.
    led = forest_roots(lead, work).select(F.col("node").alias("id"), "root")
    tree = work.table(shared.select("id").distinct().join(led, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    sets = work.table(
        map_rows(keep_ids(docs, tree, "id", "inner").select("id", "root", "text"), _sets(width, ["root"], bits=True), _SET_COLUMNS)
    )
    apart = work.table(_from_pivot(_merge_groups(work, shared, sets), percent))
    inside = _within_groups(work, apart, percent)
    across = _across_groups(work, shared, sets, apart, percent)
    to_pivot = apart.where("linked and id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    links = to_pivot.unionByName(inside).unionByName(across).unionByName(both.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    found = components(links, work).select(F.col("node").alias("rep"), "component")
    for done in (shared, lead, tree, sets, apart, inside, across, both):  # the components have read them
        work.drop(done)

    return (
        sized.join(reps.select("d1", "d2", "rep"), ["d1", "d2"], "left")
        .join(found, "rep", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNull(), None)
            .when(F.col("n") == 0, F.col("id"))
            .otherwise(F.coalesce("component", "rep", "id"))
            .alias("component_id"),
        )
    )


_SET_COLUMNS = "id bigint, root bigint, tokens array<bigint>, bits array<bigint>"


def _merge_groups(work: Workspace, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` with trees joined that belong to one family.

    A tree whose root shares at least 10 % with the root of the tree it has most
    signatures in common with becomes part of it.  Any grouping gives the same
    links; one group for one family keeps comparisons inside it."""
    by_sig = Window.partitionBy("sig")
    trees = shared.join(sets.select("id", "root"), "id").select("sig", "root").distinct()
    other = (
        trees.select("root", F.min("root").over(by_sig).alias("to")).where("root <> to")
        .groupBy("root", "to").agg(F.count("*").alias("k"))
        .groupBy("root").agg(F.max_by("to", F.struct("k", -F.col("to"))).alias("to"))
    )
    roots = sets.where("id = root")
    a, b = roots.select("root", F.col("tokens").alias("a")), roots.select(F.col("root").alias("to"), F.col("tokens").alias("b"))
    alike = other.join(a, "root").join(b, "to").withColumn("both", F.size(F.array_intersect("a", "b"))).where("10 * both >= (size(a) + size(b) - both)")
    # Each tree moves to one with a smaller root, so these moves form a forest.
    moves = work.table(alike.select(F.col("root").alias("u"), F.col("to").alias("v")))
    moved = forest_roots(moves, work).select(F.col("node").alias("root"), F.col("root").alias("component"))
    moved_here = F.broadcast(moved) if moved.count() <= BROADCAST_IDS else moved
    return sets.join(moved_here, "root", "left").select("id", F.coalesce("component", "root").alias("root"), "tokens")


def _from_pivot(sets: DataFrame, percent: int) -> DataFrame:
    """Each document's difference ``d`` from its group's pivot (the root).

    ``group`` is the root, or the document itself where it shares less than 10 %
    with the root; ``linked`` tells whether it links to the root.  For any pivot
    the difference of two documents is the difference of their ``d``.
    """
    pivot = sets.where("id = root").select("root", F.col("tokens").alias("p"))
    d = F.concat(F.array_except("tokens", "p"), F.array_except("p", "tokens"))
    return (
        sets.join(pivot, "root")
        .select("id", "root", F.size("tokens").alias("n"), F.size("p").alias("pn"), d.alias("d"))
        .select(
            "id", "root", "n",
            F.expr(f"{100 + percent} * size(d) <= {100 - percent} * (n + pn)").alias("linked"),
            F.when(F.expr("10 * (n + pn - size(d)) >= (n + pn + size(d))"), F.struct(F.col("root").alias("group"), "d"))
            .otherwise(F.struct(F.col("id").alias("group"), F.expr("array()").cast("array<bigint>").alias("d"))).alias("g"),
        )
        .select("id", "root", "n", F.expr("linked and g.group = root").alias("linked"), "g.group", "g.d")
    )


def _within_groups(work: Workspace, apart: DataFrame, percent: int) -> DataFrame:
    """Links (``u, v``) between documents of one group that do not both link to
    its pivot.

    Similar documents differ in at most ``h`` tokens, so they have a token of
    ``d`` in common among the ``h + 1`` rarest of the one with the larger ``d``
    and the ``h / 2 + 1`` rarest of the other, rare within the group; unless
    their ``d`` add up to no more than ``h``, which is looked up apart.
    """
    rest = 100 - percent
    g = apart.where("size(d) > 0").select("id", "group", "linked", F.size("d").alias("dn"), F.expr(f"{rest} * n div {percent}").alias("h"), "n", "d")
    of_doc = Window.partitionBy("id", "group").orderBy("df", "token")
    rows = work.table(
        g.select("id", "group", "linked", "dn", "h", "n", F.explode("d").alias("token"))
        .withColumn("df", F.count("*").over(Window.partitionBy("group", "token")))
        .withColumn("r", F.row_number().over(of_doc))
        .where("r <= h + 1 and df > 1")
    )
    side = lambda df, x, *on: df.select(*on, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "linked", "dn", "n", *(["r"] if "r" in df.columns else []))])
    fits = (
        "not (q_linked and m_linked) and struct(q_dn, q_id) < struct(m_dn, m_id)"
        f" and 100 * least(q_n, m_n) >= {percent} * greatest(q_n, m_n)"
        f" and {100 + percent} * (m_dn - q_dn) <= {rest} * (q_n + m_n)"
    )
    # From the first common token on, what is left of both must hold the overlap
    # that the pair needs: half of what their d exceed the allowed difference by.
    reach = f" and 2 * (1 + least(q_dn - q_r, m_dn - m_r)) >= q_dn + m_dn - {rest} * (q_n + m_n) div {100 + percent}"
    pairs = side(rows.where("r <= h div 2 + 1"), "q", "group", "token").join(side(rows, "m", "group", "token"), ["group", "token"]).where(fits + reach)
    odd = work.table(g.where("not linked and dn <= h").select("id", "group", "linked", "dn", "n"))
    near = pairs.select("q_id", "m_id")
    if not odd.isEmpty():
        other = side(g.where("dn <= h"), "m", "group").join(side(odd, "q", "group"), "group")
        near = near.unionByName(
            other.where("q_id <> m_id").where(fits.split(" and struct")[0] + f" and {100 + percent} * (q_dn + m_dn) <= {rest} * (q_n + m_n)").select("q_id", "m_id")
        )
    near = work.table(near.distinct())
    d = apart.select("id", "n", "d")
    return work.table(
        near.join(d.select(F.col("id").alias("q_id"), F.col("n").alias("q_n"), F.col("d").alias("q_d")), "q_id")
        .join(d.select(F.col("id").alias("m_id"), F.col("n").alias("m_n"), F.col("d").alias("m_d")), "m_id")
        .where(f"{100 + percent} * (size(q_d) + size(m_d) - 2 * size(array_intersect(q_d, m_d))) <= {rest} * (q_n + m_n)")
        .select(F.col("q_id").alias("u"), F.col("m_id").alias("v"))
    )


def _across_groups(work: Workspace, shared: DataFrame, sets: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Links (``u, v``) between documents of different groups.

    A cell of the matrix is looked at where a document shares a signature with a
    member of another group.  For two such groups the members of the smaller one
    are the queries (ties: the smaller group id); a group is opened only where
    the query's overlap with its token union can reach the threshold.
    """
    by_sig = Window.partitionBy("sig")
    place = apart.select("id", "group")
    # A table, so that Spark sees its size and can split the join at a hot group.
    size = work.table(place.groupBy("group").agg(F.count("*").alias("members")))
    s = work.table(
        shared.select("sig", "id", "n").join(place.join(size, "group"), "id")
        .select("*", F.min("group").over(by_sig).alias("g0"), F.max("group").over(by_sig).alias("g1"))
        .where("g0 <> g1").drop("g0", "g1")
    )
    q = s.select("sig", F.col("id").alias("q"), F.col("n").alias("q_n"), F.struct("members", "group").alias("q_rank"))
    m = s.select("sig", F.col("id").alias("m"), F.col("n").alias("m_n"), F.struct("members", "group").alias("m_rank"))
    cells = work.table(
        q.join(m, "sig")
        .where(f"q_rank < m_rank and 100 * least(q_n, m_n) >= {percent} * greatest(q_n, m_n)")
        .select("q", F.col("m_rank.group").alias("m_group"), "m")
        .distinct()
    )
    placed = sets.join(place, "id")
    matrix = _token_group_matrix(placed).select(F.col("group").alias("m_group"), "row")
    hit = F.expr(
        f"size(filter(tokens, t -> shiftright(row[cast(pmod(t, {COLUMNS}) div 64 as int)], cast(pmod(t, 64) as int)) & 1L = 1L))"
    )
    qualifying = (
        cells.select("q", "m_group").distinct()
        .join(sets.select(F.col("id").alias("q"), "tokens"), "q")
        .join(matrix, "m_group")
        .where(100 * hit >= percent * F.size("tokens"))
        .select("q", "m_group", "tokens")
    )
    opened = cells.join(qualifying, ["q", "m_group"]).join(
        sets.select(F.col("id").alias("m"), F.col("tokens").alias("m_tokens")), "m"
    )
    return work.table(opened.where(_similar("tokens", "m_tokens", percent)).select(F.col("q").alias("u"), F.col("m").alias("v")))
