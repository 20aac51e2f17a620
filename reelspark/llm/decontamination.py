"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items form one automaton over word numbers.  Training
words stream through it; where the longest match reaches a window's length the
window's words are hit.  Hit spans, or whole documents over a coverage limit,
are then removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Shared, Workspace, map_rows

#: words after A-Z are lower-cased: letters and digits of ASCII, and every code
#: point above it
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}

#: Most benchmark words in one broadcast automaton (about 60 MB); a larger
#: benchmark is dealt to several.
AUTOMATON_WORDS = 200_000
#: Automata that are broadcast at a time; with more of them the documents are
#: passed over several times.
AT_ONCE = 2


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_ASCII_LOWER)) if text else []


class SuffixAutomaton:
    """Substrings of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.shortest = window
        sequences = []
        for item, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            if ids:
                sequences.append((item, ids))
                self.shortest = min(self.shortest, len(ids))
        ends = []
        for item, ids in sequences:
            last = 0
            for c in ids:
                last = self._extend(last, c)
            ends.append(last)
        n = len(self.next)
        #: state that holds the window-long suffix of this state's matches
        self.window_state = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.window_state[v] = v if self.length[up] < window else self.window_state[up]
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, set[str]] = {}
        for (item, ids), end in zip(sequences, ends):
            if len(ids) < window:
                self.short_items.setdefault(end, set()).add(item)
                continue
            for _, v, size in self._walk(ids):
                if size >= window:
                    self.window_items.setdefault(self.window_state[v], set()).add(item)
        #: nearest state up the links, itself included, that is a whole short item
        self.short_state = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            self.short_state[v] = v if v in self.short_items else self.short_state[self.link[v]] if v else -1
        pairs = sorted({a * len(self.vocab) + b for _, ids in sequences for a, b in zip(ids, ids[1:])})
        self.pairs = np.array(pairs, np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _walk(self, ids):
        """(position, state, longest match ending there) of a word sequence."""
        nxt, link, length = self.next, self.link, self.length
        v = size = 0
        for j, c in enumerate(ids):
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = nxt[v].get(c)
            if to is None:
                v = size = 0
            else:
                v, size = to, size + 1
            yield j, v, size

    def scan(self, ws: list[str]) -> tuple[np.ndarray, set[str], int]:
        """Hit flag of each word, items with an occurring window, longest match.

        Only runs of words in which every neighbouring pair occurs in some item
        can hold a match of two words or more, so only those, if long enough for
        the shortest window, stream through the automaton."""
        n = len(ws)
        delta = np.zeros(n + 1, np.int64)
        items: set[str] = set()
        longest = 0
        if not self.vocab or n < self.shortest:
            return delta[:n] > 0, items, 0
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, n)
        known = ids >= 0
        if len(self.pairs):
            key = ids[:-1] * len(self.vocab) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = known[:-1] & known[1:] & (self.pairs[at] == key)
        else:
            joined = np.zeros(max(n - 1, 0), bool)
        # a run starts at a known word that is not joined to the one before it
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            for j, v, size in self._walk(ids[a:b].tolist()):
                longest = max(longest, size)
                if size >= self.window:
                    delta[a + j + 1 - self.window] += 1
                    delta[a + j + 1] -= 1
                    items |= self.window_items.get(self.window_state[v], set())
                u = v if size == self.length[v] else self.link[v]
                u = self.short_state[u] if u >= 0 else -1
                while u > 0:
                    delta[a + j + 1 - self.length[u]] += 1
                    delta[a + j + 1] -= 1
                    items |= self.short_items[u]
                    u = self.short_state[self.link[u]]
        return np.cumsum(delta[:n]) > 0, items, longest


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13) -> Iterator[SuffixAutomaton]:
    """Automata of all benchmark items, each over at most ``AUTOMATON_WORDS``
    words (or one longer item), one at a time.  Items are streamed; null texts
    and texts without words give no window."""
    part, size, none = [], 0, True
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        ws = words(r.t)
        if part and size + len(ws) > AUTOMATON_WORDS:
            yield SuffixAutomaton(part, window)
            part, size, none = [], 0, False
        part.append((r.i if r.i is not None else "", ws))
        size += len(ws)
    if part or none:
        yield SuffixAutomaton(part, window)


def _look(built: list[SuffixAutomaton], ws: list[str]) -> tuple[np.ndarray, set[str], int]:
    hit, items, longest = np.zeros(len(ws), bool), set(), 0
    for a in built:
        h, it, lo = a.scan(ws)
        hit |= h
        items |= it
        longest = max(longest, lo)
    return hit, items, longest


_FOUND = "starts array<bigint>, stops array<bigint>, items array<string>, longest bigint"


def _pass(spark: SparkSession, src: DataFrame, built: list[SuffixAutomaton]) -> DataFrame:
    """``h1, h2`` (hashes of the text) and ``_FOUND`` of the documents with any match."""
    shared = [Shared(spark, a) for a in built]

    def make():
        mine = [a.value for a in shared]

        def step(batch):
            text, rows = batch.column("text"), []
            for i in range(batch.num_rows):
                hit, items, longest = _look(mine, words(text[i].as_py()))
                if longest:
                    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                    rows.append((i, np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), sorted(items), longest))
            if rows:
                at = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h1").take(at), batch.column("h2").take(at), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[3] for r in rows], pa.list_(pa.string())), pa.array([r[4] for r in rows], pa.int64())],
                    ["h1", "h2", "starts", "stops", "items", "longest"],
                )

        return step

    return map_rows(src, make, f"h1 bigint, h2 bigint, {_FOUND}")


def _finder(spark: SparkSession, documents: DataFrame, text_col: str, benchmark: DataFrame, window: int):
    """(documents, make): ``make()`` gives in a task a function of (batch, row,
    words) that returns the hits, items and longest match of that row.

    Up to ``AT_ONCE`` automata are broadcast and run in place.  A larger
    benchmark goes over the documents once for each ``AT_ONCE`` of its automata,
    so that neither the driver nor a worker holds more than those; the matches
    of the few documents that have any are written down by the hash of their
    text and joined to the documents.
    """
    stream = automata(benchmark, window=window)
    built = list(islice(stream, AT_ONCE))
    more = list(islice(stream, AT_ONCE))
    if not more:
        shared = [Shared(spark, a) for a in built]

        def make():
            mine = [a.value for a in shared]
            return lambda batch, i, ws: _look(mine, ws)

        return documents, make
    work = Workspace(spark, "decontamination")
    tag = f"found_{uuid.uuid4().hex}"
    text = F.col(text_col).cast("string")
    h1, h2 = F.xxhash64(text, F.lit(1)), F.xxhash64(text, F.lit(2))
    src = documents.where(text.isNotNull()).select(text.alias("text"), h1.alias("h1"), h2.alias("h2"))
    found = None
    while built:
        one = work.table(_pass(spark, src, built).dropDuplicates(["h1", "h2"]))
        found = one if found is None else found.unionByName(one)
        built, more = more, list(islice(stream, AT_ONCE))
    every = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = work.table(found.groupBy("h1", "h2").agg(every("starts"), every("stops"), every("items"), F.max("longest").alias("longest")))
    small = found.count() <= BROADCAST_ROWS
    found = found.select(F.struct("h1", "h2", "starts", "stops", "items", "longest").alias(tag))
    joined = documents.join(F.broadcast(found) if small else found, (h1 == F.col(f"{tag}.h1")) & (h2 == F.col(f"{tag}.h2")), "left")

    def make():
        def find(batch, i, ws):
            hit = np.zeros(len(ws), bool)
            r = batch.column(tag)[i].as_py()
            for a, b in zip(r["starts"], r["stops"]) if r else ():
                hit[a:b] = True
            return hit, set(r["items"]) if r else set(), r["longest"] if r else 0

        return find

    return joined, make


#: Most rows of matches that are broadcast, at about 1 kB each.
BROADCAST_ROWS = 50_000


def scan(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", clean: bool = False) -> DataFrame:
    """Contamination of every row of ``documents``, from its whole text.

    Returns ``id_col, n_words, n_hit`` (words inside an occurring window),
    ``item_ids`` (sorted array), ``longest`` (longest match in words) and with
    ``clean`` also ``clean_text``: the text without its hit spans.  A window is
    ``window`` consecutive words of an item, or a whole shorter item.

    Null and wordless texts have no words and no hits; repeated rows repeat; a
    null id stays null; extra columns are ignored; an empty benchmark hits
    nothing; an empty table gives an empty result.  Repeated items count under
    each of their ids, equal ids once.
    """
    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    src, finder = _finder(spark, src, "text", benchmark, window)

    def make():
        find = finder()

        def step(batch):
            text = batch.column("text")
            cols: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                s = text[i].as_py()
                ws = words(s)
                hit, items, longest = find(batch, i, ws)
                cols[0].append(len(ws)), cols[1].append(int(hit.sum())), cols[2].append(sorted(items)), cols[3].append(longest)
                cols[4].append(_without(s, hit) if clean and hit.any() else s if clean else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()),
                ],
                ["id", "n_words", "n_hit", "item_ids", "longest", "clean_text"],
            )

        return step

    out = map_rows(src, make, "id bigint, n_words bigint, n_hit bigint, item_ids array<string>, longest bigint, clean_text string")
    return (out if clean else out.drop("clean_text")).withColumnRenamed("id", id_col)


def _without(text: str, hit: np.ndarray) -> str:
    """``text`` without the stretches from the first to the last word of each hit run."""
    spans = [m.span() for m in WORD.finditer(text.translate(_ASCII_LOWER))]
    out, at, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            out.append(text[at : spans[i][0]])
            at, i = spans[j][1], j
        i += 1
    return "".join(out) + text[at:]


def contaminated(limit: int = 20):
    """Column: the contamination rule, some hit and at least 1/``limit`` of the words."""
    return (F.col("n_hit") > 0) & (F.lit(limit) * F.col("n_hit") >= F.col("n_words"))


def uncontaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = 13, limit: int = 20, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` within the coverage limit, with all their
    columns; texts are not shuffled while the matches fit a broadcast.

    Null and wordless texts stay; repeated rows are decided alike; null ids and
    columns of any name do not matter; an empty benchmark drops nothing; an empty
    table gives an empty result.
    """
    names, schema = documents.columns, documents.schema
    src, finder = _finder(spark, documents, text_col, benchmark, window)

    def make():
        find = finder()

        def step(batch):
            text, keep = batch.column(text_col), []
            for i in range(batch.num_rows):
                ws = words(text[i].as_py())
                n = int(find(batch, i, ws)[0].sum())
                keep.append(n == 0 or limit * n < len(ws))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(j) for j in range(len(names))], names)

        return step

    return map_rows(src, make, schema)
