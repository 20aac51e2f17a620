"""Phrase collocations, counted in a HAT-trie.

Each task counts phrases in a shallow trie of word ids whose leaves are hash
containers, arrays that a block's phrases enter together.  First words that get many
phrases burst out of the container they share with others; when the
trie is full its largest subtrees are spilled whole, as runs in phrase order.  Runs
are dealt by ranges of that order (prefix partitions) and merged there.  Longer
phrases are only counted where every pair of neighbours is frequent.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import LOWER, Workspace, _inverse_powers, _powers, mix, small_batches

#: Phrases that a task's trie holds before it spills subtrees down to half of them.
ENTRIES = 400_000
#: Phrases of a first word in the shared hash container before they burst out of it.
BURST = 2_048
#: Distinct words that a task gives ids before it spills everything and starts anew.
WORDS = 500_000
#: Bytes of text that are counted at once, and that wait in a task.
BLOCK, WAITING = 1 << 20, 8 << 20
#: Bits of the filter of frequent pairs: a fixed 8 MB whatever the corpus.  It only
#: spares work, as pairs that pass by mistake are counted and then dropped.
FILTER_BITS, PROBES = 1 << 26, 3
#: Documents, and phrases of them, that the bounds of prefix partitions are laid by;
#: the bounds decide where a phrase is summed, not what is counted.
BOUND_DOCS, BOUND_PHRASES = 2_000, 20_000

RUNS = "part int, lang string, phrase string, n bigint"
_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE[list(b"\t .,;:!?\n\x0b\x0c\r")] = True
_LOWER = LOWER.tobytes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- words -------------------------------------------------------------------


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of ``data``, and the number of
    piece breaks before it.  Within a block words count as equal if their hashes do."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.empty(0, np.uint64), start
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(n)[n - 1 :: -1][:n], out=sums[1:])
    value = (sums[end] - sums[start]) * _inverse_powers(n)[n - end]
    return start, end, mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48))), np.cumsum(_BREAK[raw])[start]


def _pair_bits(left: np.ndarray, right: np.ndarray, lang: str) -> list[np.ndarray]:
    """Places of word pairs in the filter."""
    pair = mix(left * _ODD + right + np.uint64(zlib.crc32(lang.encode())))
    return [mix(pair + np.uint64(k)) & np.uint64(FILTER_BITS - 1) for k in range(PROBES)]


def blocks(data: bytes, overlap: int) -> Iterator[tuple]:
    """``data`` in blocks of about ``BLOCK`` bytes: the block, its :func:`tokens` and
    the number of its first words that were in the block before.  A block that goes
    on within a piece begins with up to ``overlap`` of its last words."""
    at, carry, carried = 0, b"", 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        block = carry + data[at:stop]
        start, end, h, brk = found = tokens(block)
        yield block, found, carried
        at, carry, carried = stop, b"", 0
        if len(start) and overlap and not _BREAK[np.frombuffer(block, np.uint8)[end[-1] :]].any():
            carried = int((brk[-overlap:] == brk[-1]).sum())
            carry = block[start[-carried] :]


# --- trie --------------------------------------------------------------------


def _rows(heads: np.ndarray, suffixes: np.ndarray | list[tuple]) -> np.ndarray:
    """Rows of the first and the other words' ids, with -1 behind short phrases."""
    if not isinstance(suffixes, np.ndarray):
        columns = list(zip_longest(*suffixes, fillvalue=-1))
        suffixes = np.array(columns, np.int64).reshape(len(columns), len(suffixes)).T
    return np.column_stack([heads, suffixes])


class _Container:
    """An array hash: packed phrases and their counts in slots that are found by open
    addressing.  A slot is free if its first key is 0, which no phrase has."""

    def __init__(self, columns: int, room: int = 64):
        self.keys, self.counts, self.size = np.zeros((columns, room), np.int64), np.zeros(room, np.int64), 0
        self.wanted_by = np.zeros(room, np.int32)

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.counts)
        return self.keys[:, used], self.counts[used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds phrases, columns of ``keys``, with counts above 0: the places of those
        that were new."""
        n = keys.shape[1]
        if 2 * (self.size + n) > len(self.counts):
            old = self.phrases()
            self.__init__(len(keys), 1 << (2 * (self.size + n)).bit_length())
            self.add(*old)
        code = np.zeros(n, np.uint64)
        for k in keys:
            code = mix(code * _ODD + k.astype(np.uint64))
        last = len(self.counts) - 1
        slot, todo, new = (code & np.uint64(last)).astype(np.int64), np.arange(n), []
        while len(todo):
            there = self.keys[0, slot]
            same = there == keys[0, todo]
            for mine, given in zip(self.keys[1:], keys[1:]):
                at = np.flatnonzero(same)
                same[at] = mine[slot[at]] == given[todo[at]]
            free = there == 0
            at = np.flatnonzero(free)
            self.wanted_by[slot[at]] = todo[at]  # one of them gets the slot, the others look again
            at = at[self.wanted_by[slot[at]] == todo[at]]
            self.keys[:, slot[at]] = keys[:, todo[at]]
            new.append(todo[at])
            same[at] = True
            np.add.at(self.counts, slot[same], counts[todo[same]])
            on = ~same
            slot, todo = slot[on] + ~free[on] & last, todo[on]
        self.size += sum(map(len, new))
        return np.concatenate(new) if new else todo


class HatTrie:
    """Counts of phrases of up to ``longest`` word ids below 2**31.

    The root tells phrases apart by their first words.  First words of few phrases
    share a hash container; those of more than ``burst`` burst out of it into
    containers of their own.  Phrases are packed, two ids into 64 bits."""

    def __init__(self, longest: int, burst: int | None = None):
        self.longest, self.burst, self.size = longest, burst or BURST, 0
        self.columns = (longest + 1) // 2
        self.shared, self.own = _Container(self.columns), {}
        #: by first word: its number of phrases, and whether its container is its own
        self.below, self.alone = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def sizes(self) -> dict[int, int]:
        """The number of phrases of each first word."""
        heads = np.flatnonzero(self.below)
        return dict(zip(heads.tolist(), self.below[heads].tolist()))

    @property
    def root(self) -> dict[int, _Container]:
        """The container of each first word."""
        return {h: self.own.get(h, self.shared) for h in self.sizes}

    def add(self, head: int, suffixes: list[tuple], counts: list[int]) -> None:
        """Adds phrases that begin with ``head``."""
        self.insert(_rows(np.full(len(suffixes), head), suffixes), np.array(counts))

    def add_sorted(self, heads: list[int], edges: list[int], suffixes: list[tuple], counts: list[int]) -> None:
        """Adds phrases of which those from one of ``edges`` to the next begin with
        the head of that number."""
        self.insert(_rows(np.repeat(np.array(heads, np.int64), np.diff(edges)), suffixes), np.array(counts, np.int64))

    def insert(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Adds rows of word ids, -1 behind short phrases, with counts above 0."""
        if not len(phrases):
            return
        heads, ids = phrases[:, 0], np.zeros((2 * self.columns, len(phrases)), np.int64)
        ids[: phrases.shape[1]] = phrases.T + 1
        keys = ids[::2] << 32 | ids[1::2]
        if (n := int(heads.max()) + 1) > len(self.below):
            more = max(n, 2 * len(self.below)) - len(self.below)
            self.below, self.alone = np.append(self.below, np.zeros(more, np.int64)), np.append(self.alone, np.zeros(more, bool))
        alone = self.alone[heads]
        at = np.flatnonzero(~alone)
        at = at[self.shared.add(keys[:, at], counts[at])]
        self.below += np.bincount(heads[at], minlength=len(self.below))
        self.size += len(at)
        for head, some in _groups(heads, np.flatnonzero(alone)):
            new = len(self.own[head].add(keys[:, some], counts[some]))
            self.below[head] += new
            self.size += new
        large = np.unique(heads[at])
        if len(large := large[self.below[large] > self.burst]):
            keys, counts = self._taken(large)
            for head, some in _groups((keys[0] >> 32) - 1, np.arange(len(counts))):
                self.own[head] = _Container(self.columns)
                self.own[head].add(keys[:, some], counts[some])
            self.alone[large] = True

    def _taken(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of some first words, taken out of the shared container."""
        keys, counts = self.shared.phrases()
        of = np.zeros(len(self.below), bool)
        of[heads] = True
        go = of[(keys[0] >> 32) - 1]
        self.shared = _Container(self.columns)
        self.shared.add(keys[:, ~go], counts[~go])
        return keys[:, go], counts[go]

    def subtrees(self, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out whole subtrees, the largest first, until ``until`` phrases are
        left: rows of word ids, -1 behind short phrases, and their counts."""
        heads = np.flatnonzero(self.below)
        heads = heads[np.argsort(-self.below[heads], kind="stable")]
        heads = heads[: np.searchsorted(np.cumsum(self.below[heads]), self.size - until) + 1] if self.size > until else heads[:0]
        alone = self.alone[heads]
        found = [self._taken(heads[~alone])] if not alone.all() else []
        for head in heads[alone].tolist():
            found.append(self.own[head].phrases())
            self.own[head] = _Container(self.columns)
        self.size -= int(self.below[heads].sum())
        self.below[heads] = 0
        keys = np.concatenate([np.zeros((self.columns, 0), np.int64), *[k for k, _ in found]], axis=1)
        ids = np.empty((2 * self.columns, keys.shape[1]), np.int64)
        ids[::2], ids[1::2] = keys >> 32, keys & (1 << 32) - 1
        return ids.T - 1, np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])

    def spill(self, until: int) -> Iterator[tuple[int, Iterator[tuple[tuple, int]]]]:
        """:meth:`subtrees` as the first word and the (other words, count) below it."""
        phrases, counts = self.subtrees(until)
        for head, some in _groups(phrases[:, 0], np.arange(len(counts))):
            yield head, zip((tuple(i for i in row if i >= 0) for row in phrases[some, 1:].tolist()), counts[some].tolist())


def _groups(heads: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of the places ``at`` those of each first word."""
    at = at[np.argsort(heads[at], kind="stable")]
    for some in np.split(at, np.flatnonzero(np.diff(heads[at])) + 1) if len(at) else []:
        yield int(heads[some[0]]), some


# --- counting in tasks ---------------------------------------------------------


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each value of ``x``, in order of the values, and for each place the
    number of its value."""
    order = np.argsort(x)
    new = np.append(True, np.diff(x[order]) != 0)[: len(x)]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


class _Sorted:
    """A sorted Arrow array as a sequence for ``bisect``."""

    def __init__(self, array):
        self.array = array

    def __len__(self):
        return len(self.array)

    def __getitem__(self, i):
        return self.array[i].as_py()


class _Counter:
    """One task's count of phrases of the given ``lengths``."""

    def __init__(self, lengths: tuple[int, ...], parts: int, bounds: dict[str, tuple[int, list[bytes]]], pairs: np.ndarray | None):
        self.lengths, self.parts, self.bounds, self.pairs = lengths, parts, bounds, pairs
        self.trie = HatTrie(max(lengths))
        #: ids of each language's words, and their words and languages
        self.ids: dict[int, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.lang_of = array("q")
        self.langs: list[str] = []
        self.waiting: dict[str, list[bytes]] = {}
        self.n_waiting: dict[str, int] = {}
        self.n_words: dict[str, int] = {}

    def feed(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        data = text.encode().translate(_LOWER)
        self.waiting.setdefault(lang, []).append(data)
        self.n_waiting[lang] = self.n_waiting.get(lang, 0) + len(data) + 1
        if self.n_waiting[lang] >= BLOCK:
            yield from self.count(lang)
        elif sum(self.n_waiting.values()) >= WAITING:
            yield from self.count(max(self.n_waiting, key=self.n_waiting.get))

    def count(self, lang: str) -> Iterator[pa.RecordBatch]:
        """Counts what waits of ``lang``."""
        data = b"\n".join(self.waiting.pop(lang))
        del self.n_waiting[lang]
        if lang not in self.langs:
            self.langs.append(lang)
        lang_id = self.langs.index(lang)
        for block, (start, end, h, brk), carried in blocks(data, max(self.lengths) - 1):
            self.n_words[lang] = self.n_words.get(lang, 0) + len(start) - carried
            if len(start):
                self.count_block(lang_id, block, start, end, h, brk, carried)
            if len(self.words) > WORDS:
                yield from self.spilled(0)
                self.ids, self.words, self.lang_of = {}, [], array("q")
                self.trie = HatTrie(self.trie.longest)
            elif self.trie.size > ENTRIES:
                yield from self.spilled(ENTRIES // 2)

    def count_block(self, lang_id, block, start, end, h, brk, carried) -> None:
        n = len(start)
        joined = brk[:-1] == brk[1:]
        if self.pairs is not None:
            for at in _pair_bits(h[:-1], h[1:], self.langs[lang_id]):
                joined &= (self.pairs[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        # windows of each length that lie in a piece and whose pairs all pass
        whole = {1: np.ones(n, bool)}
        for m in range(2, max(self.lengths) + 1):
            whole[m] = whole[m - 1][: n - m + 1] & joined[m - 2 :] if n >= m else np.zeros(0, bool)
        used = np.zeros(n, bool)
        for i in range(m_least := min(self.lengths)):
            used[i : i + len(whole[m_least])] |= whole[m_least]
        place = np.flatnonzero(used)
        if not len(place):
            return
        first, inverse = _distinct(h[place])
        known = self.known(lang_id, [block[i:j] for i, j in zip(start[place[first]].tolist(), end[place[first]].tolist())])
        rank = np.zeros(n, np.int64)
        rank[place] = inverse
        word = np.zeros(n, np.int64)
        word[place] = known[inverse]
        level, at = rank, place
        for m in range(1, max(self.lengths) + 1):
            if m > 1:
                at = np.flatnonzero(whole[m])
                if not len(at):
                    return
                first, inverse = _distinct(level[at] << 32 | rank[at + m - 1])
                level = np.zeros(n, np.int64)
                level[at] = inverse
            if m in self.lengths:
                counts = np.bincount(inverse[at + m - 1 >= carried], minlength=len(first))
                self.insert(word[at[first][:, None] + np.arange(m)], counts)

    def known(self, lang_id: int, words: list[bytes]) -> np.ndarray:
        """Ids of different words, which are given to new ones."""
        own = self.ids.setdefault(lang_id, {})
        new = [w for w in words if w not in own]
        own.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new
        self.lang_of.extend([lang_id] * len(new))
        return np.fromiter(map(own.__getitem__, words), np.int64, len(words))

    def insert(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        some = counts > 0
        self.trie.insert(phrases[some], counts[some])

    def spilled(self, until: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the subtrees that go, one for each language."""
        rows, all_counts = self.trie.subtrees(until)
        words = pa.array(self.words, pa.binary()) if len(rows) else None
        langs = np.array(self.lang_of)[rows[:, 0]]
        for lang_id, some in _groups(langs, np.arange(len(rows))):
            lang, counts = self.langs[lang_id], all_counts[some]
            phrases, place = self.joined(words, rows[some, 0], rows[some, 1:])
            order = pc.sort_indices(phrases)
            phrases, counts = phrases.take(order), pa.array(counts[place[order]])
            base, bounds = self.bounds.get(lang, (zlib.crc32(lang.encode()), []))
            edges = [0, *(bisect_left(_Sorted(phrases), b) for b in bounds), len(phrases)]
            part = base + np.repeat(np.arange(len(bounds) + 1), np.diff(edges))
            yield self._batch(part % self.parts, lang, phrases.cast(pa.string()), counts)

    @staticmethod
    def joined(words: pa.Array, heads: np.ndarray, suffixes: np.ndarray | list[tuple]) -> tuple[pa.Array, np.ndarray]:
        """The phrases as bytes, those of one length after those of another, and their
        places in ``suffixes``."""
        rows = _rows(heads, suffixes)
        n = (rows >= 0).sum(1)
        places = [np.flatnonzero(n == m) for m in np.unique(n)]
        columns = [[rows[p, k] for k in range(n[p[0]])] for p in places]
        phrases = [pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in cols], pa.scalar(b" ", pa.binary())) for cols in columns]
        return pa.concat_arrays(phrases), np.concatenate(places)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is left, and the number of words of each language, without phrase."""
        for lang in list(self.waiting):
            yield from self.count(lang)
        yield from self.spilled(0)
        for lang, n in self.n_words.items():
            yield self._batch(np.zeros(1, np.int64), lang, pa.array([None], pa.string()), pa.array([n], pa.int64()))

    @staticmethod
    def _batch(part, lang, phrases, counts) -> pa.RecordBatch:
        lang = pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), pa.array([lang])).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), lang, phrases, counts], ["part", "lang", "phrase", "n"])


def _runs(documents: DataFrame, lengths: tuple[int, ...], parts: int, bounds: dict, pairs=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(lengths, parts, bounds, None if pairs is None else np.frombuffer(pairs.value, np.uint64))
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                if text.is_valid:
                    yield from counter.feed(lang, text.as_py())
        yield from counter.rest()

    small_batches(documents.sparkSession)
    return documents.mapInArrow(run, RUNS)


# --- counts over all documents -------------------------------------------------


def _bounds(documents: DataFrame, parts: int) -> dict[str, tuple[int, list[bytes]]]:
    """For each language its first prefix partition and the bounds between its
    partitions, from phrases of a few documents: a prefix that many phrases share
    is several partitions."""
    n = documents.count()
    some = documents.sample(min(1.0, BOUND_DOCS / n), 7) if n else documents
    rows = _runs(some, (1, 2), 1, {}).where("phrase is not null").select("lang", "phrase").orderBy(F.xxhash64("phrase")).limit(BOUND_PHRASES).collect()
    rows = sorted((r.lang, r.phrase.encode()) for r in rows)
    cuts = [rows[len(rows) * k // parts] for k in range(1, parts)] if rows else []
    out = {}
    for lang in {r[0] for r in rows}:
        out[lang] = (bisect_left(cuts, (lang, b"")), sorted({p for k, p in cuts if k == lang}))
    return out


def _merged(runs: DataFrame, least: int, work: Workspace) -> DataFrame:
    """``lang, phrase, n`` of the frequent phrases, and a row without phrase for the
    number of words of each language: runs met and summed in their partitions."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = runs.repartition(n, "part").groupBy("part", "lang", "phrase").agg(F.sum("n").alias("n"))
    return work.table(met.where(F.col("phrase").isNull() | (F.col("n") >= least)).select("lang", "phrase", "n"))


def _pair_filter(spark: SparkSession, pairs: DataFrame):
    """Broadcast filter of word pairs ``lang, phrase``: ``FILTER_BITS`` bits, put
    together from at most that many bits over 64 words of 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist()):
                by.setdefault(lang, []).append(phrase.encode())
            for lang, phrases in by.items():
                h = tokens(b"\n".join(phrases))[2]
                at = np.concatenate(_pair_bits(h[::2], h[1::2], lang))
                bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bits)], ["slot", "bits"])

    slots = pairs.select("lang", "phrase").mapInArrow(run, "slot int, bits bigint").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return spark.sparkContext.broadcast(out.tobytes())


def phrase_counts(spark: SparkSession, documents: DataFrame, work: Workspace, longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n`` of all phrases of 1 to ``longest`` words with ``n >= least``,
    and ``lang, n``: the number of words of each language.

    See :func:`collocations` for words and pieces.  The texts are read twice, for
    one and two words and for more, of which only those are counted whose pairs
    pass the filter of frequent pairs; a phrase is never more frequent than its
    pairs, so none is lost."""
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, parts)
    short = _merged(_runs(docs, (1, 2) if longest > 1 else (1,), parts, bounds), least, work)
    counts = short.where("phrase is not null")
    if longest > 2:
        pairs = counts.where(F.contains("phrase", F.lit(" ")))
        long = _merged(_runs(docs, tuple(range(3, longest + 1)), parts, bounds, _pair_filter(spark, pairs)), least, work)
        counts = counts.unionByName(long.where("phrase is not null"))
    return counts, short.where("phrase is null").select("lang", "n")


# --- scores --------------------------------------------------------------------


def collocations(spark: SparkSession, documents: DataFrame, longest: int = 4, least: int = 30, factor: int = 2_000_000, share: int = 80, top: int = 2_000) -> DataFrame:
    """Each language's ``top`` phrases by score: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (null: none) of ``documents(lang, text)`` (null language: ``und``) are
    lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at
    spaces and tabs into words.  Candidates are phrases of 2 to ``longest`` words
    that occur ``a >= least`` times within pieces.  Cut behind its first words into
    parts of counts l and r a candidate scores floor(factor * a / (l + r)); its
    lowest cut counts, of equal ones the first.  A candidate inside a longer one of
    at least ``share`` percent of its count is dropped, whether that one is dropped
    or not.  Order: score and a falling, phrase in byte order; ``n`` is the number of
    the language's words.  Repeated rows count each time; no documents give no rows;
    other columns are not read.  Products are decimals, so sums of 19 digits are exact.
    """
    work = Workspace(spark, "phrases")
    counts, totals = phrase_counts(spark, documents, work, longest, least)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    split = counts.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    known = lambda c, n: counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    scored = scored.withColumns({"num": F.lit(factor).cast("decimal(10,0)") * wide("a"), "den": wide("l") + wide("r")}).withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    covers = split.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = best.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("cover") < F.lit(share).cast("decimal(3,0)") * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
