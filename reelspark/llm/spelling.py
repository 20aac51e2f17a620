"""Spelling variants by a reduced alphabet.

Letters are hashed to a few symbols.  Two words one edit apart have reduced words
that are equal or one edit apart, so it is enough to join the full one-edit
neighbourhood of every distinct reduced word with the reduced vocabulary, and to
compare the original strings of what meets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import forest_roots
from .runtime import Workspace, map_rows, mix, small_batches

#: Number of symbols.  More symbols give more neighbours and fewer pairs to compare.
SYMBOLS = 6
#: Letters from frequent to rare in western European text; dealt to the symbols to
#: and fro, so that these are about equally frequent.
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
#: Distinct words that a task counts before it hands the counts on.
WORDS_HELD = 200_000
#: Neighbours made at once in a task.
NEIGHBOURS_HELD = 1 << 18

_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf]){6,}")
_SHORT = re.compile(rb"[^A-Za-z\x80-\xff]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def symbol_table(symbols: int) -> np.ndarray:
    """Symbol of each code point up to U+00FF; others go by their remainder."""
    table = np.arange(256) % symbols
    for i, c in enumerate(BY_FREQUENCY):
        j = i % (2 * symbols)
        table[ord(c)] = j if j < symbols else 2 * symbols - 1 - j
    return table


def reduce_word(word: str, table: np.ndarray, symbols: int) -> bytes:
    """The word in the reduced alphabet, a byte for each code point."""
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return np.where(cp < 256, table[np.minimum(cp, 255)], cp % symbols).astype(np.uint8).tobytes()


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def code_of(reduced: bytes) -> int:
    """64-bit code of a reduced word: a sum of symbols times powers, mixed."""
    s = np.frombuffer(reduced, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(mix(np.array([(s * _powers(len(s) + 1)[:-1]).sum()], np.uint64)).view(np.int64)[0])


def neighbour_codes(reduced: bytes, symbols: int):
    """Yields arrays of the codes of the word itself and of every word one deletion,
    replacement or insertion away from it, each once.

    Codes follow from prefix sums, and repeats are left out by rule (a deletion
    from a run of equal symbols counts at its first, an insertion before an equal
    symbol counts behind it), so blocks of positions need constant memory."""
    s = np.frombuffer(reduced, np.uint8).astype(np.uint64)
    n = len(s)
    p = _powers(n + 1)
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((s + np.uint64(1)) * p[:-1], out=upto[1:])
    whole = upto[n]
    yield mix(np.array([whole], np.uint64))
    block = max(1, NEIGHBOURS_HELD // (2 * symbols))
    every = np.arange(symbols, dtype=np.uint64)
    for a in range(0, n + 1, block):
        i = np.arange(a, min(a + block, n))
        first = np.ones(len(i), bool)
        first[i > 0] = s[i[i > 0]] != s[i[i > 0] - 1]
        d = i[first]
        yield mix(upto[d] + (whole - upto[d + 1]) * back)
        changed = whole + (every[None, :] - s[i][:, None]) * p[i][:, None]
        yield mix(changed[every[None, :] != s[i][:, None]])
        j = np.arange(a, min(a + block, n + 1))
        added = (upto[j] + (whole - upto[j]) * np.uint64(_BASE))[:, None] + (every[None, :] + np.uint64(1)) * p[j][:, None]
        after = np.full(len(j), symbols, np.uint64)
        after[j < n] = s[j[j < n]]
        yield mix(added[every[None, :] != after[:, None]])


def _pieces(data: bytes, size: int = 1 << 20):
    """``data`` in pieces that no run crosses."""
    at = 0
    while len(data) - at > size:
        end = _SHORT.search(data, at + size)
        if not end:
            break
        yield data[at : end.end()]
        at = end.end()
    yield data[at:]


def count_words(documents: DataFrame, drop_every: int = 199, shortest: int = 6) -> DataFrame:
    """``word, n`` over all whole texts of ``documents(doc_id, text)``.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased.  Where
    ``drop_every`` divides h, the unsigned CRC-32 of ``<doc_id>:<word>`` (a null id
    is empty), code point h modulo the length is deleted; 0 deletes none.  Results
    shorter than ``shortest`` (at least 6) are left out.  Null and empty texts have
    no words; repeated rows count each time.  A task holds a bounded number of
    words, so a word may come to the shuffle several times.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for b in batches:
            for id_, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                seen: Counter = Counter()
                for piece in _pieces((text.as_py() or "").encode().translate(_LOWER)):
                    seen.update(_RUN.findall(piece))
                for word, n in seen.items():
                    h = zlib.crc32(word, start)
                    if drop_every and h % drop_every == 0:
                        w = word.decode()
                        at = h % len(w)
                        word = (w[:at] + w[at + 1 :]).encode()
                    if len(word) >= 2 * shortest or len(word.decode()) >= shortest:
                        held[word] += n
                if len(held) >= WORDS_HELD:
                    yield out()
        if held:
            yield out()

    small_batches(documents.sparkSession)
    counted = documents.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(vocabulary: DataFrame, work: Workspace, symbols: int = SYMBOLS) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words of ``vocabulary(word, n)``
    that differ by exactly one inserted, deleted or replaced code point.

    The vocabulary has each word once.  No pair is lost: an edit of the words is
    an edit of the reduced words or leaves them equal.  Equal codes of different
    reduced words only add pairs to compare.
    """
    table = symbol_table(symbols)

    def reduced():
        def step(b):
            r = [reduce_word(w, table, symbols) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(r, pa.binary()), pa.array([code_of(x) for x in r], pa.int64())], ["word", "n", "reduced", "code"])

        return step

    def around():
        def step(b):
            codes, near, held = [], [], 0
            for code, r in zip(b.column("code").to_pylist(), b.column("reduced").to_pylist()):
                for part in neighbour_codes(r, symbols):
                    codes.append(np.full(len(part), code, np.int64))
                    near.append(part.view(np.int64))
                    held += len(part)
                    if held >= NEIGHBOURS_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(near))], ["code", "key"])
                        codes, near, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(near))], ["code", "key"])

        return step

    words = work.table(map_rows(vocabulary.select("word", "n"), reduced, "word string, n bigint, reduced binary, code bigint"))
    distinct = work.table(words.select("code", "reduced").distinct())
    known = distinct.select(F.col("code").alias("key")).distinct()
    met = map_rows(distinct, around, "code bigint, key bigint").join(known.hint("shuffle_hash"), "key")
    links = work.table(met.distinct())
    one = words.select("code", "word").join(links, "code").select("word", F.col("key").alias("code"))
    both = one.join(words.select("code", F.col("word").alias("near"), F.col("n").alias("near_n")), "code")
    return both.where("word <> near and abs(length(word) - length(near)) <= 1").where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def variants(spark: SparkSession, documents: DataFrame, least: int = 5, times: int = 5, shortest: int = 6, drop_every: int = 199, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word with ``n >= least``.

    ``form`` is the near word of largest ``n`` (of equal ones the first in code-point
    order) if that is at least ``times`` times the word's own, else null; ``root``
    follows forms to the last.  Counts rise along forms, so these are forests, whose
    depth is at most the logarithm of the largest count.  See :func:`count_words` for
    nulls, empty texts and repeated rows; no documents give no rows.  Other columns
    of ``documents`` are not read.
    """
    work = Workspace(spark, "spelling")
    words = work.table(count_words(documents, drop_every, shortest).where(F.col("n") >= least))
    pairs = near_pairs(words, work, symbols)
    best = F.min(F.struct((-F.col("near_n")).alias("below"), F.col("near").alias("near")))
    near = work.table(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")))
    seen = words.join(near, "word", "left").withColumn("chosen", -F.col("best.below") >= F.col("n") * times)
    formed = work.table(seen.select("word", F.when(F.col("chosen"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("chosen"), -F.col("best.below")).alias("form_n")))
    roots = forest_roots(formed.where("form is not null").select(F.col("word").alias("u"), F.col("form").alias("v")), work)
    out = formed.join(roots.select(F.col("node").alias("word"), "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
