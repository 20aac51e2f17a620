"""Phrase collocations against a brute-force version; the trie, its bursts and
spills; blocks of long texts."""

import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import collocation
from reelspark.llm.queries import ORACLE_SQL, op13_phrase_collocations

DOCS = "doc_id bigint, text string, lang string, phrase string, n bigint, part int"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def brute(rows, longest=4, least=30, factor=2_000_000, share=80, top=2_000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i : i + m]] = max(cover[p[i : i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * cover[p] >= share * a:
                continue
            score, k = min((factor * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        for rank, (score, a, p, left, right) in enumerate(rows_[:top], 1):
            out[lang, rank] = (p, a, left, right, n[lang], score)
    return out


def got(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def trouble():
    rng = random.Random(5)
    words = ["the", "The", "of", "a\x01", "a", "é", "Éa", "new", "york", "city", "中", "x.y", " ", "a-b", "\x1f"]
    rows = [(None, "en"), ("", "en"), ("  \t ", None), ("...", "de"), ("solo", "fr")]
    for i in range(200):
        w = rng.choices(words, [9, 3, 9, 2, 2, 2, 1, 4, 4, 4, 1, 1, 1, 1, 1], k=rng.randint(1, 60))
        w = [x + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for x in w]
        rows.append(("".join(w), rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += rows[-9:] + [("new york city hall " * 800, "en"), ("new york city hall " * 40, "en")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, t, k, "p", 1, 0) for i, (t, k) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("limits", [{}, {"ENTRIES": 40, "BURST": 3, "BLOCK": 50, "WAITING": 200}, {"WORDS": 5, "BURST": 2, "BLOCK": 900}, {"FILTER_BITS": 64}, {"BOUND_PHRASES": 3}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(collocation, k, v)
    rows = trouble()
    want = brute(rows, least=8)
    assert got(collocation.collocations(spark, frame(spark, rows), least=8)) == want
    assert len(want) > 60


@pytest.mark.parametrize("longest,top", [(2, 5), (3, 2_000)])
def test_other_parameters(spark, longest, top):
    rows = trouble()
    assert got(collocation.collocations(spark, frame(spark, rows), longest=longest, least=8, top=top, share=50)) == brute(rows, longest, 8, top=top, share=50)


def test_empty_table(spark):
    assert collocation.collocations(spark, frame(spark, [])).collect() == []
    assert collocation.collocations(spark, frame(spark, [(None, "en"), ("", None), ("once", "en")])).collect() == []


def test_products_past_64_bits(spark, monkeypatch):
    """Counts of 10**15 in place of the counted ones."""
    big = 10**15 + 7
    counts = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", big + 1), ("en", "a b", big)], "lang string, phrase string, n bigint")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n bigint")
    monkeypatch.setattr(collocation, "phrase_counts", lambda *a: (counts, totals))
    (r,) = collocation.collocations(spark, frame(spark, [])).collect()
    assert (r.phrase, r.score, r.n) == ("a b", 2_000_000 * big // (4 * big + 1), 9 * big)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=4), st.integers(1, 3)), max_size=150), st.integers(1, 5), st.integers(1, 30))
def test_trie_counts_and_spills_whole_subtrees(phrases, burst, limit):
    trie, want, have = collocation.HatTrie(4, burst), Counter(), Counter()

    def spill(until):
        for head, below in trie.spill(until):
            assert head not in trie.root
            for s, n in below:
                have[head, *s] += n

    for p, n in phrases:
        want[tuple(p)] += n
        trie.add(p[0], [tuple(p[1:])], [n])
        if trie.size > limit:
            spill(limit // 2)
            assert trie.size <= limit // 2
    spill(0)
    assert have == want and trie.size == 0 and not trie.root and not trie.sizes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 4)), st.integers(1, 3)), max_size=6), st.integers(1, 5))
def test_sorted_phrases_are_added_head_by_head(blocks, burst):
    one, all_ = collocation.HatTrie(3, burst), collocation.HatTrie(3, burst)
    for block in blocks:
        phrases = sorted(block)
        heads = sorted({p[0] for p in phrases})
        edges = [0, *np.cumsum([sum(p[0] == h for p in phrases) for h in heads]).tolist()]
        all_.add_sorted(heads, edges, [p[1:] for p in phrases], [block[p] for p in phrases])
        for p in phrases:
            one.add(p[0], [p[1:]], [block[p]])
    assert all_.size == one.size and all_.sizes == one.sizes
    assert {h: sorted(b) for h, b in all_.spill(0)} == {h: sorted(b) for h, b in one.spill(0)} and all_.size == 0


def test_heads_of_one_phrase_are_added_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(collocation.HatTrie, "add", lambda *a: calls.append(a))
    counter = collocation._Counter((1,), 4, {}, None)
    for _ in range(2):
        list(counter.feed("en", "one two three two"))
        list(counter.count("en"))
    (run, total) = counter.rest()
    assert not calls and total.column("n").to_pylist() == [8]
    assert dict(zip(run.column("phrase").to_pylist(), run.column("n").to_pylist())) == {"one": 2, "three": 2, "two": 4}


def test_phrases_are_counted_and_spilled_by_columns():
    """Each block's phrases go into the trie and out of it in a few calls, however many."""
    rng, calls = random.Random(3), Counter()
    text = " ".join(f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(60_000))
    counter = collocation._Counter((1, 2), 4, {}, None)
    list(counter.feed("en", "what is imported at first use"))
    list(counter.rest())
    list(counter.feed("en", text))
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        list(counter.count("en"))
        (run,) = counter.spilled(0)
    finally:
        sys.setprofile(None)
    assert run.num_rows > 9_000
    assert calls["call"] + calls["c_call"] < run.num_rows / 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 90), st.integers(-1, 3), st.integers(1, 3)), max_size=120), max_size=6), st.integers(1, 2))
def test_array_hash_counts_phrases_that_share_slots(batches, columns):
    container, want = collocation._Container(columns), Counter()
    for batch in batches:
        keys = np.array([[(a + 1) << 32 | b + 1 for a, b, _ in batch], [b + 1 for _, b, _ in batch]], np.int64)[:columns]
        before = set(want)
        new = container.add(keys, np.array([n for *_, n in batch], np.int64))
        for (a, b, n) in batch:
            want[a, b] += n
        assert sorted(batch[i][:2] for i in new.tolist()) == sorted(set(want) - before)
    keys, counts = container.phrases()
    assert {((k >> 32) - 1, (k & 0xFFFFFFFF) - 1): n for k, n in zip(keys[0].tolist(), counts.tolist())} == want
    assert container.size == len(want) == len(counts)


def test_words_of_two_languages_are_told_apart():
    counter = collocation._Counter((1, 2), 4, {}, None)
    for lang in ("en", "de"):
        list(counter.feed(lang, "in in der" if lang == "de" else "in the in the"))
    got = {(r["lang"], r["phrase"]): r["n"] for b in counter.rest() for r in b.to_pylist()}
    assert got == {("en", None): 4, ("en", "in"): 2, ("en", "the"): 2, ("en", "in the"): 2, ("en", "the in"): 1, ("de", None): 3, ("de", "in"): 2, ("de", "der"): 1, ("de", "in in"): 1, ("de", "in der"): 1}


def test_spilled_phrases_are_joined_by_columns():
    words = ["é".encode(), b"b", b"\x01", b"aa"]
    suffixes = [(), (1, 2), (3,), (), (0, 0), (2,)]
    phrases, place = collocation._Counter.joined(pa.array(words, pa.binary()), np.array([3, 0, 1, 0, 2, 0]), suffixes)
    want = [b" ".join(words[i] for i in (h, *s)) for h, s in zip([3, 0, 1, 0, 2, 0], suffixes)]
    assert phrases.to_pylist() == [want[i] for i in place] and sorted(place) == list(range(6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", " ", " ", ".", "\t", "é"]), max_size=60), st.integers(1, 30), st.integers(0, 3))
def test_blocks_lose_and_repeat_no_window(parts, size, overlap):
    data = "".join(parts).encode()
    before, collocation.BLOCK = collocation.BLOCK, size
    try:
        seen = Counter()
        for block, (start, end, _, brk), carried in collocation.blocks(data, overlap):
            w = [block[a:b] for a, b in zip(start, end)]
            for m in range(1, overlap + 2):
                seen.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1) if brk[i] == brk[i + m - 1] and i + m - 1 >= carried)
    finally:
        collocation.BLOCK = before
    want = Counter()
    for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", data):
        w = re.findall(rb"[^ \t]+", piece)
        for m in range(1, overlap + 2):
            want.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    assert seen == want


def test_tokens_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"abc", b"cab", "é".encode(), b"a" * 5000, b"a" * 5001]
    h = collocation.tokens(b" ".join(words * 2))[2]
    assert len(np.unique(h)) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {(r[0], r[1]): r[2:] for r in con.execute(ORACLE_SQL["op13_phrase_collocations"]).fetchall()}
    assert got(op13_phrase_collocations(spark, sf)) == want
