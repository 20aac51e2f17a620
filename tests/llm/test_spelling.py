"""Spelling variants against a brute-force version."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import spelling
from reelspark.llm.queries import ORACLE_SQL
from reelspark.llm.runtime import mix

DOCS = "doc_id bigint, text string, word string, n bigint, key string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, times=5, drop_every=199):
    counts = Counter()
    for id_, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            if h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near_of = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in near_of.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near_of[w]), counts.get(form[w]))
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def rows_of_trouble():
    base = ["caring", "Caring", "carings", "cairng", "caringe", "cariné", "Écaring", "banana", "bananas", "ananas", "bananan", "aaaaaa", "aaaaaaa", "aaaaaab", "abcdefghij" * 300, "abcdefghij" * 300 + "x"]
    rows = [(None, None), (None, ""), (1, None), (2, "   "), (None, "caring " * 7), (3, "12 ,; 中文 ăăăăăă ×÷×÷×÷ " * 9)]
    rows += [(i % 40, " ".join(w for k, w in enumerate(base) for _ in range((i + k) % 3 * (30 if w == "caring" else 1)))) for i in range(60)]
    return rows + rows[-3:]


@pytest.mark.parametrize("drop_every", [199, 3])
def test_equals_brute_force(spark, drop_every):
    rows = rows_of_trouble()
    docs = spark.createDataFrame([(a, b, "w", 1, "k") for a, b in rows], DOCS)
    want = brute(rows, drop_every=drop_every)
    assert got(spelling.variants(spark, docs, drop_every=drop_every)) == want
    assert any(f for f, *_ in want.values())


def test_chain_of_forms_and_ties(spark):
    # one edit at a time, five times as frequent at each step; the last two tie
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(zip(words, (5, 25, 125, 625)))] + [(9, "aaaaac " * 25)]
    docs = spark.createDataFrame([(a, b, "w", 1, "k") for a, b in rows], DOCS)
    out = got(spelling.variants(spark, docs, drop_every=10**9))
    assert out == brute(rows, drop_every=10**9)
    assert out["aaaaaa"][:2] == ("aaaaab", "aaabbb")


def test_empty_table(spark):
    assert spelling.variants(spark, spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 40))
def test_neighbourhood_is_full_and_has_no_repeat(reduced, held):
    s, k = bytes(reduced), 4
    want = {s}
    for i in range(len(s) + 1):
        want |= {s[:i] + bytes([c]) + s[i:] for c in range(k)}
        if i < len(s):
            want |= {s[:i] + s[i + 1 :]} | {s[:i] + bytes([c]) + s[i + 1 :] for c in range(k)}
    before, spelling.NEIGHBOURS_HELD = spelling.NEIGHBOURS_HELD, held
    try:
        have = np.concatenate(list(spelling.neighbour_codes(s, k))).view(np.int64).tolist()
    finally:
        spelling.NEIGHBOURS_HELD = before
    empty = int(mix(np.zeros(1, np.uint64)).view(np.int64)[0])
    assert sorted(have) == sorted(spelling.code_of(w) if w else empty for w in want)


def test_pieces_cut_no_run():
    data = (b"abc def" * 50 + b"x" * 300 + b" ") * 20
    for size in (1, 10, 400):
        pieces = list(spelling._pieces(data, size))
        assert b"".join(pieces) == data
        assert [w for p in pieces for w in spelling._RUN.findall(p)] == spelling._RUN.findall(data)


def test_query_equals_sql(spark, sf):
    from reelspark.llm.queries import op11_spelling_variants

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    q = con.execute(ORACLE_SQL["op11_spelling_variants"])
    cols = [d[0] for d in q.description]
    want = {r[cols.index("word")]: tuple(r[cols.index(c)] for c in ("form", "root", "n", "n_near", "form_n")) for r in q.fetchall()}
    assert got(op11_spelling_variants(spark, sf)) == want
