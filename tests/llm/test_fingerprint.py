"""Stored fingerprints: read back as text they peel alone, subtract, and give the
likeness columns."""

import random

from pyspark.sql import functions as F

from reelspark.llm import fingerprint

M = (1 << 64) - 1


def _read(text):
    """(number of paragraphs, segments of three tables of (count, digest, check))."""
    n, rest = text.split("|")
    segs = []
    for part in rest.split(";"):
        cells = [tuple(int(x, 16) for x in c.split(":")) for c in part.split(",")]
        m = len(cells) // 3
        assert len(cells) == 3 * m and m & (m - 1) == 0
        segs.append([cells[i * m : (i + 1) * m] for i in range(3)])
    return int(n), segs




def _digests(spark, texts):
    """Digest and check of each paragraph and its place among m cells, by Spark."""
    rows = [(p,) for t in texts for p in set((t or "").split("\n")) if p]
    df = spark.createDataFrame(rows or [("",)], "p string").distinct()
    out = df.select("p", F.expr("xxhash64(p)").alias("d")).selectExpr("p", "d", "xxhash64(d, 'check') as c", *[f"xxhash64(d, {t}) as h{t}" for t in range(3)]).collect()
    return {r.d & M: (r.c & M, [r[f"h{t}"] for t in range(3)]) for r in out}


def _decode(tables, known):
    """Digests with sign that peeling recovers, and whether nothing is left."""
    t = [list(map(list, x)) for x in tables]
    m, got = len(t[0]), {}
    while True:
        pure = next(((d, n) for tab in t for n, d, c in tab if n in (1, -1) and d in known and known[d][0] == c), None)
        if pure is None:
            return got, all(n == d == c == 0 for tab in t for n, d, c in tab)
        d, n = pure
        got[d] = n
        for i in range(3):
            cell = t[i][known[d][1][i] % m]
            cell[0] -= n
            cell[1] ^= d
            cell[2] ^= known[d][0]


def _fold(tables, m):
    while len(tables[0]) > m:
        h = len(tables[0]) // 2
        tables = [[(a[0] + b[0], a[1] ^ b[1], a[2] ^ b[2]) for a, b in zip(x[:h], x[h:])] for x in tables]
    return tables


def test_stored_fingerprints_peel_and_subtract(spark):
    rng = random.Random(6)
    line = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 12)))
    texts = ["", "one", "one\ntwo", None, "\n\n"]
    texts += ["\n".join(line() for _ in range(rng.choice((3, 9, 20, 47, 60, 130, 700)))) for _ in range(25)]
    for t in texts[5:15]:  # versions with few changed lines
        ls = t.split("\n")
        ls[rng.randrange(len(ls))] = line()
        texts.append("\n".join(ls))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r.doc_id: r for r in fingerprint.fingerprints(spark, df).collect()}
    edited = {}
    for i, t in docs:
        t, n = t or "", texts[i - 1] or ""  # the next in descending order; the first for the last
        half = len(t) // 2
        edited[i] = t[: len(t) - half] + n[:half]
    known = _digests(spark, [*texts, *edited.values()])
    sets = {}
    for i, r in rows.items():
        for kind, text, stored in (("own", texts[i], r.fingerprint), ("edit", edited[i], r.edited_fingerprint)):
            n, segs = _read(stored)
            found = [_decode(s, known) for s in segs]
            assert all(clean for _, clean in found)
            sets[i, kind] = {d for got, _ in found for d in got}
            assert len(sets[i, kind]) == n == len({p for p in (text or "").split("\n") if p})
    for i, r in rows.items():
        for other, near in ((sets[i, "edit"], r.near_edited), (sets[(i - 1) % len(docs), "own"], r.near_next)):
            own = sets[i, "own"]
            assert abs(near - (len(own & other) / len(own | other) if own | other else 1.0)) < 1e-12
    subtracted = 0
    for i in range(30, 40):  # versions: subtract directly, at the smaller size
        a, b = (_read(rows[j].fingerprint)[1] for j in (i - 25, i))
        if len(a) == len(b):
            for x, y, in zip(a, b):
                m = min(len(x[0]), len(y[0]))
                diff = [[(p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2]) for p, q in zip(u, v)] for u, v in zip(_fold(x, m), _fold(y, m))]
                got, clean = _decode(diff, known)
                subtracted += clean and bool(got)
                assert not clean or all(d in sets[i - 25 if s == 1 else i, "own"] for d, s in got.items())
    assert subtracted >= 8
