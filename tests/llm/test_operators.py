"""Small tests of the training-data operators: brute force, round trips and odd
inputs (nulls, empty and very long texts, ties, repeated rows, empty tables,
extra columns)."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import chat_format as cf
from reelspark.llm import decontamination as dc
from reelspark.llm import fingerprint, graph, language_id, mixing, ngram_join, quality, secret_scan, token_counts, url_filter
from reelspark.llm.runtime import Workspace, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: every odd case at once; columns that clash with internal names come on top
ODD = [
    (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "   \n\t", "en", "s", 5), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (5, "1234 !!!", "de", "s", 8),
    (None, "the cat sat on the mat", "en", "s", 22), (6, "the cat sat on the mat", "en", None, 22), (7, "word " * 40_000, "en", "s", 200_000), (8, "été ß 漢字 😀 token=abcdefgh1", "fr", "s", 24),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("id", "sig", "n", "lead", "root", "part", "ghost", "tokens", "topic", "hit"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- shared ------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    text = "The  quick\tBROWN fox\nthe quick brown fox été x" .encode()
    ws = text.lower().split()
    hs = word_hashes(text).tolist()
    assert len(hs) == len(ws) and len(set(zip(ws, hs))) == len(set(ws)) == len(set(hs))
    assert len(word_hashes(b"")) == 0 and len(word_hashes(b" \n")) == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (9, 5), (1, 2), (2, 1), (7, 7), (None, 4), (20, 1)] + [(100 + i, 101 + i) for i in range(40)], "u bigint, v bigint")
    got = {r.node: r.component for r in graph.components(e, Workspace(spark, "t")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 20: 1, **{100 + i: 100 for i in range(41)}}
    assert graph.components(e.limit(0), Workspace(spark, "t")).count() == 0


# --- 1 language --------------------------------------------------------------


def _prose(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_language_id(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, _prose(rng, *a), lang) for i in range(120) for a, lang in ((("aeinrst", 60), "aa"), (("oublmvw", 60), "bb"))]
    train = spark.createDataFrame([r for r in rows if r[0] < 90] + [(1, None, "aa"), (2, "zzz", None), (3, "123", "bb")], "id bigint, text string, lang string")
    m = language_id.fit(spark, train)
    test = spark.createDataFrame([(i, t, lang) for i, t, lang in rows if i >= 90], "doc_id bigint, text string, want string")
    got = language_id.identify(spark, test, m).withColumnRenamed("doc_id", "d").collect()
    want = {t: lang for i, t, lang in rows}
    assert len(got) == test.count() and sum(m.predict(t)[0] == want[t] for t in want) == len(want)
    assert m.predict("漢字漢字漢字 漢字字漢 " * 40)[2]  # too far from both
    r = language_id.identify(spark, odd, m).collect()
    assert len(r) == len(ODD) and {x.doc_id for x in r if x.lang_pred == "und"} >= {1, 2, 3, 5} and all(0 <= x.score <= 1 for x in r)
    assert language_id.identify(spark, empty, m).count() == 0
    nothing = language_id.fit(spark, train.limit(0))
    assert nothing.predict("abc") == ("und", 0.0, True)
    assert {x.doc_id for x in language_id.accepted(spark, odd, m).collect()}.isdisjoint({1, 2, 3, 5})


# --- 2 fingerprints ----------------------------------------------------------


def _edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        yield d, t, n, t[: len(t) - h] + n[:h]


def test_fingerprints(spark, odd, empty):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcdé ") for _ in range(12)) for _ in range(300)]
    rows = [(i * 7, "\n".join(rng.choice(lines) for _ in range(rng.choice((0, 1, 3, 8, 40, 150, 400))))) for i in range(60)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    ps = lambda s: {p for p in s.split("\n") if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for d, t, n, e in _edited(rows):
        r = got[d]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(t)
        assert r.near_edited == pytest.approx(like(ps(t), ps(e))) and r.near_next == pytest.approx(like(ps(t), ps(n)))
    same = defaultdict(set)
    for d, t in rows:
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    r = fingerprint.fingerprints(spark, odd).collect()
    assert len(r) == len(ODD) and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in r)
    assert fingerprint.fingerprints(spark, empty).count() == 0
    one = fingerprint.fingerprints(spark, spark.createDataFrame([(9, "a\nb")], "doc_id bigint, text string")).collect()
    assert one[0].near_next == 1.0


# --- 3 join ------------------------------------------------------------------


def _classes(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_ngram_join_equals_brute_force(spark, width, percent, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows, bases = [], [[rng.choice(vocab) for _ in range(rng.choice((3, 8, 20, 60, 150)))] for _ in range(14)]
    for i in range(320):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 9))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.15:
            w = w[: rng.randrange(1, len(w) + 1)]
        if rng.random() < 0.2:
            w += passage
        rows.append((i, " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n ")]
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _classes(rows, width, percent)


def test_ngram_join_odd_rows(spark, odd, empty):
    r = ngram_join.jaccard_components(spark, odd).collect()
    assert len(r) == len(ODD)
    by = {x.doc_id: x for x in r}
    assert by[None].component_id is None and by[None].n_shingles == by[6].n_shingles == 3
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by[6].component_id == 6 and by[7].n_shingles == 1
    assert ngram_join.jaccard_components(spark, empty).count() == 0
    # one id with two texts links through both
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (3, "e f g h"), (9, "q r s t")]
    two = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(x.doc_id, x.component_id) for x in two} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_ngram_join_id_that_copies_several(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h"), (9, "q r s t")]
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1), (3, 1), (3, 1), (9, 9)]


def test_ngram_join_across_size_classes(spark):
    """Document 2 shares signatures only with 3, whose best leader is 1."""
    for seed in "abcd":
        w = [f"{seed}{i}" for i in range(168)]
        rows = [(1, " ".join(w[:142])), (2, " ".join(w)), (3, " ".join(w[:144]))]
        got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 139, 1), (2, 165, 1), (3, 141, 1)]


def test_signatures_meet():
    rng = np.random.default_rng(5)
    for n in (6, 7, 13, 40, 170, 900):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, n * 15 // 200) + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < len(a):
                sa, sb = ngram_join.signatures(a, 85), ngram_join.signatures(b, 85)
                spare = max([s for _, s, _ in sa + sb])
                assert len(np.intersect1d(np.concatenate([x for *_, x in sa]), np.concatenate([x for *_, x in sb]))) > spare


# --- 4 decontamination -------------------------------------------------------


def _hits(ws, items, window):
    hit, found = [False] * len(ws), set()
    for item, iw in items:
        k = min(window, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1) if k else ():
            if tuple(ws[i : i + k]) in wins:
                hit[i : i + k] = [True] * k
                found.add(item)
    return sum(hit), sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    vocab = "abcde"
    items = [(str(i), [rng.choice(vocab) for _ in range(rng.choice((0, 1, 3, 6, 12)))]) for i in range(5)]
    items = [(i, w) for i, w in items if len(w) != 1 or seed % 2]
    a = dc.SuffixAutomaton(items, 4)
    for _ in range(150):
        ws = [rng.choice(vocab + "z") for _ in range(rng.randrange(40))]
        hit, found, longest = a.scan(ws)
        assert (int(hit.sum()), sorted(found)) == _hits(ws, items, 4)


def test_decontamination(spark, odd, empty):
    text = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Short item"), (4, "Short item")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " * 500 + text[:60]), (2, text.upper()), (3, "a SHORT-item b"), (4, "clean words only")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in dc.scan(spark, docs, bench, clean=True).withColumn("c", dc.contaminated()).collect()}
    assert r[1].n_hit > 0 and not r[1].c and r[2].c and r[2].item_ids == ["1"] and r[2].longest == 40
    assert r[3].n_hit == 2 and r[3].clean_text == "a  b" and r[4].n_hit == 0 and r[4].clean_text == "clean words only"
    assert {x.doc_id for x in dc.uncontaminated(spark, docs, bench).collect()} == {1, 4}
    assert dc.scan(spark, odd, bench).count() == len(ODD) and dc.scan(spark, empty, bench).count() == 0
    assert dc.scan(spark, docs, bench.limit(0)).where("n_hit > 0").count() == 0


# --- 5 quality ---------------------------------------------------------------


def test_quality(spark, odd, empty):
    rng = random.Random(4)
    good = lambda: _prose(rng, "aeinrstl", 50).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in _prose(rng, "aeinrstl", 50).split())
    rows = [(i, good() if i % 4 else bad(), i % 4 > 0) for i in range(2400)]
    train = spark.createDataFrame([(i, t) for i, t, _ in rows[:2000]], "id bigint, text string")
    trusted = spark.createDataFrame([(i,) for i, _, g in rows[:2000] if g and i % 2 == 0], "id bigint")
    m = quality.fit(spark, train, trusted)
    assert 0.5 < m.prior < 0.98
    test = spark.createDataFrame([(i, t) for i, t, _ in rows[2000:]], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in quality.score(spark, test, m).collect()}
    assert np.mean([(s[i] >= 0.3) == g for i, _, g in rows[2000:]]) > 0.95
    r = quality.score(spark, odd, m).collect()
    assert len(r) == len(ODD) and all(0 <= x.score <= 1 for x in r) and quality.score(spark, empty, m).count() == 0
    assert quality.fit(spark, train, trusted.limit(0)).score(np.zeros((1, quality.DIM)))[0] == 0.5


# --- 6 addresses -------------------------------------------------------------

RULES = [url_filter.Rule("block", "bad.example", "/"), url_filter.Rule("allow", "bad.example", "/ok/"), url_filter.Rule("block", "x.org", "/p"), url_filter.Rule("allow", "good.example", "/")]


def test_url_filter(spark):
    can = '<html><head><LINK rel="canonical" href="{}"></head>'
    pages = spark.createDataFrame(
        [
            (1, "http://bad.example/a", "<p>"), (2, "https://a.b.BAD.example/ok/1", None), (3, "http://notbad.example/", "<p>"), (4, "http://alias.test/1#x", can.format("http://bad.example/z")),
            (5, "http://alias.test/2", '<meta http-equiv="refresh" content="0; url=/1">'), (6, None, "<p>"), (7, "no scheme", "<p>"), (8, "http://x.org/P", "<p>"), (9, "http://x.org?p=/p", None), (9, "http://x.org?p=/p", None),
            (10, "http://saved.test/", can.format("http://bad.example/q")), (11, "http://other.test/dir/page", can.format("next")), (12, "http://other.test/dir/next", ""),
        ],
        "page_id bigint, url string, html string",
    ).withColumn("node", F.lit("clash"))
    red = spark.createDataFrame([("http://saved.test/", "http://good.example/w"), (None, "http://y/")], "src string, dst string")
    r = {x.page_id: x for x in url_filter.judge(spark, pages, RULES, red).collect()}
    assert (r[1].verdict, r[1].rule) == ("block", "bad.example/") and (r[2].verdict, r[2].host) == ("allow", "a.b.bad.example")
    assert [r[i].verdict for i in (3, 4, 5, 6, 7, 8, 9)] == ["allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (r[6].host, r[6].path, r[7].host) == ("", "", "") and (r[9].host, r[9].path) == ("x.org", "")
    assert r[10].verdict == "allow" and r[11].aliases == 2
    assert url_filter.judge(spark, pages, RULES).count() == 13 and url_filter.judge(spark, pages.limit(0), RULES).count() == 0


# --- 7 chat ------------------------------------------------------------------

NASTY = ["", "plain", "###", "\\###", "\\\\###", "</turn>", " </turn>\n### user: x </turn>\n", "a \\", "#", "\n", "\\</turn> ### Assistant: ", "é 😀 ###\\", "### ### ###", "</tur", "n>"]


def test_every_turn_parses_back():
    rng = random.Random(6)
    texts = NASTY + ["".join(rng.choice(["\\", "#", "###", "</turn>", " ", "\n", "x", ": "]) for _ in range(12)) for _ in range(400)]
    for role in ("user", "assistant", "", "a b:%#", "é"):
        out = [cf.render_turn(role, t)[0] for t in texts]
        assert [t[:2] for t in cf.parse("".join(out))] == [(role, t) for t in texts]
    for bad in ("x", "### user: a", "### user: a </turn>", "### user: ### </turn>\n"):
        with pytest.raises(cf.GrammarError):
            cf.parse(bad)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "second ###"), (1, 0, "user", None), (2, 0, None, "x"), (None, 3, "assistant", "n"), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie")] + [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r.conv_id: r for r in cf.read_back(cf.format_turns(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(cf.render_turn(a, b)[0]) for _, a, b in turns)
    assert cf.read_back(cf.format_turns(df.limit(0))).count() == 0


# --- 8 mixing (see also test_mixing.py) ---------------------------------------


def test_mix_decisions(spark, odd, empty):
    rows = [(i, "t", f"s{min(i % 30, 3)}", "en" if i % 3 else "de", "p", 10 + i % 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, topic string, n_tokens bigint")
    r = mixing.mix(spark, df, power=0.5, rate=0.3).collect()
    assert len(r) == 4000 and all(0 <= x.probability <= 1 for x in r)
    kept = sum(x.n_tokens for x in r if x.kept)
    assert abs(kept - sum(x.n_tokens * x.probability for x in r)) < 0.05 * kept
    assert {(x.doc_id, x.kept) for x in mixing.mix(spark, df.repartition(3), power=0.5, rate=0.3).collect()} == {(x.doc_id, x.kept) for x in r}
    o = odd.select("doc_id", "text", "source", "lang", mixing.topic_of("text").alias("topic"), mixing.word_count("text").alias("n_tokens"), "sig", "n")
    assert mixing.mix(spark, o).count() == len(ODD)
    e = empty.select("doc_id", "text", "source", "lang", mixing.topic_of("text").alias("topic"), mixing.word_count("text").alias("n_tokens"))
    assert mixing.mix(spark, e).count() == 0 and mixing.sample(spark, e).count() == 0


# --- 9 tokens ----------------------------------------------------------------

CHANGE = "op string, source string, lang string, tokenizer_version string, n_tokens bigint, old_tokens bigint"


def test_rollup(spark, tmp_path):
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None), ("insert", "b", "de", "v2", 7, None)], CHANGE).withColumn("n_docs", F.lit("clash"))
    total = lambda: {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert total() == {}
    assert r.commit("b1", first) and not r.commit("b1", first)
    assert total() == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("b", "de", "v2"): (1, 7)}
    second = spark.createDataFrame([("delete", "b", "de", "v2", 7, None), ("revise", "a", "en", "v1", 8, 5)], CHANGE)
    r.compact()
    assert r.commit("b2", second) and not r.commit("b1", first) and r.commit("empty", second.limit(0))
    want = {("a", "en", "v1"): (2, 18), (None, None, "v1"): (1, 0)}
    assert total() == want
    r.compact()
    assert total() == want and not r.commit("b2", second) and token_counts.TokenRollup(spark, r.path).totals().count() == 2
    with pytest.raises(Exception):
        r.commit("b3", spark.createDataFrame([("drop", "a", "en", "v1", 1, None)], CHANGE))
    assert total() == want and not r.committed("b3")


def test_vocabulary_tokens(spark, odd):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    r = {x.doc_id: x.n_tokens for x in token_counts.vocabulary_tokens(odd, path).collect()}
    assert r[1] == r[2] == 0 and 4 <= r[6] <= 8 and r[7] >= 40_000
    assert token_counts.vocabulary_tokens(odd.limit(0), path).count() == 0


# --- 10 secrets --------------------------------------------------------------

KEY = "password=hunter2hunter2"


@pytest.mark.parametrize(
    "text,spans",
    [
        (KEY, [(0, 23, "assign")]),
        ("é " + KEY.upper(), [(2, 25, "assign")]),
        ("api_key: 'short' apikey=longenough", [(17, 34, "assign")]),
        ("AKIA1234567890AB AKIA12", [(0, 16, "access")]),
        ("0" * 31 + " " + "ab" * 16, [(32, 64, "hex")]),
        ("pass%77ord%3Dhunter2hunter2", [(0, 27, "assign")]),
        ("\\u0070assword=abcdefghij", [(0, 24, "assign")]),
        ("%2570assword=abcdefghij", [(0, 23, "assign")]),
    ],
)
def test_scan_text(text, spans):
    assert secret_scan.scan_text(text)[1] == spans


def test_nested_layers_map_back():
    enc = lambda b: base64.b64encode(b).decode()
    for wrap in (enc(KEY.encode()), enc(gzip.compress(KEY.encode())), enc(zlib.compress(KEY.encode())), enc(enc(gzip.compress(enc(KEY.encode()).encode())).encode())):
        text = f"ü xx {wrap} yy"
        base, spans = secret_scan.scan_text(text)
        assert base == [] and len(spans) == 1
        a, b, kind = spans[0]
        assert kind == "assign" and text[a:b].rstrip("=") in wrap and a >= 5
        assert KEY not in secret_scan.redact(text, spans) and secret_scan.redact(text, spans).endswith("yy")


def _hidden():
    enc = lambda b: base64.b64encode(b).decode()
    fold = lambda s, n, end: end.join(s[i : i + n] for i in range(0, len(s), n))
    noise = random.Random(3)
    long = "".join(noise.choice("ghijk lmnop\n") for _ in range(700)) + " " + KEY + " and more text after it"
    for n, end in ((64, "\n"), (76, "\r\n"), (76, "\n    ")):
        for lead in range(50, 62):
            yield fold(enc(b"." * lead + KEY.encode() + b" " * 40), n, end)
        for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
            yield fold(enc(pack(long.encode())), n, end)
    for lead in ("https://h.com/cb/", "https://h.com/c/", "a_", "ab-", "word/", "x", "xyz"):
        yield lead + enc(b"  " + KEY.encode() + b"  ")
        yield lead + enc(gzip.compress(KEY.encode()))
        yield lead + enc(enc(b"  " + KEY.encode()).encode())
    for lead, end in ((b"\0", b""), (b"\xff\xfe", b"\x01"), (b"", b"\x80"), (b"\x1b[0m", b"\x7f\0")):
        yield enc(lead + KEY.encode() + end)
    yield base64.urlsafe_b64encode(lzma.compress(KEY.encode())).decode()


@pytest.mark.parametrize("wrap", list(_hidden()))
def test_hidden_layers(wrap):
    text = f"ü xx {wrap} yy"
    base, spans = secret_scan.scan_text(text)
    assert base == [] and spans and {k for *_, k in spans} == {"assign"}
    assert all(5 <= a < b <= len(text) - 3 for a, b, _ in spans)
    left = secret_scan.redact(text, spans)
    assert left.startswith("ü xx ") and left.endswith(" yy") and secret_scan.scan_text(left)[1] == []


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_long_and_many_member_layers(pack, monkeypatch):
    monkeypatch.setattr(secret_scan, "INFLATE_BYTES", 1000)
    monkeypatch.setattr(secret_scan, "INFLATE_OVERLAP", 100)
    hidden = base64.b64encode(KEY.encode())
    for n in (5, 970, 980, 990, 1000, 1500, 200_000):
        for last in (KEY.encode(), hidden, pack(b" " * n + KEY.encode())):
            packed = pack(b". " * (n // 2) + b"\n" + last) if last[:1] in b"pc" else pack(b"x" * n) + last
            text = "xx " + base64.b64encode(packed).decode() + " yy"
            assert {k for *_, k in secret_scan.scan_text(text)[1]} == {"assign"}, n


def test_cycles_end():
    loop = "%2525252525" * 50 + base64.b64encode(b"QUJDREVGR0hJSktMTU5P" * 3).decode()
    assert secret_scan.scan_text(loop)[1] == []


def test_secret_table(spark, odd, empty):
    r = {x.doc_id: x for x in secret_scan.scan(odd, redacted=True).collect()}
    assert r[1].base == [] and r[1].redacted_text is None and [tuple(s) for s in r[8].spans] == [("assign", 11, 26)]
    assert r[8].redacted_text == "été ß 漢字 😀 <secret:assign>"
    docs = secret_scan.redact_documents(odd)
    assert docs.columns == odd.columns and docs.count() == len(ODD) and docs.where("doc_id = 8").first().n_chars == 26
    assert secret_scan.scan(empty).count() == 0


# --- pipeline ----------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work = Workspace(spark, "t")
    before = {r.doc_id: r for r in docs.collect()}
    lang = work.table(p.identify_language(spark, docs, sf))
    near = work.table(p.remove_near_duplicates(spark, lang, sf))
    rows = [(r.doc_id, r.text) for r in lang.collect()]
    classes = _classes(rows, 5, 80)
    assert {r.doc_id for r in near.collect()} == {c for _, c in classes.values()}
    bench = [(str(r.item_id), dc.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = work.table(p.decontaminate(spark, near, sf))
    want = set()
    for r in near.collect():
        ws = dc.words(r.text)
        n, _ = _hits(ws, bench, 13)
        if not (n and 20 * n >= len(ws)):
            want.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == want
    red = work.table(p.redact_secrets(spark, clean, sf))
    for r in red.collect():
        assert r.text == secret_scan.redact(before[r.doc_id].text, secret_scan.scan_text(before[r.doc_id].text)[1])
    assert red.columns == near.columns == list(p.COLUMNS)
    mixed = p.mix_sources(spark, red, sf).collect()
    assert 0 < len(mixed) < red.count() and {r.doc_id for r in mixed} <= want


def test_pipeline_stages_take_odd_rows(spark, odd, empty, sf):
    import corpus_pipeline as p

    for docs in (odd, empty):
        for name, stage in p.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count()
            assert name == "mixing" or out.columns == list(p.COLUMNS)
