"""Decontamination with more automata than are broadcast at a time."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.llm import decontamination as dc
from tests.llm.test_operators import _hits


@pytest.mark.parametrize("rows", [50_000, 0])
def test_many_automata_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(dc, "AUTOMATON_WORDS", 30)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    vocab = "abcdefg"
    items = [(i, [rng.choice(vocab) for _ in range(rng.choice((2, 5, 9, 20)))]) for i in range(25)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None)], "item_id bigint, text string")
    assert len(list(dc.automata(bench, window=5))) > 2 * dc.AT_ONCE
    docs = [(i, " ".join(rng.choice(vocab + "zyx") for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [docs[3], docs[3], (None, docs[7][1]), (200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("starts", F.lit("clash")).withColumn("h1", F.lit("clash"))
    got = dc.scan(spark, df, bench, window=5, clean=True).collect()
    named = [(str(i), w) for i, w in items]
    want = [(i, *_hits((t or "").split(), named, 5)) for i, t in docs]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_hit, r.item_ids) for r in got), key=key) == sorted(want, key=key)
    kept = dc.uncontaminated(spark, df, bench, window=5, limit=3)
    clean = [(i, t) for i, t in docs if not (n := _hits((t or "").split(), named, 5)[0]) or 3 * n < len(t.split())]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(clean, key=order)
