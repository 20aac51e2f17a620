"""Quality: repeated ids in the training rows, the risk and its gradient against a
plain version, and the registered query."""

import numpy as np
import pytest

from reelspark.llm import quality
from reelspark.llm.queries import op5_quality_classifier

ROWS = "id bigint, text string"


def test_repeated_ids_send_one_row_each(spark, monkeypatch):
    seen = []
    plain = quality._vectors
    monkeypatch.setattr(quality, "_vectors", lambda df, *a: (seen.append(df.count()), plain(df, *a))[1])
    rows = [(1, f"good text {i % 7} and more of it") for i in range(6000)] + [(i, f"bad {i} $$$ xx") for i in range(2, 40)] + [(None, "no id")] * 50 + [(41, None)] * 9
    training = spark.createDataFrame(rows, ROWS).repartition(4)
    model = quality.fit(spark, training, spark.createDataFrame([(1,), (1,), (None,)], "id bigint"), positives=10, unlabelled=20)
    assert seen == [1, 20] and np.isfinite(model.weight).all() and 0 < model.prior < 1
    # the text that serves does not depend on the order of the rows
    again = quality.fit(spark, training.repartition(3), spark.createDataFrame([(1,)], "id bigint"), positives=10, unlabelled=20)
    assert (again.weight == model.weight).all()


def test_query_separates_held_out_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if labels.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in known]) >= 0.9


def test_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    model = quality.fit(spark, empty, spark.createDataFrame([], "id bigint"))
    assert model.score(np.zeros((2, quality.DIM), np.float32)).tolist() == pytest.approx([0.5, 0.5])


def plain_risk(w, b, pos, unl, prior, l2):
    """The non-negative risk row by row."""
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    zp, zu = [sum(x * k for x, k in zip(r, w)) + b for r in pos], [sum(x * k for x, k in zip(r, w)) + b for r in unl]
    plus = prior * sum(loss(z, 1) for z in zp) / len(zp)
    minus = sum(loss(z, -1) for z in zu) / len(zu) - prior * sum(loss(z, -1) for z in zp) / len(zp)
    return plus + max(0.0, minus) + l2 / 2 * sum(k * k for k in w)


def test_fit_reaches_a_minimum_of_the_plain_risk():
    rng = np.random.default_rng(3)
    pos = rng.normal([1, 0.5, 0], 1, (60, 3))
    unl = np.concatenate((rng.normal([1, 0.5, 0], 1, (60, 3)), rng.normal([-1, -0.5, 0], 1, (120, 3))))
    w, b = quality._fit_linear(pos, unl, 1 / 3, 1e-2, rounds=1500)
    best = plain_risk(w, b, pos, unl, 1 / 3, 1e-2)
    assert best < plain_risk(np.zeros(3), 0.0, pos, unl, 1 / 3, 1e-2) - 0.1
    for i in range(4):
        for d in (-0.05, 0.05):
            v, c = w.copy(), b
            if i < 3:
                v[i] += d
            else:
                c += d
            assert plain_risk(v, c, pos, unl, 1 / 3, 1e-2) >= best - 1e-4
