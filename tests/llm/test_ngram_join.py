"""The join at several thresholds, on sets of very different sizes."""

import random

import pytest

from reelspark.llm import graph, ngram_join
from reelspark.llm.runtime import Workspace
from tests.llm.test_operators import _classes


@pytest.mark.parametrize("percent", [20, 50, 60, 75, 85, 100])
def test_uneven_lengths_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    rows, i = [], 0
    for base in range(24):
        w = [f"b{base}x{j}" for j in range(rng.choice((12, 40, 90, 200)))]
        for _ in range(6):
            keep = rng.uniform(percent / 100 - 0.08, 1)
            cut = max(1, int(len(w) * min(1, keep)))
            part = w[:cut] if rng.random() < 0.5 else w[len(w) - cut :]
            if rng.random() < 0.3:
                part = part + [f"own{i}x{j}" for j in range(rng.randrange(1, 6))]
            rows.append((i, " ".join(part)))
            i += 1
    rng.shuffle(rows)
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), width=3, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _classes(rows, 3, percent)


def test_percent_out_of_range(spark):
    for percent in (0, 101):
        with pytest.raises(ValueError):
            ngram_join.jaccard_components(spark, spark.createDataFrame([], "doc_id bigint, text string"), percent=percent)


def test_forest_roots_of_chains_and_hubs(spark):
    rng = random.Random(1)
    up = {i: i - 1 for i in range(1, 70)} | {i: 100 for i in range(101, 160)} | {i: rng.randrange(200, i) for i in range(201, 300)}
    found = graph.forest_roots(spark.createDataFrame(list(up.items()), "u bigint, v bigint"), Workspace(spark, "forest")).collect()

    def root(i):
        return root(up[i]) if i in up else i

    assert sorted(map(tuple, found)) == sorted((i, root(i)) for i in up)
    assert graph.forest_roots(spark.createDataFrame([], "u bigint, v bigint"), Workspace(spark, "forest")).isEmpty()
