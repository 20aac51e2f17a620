"""Language identification: cosines by a plain loop, cluster sizes, rejection and
the bound of the training sample."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelspark.llm import language_id
from reelspark.llm.queries import language_model, op1_language_id

OTHER = {
    "pl": "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem i sumieniem i powinni postepowac wobec innych w duchu braterstwa. ",
    "tr": "Butun insanlar hur, haysiyet ve haklar bakimindan esit dogarlar. Akil ve vicdana sahiptirler ve birbirlerine karsi kardeslik zihniyeti ile hareket etmelidirler. ",
    "fi": "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto, ja heidan on toimittava toisiaan kohtaan veljeyden hengessa. ",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
}


def _columns(text):
    """Trigrams of folded letters, as the operator hashes them: one at a time."""
    folded = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    out = Counter()
    grams = f" {folded} "
    for i in range(len(grams) - 2):
        out[grams[i : i + 3]] += 1
    return out


@pytest.fixture(scope="module")
def sf():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path


@pytest.fixture(scope="module")
def model(spark, sf):
    return language_model(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def test_cosine_equals_a_plain_loop(model):
    text = "Eronre anly, a ered! is hast sh of the oning"
    col, count = language_id.trigram_counts(text)
    assert sum(_columns(text).values()) == count.sum()
    v = {int(c): (1 + math.log(n)) * float(model.idf[c]) for c, n in zip(col, count)}
    norm = math.sqrt(sum(x * x for x in v.values()))
    best = max(sum(float(c[i]) * x for i, x in v.items()) / norm for c in model.centroids)
    assert abs(model.predict(text)[1] - best) < 1e-5


def test_clusters_are_real(model, spark):
    by = Counter()
    for la, n in zip(model.languages, model.members):
        by[la] += n
    assert len(model.languages) > len(by)
    assert all(n >= 0.05 * by[la] for la, n in zip(model.languages, model.members))


def test_rejection(model, spark, sf):
    rng = random.Random(4)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000)), "".join(chr(rng.randrange(32, 127)) for _ in range(3000))]
    assert all(model.predict(t * 3)[2] for t in [*OTHER.values(), *noise])
    rows = op1_language_id(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_sample_is_bounded_by_ids(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("id"), F.concat(F.lit("text "), (F.col("id") % 10).cast("string")).alias("text"), F.lit("aa").alias("lang")
    )
    got = language_id._sample(rows, 50).count()
    assert 40 <= got <= 50
    few = language_id._sample(rows.where("id < 40"), 50).count()
    assert few == 20 and language_id._sample(rows.limit(0), 50).count() == 0
