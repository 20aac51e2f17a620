"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter trigrams.  Every language
has several centroids (spherical k-means over its training vectors); a text
takes the language of the centroid with the largest cosine and is rejected when
even that centroid is farther away than training texts of that size, which the
centroids were not fitted on, ever are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Shared, map_rows, mix, small_batches

DIM = 1 << 13
UNKNOWN = "und"
#: classes of text sizes (distinct trigrams, doubling from 4 on) with a rejection
#: floor each, and the held-out texts that a floor is measured on at least
SIZES, LEAST_HELD = 12, 5
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram columns of ``text`` and their counts.  Case is folded and
    each run of other characters than letters counts as one space; a text
    without letters has none."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate(([np.uint32(32)], code[keep], [np.uint32(32)])).astype(np.uint64)
    h = mix(code[:-2] | code[1:-1] << np.uint64(21) | code[2:] << np.uint64(42))
    count = np.bincount((h & np.uint64(DIM - 1)).astype(np.int64), minlength=DIM)
    col = np.flatnonzero(count)
    return col, count[col]


def _size(distinct: int) -> int:
    return min(max(int(distinct).bit_length() - 3, 0), SIZES - 1)


def _vector(col, count, idf):
    v = (1 + np.log(count)) * idf[col]
    n = np.sqrt((v * v).sum())
    return v / n if n else v


@dataclass(frozen=True)
class LanguageModel:
    """``centroids`` (n x DIM, unit rows) of ``languages[i]`` with ``members[i]``
    training texts; ``floor[i]`` holds the cosine under which centroid ``i``
    rejects a text, for each of the ``SIZES`` classes."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]
    members: tuple[int, ...]
    floor: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); (``und``, 0, True) without letters or
        without any learned language."""
        col, count = trigram_counts(text)
        if not len(col) or not self.languages:
            return UNKNOWN, 0.0, True
        cos = self.centroids[:, col] @ _vector(col, count, self.idf)
        best = int(np.argmax(cos))
        score = float(min(max(cos[best], 0.0), 1.0))
        return self.languages[best], score, bool(score < self.floor[best, _size(len(col))])


def _seeds(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++: each seed is drawn in proportion to its distance from the nearest seed."""
    at = [int(rng.integers(len(x)))]
    far = 1 - x @ x[at[0]]
    while len(at) < k:
        p = np.maximum(far, 0).astype(np.float64)
        at.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, 1 - x @ x[at[-1]])
    return x[at]


def _means(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    c = np.stack([x[own == i].sum(0) for i in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, least: float = 0.05, rounds: int = 12, restarts: int = 4) -> np.ndarray:
    """Centroids of the best of several runs of spherical k-means.

    No cluster holds less than ``least`` of the rows: a smaller one is given up
    and the largest one is split, by its members nearer to and farther from its
    centroid; one that is still small at the end is dissolved.  Deterministic.
    """
    k = max(1, min(k, len(x) // 4))
    small = least * len(x)
    best, best_fit = None, (0, -1.0)
    for run in range(restarts):
        rng = np.random.default_rng(run)
        c = _seeds(x, k, rng)
        for _ in range(rounds):
            cos = x @ c.T
            own = np.argmax(cos, 1)
            for i in np.flatnonzero(np.bincount(own, minlength=k) < small):
                big = int(np.argmax(np.bincount(own, minlength=k)))
                its = np.flatnonzero(own == big)
                own[own == i] = big
                own[its[np.argsort(cos[its, big], kind="stable")[: len(its) // 2]]] = i
            c = _means(x, own, k)
        while True:
            own = np.argmax(x @ c.T, 1)
            size = np.bincount(own, minlength=len(c))
            if len(c) == 1 or size.min() >= small:
                break
            c = np.delete(c, int(np.argmin(size)), 0)
        fit = len(c), float((x @ c.T).max(1).sum())
        if fit > best_fit:
            best, best_fit = c, fit
    return best


def _floors(held: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, cents: np.ndarray, slack: float) -> np.ndarray:
    """``slack`` times the least cosine that held-out texts of a language have to
    their nearest centroid, by size class.  A text also stands for the smaller
    classes, by trigrams drawn from it; a class of too few texts takes the floor
    of the one below, and none is above that of a larger one."""
    seen: list[list[float]] = [[] for _ in range(SIZES)]
    rng = np.random.default_rng(0)
    for col, count in held:
        total = int(count.sum())
        for n in [count] + [np.bincount(rng.choice(len(col), size, p=count / total), minlength=len(col)) for size in (4 << i for i in range(SIZES)) if size < total]:
            on = n > 0
            seen[_size(on.sum())].append(float((cents[:, col[on]] @ _vector(col[on], n[on], idf)).max()))
    least = np.zeros(SIZES)
    for i, cos in enumerate(seen):
        least[i] = min(cos) if len(cos) >= LEAST_HELD else least[i - 1] if i else 0.0
    return slack * np.minimum.accumulate(least[::-1])[::-1]


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each trigram column over all rows, and their number;
    each task adds up its own rows first."""

    def run(batches):
        total = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            text = batch.column("text")
            for i in range(batch.num_rows):
                col, _ = trigram_counts(text[i].as_py())
                total[col] += 1
                total[DIM] += len(col) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["col", "df"])

    small_batches(train.sparkSession)
    df = train.select("text").mapInArrow(run, "col bigint, df bigint").groupBy("col").agg(F.sum("df").alias("df"))
    freq = np.zeros(DIM + 1, np.int64)
    for r in df.collect():  # at most DIM + 1 rows
        freq[r.col] = r.df
    return freq[:DIM], int(freq[DIM])


def _sample(train: DataFrame, per_language: int) -> DataFrame:
    """``lang, text`` of at most ``per_language`` ids of each language: those with
    the smallest hashes.  An id that repeats counts once, with its first text in
    order.  No row is shuffled but those chosen."""
    h = F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 11)
    ids = {r.lang: r.n for r in train.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    if not ids:
        return train.select("lang", "text")
    bound = lambda of: F.element_at(F.create_map(*[F.lit(x) for la, v in of.items() for x in (la, int(v))]), F.col("lang"))
    # about three times as many as needed, from which the cut is read exactly
    rough = {la: min(1.0, 3 * per_language / max(n, 1) + 1e-9) * 2**53 for la, n in ids.items()}
    low: dict[str, list[int]] = {}
    for r in train.select("lang", h.alias("h")).where(F.col("h") <= bound(rough)).distinct().toLocalIterator():
        low.setdefault(r.lang, []).append(r.h)
    cut = {la: sorted(hs)[:per_language][-1] for la, hs in low.items()}
    if not cut:
        return train.select("lang", "text").limit(0)
    return train.where(h <= bound(cut)).groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text")


def fit(
    spark: SparkSession,
    training: DataFrame,
    per_language: int = 400,
    clusters: int = 4,
    slack: float = 0.6,
) -> LanguageModel:
    """Learn from ``training(id, text, lang)``.

    Document frequencies cover every training row with a language.  Centroids
    are fitted on at most ``per_language`` ids of each language, chosen by hash
    of the id; a fourth of them is held out and sets the rejection floors:
    ``slack`` times their least cosine, by text size.  Rows with a null or empty
    language, a null id or no letters are not used; repeated ids count once;
    extra columns are ignored; without any usable row the model rejects all.
    """
    train = training.where("lang is not null and lang <> '' and id is not null").select("id", "lang", "text")
    freq, n = _frequencies(train)
    idf = np.log((1 + n) / (1 + freq)) + 1

    def vectors():
        def step(batch):
            rows = [(la, *trigram_counts(tx)) for la, tx in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())]
            rows = [r for r in rows if len(r[1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i].astype("<i8").tobytes() for r in rows], pa.binary()) for i in (1, 2)]], ["lang", "cols", "counts"]
            )

        return step

    by_lang: dict[str, list] = {}
    for r in map_rows(_sample(train, per_language), vectors, "lang string, cols binary, counts binary").collect():  # at most per_language rows of a language
        by_lang.setdefault(r.lang, []).append((bytes(r.cols), bytes(r.counts)))
    cents, langs, members, floor = [], [], [], []
    for lang, rows in sorted(by_lang.items()):
        rows = [(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")) for a, b in sorted(rows)]
        order = np.random.default_rng(0).permutation(len(rows))
        held = [rows[i] for i in order[: len(rows) // 4]]
        x = np.zeros((len(rows) - len(held), DIM), np.float32)
        for j, i in enumerate(order[len(held) :]):
            x[j, rows[i][0]] = _vector(*rows[i], idf)
        c = _cluster(x, clusters)
        cents.append(c)
        langs += [lang] * len(c)
        members += np.bincount(np.argmax(x @ c.T, 1), minlength=len(c)).tolist()
        floor += [_floors(held, idf, c, slack)] * len(c) if held else [np.zeros(SIZES)] * len(c)
    return LanguageModel(
        idf, np.concatenate(cents).astype(np.float32) if cents else np.zeros((0, DIM), np.float32), tuple(langs), tuple(members),
        np.array(floor).reshape(len(langs), SIZES),
    )


def identify(spark: SparkSession, documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, rejected`` for every row, from the whole text.

    Null texts and texts without letters give ``und``, 0.0 and rejected.  Ties
    go to the alphabetically first language.  Repeated rows repeat; a null id
    stays null; other columns are ignored; an empty table gives an empty result.
    """
    shared = Shared(spark, model)  # DIM x centroids floats, whatever the input's size

    def make():
        m = shared.value

        def step(batch):
            text = batch.column("text")
            out = [m.predict(text[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([o[1] for o in out], pa.float64()),
                    pa.array([o[2] for o in out], pa.bool_()),
                ],
                ["id", "lang_pred", "score", "rejected"],
            )

        return step

    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, make, "id bigint, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(spark: SparkSession, documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose whole text is not rejected, with all their
    columns; one pass, no shuffle.

    Null texts and texts without letters are rejected.  Repeated rows are decided
    alike; null ids and columns of any name do not matter; an empty table gives
    an empty result.
    """
    shared = Shared(spark, model)

    def make():
        m = shared.value

        def step(batch):
            text = batch.column(text_col)
            yield batch.filter(pa.array([not m.predict(text[i].as_py())[2] for i in range(batch.num_rows)], pa.bool_()))

        return step

    return map_rows(documents, make, documents.schema)
