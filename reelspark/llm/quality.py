"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model by minimising the
non-negative unbiased PU risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),

with the class prior ``pi`` estimated from the scores of a first model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Shared, map_rows, mix

SHAPES = 1 << 10
#: dimensions of a feature vector: hashed shape trigrams and eight ratios
DIM = SHAPES + 8


def _shape_table() -> np.ndarray:
    """Byte -> shape class: upper, lower (any non-ASCII byte too), digit, and
    every other byte by itself."""
    t = np.arange(256, dtype=np.uint64)
    t[97:123] = 97
    t[128:] = 97
    t[65:91] = 65
    t[48:58] = 48
    return t


_SHAPE = _shape_table()


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text; all zero for null or empty."""
    out = np.zeros(DIM, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    s = _SHAPE[raw]
    # runs of one class count as at most two, so word length does not matter
    if len(s) > 2:
        s = s[np.concatenate(([True, True], (s[2:] != s[1:-1]) | (s[1:-1] != s[:-2])))]
    if len(s) >= 3:
        h = (mix(s[:-2] | s[1:-1] << np.uint64(8) | s[2:] << np.uint64(16)) & np.uint64(SHAPES - 1)).astype(np.int64)
        out[:SHAPES] = np.sqrt(np.bincount(h, minlength=SHAPES) / len(h))
    n = len(raw)
    upper, lower = int(((raw >= 65) & (raw < 91)).sum()), int(((raw >= 97) & (raw < 123)).sum())
    space = int((raw == 32).sum() + (raw == 10).sum())
    digit = int(((raw >= 48) & (raw < 58)).sum())
    high = int((raw >= 128).sum())
    lines = text.split("\n")
    words = text.split()
    out[SHAPES:] = (
        upper / n,
        digit / n,
        (n - upper - lower - space - digit - high) / n,
        min(n / max(len(words), 1), 40) / 40,
        1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / max(len(words), 1),
        min(np.log1p(len(words)), 12) / 12,
        min(np.log1p(n / len(lines)), 12) / 12,
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for rows of features."""
        z = (((x - self.mean) / self.scale) @ self.weight + self.bias).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(pos: np.ndarray, unl: np.ndarray, prior: float | None, l2: float, rounds: int = 250, rate: float = 0.01):
    """Full-batch Adam with the logistic loss: on the non-negative PU risk, or
    without a ``prior`` on plain separation of positives from unlabelled text."""
    kind = pos.dtype  # one type throughout: a mixed product would copy the samples each round
    w, b = np.zeros(pos.shape[1], kind), kind.type(0)
    m, v = np.zeros(len(w) + 1, kind), np.zeros(len(w) + 1, kind)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = pos @ w + b, unl @ w + b
        if prior is None:
            g = np.append(pos.T @ ((sig(zp) - 1) / len(pos)) + unl.T @ (sig(zu) / len(unl)) + l2 * w, (sig(zp) - 1).mean() + sig(zu).mean())
            m, v, w, b = _adam(t, g, m, v, w, b, rate)
            continue
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus = (sig(zp) - 1) * (prior / len(pos))
        gu, gp_minus = sig(zu) / len(unl), sig(zp) * (prior / len(pos))
        if negative >= 0:
            cp, cu = gp_plus - gp_minus, gu
        else:  # step back from over-fitting the negative part
            cp, cu = gp_minus, -gu
        g = np.append(pos.T @ cp + unl.T @ cu + l2 * w, cp.sum() + cu.sum())
        m, v, w, b = _adam(t, g, m, v, w, b, rate)
    return w, float(b)


def _adam(t, g, m, v, w, b, rate):
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return m, v, w - step[:-1].astype(w.dtype), w.dtype.type(b - step[-1])


def estimate_prior(pos_scores: np.ndarray, unl_scores: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the two
    groups' shares above a threshold, over thresholds that keep at least
    ``least`` of the positives (the top bin is purest)."""
    p, u = np.sort(pos_scores), np.sort(unl_scores)
    cuts = np.quantile(p, np.linspace(0, 1 - least, 60))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))


def _vectors(df: DataFrame, extra: list[str], schema: str) -> DataFrame:
    def make():
        def step(batch):
            text = batch.column("text")
            x = [features(text[i].as_py()).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(x, pa.binary())], [*extra, "x"])

        return step

    return map_rows(df.select(*extra, "text"), make, schema)


def fit(spark: SparkSession, training: DataFrame, trusted: DataFrame, positives: int = 2000, unlabelled: int = 4000, l2: float = 1e-3) -> QualityModel:
    """Learn from ``training(id, text)`` and the ids of its ``trusted(id)``
    positives.

    Every row serves as unlabelled text, as the unlabelled sample must have the
    mixture the model will see.  At most ``positives`` and ``unlabelled`` ids,
    chosen by hash, are fitted on; only ids are joined and sorted, and texts are
    read for the chosen ones alone.  Of rows that repeat an id the first text in byte
    order serves (a null text only if there is no other), so the driver never
    receives more rows than ids; rows with a null id are not learned from.  Without
    any positive, as of empty tables, the model scores 0.5 everywhere.
    """
    known = training.where("id is not null")

    def sample(ids, n, salt):
        # at most the documented bound of ids, so they can be broadcast, and one row of each
        ids = ids.distinct().orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n)
        one = known.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
        rows = _vectors(one, ["id"], "id bigint, x binary")
        got = sorted((r.id, bytes(r.x)) for r in rows.collect())
        return np.array([np.frombuffer(x, np.float32) for _, x in got], np.float32).reshape(-1, DIM)

    pos = sample(known.select("id").join(trusted.select("id").distinct(), "id", "left_semi"), positives, 1)
    unl = sample(known.select("id"), unlabelled, 2)
    if not len(pos) or not len(unl):
        return QualityModel(np.zeros(DIM), np.ones(DIM), np.zeros(DIM), 0.0, 0.5)
    mean, scale = unl.mean(0), unl.std(0) + 0.02
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    # Prior: a first model separates positives from unlabelled text, for which no
    # prior is needed; the ratio is read from rows it was not fitted on.
    found = []
    for seed in range(5):
        rng = np.random.default_rng(seed)
        a, c = (rng.permutation(len(x)) % 2 == 0 for x in (pos, unl))
        if (~a).any() and (~c).any():
            w, _ = _fit_linear(pos[a], unl[c], None, l2, rounds=120)
            found.append(estimate_prior(pos[~a] @ w, unl[~c] @ w))
    prior = float(np.median(found)) if found else 0.5
    w, b = _fit_linear(pos, unl, prior, l2, rounds=500)
    return QualityModel(mean, scale, w, b, prior)


def score(spark: SparkSession, documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row, from the whole text.

    Null and empty texts are scored from a zero vector.  Repeated rows repeat; a
    null id stays null; other columns are ignored; an empty table gives an empty
    result.
    """
    shared = Shared(spark, model)  # DIM numbers, whatever the input's size

    def make():
        m = shared.value

        def step(batch):
            text = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                x = np.stack([features(text[i].as_py()) for i in range(at, min(at + 256, batch.num_rows))])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(x)), pa.array(m.score(x))], ["id", "score"])

        return step

    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, make, "id bigint, score double").withColumnRenamed("id", id_col)
