"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are the sum of signed deltas,
one set for each committed batch: inserts add, deletes subtract, a revised count
adds the new and subtracts the old.  Committing a batch id again changes
nothing, so a job that failed halfway can simply be run again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import map_rows

KEYS = ("source", "lang", "tokenizer_version")
_DELTA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"

#: Word-like tokenizers as patterns of one token.
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "alnum-1": r"[0-9A-Za-z]+",
}


def pattern_tokens(text: str, version: str) -> Column:
    """Number of tokens of a column under one of ``PATTERNS``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PATTERNS[version])), F.lit(0)).cast("bigint")


def _encoder(path: str) -> Callable[[str], int]:
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f.read().splitlines() if line)}
        enc = tiktoken.Encoding("local", pat_str=r"\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
        return lambda s: len(enc.encode_ordinary(s))
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda s: len(sp.encode(s))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda s: len(tok.encode(s, add_special_tokens=False).ids)


def vocabulary_tokens(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens`` under the vocabulary file at ``path`` (present on
    every executor).  Null texts have 0 tokens; repeated rows repeat."""

    def make():
        count = _encoder(path)

        def step(batch):
            text = batch.column("text")
            n = [count(t) if (t := text[i].as_py()) else 0 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

        return step

    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(src, make, "id bigint, n_tokens bigint").withColumnRenamed("id", id_col)


class TokenRollup:
    """Rollup kept as Parquet deltas under ``path``, a folder all machines share.

    Layout: ``<path>/batches/<hash of batch id>/`` holds one batch's deltas,
    ``<path>/base-<uuid>/`` a compacted sum and ``<path>/MANIFEST-<n>`` names a
    base and the batches it covers.  The manifest with the highest ``n`` counts.
    Batches and manifests are written under another name and then renamed in one
    step, and neither is ever written again, so a driver lost at any point leaves
    the old or the new state.  What a manifest has replaced stays until the
    compaction after the next one, so a reader that began before it can finish.
    One writer at a time; readers need no lock.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}" if p else self.path)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _name(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()[:32]

    def _names(self, folder: str, prefix: str = "") -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(n for s in self._fs.listStatus(self._at(folder)) if (n := s.getPath().getName()).startswith(prefix))

    def _rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._at(a), self._at(b)):
            raise OSError(f"{b} could not be written")

    def _manifests(self) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in self._names("", "MANIFEST-"))

    def _manifest(self, n: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/MANIFEST-{n}", wholetext=True).first()[0])

    def _current(self) -> dict:
        found = self._manifests()
        return self._manifest(found[-1]) if found else {"base": None, "covers": []}

    def committed(self, batch_id: str) -> bool:
        name = self._name(batch_id)
        return self._fs.exists(self._at(f"batches/{name}")) or name in self._current()["covers"]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes(op, source, lang, tokenizer_version, n_tokens,
        old_tokens)`` once; False if ``batch_id`` was committed before.

        ``op``: ``insert`` (+1 document, + n_tokens), ``delete`` (-1, - n_tokens)
        or ``revise`` (0, + n_tokens - old_tokens); any other raises.  A column
        ``times``, if there is one, says how many equal changes a row stands for.
        Null counts are 0; null sources and languages are values of their own;
        repeated rows count each time; an empty batch commits nothing but its
        id.  Hot keys cost nothing: deltas are summed map-side.
        """
        if self.committed(batch_id):
            return False
        times = F.col("times").cast("bigint") if "times" in changes.columns else F.lit(1).cast("bigint")
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.when(sign.isNull(), F.raise_error(F.lit("unknown change"))).otherwise(sign).cast("bigint")
        n = F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0))
        old = F.coalesce(F.col("old_tokens").cast("bigint"), F.lit(0))
        tokens = F.when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(n)
        delta = (
            changes.select(*[F.col(k).cast("string").alias(k) for k in KEYS], (sign * times).alias("n_docs"), (tokens * times).alias("n_tokens"))
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        )
        stage = f"staging/{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/{stage}")
        self._fs.mkdirs(self._at("batches"))
        self._rename(stage, f"batches/{self._name(batch_id)}")
        return True

    def _deltas(self) -> tuple[DataFrame, list[str]]:
        now = self._current()
        read = self.spark.read.schema(_DELTA)
        names = self._names("batches")
        # A batch that compaction has covered but not yet removed counts once.
        paths = [f"{self.path}/batches/{n}" for n in names if n not in now["covers"]]
        if now["base"]:
            paths.append(f"{self.path}/{now['base']}")
        df = read.parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return df, sorted({*now["covers"], *names})

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, n_docs, n_tokens``; groups that
        deltas have brought to nothing are left out."""
        df, _ = self._deltas()
        return (
            df.groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )

    def compact(self) -> None:
        """Fold the committed batches into one base; totals stay the same and
        the folded batches stay committed."""
        _, covers = self._deltas()
        found = self._manifests()
        base = f"base-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{base}")
        stage = f"staging/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(stage), True)
        out.write(bytearray(json.dumps({"base": base, "covers": covers}).encode()))
        out.close()
        self._rename(stage, f"MANIFEST-{found[-1] + 1 if found else 0}")
        self._clean(found)

    def _clean(self, before: list[int]) -> None:
        """Remove what the manifest before the last already covered, and every
        base and staged file that no kept manifest names."""
        old = self._manifest(before[-1]) if before else {"base": None, "covers": []}
        for n in set(old["covers"]) & set(self._names("batches")):
            self._fs.delete(self._at(f"batches/{n}"), True)
        for n in before[:-1]:
            self._fs.delete(self._at(f"MANIFEST-{n}"), False)
        named = {self._manifest(n)["base"] for n in self._manifests()}
        for n in self._names("", "base-"):
            if n not in named:
                self._fs.delete(self._at(n), True)
        self._fs.delete(self._at("staging"), True)
