"""Rollup: a driver lost after any file operation, and the query on repeated
rows and null ids against its SQL."""

import itertools

import duckdb
import pytest

from reelspark.llm import token_counts
from reelspark.llm.queries import ORACLE_SQL, op9_token_counts

CHANGE = "op string, source string, lang string, tokenizer_version string, n_tokens bigint, old_tokens bigint"


class _Lost(Exception):
    pass


class _Failing:
    """A file system that stops before its ``n``-th change."""

    def __init__(self, fs, n):
        self.fs, self.left = fs, n

    def __getattr__(self, name):
        if name in ("rename", "delete", "create", "mkdirs"):
            if self.left == 0:
                raise _Lost(name)
            self.left -= 1
        return getattr(self.fs, name)


def _total(r):
    return {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_compaction_stopped_anywhere_keeps_the_totals(spark, tmp_path):
    change = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], CHANGE)
    for n in itertools.count():
        r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r{n}")
        assert r.commit("b0", change)
        r.compact()
        assert r.commit("b1", change) and r.commit("b2", change)
        r.compact()
        assert r.commit("b3", change)
        want = {("a", "en", "v1"): (4, 20)}
        fs, r._fs = r._fs, _Failing(r._fs, n)
        try:
            r.compact()
            stopped = False
        except _Lost:
            stopped = True
        r = token_counts.TokenRollup(spark, r.path)
        assert _total(r) == want and all(r.committed(f"b{i}") for i in range(4)), n
        assert not r.commit("b1", change)
        r.compact()
        r.compact()
        assert _total(r) == want and len(r._names("", "base-")) <= 2 and all(not r.commit(f"b{i}", change) for i in range(4))
        if not stopped:
            break
    assert n >= 3


def test_times_and_commits_stopped_anywhere(spark, tmp_path):
    rows = [("insert", "a", "en", "v1", 5, None, 3), ("delete", "a", "en", "v1", 5, None, 1), ("revise", "a", "en", "v1", 7, 5, 2)]
    change = spark.createDataFrame(rows, CHANGE + ", times bigint")
    for n in itertools.count():
        r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r{n}")
        fs, r._fs = r._fs, _Failing(r._fs, n)
        try:
            r.commit("b", change)
            stopped = False
        except _Lost:
            stopped = True
        r._fs = fs
        r.commit("b", change)
        assert _total(r) == {("a", "en", "v1"): (2, 14)}
        if not stopped:
            break


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("rows", [
    [(None, "a b", "en", "s"), (None, "a b", "en", "s"), (1, "c\nLicensed under X y\nd", "de", "t"), (1, "c\nLicensed under X y\nd", "de", "t"), (2, "a b", None, "u"),
     (2, "a b", None, None), (3, None, "en", "s"), (4, "", None, None), (None, "only", None, "s"), (5, "Licensed under X", "en", "s"), (6, "x " * 5000, "en", "s")],
    [],
])
def test_query_equals_its_sql(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in op9_token_counts(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(map(str, con.sql(ORACLE_SQL["op9_token_counts"]).fetchall()))
