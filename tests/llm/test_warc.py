"""Archives: what is written is read back, also by the standard library; broken
records; repeated payloads against SQL."""

import glob
import gzip
import hashlib
import io

import duckdb
import pytest

from reelspark.llm import warc
from reelspark.llm.queries import ORACLE_SQL, op12_warc
from reelspark.llm.runtime import Workspace

PAGES = "page_id bigint, url string, html string, digest string, payload string, key string"


def page_rows():
    big = "é" * 60
    rows = [(1, "http://a/1", big), (0, "http://a/0", big), (5, None, big), (5, "http://a/5\r\nX: y z", big), (0, "http://a/0", big), (None, "u", big), (2, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short")]
    rows += [(7, "u", "x" * 3_000_000), (8, "u", "x" * 3_000_000), (None, "u", "y" * 100), (None, "u", "y" * 100), (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "w\r\n\r\nWARC/1.1" * 40)]
    return [(*r, "d", "p", "k") for r in rows]


def as_rows(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def test_query_equals_sql_on_trouble(spark, tmp_path):
    spark.createDataFrame(page_rows(), PAGES).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    q = con.execute(ORACLE_SQL["op12_warc"])
    cols = [d[0] for d in q.description]
    want = sorted((tuple(r[cols.index(c)] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in q.fetchall()), key=str)
    assert as_rows(op12_warc(spark, str(tmp_path))) == want
    assert sum(r[3] == "revisit" for r in want) == 5


def test_shuffled_join_of_payloads_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(page_rows(), PAGES)
    of = lambda: sorted(str((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.archive_pages(spark, pages).collect())
    want = of()
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    assert of() == want


def test_archives_are_gzip_members_and_roll_over(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).coalesce(1)
    work = Workspace(spark, "t")
    manifest = warc.write_archives(spark, pages, f"file://{tmp_path}/a", work, date="2024-01-01T00:00:00Z", archive_bytes=2000)
    files = glob.glob(f"{tmp_path}/a/*.warc.gz")
    assert manifest.count() == len(files) > 1
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") + text.count(b"WARC/1.1\r\nWARC-Type: revisit") == len(page_rows())
    read = warc.read_archives(manifest, keep_payload=True).where("record_type <> 'warcinfo'").collect()
    assert all(r.verified and r.error is None for r in read)
    ids = {}
    for i, _, h, *_ in page_rows():
        ids.setdefault(i, set()).add((h or "").encode())
    for r in read:
        if r.record_type == "response" and r.record_id.startswith(warc.RECORD_ID):
            assert bytes(r.payload) in ids[int(r.record_id[len(warc.RECORD_ID) :])]
    # the same through Spark's own reader of binary files
    again = spark.read.format("binaryFile").load(f"file://{tmp_path}/a").selectExpr("path as file", "content")
    assert sorted((r.offset, r.record_id, r.payload_digest) for r in warc.read_archives(again).collect()) == sorted((r.offset, r.record_id, r.payload_digest) for r in warc.read_archives(manifest).collect())


def test_empty_table_and_missing_file(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).collect() == []
    row = warc.read_archives(spark.createDataFrame([("file:///nowhere/x.warc.gz",)], "file string")).first()
    assert row.error.startswith("cannot be opened")


def member(payload, **over):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "Content-Type": "application/http", "Content-Length": str(len(payload) + 19)} | over
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return gzip.compress(("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n")


def read(data, **k):
    return list(warc.read_records(io.BytesIO(data).read, **k))


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_broken_records_do_not_hide_good_ones(monkeypatch, step):
    monkeypatch.setattr(warc, "STEP", step)
    good = member(b"fine" * 50)
    raw = bytearray(member(b"broken" * 400 + bytes(range(256)) * 9))
    raw[len(raw) // 2] ^= 0xFF
    bad = [
        bytes(raw), member(b"abc", **{"Content-Length": "9"}), member(b"abc", **{"Content-Length": "4000"}), member(b"abc", **{"Content-Length": None}), gzip.compress(b"no archive"), gzip.compress(b"WARC/1.0\r\n"), b"noise" * 9,
        gzip.compress(b"WARC/1.0\r\nno colon\r\n\r\n"),
    ]
    for b in bad:
        rows = read(good + b + good + good)
        assert [r.get("error") is None for r in rows] == [True, False, True, True], (rows, b)
        assert [r["offset"] for r in rows] == [0, len(good), len(good) + len(b), 2 * len(good) + len(b)]
    assert [bool(r.get("error")) for r in read(good + good[:-9])] == [False, True]
    assert read(b"") == []


def test_digests():
    import base64

    p = b"payload"
    for algorithm in ("sha1", "sha256", "md5"):
        h = hashlib.new(algorithm, p)
        for value in (h.hexdigest(), base64.b32encode(h.digest()).decode(), h.hexdigest().upper()):
            (r,) = read(member(p, **{"WARC-Payload-Digest": f"{algorithm}:{value}"}))
            assert r["verified"] and not r.get("error")
        (r,) = read(member(p + b"!", **{"WARC-Payload-Digest": f"{algorithm}:{h.hexdigest()}"}))
        assert r["verified"] is False and r["error"]
    (r,) = read(member(p), keep_payload=True)
    assert r["verified"] is None and r["payload"] == p and r["payload_bytes"] == len(p)


def test_inflating_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 1000)
    sizes = []
    seen = warc._Block.add
    monkeypatch.setattr(warc._Block, "add", lambda self, d: (sizes.append(len(d)), seen(self, d))[1])
    (r,) = read(member(b"0" * 1_000_000))
    assert r["payload_bytes"] == 1_000_000 and max(sizes) <= 1000


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = {r[0]: r for r in con.execute(ORACLE_SQL["op12_warc"]).fetchall()}
    rows = op12_warc(spark, sf).collect()
    assert len(rows) == len(want) and all(want[r.page_id] == (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
