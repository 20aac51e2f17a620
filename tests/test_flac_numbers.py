"""Frame numbers of more than one byte."""

import duckdb

from reelspark import catalog


def test_frame_size_counts_the_number(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"copy (select 524288 + i as event_id, timestamp '2024-01-01' + interval (i * 7) second as ts, (i * 37 % 500) / 3 as value from range(600) t(i)) to '{tmp_path}/events.parquet'")
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = [(r.clip, r.block, r["size"], r.code) for r in catalog.queries()["codec_flac_enc"](spark, str(tmp_path)).collect()]
    want = db.execute(f"select clip, block, size, code from ({catalog.oracle_sql()['codec_flac_enc']})").fetchall()
    assert got == want and got[0][1] == 128
