"""Many short transport streams, and times beyond 33 bits."""

import duckdb

from reelspark import catalog
from reelspark.sources import transport


def test_short_files_share_a_task():
    files = [(f"f{i}", 1880) for i in range(5000)] + [("long", 1 << 28)]
    dealt = transport.deal_ranges(files, 64 << 20)
    assert len(dealt) < 200 and max(sum(b - a for _, a, b in r) for r in dealt) <= 64 << 20
    bytes_of = {}
    for file, a, b in (x for r in dealt for x in r):
        assert a == bytes_of.get(file, 0)
        bytes_of[file] = b
    assert bytes_of == dict(files)


def test_times_are_33_bits(spark, tmp_path):
    rows = [("a", 0, i, t, t, 1, 90000, True, b"x") for i, t in enumerate([(1 << 33) - 1, 1 << 33, (1 << 33) + 5])]
    p = spark.createDataFrame(rows, "file string, idx int, ordinal bigint, pts bigint, dts bigint, tb_num int, tb_den int, keyframe boolean, data binary")
    s = spark.createDataFrame([("a", 0, "video", "h264")], "file string, idx int, media_type string, codec string")
    transport.write_transport(p, s, str(tmp_path)).collect()
    assert [r.pts for r in transport.read_packets(spark, str(tmp_path)).orderBy("ordinal").collect()] == [(1 << 33) - 1, 0, 5]
    db = duckdb.connect()
    db.execute("create view events as select i as event_id, i % 2 as user_id, 'click' as event_type, '' as props from range(4772190, 4772200) t(i), (select 1)")
    # as many rows as reach that time, of which few are kept
    sql = catalog.oracle_sql()["src_ts_ranges"].replace("row_number() over (partition by user_id % 2 order by event_id) - 1", "event_id // 2")
    got = db.execute(f"select max(pts), max(dts), min(dts) from ({sql})").fetchone()
    assert got[0] < 1 << 33 and got[1] < 1 << 33 and got[2] < 100000
