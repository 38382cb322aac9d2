"""What the findings of round 4 named: each of these failed before."""

from __future__ import annotations

import datetime as dt

import duckdb

from stewardry.queries import ORACLES, QUERIES
from tests.test_queries import rows_of


def by_twin(spark, path, name, table):
    """(the query's rows, its twin's rows) over one table."""
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(path)), con.sql(ORACLES[name])
    return rows_of(want.columns, got.columns, got.collect()), rows_of(want.columns, want.columns, want.fetchall())


def test_events_without_a_time_are_counted(spark, tmp_path):
    at = [dt.datetime(1970, 1, 1, 0, 10), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 5, 1, 7), None, None, None]
    rows = [(k, t, k % 2, kind, v, "{}") for k, (t, kind, v) in enumerate(zip(at, ["view", "view", None, "view", "view", None], [1.5, 2.0, None, 4.25, None, 8.0], strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got, want = by_twin(spark, tmp_path, "streaming_windows", "events")
    assert got == want and len(got) == 5 and sum(n for _, _, n, _ in got) == len(rows)


def test_references_behind_letters_of_any_script_count(spark, tmp_path):
    texts = ["\u00e9ref:part:7 aref:part:8 _ref:part:9 1ref:part:10", "\u65e5\u672cref:a:1 \u0663ref:a:2 \u017fref:a:3 e\u0301ref:a:4", "ref:ab:1ref:cd:2 -ref:a:5 x\u00e9ref:a:6 Ref:a:7 ref:A:8", "ref:a:1", None, "y\u200dref:a:9 ref:a:9"]
    ids = [(1, 0), (2, 1), (3, 2), (None, 3), (4, None), (5, None)]
    rows = [(c, t, "user", text) for (c, t), text in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = by_twin(spark, tmp_path, "object_references", "conversations")
    assert got == want and (2, 1, "ref:conversation:2,ref:a:1,ref:a:2,ref:a:3,ref:a:4,ref:turn:1") in [(r[0], r[1], r[2]) for r in got]
