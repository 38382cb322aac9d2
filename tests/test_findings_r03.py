"""What the findings of round 3 named: each of these failed before."""

from __future__ import annotations

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stewardry.llm.repeats import KEY_BITS, Units, _hashes, _shared, anchors
from stewardry.operators import ingest as I
from stewardry.operators import search as R
from stewardry.operators.store import CHANGES, Store, WriteRules, governed_write
from stewardry.queries import ORACLES, QUERIES
from stewardry.session import fresh_dir
from stewardry.sources.connectors import _TableReader, with_deadline
from tests.test_queries import rows_of


def test_both_zeros_are_one_value_of_a_governed_write(spark):
    store, rules = Store(spark, fresh_dir(spark, "zeros")), WriteRules({}, {}, {})
    told = lambda total, expected: spark.range(1).select("id", F.lit(expected).cast("long").alias("expected"), F.lit(total).alias("total"), F.lit("a").alias("name"))
    governed_write(store, told(-0.0, None), ["total", "name"], rules, "u", F.current_timestamp())
    governed_write(store, told(0.0, 1).withColumn("name", F.lit("b")), ["total", "name"], rules, "u", F.current_timestamp())
    assert [r.changed for r in store.read("changes", CHANGES).where("kind = 'updated'").collect()] == [["name"]]


def plain_identity(incoming, links, people):
    out = {}
    for s in {r[0] for r in incoming}:
        linked = [rec for l, rec in links if l == s]
        mine = [(reg, (m or "").strip().lower()) for x, reg, m in incoming if x == s]
        found = {rec: 0.9 for _, m in mine if m for rec, e in people if (e or "").strip().lower() == m}
        found |= {rec: 1.0 for reg, _ in mine for l, rec in links if reg is not None and l == reg}
        sure = len(found) == 1 and max(found.values()) == 1.0
        outcome = "linked" if linked else "created" if not found else "linked" if sure else "review"
        record = min(linked) if linked else next(iter(found)) if sure else None
        out[s] = (outcome, record, 1.0 if linked else max(found.values(), default=None), len(found))
    return out


def test_identity_counts_every_candidate_once(spark):
    r = random.Random(3)
    mail = lambda: r.choice([None, "", " A ", "a", "b", "C", "d"])
    incoming = [(r.randrange(40), r.choice([None, *range(100, 110)]), mail()) for _ in range(90)]
    links = [(r.choice([*range(5), *range(100, 110)]), f"r{r.randrange(25)}") for _ in range(20)]
    people = [(f"r{r.randrange(25)}", mail()) for _ in range(60)]
    frames = spark.createDataFrame(incoming, "source_id long, registry_id long, email string"), spark.createDataFrame(links, "source_id long, record string"), spark.createDataFrame(people, "record string, email string")
    got = {x.source_id: (x.outcome, x.record, x.confidence, x.candidates) for x in I.identity_outcomes(*frames).collect()}
    assert got == plain_identity(incoming, links, people)


def test_an_address_that_all_share_makes_no_pairs(spark):
    n = 20_000  # 400 million pairs
    incoming = spark.range(n).select(F.col("id").alias("source_id"), F.lit(None).cast("long").alias("registry_id"), F.lit("x@y").alias("email"))
    people = spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("record"), F.lit("x@y").alias("email"))
    out = I.identity_outcomes(incoming, spark.createDataFrame([], "source_id long, record string"), people)
    assert [tuple(r) for r in with_deadline(out.groupBy("outcome", "candidates").count(), 30)] == [("review", n, n)]


def rows_by_twin(spark, data, name):
    """(the query's rows, its twin's rows) over the smallest tables."""
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    got, want = QUERIES[name](spark, data), con.sql(ORACLES[name])
    return rows_of(want.columns, got.columns, got.collect()), rows_of(want.columns, want.columns, want.fetchall())


def test_outcomes_tell_all_candidates(spark, data):
    got, want = rows_by_twin(spark, data, "ingest_outcomes")
    each = QUERIES["identity_outcomes"](spark, data).agg(F.sum("candidates")).first()[0]
    assert got == want and sum(r[2] for r in got) == each > sum(r[1] for r in got) / 2


def test_keys_of_all_customers(spark, tmp_path, data):
    spark.range(1500).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.col("id")).alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    for f in os.listdir(data):
        if f != "customer.parquet":
            os.symlink(f"{data}/{f}", f"{tmp_path}/{f}")
    assert QUERIES["projection_keys"](spark, str(tmp_path)).count() == 1500


def test_windows_are_hours(spark, data):
    got, want = rows_by_twin(spark, data, "streaming_windows")
    hours = spark.read.parquet(f"{data}/events.parquet").select(F.date_trunc("hour", "ts"), "event_type").distinct().count()
    assert got == want and len(got) == hours


def test_deny_all_tells_the_ids_of_all_rows(spark, tmp_path, data):
    spark.range(300).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    for f in os.listdir(data):
        if f != "customer.parquet":
            os.symlink(f"{data}/{f}", f"{tmp_path}/{f}")
    got = QUERIES["role_deny_all"](spark, str(tmp_path))
    assert got.columns == ["__id"] and got.count() == 300


def test_a_search_without_limit_tells_all_hits(spark, tmp_path, data):
    spark.range(250).select(F.col("id").alias("p_partkey"), F.lit("red thing").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(5).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    for f in os.listdir(data):
        if f != "part.parquet":
            os.symlink(f"{data}/{f}", f"{tmp_path}/{f}")
    assert QUERIES["policy_semi_join_search"](spark, str(tmp_path)).count() == 250


def test_references_behind_the_fortieth_character_count(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x" * 60 + " ref:part:7"), (2, 1, "user", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["object_references"](spark, str(tmp_path)).orderBy("conv_id").collect()
    assert [r.refs for r in got] == ["ref:conversation:1,ref:part:7", "ref:conversation:2,ref:turn:1"]


def test_a_texts_words_are_counted_within_it(spark):
    texts = [["b", "a", "b", "é"], [], ["x"], [random.Random(k).choice("abcdef") for k in range(500)]]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>").select("k", R.counted(F.col("t")).alias("c")).collect()
    assert {r.k: {x.term: x.tf for x in r.c} for r in got} == {k: dict(Counter(t)) for k, t in enumerate(texts)} and all(len(r.c) == len(set(texts[r.k])) for r in got)


def test_vectors_are_not_shuffled_to_be_reranked(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)], "id long, embedding array<double>").repartition(3)
    pool = spark.createDataFrame([(3, 0.5), (7, 0.25), (99, 0.1)], "id long, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.rerank(pool, vectors, [1.0, 0.0], 3)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [id" in plan and "LeftSemi" in plan and [r.id for r in out.collect()] == [7, 3, 99]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_row_group_is_read_by_one_task(tmp_path):
    pq.write_table(pa.table({"k": list(range(1000))}), f"{tmp_path}/a.parquet", row_group_size=300)
    reader = _TableReader(str(tmp_path), 10, ["k"])
    parts = reader.partitions({"row": 50}, {"row": 950})
    assert [(p.first, p.end) for p in parts] == [(50, 300), (300, 600), (600, 900), (900, 950)]
    assert [k for p in parts for b in reader.read(p) for k in b.column("k").to_pylist()] == list(range(50, 950))
    assert [(p.first, p.end) for p in _TableReader(str(tmp_path), 500, ["k"]).partitions({"row": 0}, {"row": 1000})] == [(0, 600), (600, 1000)]


def test_packed_anchors_tell_what_different_ids_share():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 4, 300).astype(np.uint8).tobytes() for _ in range(30)]
    texts, ids = [*docs, docs[3], docs[4] + docs[5], docs[6], docs[7]], [*range(30), 40, 41, 6, None]
    u = Units(lambda x: np.frombuffer(x, np.uint8), np.uint8, 24, None)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())})
    want, mask = {}, (1 << KEY_BITS) - 1
    for i, x in zip(ids, texts, strict=True):
        for h in anchors(np.frombuffer(x, np.uint8), 24)[1].tolist() if i is not None else ():
            want.setdefault(h & mask, set()).add(i)
    packed = list(_hashes(u, 7)(iter([batch])))
    got = [k for b in _shared(iter(packed)) for k in b.column("a").to_pylist()]
    assert sorted(got) == sorted(k for k, who in want.items() if len(who) > 1) and got
