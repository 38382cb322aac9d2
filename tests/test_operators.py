"""Operators: what queries over whole tables can't show."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stewardry.functions import seal as S
from stewardry.functions import transforms as X
from stewardry.operators import graph as G
from stewardry.operators import ingest as I
from stewardry.operators import lifecycle as V
from stewardry.operators import search as R
from stewardry.operators.numbering import numbered, running
from stewardry.operators.store import AUDIT, CHANGES, RECORDS, Conflict, Store, WriteRules, governed_write
from stewardry.plans.reads import audited
from stewardry.session import fresh_dir
from stewardry.sources import connectors as C
from stewardry.streaming import events as E


def test_numbers_have_no_gaps(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "b", "b"]), r.randrange(50), k) for k in range(400)]
    got = numbered(spark.createDataFrame(rows, "g string, o int, k int"), ["g"], ["o", "k"], "n", "all").collect()
    for g in (None, "a", "b"):
        want = [k for _, k in sorted((o, k) for x, o, k in rows if x == g)]
        here = sorted((x.n, x.k, x["all"]) for x in got if x.g == g)
        assert [k for _, k, _ in here] == want and [n for n, _, _ in here] == list(range(1, len(want) + 1)) and {a for _, _, a in here} == {len(want)}
    assert numbered(spark.createDataFrame([], "g string, o int"), ["g"], ["o"]).count() == 0
    sums = running(spark.createDataFrame([(k, k % 7) for k in range(300)], "k int, v int"), ["k"], "v", "s").collect()
    assert all(x.s == sum(j % 7 for j in range(x.k + 1)) for x in sums)


def test_numbering_a_hot_group_takes_many_tasks(spark):
    hot = spark.range(20000).select(F.lit(1).alias("org"), "id")
    plan = numbered(hot, ["org"], ["id"])._jdf.queryExecution().toString()
    assert "hashpartitioning(__range" in plan and "hashpartitioning(org" not in plan


def brute_expand(edges, tokens, root, budget):
    """Nodes of one level in order, one after another."""
    taken, n, paid, cut = [], 1, tokens[root], set()
    for s, rel, d in sorted(edges):
        if s != root or (s, rel) in cut or d in taken:
            continue
        if n >= budget.records or paid + tokens[d] > budget.tokens:
            cut.add((s, rel))
            continue
        taken.append(d)
        n, paid = n + 1, paid + tokens[d]
    return sorted(taken)


@pytest.mark.parametrize("seed", range(4))
def test_a_dear_node_cuts_its_own_relation_only(spark, seed):
    r = random.Random(seed)
    names = [f"n{k:02d}" for k in range(30)]
    tokens = {n: r.choice([1, 2, 5, 40]) for n in names} | {"root": 1}
    edges = [("root", rel, n) for rel, part in (("a", names[:10]), ("b", names[10:20]), ("c", names[20:])) for n in part]
    budget = G.Budget(1, 100, 60, 100)
    e = spark.createDataFrame([(s, d, rel) for s, rel, d in edges], "src string, dst string, relation string")
    made = G.expand(spark.createDataFrame([("root",)], "node string"), e, spark.createDataFrame(list(tokens.items()), "node string, tokens int"), budget)
    assert sorted(x.node for x in made.records.collect() if x.depth == 1) == brute_expand(edges, tokens, "root", budget)
    left = {x.relation: x.left for x in made.open.collect()}
    assert sum(left.values()) + made.records.count() == 31


def test_an_expansion_that_is_gone_on_with(spark):
    r = random.Random(5)
    edges = [(f"v{r.randrange(12)}", f"v{r.randrange(40)}", r.choice("xy")) for _ in range(200)]
    e = spark.createDataFrame(sorted(set(edges)), "src string, dst string, relation string")
    n = spark.createDataFrame([(f"v{k}", 1) for k in range(40)], "node string, tokens int")
    roots = spark.createDataFrame([("v0",), ("v1",)], "node string")
    whole = G.expand(roots, e, n, G.Budget(1, 1000, 1000, 1000))
    made = G.expand(roots, e, n, G.Budget(1, 1000, 1000, 3))
    while made.open.count():
        made = G.expand(roots, e, n, G.Budget(1, 1000, 1000, 3), resume=made)
    assert {x.node for x in made.records.collect()} == {x.node for x in whole.records.collect()}


def test_an_index_of_nothing_and_of_repeated_ids(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, text string")
    stored = R.store_index(R.index_rows(rows(), "id", "text"), fresh_dir(spark, "i"))
    assert R.stored_lexical(stored, "alpha").count() == 0 and R.stored_bm25(stored, "alpha").count() == 0
    R.upsert_index(stored, R.index_rows(rows((1, "alpha beta"), (1, "alpha alpha zeta"), (2, None)), "id", "text"))
    assert [x.id for x in R.stored_lexical(stored, "alpha").collect()] == [1]
    with pytest.raises(ValueError):
        R.upsert_index(stored, rows((3, "a"), (3, "b")).select("id", "text", R.terms(F.col("text")).alias("terms")))
    R.remove_from_index(stored, rows((1, "")).select("id"))
    assert R.stored_lexical(stored, "alpha").count() == 0 and stored.totals()[0] == 1
    R.upsert_index(stored, R.index_rows(rows((1, "alpha again")), "id", "text"))
    again = R.compact_index(stored, fresh_dir(spark, "i"))
    assert [x.id for x in R.stored_bm25(again, "again").collect()] == [1] and again.totals() == stored.totals()
    with pytest.raises(ValueError):
        R.query_terms(spark, "the of")


def test_a_snippet_never_begins_inside_a_word(spark):
    text = "overdue " * 30 + "the verdict came, and verdicts came again after it"
    got = spark.range(1).select(R.snippet(F.lit(text), ["verdict"]).alias("s")).first().s
    assert got.startswith("verdict came,") and "verdicts" in got
    assert spark.range(1).select(R.snippet(F.lit("a b c"), ["z"]).alias("s")).first().s == "a b c"


def test_a_write_that_fails_leaves_nothing(spark):
    store = Store(spark, fresh_dir(spark, "s"))
    rows = spark.createDataFrame([(1, None, "5")], "id long, expected long, total string")
    rules = WriteRules({"total": {"min": 1}}, {}, {})
    assert governed_write(store, rows, ["total"], rules, "u", F.current_timestamp()).first().outcome == "written"
    with pytest.raises(Conflict):
        store.commit({"records": store.read("records", RECORDS)}, 0)
    broken = F.raise_error(F.lit("broken")).cast("timestamp")
    with pytest.raises(Exception, match="broken"):
        governed_write(store, rows.withColumn("expected", F.lit(1).cast("long")), ["total"], rules, "u", broken)
    assert store.version() == 1 and store.read("records", RECORDS).count() == store.read("audit", AUDIT).count() == store.read("changes", CHANGES).count() == 1
    twice = rows.withColumn("expected", F.lit(1).cast("long"))
    assert {x.outcome for x in governed_write(store, twice.unionByName(twice), ["total"], rules, "u", F.current_timestamp()).collect()} == {"duplicate"}


def test_sealed_values(spark):
    df = spark.createDataFrame([(1, " A@x.Org "), (2, None)], "id int, m string")
    import hashlib
    import hmac

    head = hashlib.sha256(b"o").digest()[:16] + hashlib.sha256(b"f").digest()[:16]
    got = {r.id: r.d for r in df.select("id", S.blind_index(b"k", "o", "f", F.col("m"), "email").alias("d")).collect()}
    assert got == {1: hmac.new(b"k", head + b"a@x.org", "sha256").hexdigest(), 2: None}
    assert df.select(S.projection_key(None, F.col("m")).alias("k")).first().k is None


def test_transforms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(X.bucket(F.lit(v), [1, 5], ["a", "b", "c"])) for v in ("0", "1", "9", "x")] == ["a", "b", "c", None]
    assert one(X.mask(F.lit("ab"))) == "***ab" and one(X.mask(F.lit("abcdef"), 0)) == "***"
    assert one(X.round_half_away(F.lit(-2.5))) == -3.0 and one(X.handle(F.lit("--Ä!"))) == "actor"
    assert one(X.mentions(F.lit("a@b.c @x. (@y-z) @x"))) == ["x", "y-z"]
    assert one(X.modelled(F.lit("v"), None)) == X.UNAVAILABLE
    with pytest.raises(ValueError):
        X.condition(F.lit(1), "like", 1)


def test_connectors(spark):
    with pytest.raises(TimeoutError):
        C.with_deadline(spark.range(0, 10**12).selectExpr("sum(id % 7) as s"), 1.0)
    pages = list(audited(spark.range(1200), 500))
    assert [len(p) for p, _ in pages] == [500, 500, 200] and [d for _, d in pages] == [False, False, True]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    later = C.altered(rows, F.col("k") == 1, {"v": F.upper("v")}, spark.createDataFrame([(3, "c")], "k int, v string"), {"f": F.lit(1)})
    assert sorted(map(tuple, later.collect()), key=str) == [(2, "B", 1), (3, "c", None)]


def test_ingest_odds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(I.canonical_number(F.lit(v))) for v in ("50000", "50000.0", "5e4", "0", "0.10", "x")] == ["50000", "50000", "50000", "0", "0.1", None]
    many = spark.range(I.MOST_NAMES + 1).select(F.concat(F.lit("t"), F.col("id")).alias("target"))
    with pytest.raises(ValueError):
        I.mapping_proposals(spark.createDataFrame([("s", "f")], "stream string, field string"), many)
    v = spark.createDataFrame([(k, k - 1) for k in range(1, 60)] + [(0, None)], "version int, parent int")
    with pytest.raises(ValueError):
        V.effective_fields(v, spark.createDataFrame([(0, "f", "t")], "version int, field string, type string"))


def test_a_replayed_batch_adds_nothing(spark):
    path = fresh_dir(spark, "b")
    write = E.into_batches(path)
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    assert spark.read.parquet(path).count() == 5
