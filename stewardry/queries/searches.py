"""Search, vectors and graph expansion over documents, conversations, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators import graph as G
from stewardry.operators import search as R
from stewardry.queries import query
from stewardry.session import fresh_dir, table

_indexes: dict[tuple[str, str], R.Stored] = {}
QUERY = "the thing of retion"
_STOP = ", ".join(f"'{w}'" for w in R.STOP)
_STEM = "case when length(w) <= 4 then w when w like '%ies' or w like '%ing' then w[:-4] when w like '%ed' or w like '%es' then w[:-3] when w like '%s' then w[:-2] else w end"
_TERMS = f"list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' and w not in ({_STOP})), lambda w: {_STEM})"
_IDX = f"idx as (select doc_id as id, text, {_TERMS} as t from documents)"


def search_index(spark: SparkSession, sf_dir: str) -> R.Stored:
    """Documents, indexed and stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = R.store_index(R.index_rows(table(spark, sf_dir, "documents"), "doc_id", "text"), fresh_dir(spark, "index"))
    return _indexes[key]


#: QUERY without stop words; `thing` loses its ending.
_Q = "['th', 'retion']"
_LEX = f"lex as (select id, text, len(list_filter(t, lambda w: list_contains({_Q}, w))) / len(t) as score from idx where list_has_all(t, {_Q}))"


@query(f"with {_IDX}, {_LEX} select id, round(score, 9) as score from lex order by score desc, id limit 50")
def lexical_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stored_lexical(search_index(spark, sf_dir), QUERY, limit=50).select("id", F.round("score", 9).alias("score"))


def _pieces(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda p: p <> '')"


_MET = f"list_transform({_pieces('text')}, lambda p: coalesce(list_filter(list_transform(list_filter(regexp_split_to_array(lower(p), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' and w not in ({_STOP})), lambda w: {_STEM}), lambda w: list_contains({_Q}, w))[1], ''))"


@query(f"""with {_IDX}, {_LEX}, top as (select * from lex order by score desc, id limit 50), m as (select id, {_pieces('text')} as p, {_MET} as met from top),
s as (select id, k, len(list_distinct(list_filter(met[k : k + 23], lambda x: x <> ''))) as n from (select id, met, unnest(range(1, len(met) + 1)) as k from m) where met[k] <> ''),
b as (select id, arg_max(k, n * 100000 - k) as k from s group by id)
select id, array_to_string(p[k : k - 1 + greatest(10, list_max(list_transform(range(1, 25), lambda j: case when coalesce(met[k - 1 + j], '') <> '' then j else 0 end)))], ' ') as snippet from m join b using (id)""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stored_lexical(search_index(spark, sf_dir), QUERY, limit=50).select("id", "snippet")


_BM25 = f"""tot as (select count(*) as n, avg(len(t)) as mean from idx), q as (select unnest({_Q}) as w), tf as (select id, w, len(list_filter(t, lambda x: x = w)) as tf, len(t) as size from idx, q where list_contains(t, w)),
df as (select w, count(*) as df from tf group by w), bm as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) as score from tf join df using (w), tot group by id)"""


@query(f"with {_IDX}, {_BM25} select id, round(score, 9) as score from bm order by score desc, id limit 100")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stored_bm25(search_index(spark, sf_dir), QUERY, limit=100).select("id", F.round("score", 9).alias("score"))


@query(f"with {_IDX}, {_BM25} select id, round(score, 9) as score from bm order by score desc, id limit 100")
def bm25_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_search(R.index_rows(table(spark, sf_dir, "documents"), "doc_id", "text"), QUERY, limit=100).select("id", F.round("score", 9).alias("score"))


@query(f"""with state as (select doc_id, case when doc_id % 5 = 1 then 'retion thing ' || doc_id else text end as text from documents where doc_id % 7 <> 3),
idx as (select doc_id as id, text, {_TERMS} as t from state), {_BM25} select id, round(score, 9) as score from bm order by score desc, id limit 100""")
def index_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts and a delete, each one small segment: records found by what they say now, statistics those of what is alive."""
    d = table(spark, sf_dir, "documents")
    stored = R.store_index(R.index_rows(d, "doc_id", "text"), fresh_dir(spark, "index"))
    changed = lambda text: R.index_rows(d.where("doc_id % 5 = 1").withColumn("text", text), "doc_id", "text")
    R.upsert_index(stored, changed(F.lit("something else for a while")))
    R.upsert_index(stored, changed(F.concat(F.lit("retion thing "), F.col("doc_id"))))
    R.remove_from_index(stored, d.where("doc_id % 7 = 3").select(F.col("doc_id").alias("id")))
    return R.stored_bm25(stored, QUERY, limit=100).select("id", F.round("score", 9).alias("score"))


@query("select doc_id from documents where doc_id % 4 in (0, 3)")
def index_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("text", "pii.email", "secret.key", "piitext"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return R.guarded(table(spark, sf_dir, "documents").withColumn("storage_class", kinds)).select("doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(vectors(spark, sf_dir).where("id = 0").first().embedding)


_COS = "list_dot_product(cast(a as double[]), cast(b as double[])) / sqrt(list_dot_product(cast(a as double[]), cast(a as double[])) * list_dot_product(cast(b as double[]), cast(b as double[])))"


@query(f"with {_IDX}, {_LEX}, pool as (select id, row_number() over (order by score desc, id) as place from lex order by place limit 80), v as (select p.id, place, round(coalesce({_COS.replace('(a ', '(e.embedding ').replace('(b ', '(z.embedding ')}, 0), 9) as similarity from pool p left join embeddings e on e.vec_id = p.id, (select embedding from embeddings where vec_id = 0) z) select id, round(similarity, 6) as similarity from v order by v.similarity desc, place limit 20")
def semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.semantic_search(search_index(spark, sf_dir), vectors(spark, sf_dir), QUERY, _first_vector(spark, sf_dir), limit=20)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


@query("select doc_id as id, doc_id % 3 = 0 as valid from documents")
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors hold; others are of another model, another length, or of a text that has changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    k = F.col("id") % 6
    text = F.when(k == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    cache = d.select("id", F.when(k == 2, "old").otherwise("m").alias("model"), F.when(k == 4, 3).otherwise(2).alias("dimensions"), F.sha2(text, 256).alias("text_sha256"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).where("id % 6 <> 5")
    valid, missing = R.cached_vectors(d, cache, "m")
    return valid.select("id", F.lit(True).alias("valid")).unionByName(missing.select("id", F.lit(False).alias("valid")))


_FNV = "list_reduce(list_concat([14695981039346656037::uhugeint], list_transform(range(0, octet_length(encode(w))), lambda i: cast((instr('0123456789abcdef', lower(hex(encode(w)))[2 * i + 1]) - 1) * 16 + instr('0123456789abcdef', lower(hex(encode(w)))[2 * i + 2]) - 1 as uhugeint))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(rf"""with w as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as ws from conversations), u as (select conv_id, turn, unnest(ws) as w from w),
d as (select w, cast({_FNV} % 64 as int) as cell from (select distinct w from u)), c as (select conv_id, turn, cell, count(*) as n from u join d using (w) group by all)
select conv_id, turn, max(n) as most, round(max(n) / sqrt(sum(n * n)), 5) as peak, count(*) as cells from c group by all""")
def hashed_word_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    e = R.embed(c, "key", "text").where(F.exists("embedding", lambda x: x > 0))
    peak = F.array_max("embedding")
    words = c.select(F.col("key").alias("id"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("ws"))
    # how often the fullest cell was met: its share times the vector's length, which the smallest whole number of words gives
    scaled = e.join(words, "id").select("id", "embedding", peak.cast("double").alias("peak"), F.size("ws").alias("n"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return scaled.select("id.conv_id", "id.turn", F.round(F.col("peak") * F.col("n") / total, 0).cast("long").alias("most"), F.round("peak", 5).alias("peak"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("cells"))


@query(f"select vec_id as id, round({_COS.replace('(a ', '(e.embedding ').replace('(b ', '(z.embedding ')}, 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) z order by similarity desc, id limit 25")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(vectors(spark, sf_dir), "id", "embedding", _first_vector(spark, sf_dir), 25)


@query(f"""with m as (select conv_id * 1000 + turn as id, coalesce(text, '') || chr(10) || 'Thread: ' || case when conv_id % 4 = 0 then 'retion' else 'other' end as text from conversations where conv_id % 3 <> 0 and turn % 5 <> 4),
idx as (select id, {_TERMS} as t from m) select id, round(len(list_filter(t, lambda w: w = 'retion')) / len(t), 9) as score, '▪▪▪' as snippet from idx where list_contains(t, 'retion') order by len(list_filter(t, lambda w: w = 'retion')) / len(t) desc, id limit 100""")
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index still holds messages that are no more, and the caller sees two thirds of the conversations, but no bodies."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    messages = c.select("id", F.col("conv_id").alias("thread"), F.col("text").alias("body"))
    subject = F.when(F.col("thread") % 4 == 0, "retion").otherwise("other")
    threads = messages.select("thread").distinct().select("thread", subject.alias("subject"))
    indexed = messages.select("id", F.concat(F.coalesce("body", F.lit("")), F.lit("\nThread: "), subject).alias("text"))
    scope = messages.where("thread % 3 <> 0").select(F.col("id").alias("__id"))
    found = R.message_search(messages.where("id % 1000 % 5 <> 4"), threads, "retion", scope, 100, False, indexed)
    return found.select("id", F.round("score", 9).alias("score"), "snippet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, edges, nodes): customers of one nation, their orders, and the parts and suppliers of these; every node weighs differently."""
    c, o, li, p, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part", "supplier"))
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    edges = o.select(name("c", F.col("o_custkey")).alias("src"), name("o", F.col("o_orderkey")).alias("dst"), F.lit("orders").alias("relation"))
    edges = edges.unionByName(li.select(name("o", F.col("l_orderkey")).alias("src"), name("p", F.col("l_partkey")).alias("dst"), F.lit("parts").alias("relation")))
    edges = edges.unionByName(li.select(name("o", F.col("l_orderkey")).alias("src"), name("s", F.col("l_suppkey")).alias("dst"), F.lit("suppliers").alias("relation")))
    nodes = c.select(name("c", F.col("c_custkey")).alias("node"), F.lit(1).alias("tokens"))
    nodes = nodes.unionByName(o.select(name("o", F.col("o_orderkey")).alias("node"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("tokens")))
    nodes = nodes.unionByName(p.where("p_size < 45").select(name("p", F.col("p_partkey")).alias("node"), F.col("p_size").alias("tokens")))
    nodes = nodes.unionByName(s.select(name("s", F.col("s_suppkey")).alias("node"), F.lit(7).alias("tokens")))
    return c.where("c_nationkey = 3").select(name("c", F.col("c_custkey")).alias("node")), edges, nodes


_GRAPH = """e as (select 'c' || o_custkey as src, 'o' || o_orderkey as dst, 'orders' as relation from orders union select 'o' || l_orderkey, 'p' || l_partkey, 'parts' from lineitem union select 'o' || l_orderkey, 's' || l_suppkey, 'suppliers' from lineitem),
n as (select 'c' || c_custkey as node, 1 as tokens from customer union all select 'o' || o_orderkey, o_orderkey % 50 + 1 from orders union all select 'p' || p_partkey, p_size from part where p_size < 45 union all select 's' || s_suppkey, 7 from supplier),
l0 as (select 'c' || c_custkey as node from customer where c_nationkey = 3),
r1 as (select src, relation, dst, row_number() over (partition by src, relation order by dst) as place from e join n on dst = node where src in (select node from l0)),
l1 as (select distinct dst as node from r1 where place <= 4),
r2 as (select src, relation, dst, row_number() over (partition by src, relation order by dst) as place from e join n on dst = node where src in (select node from l1)),
l2 as (select distinct dst as node from r2 where place <= 4 and dst not in (select node from l1))"""
WIDE = G.Budget(depth=2, records=10_000_000, tokens=1_000_000_000, fan_out=4)


@query(f"with {_GRAPH} select node, 0 as depth from l0 union all select node, 1 from l1 union all select node, 2 from l2")
def graph_expand_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.expand(*graph(spark, sf_dir), WIDE).records.select("node", "depth")


@query(f"with {_GRAPH} select src, relation, 1 as depth, count(*) - 4 as left from r1 group by 1, 2 having count(*) > 4 union all select src, relation, 2, count(*) - 4 from r2 group by 1, 2 having count(*) > 4")
def graph_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.manifest(G.expand(*graph(spark, sf_dir), WIDE)).where("state = 'fan_out'").select("src", "relation", "depth", "left")


@query("""with recursive c as (select 'c' || o_custkey as src, 'o' || o_orderkey as dst, o_orderkey % 50 + 1 as tokens, row_number() over (order by 'c' || o_custkey, 'o' || o_orderkey) as k from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)),
walk(k, dst, cut, spent, took) as (select 0, '', '', (select count(*) from customer where c_nationkey = 3), false
  union all select c.k, c.dst, case when c.src = w.cut or w.spent + c.tokens > 600 then c.src else '' end, w.spent + case when c.src <> w.cut and w.spent + c.tokens <= 600 then c.tokens else 0 end, c.src <> w.cut and w.spent + c.tokens <= 600 from walk w join c on c.k = w.k + 1)
select dst as node, 1 as depth from walk where took union all select 'c' || c_custkey, 0 from customer where c_nationkey = 3""")
def graph_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of unequal weight: one that can't be paid for cuts the rest of its customer's, and those of others go on."""
    return G.expand(*graph(spark, sf_dir), G.Budget(1, 10_000_000, 600, 1_000_000)).records.select("node", "depth")


@query("""with z as (select embedding from embeddings where vec_id = 0), e as (select v.vec_id % 20 as src, v.vec_id as dst, round(list_dot_product(cast(v.embedding as double[]), cast(z.embedding as double[])) / sqrt(list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[])) * list_dot_product(cast(z.embedding as double[]), cast(z.embedding as double[]))), 9) as s from embeddings v, z where vec_id >= 20),
r as (select src, dst, row_number() over (partition by src order by case when dst % 3 > 0 then s end desc nulls last, 'v' || dst) as place from e) select 'v' || dst as node, 1 as depth from r where place <= 5 union all select 'v' || x, 0 from range(20) t(x)""")
def graph_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest to a focus first; nodes without a vector come last, in their order."""
    v = table(spark, sf_dir, "embeddings")
    node = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    nodes = v.select(node.alias("node"), F.lit(1).alias("tokens"), F.when((F.col("vec_id") % 3 > 0) | (F.col("vec_id") < 20), F.col("embedding")).alias("embedding"))
    edges = v.where("vec_id >= 20").select(F.concat(F.lit("v"), (F.col("vec_id") % 20).cast("string")).alias("src"), node.alias("dst"), F.lit("near").alias("relation"))
    made = G.expand(v.where("vec_id < 20").select(node.alias("node")), edges, nodes, G.Budget(1, 10_000, 10_000, 5), rank=G.similarity(_first_vector(spark, sf_dir)))
    return made.records.select("node", "depth")


@query("select distinct 'o' || o_orderkey as node, 1 as depth from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3) union select 'c' || c_custkey, 0 from customer where c_nationkey = 3")
def graph_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gone on with from its open ends until none is left, an expansion of narrow fan-out has found what a wide one finds at once."""
    roots, edges, nodes = graph(spark, sf_dir)
    narrow = G.Budget(1, 10_000_000, 1_000_000_000, 8)
    made = G.expand(roots, edges, nodes, narrow)
    while made.open.limit(1).count():
        made = G.expand(roots, edges, nodes, narrow, resume=made)
    return made.records.select("node", "depth")
