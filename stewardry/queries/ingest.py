"""Sources, landing, identity, survivorship, promotion, and governed writes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions.seal import hmac_sha256
from stewardry.operators import ingest as I
from stewardry.operators.store import AUDIT, CHANGES, Store, WriteRules, current, governed_write
from stewardry.queries import query
from stewardry.queries.reads import _hmac_sql
from stewardry.session import fresh_dir, table, written
from stewardry.sources import connectors as C

NOW = "2024-01-15 12:00:00"
KEY = b"landing-key"


def at(text: str = NOW):
    return F.lit(text).cast("timestamp")


def connector(spark: SparkSession, sf_dir: str) -> C.Connector:
    return C.Connector({"event": (table(spark, sf_dir, "events"), ("ts", "event_id")), "order": (table(spark, sf_dir, "orders"), ("o_orderdate", "o_orderkey"))})


@query("select * from (select 'event' as object, count(*) as n, 6 as fields from events union all select 'order', count(*), 6 from orders)")
def connector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connector(spark, sf_dir)
    fields = c.discover(spark).groupBy("object").agg(F.count("*").cast("int").alias("fields"))
    counts = c.count("event").select(F.lit("event").alias("object"), "n").unionByName(c.count("order").select(F.lit("order").alias("object"), "n"))
    return counts.join(fields, "object")


@query("select 1 as page, event_id from (select event_id, row_number() over (order by ts, event_id) as n from events) where n <= 100 union all select 2, event_id from (select event_id, row_number() over (order by ts, event_id) as n from events) where n between 101 and 200 union all select 3, event_id from (select event_id, row_number() over (order by ts, event_id) as n from events) where n <= 10")
def connector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages in turn, and one behind a cursor that can't be read, which starts anew."""
    c = connector(spark, sf_dir)
    first, cursor = c.fetch_page("event", None, 100)
    second, _ = c.fetch_page("event", cursor, 100)
    anew, _ = c.fetch_page("event", "not a cursor", 10)
    out = [p.select(F.lit(k + 1).alias("page"), "event_id") for k, p in enumerate((first, second, anew))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select event_id, user_id, value from events")
def connector_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is stopped after a third of the files, and goes on from the committed offset: each row comes once."""
    landing, out, checkpoint = (fresh_dir(spark, f"restart-{x}") for x in ("files", "out", "checkpoint"))
    spark.dataSource.register(C.TableStream)
    events = table(spark, sf_dir, "events")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k in range(3):
        # files arrive under later names, as many as their tasks have written
        events.where(F.col("event_id") % 3 == k).write.parquet(f"{landing}/run-{k}")
        fs = path(landing).getFileSystem(spark._jsc.hadoopConfiguration())
        for j, name in enumerate(sorted(f.getPath().toString() for f in fs.globStatus(path(f"{landing}/run-{k}/part-*.parquet")))):
            fs.rename(path(name), path(f"{landing}/{k:06d}-{j:06d}.parquet"))
        stream = spark.readStream.format("table_stream").option("path", landing).option("page_rows", 1000).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "value")


@query("select event_id from (select event_id, row_number() over (order by ts, event_id) as n from events) where n > 500")
def incremental_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.orderBy("ts", "event_id").limit(500).agg(F.max(F.struct("ts", "event_id")).alias("c")).first().c
    return I.incremental(e, ["ts", "event_id"], {"ts": last.ts, "event_id": last.event_id}).select("event_id")


@query("select ts, event_id from events order by ts desc, event_id desc limit 1")
def extract_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cursor(table(spark, sf_dir, "events"), ["ts", "event_id"])


@query("select mode, count(*) as n from (select 'full' as mode from orders union all select 'incremental' from orders where o_orderkey > 10000) group by 1 union all select 'incremental', 0 where (select max(o_orderkey) from orders) <= 10000")
def resync_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full resync clears the cursor first; an incremental run goes on behind it."""
    o = table(spark, sf_dir, "orders")
    n = lambda mode: I.incremental(o, ["o_orderkey"], {"o_orderkey": 10000}, mode == "full").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
    return n("full").unionByName(n("incremental"))


@query("select event_id, sha256(event_id || chr(0) || case when event_id % 5 = 0 then '1' else '0' end || chr(0) || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || chr(0) || 'event_type' || chr(0) || '{\"v\":\"' || event_type || '\"}' || chr(0) || 'user_id' || chr(0) || '{\"v\":' || user_id || '}' || chr(0)) as hash from events")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("gone", F.col("event_id") % 5 == 0).withColumn("none", F.lit(None).cast("string"))
    return e.select("event_id", I.record_hash("event_id", "gone", "ts", ["user_id", "event_type", "none"]).alias("hash"))


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("_source_id"), F.lit(1).alias("_batch"), (F.col("c_custkey") % 11 == 0).alias("_deleted"), F.when(F.col("c_custkey") % 3 == 0, "old").otherwise(F.col("c_name")).alias("name"))


@query("select c_custkey as _source_id, case when c_custkey % 5 = 0 then 'delete' when c_custkey % 7 = 0 then 'insert' else 'update' end as action from customer where (c_custkey % 5 = 0 and c_custkey % 7 <> 0 and c_custkey % 11 <> 0) or (c_custkey % 5 <> 0 and (c_custkey % 7 = 0 or c_custkey % 11 = 0 or c_custkey % 3 = 0))")
def content_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("_source_id"), F.sha2("c_name", 256).alias("hash"))
    return I.snapshot_diff(landing(spark, sf_dir).withColumn("hash", F.sha2("name", 256)), source, "_source_id", "hash")


@query("select c_custkey as _source_id, c_custkey % 11 = 0 or c_custkey % 5 = 0 as _deleted from customer where c_custkey % 7 <> 0")
def snapshot_mark_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("_source_id"))
    return I.mark_deleted(landing(spark, sf_dir), seen, "_source_id").select("_source_id", "_deleted")


@query("select doc_id, case when doc_id % 4 = 0 then 'new' else lang end as lang, case when doc_id % 4 = 0 then 2 else 1 end as batch, case when doc_id % 4 = 0 then n_chars end as added from documents")
def landing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("batch"), "n_chars")
    later = d.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("lang"), F.lit(2).alias("batch"), F.col("n_chars").alias("added"))
    return I.landed_upsert(d.drop("n_chars"), later, ["doc_id"], ["batch"]).select("doc_id", "lang", "batch", "added")


@query("select c_custkey as _source_id from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0 and c_custkey > 50 order by c_custkey limit 200")
def landing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.landing_page(landing(spark, sf_dir), F.lit(50), 200).select("_source_id")


@query("select sha256(text) as sha256, min(doc_id) as path, count(*) as copies from documents where doc_id % 4 in (0, 1) group by 1")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: above the ceiling or of no known class they are refused, and each content is kept once."""
    kinds = F.element_at(F.array(*map(F.lit, ("public", "internal", "pii", "odd"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"), kinds.alias("class"))
    return C.stored_files(files, "internal")[0].select("sha256", "path", "copies")


@query("select doc_id from documents where doc_id % 5 <> 0 and ((doc_id % 2 = 0 and doc_id % 60 > 30) or (doc_id % 2 = 1 and doc_id % 60 > 10))")
def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "public").otherwise("pii").alias("class"), F.timestamp_add("DAY", -(F.col("doc_id") % 60).cast("int"), at()).alias("stored_at"), (F.col("doc_id") % 5 == 0).alias("hold"))
    return C.expired_files(files, at(), {"public": 30, "pii": 10}).select("doc_id")


@query("select 'm' || event_id as message_id, 'u' || user_id as sender, event_type as body, event_id % 3 as n_attachments from events where event_id % 10 <> 3")
def inbound_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth signature is forged; every seventh payload comes twice."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.concat(F.lit("m"), F.col("event_id")).alias("message_id"), F.concat(F.lit("u"), F.col("user_id")).alias("sender"), F.col("event_type").alias("body"), F.transform(F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("event_id") % 3).cast("int")), lambda x: x).alias("attachments")))
    signed = e.select(F.col("ts").alias("received_at"), body.alias("body_json"), "event_id").withColumn("signature", F.when(F.col("event_id") % 10 == 3, "forged").otherwise(hmac_sha256(KEY, F.col("body_json"))))
    got = C.inbound_messages(signed.unionByName(signed.where("event_id % 7 = 0")), KEY)
    return got.select("message_id", "sender", "body", F.col("n_attachments").cast("long").alias("n_attachments"))


_PEOPLE = "select c_custkey as id, 'm' || c_custkey % 400 || '@x.org' as email from customer"


@query(f"""with people as ({_PEOPLE} where c_custkey % 2 = 0), mail as (select email, count(*) as n, max(id) as record from people group by 1)
select c.c_custkey as source_id, case when c_custkey % 10 = 3 then 'linked' when c_custkey % 10 = 5 and coalesce(n, 0) = 0 then 'linked' when c_custkey % 10 <> 5 and coalesce(n, 0) = 0 then 'created' else 'review' end as outcome,
  case when c_custkey % 10 = 5 then 1 else 0 end + coalesce(n, 0) as candidates from customer c left join mail on email = 'm' || c_custkey % 400 || '@x.org'""")
def identity_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in ten is linked already, one in ten has a sure candidate in the registry, and half of all addresses are of people known."""
    c = table(spark, sf_dir, "customer")
    mail = F.concat(F.lit("m"), F.col("c_custkey") % 400, F.lit("@x.org"))
    incoming = c.select(F.col("c_custkey").alias("source_id"), (-1 - F.col("c_custkey")).alias("registry_id"), F.concat(F.lit(" "), F.upper(mail)).alias("email"))
    linked = c.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("r"), F.col("c_custkey")).alias("record"))
    registry = c.where("c_custkey % 10 = 5").select((-1 - F.col("c_custkey")).alias("source_id"), F.concat(F.lit("g"), F.col("c_custkey")).alias("record"))
    people = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("r"), F.col("c_custkey")).alias("record"), mail.alias("email"))
    return I.identity_outcomes(incoming, linked.unionByName(registry), people).select("source_id", "outcome", "candidates")


@query(f"""with people as ({_PEOPLE} where c_custkey % 2 = 0), mail as (select email, count(*) as n from people group by 1),
o as (select case when c_custkey % 10 = 3 then 'linked' when c_custkey % 10 = 5 and coalesce(n, 0) = 0 then 'linked' when c_custkey % 10 <> 5 and coalesce(n, 0) = 0 then 'created' else 'review' end as outcome, case when c_custkey % 10 = 5 then 1 else 0 end + coalesce(n, 0) as candidates
  from customer c left join mail on email = 'm' || c_custkey % 400 || '@x.org')
select outcome, count(*) as n, cast(sum(candidates) as bigint) as candidates from o group by 1""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with the candidates that were weighed for them: every person of an address counts."""
    return identity_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("candidates").alias("candidates"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items propose values of their order's field: blank for every fourth quantity."""
    li = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_quantity") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("v"), F.col("l_partkey")))
    return li.select(F.col("l_orderkey").alias("record"), F.lit("ship").alias("field"), value.alias("value"), F.col("l_suppkey").cast("string").alias("source"), (F.col("l_suppkey") % 3).alias("priority"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ordinal"))


_WON = """won as (select record, value, source from (select l_orderkey as record, 'v' || l_partkey as value, cast(l_suppkey as varchar) as source, row_number() over (partition by l_orderkey order by l_suppkey % 3, l_linenumber * 100000 + l_partkey, cast(l_suppkey as varchar)) as n from lineitem where l_quantity % 4 <> 0) where n = 1),
kept as (select won.* from won left join (select distinct l_orderkey from lineitem where l_orderkey % 6 = 0) h on h.l_orderkey = record where h.l_orderkey is null)"""


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = proposals(spark, sf_dir)
    won = I.survivors(p, p.limit(0).select("record", "field", "value"))
    held = won.where("record % 6 = 0").select("record", "field", "value")
    return I.survivors(p, held)


@query(f"with {_WON} select record, 'ship' as field, value, source from kept")
def survivorship_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir).select("record", "field", "value", "source")


@query(f"with {_WON} select record, source, sha256(value) as value_sha256, 'run-1' as run from kept")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.provenance(winners(spark, sf_dir), "run-1", at()).select("record", "source", "value_sha256", "run")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("record"), F.when(F.col("o_orderkey") % 9 == 0, "lots").otherwise(F.format_string("%de0", F.col("o_custkey"))).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 13 == 0, "perhaps").otherwise(F.lit("TRUE")).alias("open"), F.lit("x").alias("unmapped"))
    return I.mapped(rows, {"amount": "total", "day": "due", "open": "active"}, "record")


KINDS = {"total": "number", "due": "date", "active": "boolean"}


@query("select o_orderkey as record, 'total' as field, 'not a number' as error from orders where o_orderkey % 9 = 0 union all select o_orderkey, 'active', 'not a boolean' from orders where o_orderkey % 13 = 0")
def promotion_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.promotion_conflicts(I.typed_values(triples(spark, sf_dir), KINDS)).select("record", "field", "error")


@query("select o_orderkey as record, cast(o_custkey as varchar) as total, strftime(o_orderdate, '%Y-%m-%d') as due, 'true' as active from orders where o_orderkey % 9 <> 0 and o_orderkey % 13 <> 0")
def promoted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = I.promoted(triples(spark, sf_dir), KINDS, "record")
    return good.select("record", *[F.element_at("fields", f).alias(f) for f in KINDS])


@query("select event_id, value * 10 as n, rtrim(rtrim(cast(cast(value as decimal(20,2)) as varchar), '0'), '.') as canonical from events")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written with exponents and trailing zeros."""
    told = F.concat((F.col("value").cast("decimal(20,2)")).cast("string"), F.lit("00e0"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") * 10).alias("n"), I.canonical_number(told).alias("canonical"))


def stream_fields(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """Parts' brands as streams, their types as fields and sizes as kinds; later, small parts have gone and others have changed."""
    p = table(spark, sf_dir, "part")
    rows = p.groupBy(F.col("p_brand").alias("stream"), F.col("p_type").alias("field")).agg(F.concat(F.lit("k"), F.min("p_size") % 3).alias("type"), F.min("p_partkey").alias("k"))
    if later:
        changed = F.when(F.col("k") % 4 == 1, F.concat(F.lit("n"), F.col("type"))).otherwise(F.col("type"))
        rows = rows.where("k % 4 <> 0").withColumn("type", changed).unionByName(rows.where("k % 5 = 0").withColumn("field", F.concat("field", F.lit("2"))))
    return rows.select("stream", "field", "type")


_FIELDS = "f as (select p_brand as stream, p_type as field, 'k' || min(p_size) % 3 as type, min(p_partkey) as k from part group by 1, 2)"


@query(f"with {_FIELDS} select stream, sha256(string_agg(field || ':' || type, '|' order by field || ':' || type)) as fingerprint from f group by 1")
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.schema_fingerprints(stream_fields(spark, sf_dir), "stream")


_DRIFT = _FIELDS + ", d as (select stream, field, 'removed' as change, true as breaking from f where k % 4 = 0 union all select stream, field, 'type_changed', true from f where k % 4 = 1 union all select stream, field || '2', 'added', false from f where k % 5 = 0)"


@query(f"with {_DRIFT} select * from d")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.drift(stream_fields(spark, sf_dir), stream_fields(spark, sf_dir, True), "stream")


@query(f"with {_DRIFT} select stream, string_agg(field || ':' || change, ',' order by field || ':' || change) as found, 'open' as status from d where breaking group by 1")
def drift_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review item for each stream that breaking changes pause."""
    _, items = I.drift_reviews(schema_drift(spark, sf_dir), "stream", at())
    return items.select("stream", F.array_join("found", ",").alias("found"), "status")


@query(f"with {_DRIFT} select distinct f.stream, case when p.stream is null then 'started' else 'paused' end as outcome from f left join (select distinct stream from d where breaking) p using (stream)")
def ingest_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    paused, _ = I.drift_reviews(schema_drift(spark, sf_dir), "stream", at())
    fields = stream_fields(spark, sf_dir)
    runs = spark.createDataFrame([], "stream string, status string, heartbeat timestamp")
    return I.runs_to_start(fields, runs, at(), paused)


@query("""with t as (select distinct p_type as target, lower(p_type) as t from part union select distinct p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') from part),
s as (select distinct c_mktsegment as stream, lower(p_type) || case when p_size % 2 = 0 then '_x' else '' end as field from part, customer where c_custkey = p_partkey % 100),
m as (select stream, field, target, case when regexp_replace(field, '[^a-z0-9]', '', 'g') = t then 1.0 else 0.6 end as score from s join t on contains(regexp_replace(field, '[^a-z0-9]', '', 'g'), t) or contains(t, regexp_replace(field, '[^a-z0-9]', '', 'g')))
select stream, field, target, cast(score as double) as score from (select *, row_number() over (partition by stream, field order by score desc, target) as n from m) where n = 1""")
def mapping_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields named after part types, with and without an ending, against the names of types and parts."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    source = p.join(c, F.col("c_custkey") == F.col("p_partkey") % 100).select(F.col("c_mktsegment").alias("stream"), F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "_x").otherwise("")).alias("field")).distinct()
    target = p.select(F.col("p_type").alias("target")).union(p.select("p_name")).distinct()
    return I.mapping_proposals(source, target)


@query("select distinct lower(p_type) as field, p_type as target, 'proposed' as status from part where p_type <> 'PROMO'")
def mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adapter sees field names only; what it says beyond the known targets is dropped."""
    p = table(spark, sf_dir, "part")
    targets = [r.p_type for r in p.where("p_type <> 'PROMO'").select("p_type").distinct().collect()]
    return I.suggested(p.select(F.lower("p_type").alias("field")), lambda names: {n: n.upper() for n in names} | {"made_up": "ECONOMY"}, targets)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("stream")).agg(F.max("ts").cast("timestamp").alias("last"), F.count("*").alias("n")).select("stream", F.when(F.col("n") % 2 == 0, "running").otherwise("done").alias("status"), F.col("last").alias("heartbeat"))


_RUNS = "runs as (select user_id as stream, case when count(*) % 2 = 0 then 'running' else 'done' end as status, max(ts) as heartbeat from events group by 1)"
_LATE = "2024-01-30 20:00:00"


@query(f"with {_RUNS} select stream, case when status = 'running' and floor(epoch(timestamp '{_LATE}')) - floor(epoch(heartbeat)) <= 300 then 'busy' else 'started' end as outcome from runs")
def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return I.runs_to_start(r, r, at(_LATE))


@query(f"with {_RUNS} select stream from runs where status = 'running' and floor(epoch(timestamp '{_LATE}')) - floor(epoch(heartbeat)) > 300")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stale_runs(runs(spark, sf_dir), at(_LATE)).select("stream")


@query("select o_orderkey as source_id, case when o_orderkey % 4 = 0 then 'linked' when o_orderkey % 4 = 1 then 'rejected' else 'open' end as status, case when o_orderkey % 4 = 0 then o_custkey end as record from orders where o_orderkey % 3 = 0")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second decision and a link to what is no candidate change nothing."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    reviews = o.select(F.col("o_orderkey").alias("source_id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("candidates"), F.lit("open").alias("status"))
    k = F.col("o_orderkey") % 4
    said = o.where("o_orderkey % 4 < 3").select(F.col("o_orderkey").alias("source_id"), F.when(k == 1, "reject").otherwise("link").alias("verdict"), F.when(k == 2, -1).otherwise(F.col("o_custkey")).alias("record"), F.lit(1).alias("decided_at"))
    again = said.withColumn("verdict", F.lit("reject")).withColumn("decided_at", F.lit(2))
    return I.reviewed(reviews, said.unionByName(again))


def _sealed_sql(value: str) -> str:
    import hashlib

    head = (hashlib.sha256(b"all").digest()[:16] + hashlib.sha256(b"email").digest()[:16]).hex()
    return f"""'{{"$email_sealed": "' || {_hmac_sql(KEY, f"from_hex('{head}') || encode(lower({value}))")} || '"}}'"""


@query(f"select c_custkey, {_sealed_sql('c_name')} as email from customer")
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email"))
    once = I.scrubbed(c, {"email": "email"}, KEY, "all")
    return I.scrubbed(once, {"email": "email"}, KEY, "all")


@query(f"select c_mktsegment as part, count(*) as n, count(*) filter (email like '%$email_sealed%') as sealed, min(email) as least, case when c_mktsegment = 'BUILDING' then 0 else 1 end as rewritten, 0 as again from (select c_mktsegment, {_sealed_sql('c_name')} as email from customer) group by 1")
def landing_retrofit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field becomes sensitive: partitions with plain values are rewritten, the others stay, and a second run finds nothing."""
    path = fresh_dir(spark, "retrofit")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email"), F.col("c_mktsegment").alias("part"))
    done = I.scrubbed(c.where("part = 'BUILDING'"), {"email": "email"}, KEY, "all")
    done.unionByName(c.where("part <> 'BUILDING'")).write.partitionBy("part").parquet(path)
    read = lambda: spark.read.schema(c.schema).parquet(path)
    first = I.retrofit(path, read(), "part", {"email": "email"}, KEY, "all")
    again = I.retrofit(path, read(), "part", {"email": "email"}, KEY, "all")
    told = read().groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.contains("email", F.lit("$email_sealed"))).alias("sealed"), F.min("email").alias("least"))
    return told.select("part", "n", "sealed", "least", F.col("part").isin(first).cast("int").alias("rewritten"), F.lit(len(again)).alias("again"))


@query("select c_custkey, case when c_custkey % 50 = 49 then 'not_found' when c_custkey % 3 = 0 then 'applied' else 'conflict' end as outcome from customer")
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    records = c.where("c_custkey % 50 <> 49").select("c_custkey", (F.col("c_custkey") % 3).alias("version"), F.col("c_name").alias("value"))
    updates = c.select("c_custkey", F.lit(0).cast("long").alias("expected"), F.lit("new").alias("value"))
    return I.compare_and_set(records, updates, "c_custkey")[1].select("c_custkey", "outcome")


_WRITTEN = """w as (select c_custkey as id, case when c_acctbal < 0 then 'invalid' when c_custkey % 10 = 9 then 'missing' else 'written' end as first, case when c_acctbal < 0 or c_custkey % 10 = 9 then 'missing' when c_custkey % 4 = 1 then 'conflict' else 'written' end as second from customer)"""


@query(f"with {_WRITTEN} select id, first, case when id % 2 = 1 then second end as second, case when first <> 'written' then 0 when id % 2 = 1 and second = 'written' then 2 else 1 end as version, case when first <> 'written' then 0 when id % 2 = 1 and second = 'written' then 2 else 1 end as audits, case when first = 'written' and id % 2 = 1 and second = 'written' then 1 end as depth, case when first = 'written' and id % 2 = 1 and second = 'written' then 'segment' end as changed from w")
def governed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of writes: versions, audit rows and change rows come together or not at all."""
    store = Store(spark, fresh_dir(spark, "store"))
    c = table(spark, sf_dir, "customer")
    rules = WriteRules({"balance": {"required": True, "min": 0}}, {"owner": ({"actor": "id"}, "always"), "segment": ("none", "missing")}, {"email": "email"}, KEY)
    fields = ["balance", "segment", "owner", "email"]
    row = lambda segment, expected: c.select(F.col("c_custkey").alias("id"), expected.cast("long").alias("expected"), F.col("c_acctbal").alias("balance"), segment.alias("segment"), F.lit(None).cast("string").alias("owner"), F.col("c_name").alias("email"))
    first = governed_write(store, row(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 10 == 9, 1)), fields, rules, "u7", at())
    kept = c.where("c_acctbal >= 0")
    later = row(F.lit("moved"), F.when(F.col("c_custkey") % 4 == 1, 5).otherwise(1)).join(kept.select(F.col("c_custkey").alias("k")), F.col("id") == F.col("k"), "left").where("id % 2 = 1").withColumn("balance", F.abs("balance")).drop("k")
    second = governed_write(store, later, fields, rules, "u7", at(), depth=1)
    audits = store.read("audit", AUDIT).groupBy("id").agg(F.count("*").alias("audits"))
    change = store.read("changes", CHANGES).where("kind = 'updated'").select("id", "depth", F.array_join("changed", ",").alias("changed"))
    out = first.select("id", F.col("outcome").alias("first")).join(second.select("id", F.col("outcome").alias("second")), "id", "left")
    out = out.join(current(store).select("id", "version"), "id", "left").join(audits, "id", "left").join(change, "id", "left")
    return written(out.select(F.col("id").cast("long").alias("id"), "first", "second", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("audits", F.lit(0)).alias("audits"), "depth", "changed"))


@query(f"with {_WON} select 'survivors' as step, count(*) as n from kept union all select 'landed', count(*) from documents union all select 'distinct_hashes', count(distinct sha256(text)) from documents")
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing, hashing and survivorship in one run, counted."""
    d = table(spark, sf_dir, "documents")
    counts = d.agg(F.count("*").alias("landed"), F.count_distinct(F.sha2("text", 256)).alias("distinct_hashes")).select(F.inline(F.array(F.struct(F.lit("landed").alias("step"), F.col("landed").alias("n")), F.struct(F.lit("distinct_hashes").alias("step"), F.col("distinct_hashes").alias("n")))))
    return counts.unionByName(winners(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit("survivors").alias("step"), "n"))
