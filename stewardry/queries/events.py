"""Change logs, automations, digests, routing; and the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions import transforms as X
from stewardry.queries import query
from stewardry.session import fresh_dir, table
from stewardry.streaming import events as E


@query("""select c_custkey, case when c_custkey % 7 = 0 then 'deleted' when c_custkey % 5 = 0 then 'created' else 'updated' end as kind, case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then 'c_acctbal,c_name' else 'c_name' end as changed from customer where (c_custkey % 7 = 0) <> (c_custkey % 5 = 0) or (c_custkey % 3 = 0 and c_custkey % 35 <> 0)""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    after = c.where("c_custkey % 7 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_name")))
    return E.change_log(c.where("c_custkey % 5 <> 0"), after, "c_custkey", ["c_acctbal", "c_name"]).withColumn("changed", F.array_join("changed", ","))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of deals."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "updated").otherwise("other")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "value", "user_id", F.lit("deal").alias("object"), kind.alias("kind"), F.array(F.concat(F.lit("k"), F.col("event_id") % 2)).alias("changed"), (F.col("event_id") % 5).alias("depth"))


AUTOMATIONS = [("a1", "deal", "created", []), ("a2", "deal", "updated", ["k1"]), ("a3", "deal", "updated", []), ("a4", "other", "created", []), ("a5", "deal", "created", [])]
CONDITIONS = [("a1", "value", "gt", "20"), ("a2", "odd", "eq", "1.0"), ("a5", "user_id", "in", "3|5|8.0"), ("a5", "value", "lte", "30"), ("a5", "unknown", "is_empty", "")]
_RUNS = """select a as automation, event_id, case when event_id % 5 >= 3 then 'loop_blocked' when a = 'a3' or (a = 'a1' and value > 20) or (a = 'a2' and user_id % 2 = 1) then 'ran' else 'skipped' end as outcome from events, (values ('a1', 'signup', ''), ('a2', 'view', 'k1'), ('a3', 'view', ''), ('a5', 'signup', '')) t(a, k, f) where event_type = k and (f = '' or event_id % 2 = 1)"""


def _configured(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(AUTOMATIONS, "automation string, object string, trigger string, fields array<string>"), spark.createDataFrame(CONDITIONS, "automation string, field string, op string, wanted string")


@query(_RUNS)
def automation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changes(spark, sf_dir).withColumn("odd", F.col("user_id") % 2)
    return E.runs(e.unionByName(e.where("event_id % 9 = 0")), *_configured(spark), ["value", "user_id", "odd"])


@query("""select r as automation, event_id, case when event_id % 5 >= 3 then 'loop_blocked' when (o = 0 and value > k) or (o = 1 and user_id = k) or (o = 2 and user_id in (k, k + 1)) then 'ran' else 'skipped' end as outcome from events, (select 'r' || n as r, n % 3 as o, n % 40 as k from range(300) x(n)) where event_type = 'signup' and event_id % 10 = 0""")
def automations_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred automations, whose conditions are rows: the plan doesn't grow with them."""
    made = spark.range(300).withColumn("k", F.col("id") % 40)
    name = F.concat(F.lit("r"), F.col("id"))
    automations = made.select(name.alias("automation"), F.lit("deal").alias("object"), F.lit("created").alias("trigger"), F.array().cast("array<string>").alias("fields"))
    kind = (F.col("id") % 3).cast("int")
    pick = lambda *x: F.element_at(F.array(*x), kind + 1)
    k = F.col("k").cast("string")
    conditions = made.select(name.alias("automation"), pick(F.lit("value"), F.lit("user_id"), F.lit("user_id")).alias("field"), pick(F.lit("gt"), F.lit("eq"), F.lit("in")).alias("op"), pick(k, k, F.concat(k, F.lit("|"), F.col("k") + 1)).alias("wanted"))
    return E.runs(changes(spark, sf_dir).where("event_id % 10 = 0"), automations, conditions, ["value", "user_id"])


@query("""select event_id, value = 6.55 as eq, event_type in ('view', 'click') as among, event_type like '%lic%' as has, coalesce(props, '') = '' as blank, event_id % 2 = 0 as moved from events""")
def automation_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    changed = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("value"))).otherwise(F.array(F.lit("x")))
    return e.select("event_id", X.condition(F.col("value"), "eq", "6.550").alias("eq"), X.condition(F.col("event_type"), "in", ["view", "click"]).alias("among"), X.condition(F.col("event_type"), "contains", "lic").alias("has"), X.condition(F.col("props"), "is_empty").alias("blank"), X.condition(F.col("value"), "changed", None, changed, "value").alias("moved"))


@query("select case when user_id % 10 < 6 then 0 else user_id % 4 end as org, event_id, case when event_type = 'error' then 'SchemaVersion' else 'Record' end as kind, row_number() over (partition by case when user_id % 10 < 6 then 0 else user_id % 4 end order by ts, event_id) as seq from events")
def signal_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One organisation makes most of the changes; records and schema versions share its numbers."""
    org = F.when(F.col("user_id") % 10 < 6, 0).otherwise(F.col("user_id") % 4)
    e = table(spark, sf_dir, "events").select(org.cast("long").alias("org"), "event_id", "ts", F.when(F.col("event_type") == "error", E.SIGNAL_KINDS[1]).otherwise(E.SIGNAL_KINDS[0]).alias("kind"))
    return E.signals(e, "org", ["ts", "event_id"]).select("org", "event_id", "kind", "seq")


@query("""select user_id, make_timestamp(cast((epoch(ts)::bigint - case when epoch(ts) < epoch(ts)::bigint then 1 else 0 end) // 2700 * 2700 * 1000000 as bigint)) as window_start, count(*) as n_items from events group by 1, 2""")
def digest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.digest_windows(table(spark, sf_dir, "events"), "user_id", "ts", 45)
    return made.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""select event_id, make_timestamp(cast((epoch(ts)::bigint - case when epoch(ts) < epoch(ts)::bigint then 1 else 0 end) // 2700 * 2700 * 1000000 as bigint)) as window_start from events""")
def digest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.digest_items(table(spark, sf_dir, "events"), "ts", 45)
    return made.select("event_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"))


@query("""select org, event_id, seq, 10 < oldest - 1 as resync from (select *, min(seq) over (partition by org) as oldest from (select user_id % 4 as org, event_id, row_number() over (partition by user_id % 4 order by ts, event_id) as seq from events) where seq >= 10 * (org + 1)) where seq > 10""")
def signal_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that have seen ten signals; organisations keep ever less of their log."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("org"), "event_id", "ts")
    log = E.signals(e, "org", ["ts", "event_id"]).where("seq >= 10 * (org + 1)")
    kept = log.groupBy("org").agg(F.min("seq").alias("oldest"))
    return E.next_events(log.join(kept, "org"), F.lit(10), F.col("oldest")).select("org", "event_id", "seq", "resync")


@query("select event_id, case when event_id % 4 = 0 then 'suppressed' when strftime(ts, '%H:%M') >= '22:00' or strftime(ts, '%H:%M') < '07:00' then 'deferred' when event_id % 4 = 1 then 'batched' else 'queued' end as outcome from events")
def notification_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    wish = F.element_at(F.array(*map(F.lit, ("off", "digest", "now", "now"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", E.route(wish, X.is_quiet(F.col("ts"), "22:00", "07:00")).alias("outcome"))


@query("select idempotency_key, request_id from (select user_id || event_type as idempotency_key, event_id as request_id, row_number() over (partition by user_id || event_type order by ts, event_id) as n from events) where n = 1 and idempotency_key not in (select user_id || event_type from events where event_id % 50 = 0)")
def delivery_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("idempotency_key", F.concat(F.col("user_id"), "event_type"))
    sent = e.where("event_id % 50 = 0").select("idempotency_key").distinct()
    asked = e.select("idempotency_key", F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"))
    return E.deliveries(asked, sent).select("idempotency_key", "request_id")


@query("select o_orderkey as request, case when o_orderkey % 6 = 1 then 'rejected' when o_orderkey % 6 = 2 then case when o_orderkey % 4 = 0 then 'executed' else 'approved' end when o_orderdate < timestamp '1998-01-01' then 'expired' else 'pending' end as status from orders")
def approval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks can't decide; a second decision changes nothing; what was approved and has run is executed."""
    o = table(spark, sf_dir, "orders")
    asked = o.select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("requester"), F.col("o_orderdate").alias("expires_at"))
    k = F.col("o_orderkey") % 6
    first = o.where("o_orderkey % 6 in (1, 2, 3)").select(F.col("o_orderkey").alias("request"), F.when(k == 3, F.col("o_custkey")).otherwise(-1).alias("decider"), F.when(k == 1, "rejected").otherwise("approved").alias("verdict"), F.lit(1).alias("decided_at"))
    later = o.where("o_orderkey % 6 = 1").select(F.col("o_orderkey").alias("request"), F.lit(-2).alias("decider"), F.lit("approved").alias("verdict"), F.lit(2).alias("decided_at"))
    executed = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("request"))
    return E.approvals(asked, first.unionByName(later), F.lit("1998-01-01").cast("timestamp"), executed)


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_stream_folder(spark, sf_dir))
    made = E.run_available(E.windowed_counts(e, "ts", "event_type", "1 hour", "1 hour"), fresh_dir(spark, "windows"), fresh_dir(spark, "checkpoint"))
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream_folder(spark: SparkSession, sf_dir: str) -> str:
    """Events as a folder of files, in the order of time."""
    path = fresh_dir(spark, "stream")
    table(spark, sf_dir, "events").repartitionByRange(3, "ts").write.parquet(path)
    return path


@query(_RUNS)
def streaming_automations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changes(spark, sf_dir).withColumn("odd", F.col("user_id") % 2)
    folder, path = fresh_dir(spark, "stream"), fresh_dir(spark, "runs")
    e.repartitionByRange(3, "ts").write.parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def act(batch: DataFrame, number: int) -> None:
        E.into_batches(path)(E.runs(batch, *_configured(batch.sparkSession), ["value", "user_id", "odd"]), number)

    q = stream.writeStream.foreachBatch(act).option("checkpointLocation", fresh_dir(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("automation", "event_id", "outcome")


@query("select user_id || '/' || event_type || '/' || event_id % 40 as effect, count(*) as asked from events group by 1")
def durable_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests come again in later batches and in a second run; each effect is had once, and told with how often it was asked for."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type", F.col("event_id") % 40).alias("effect"))
    folder, path, checkpoint = (fresh_dir(spark, x) for x in ("steps-in", "steps-out", "steps-checkpoint"))
    out = None
    for k in range(3):
        # the last run sends everything again
        (e if k == 2 else e.where(F.col("event_id") % 2 == k)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = E.run_steps(stream, path, checkpoint, ["effect"], "ts", "60 days")
    asked = e.groupBy("effect").agg(F.count("*").alias("asked"))
    return out.join(asked, "effect", "left").select("effect", "asked")
