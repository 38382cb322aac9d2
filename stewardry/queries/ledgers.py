"""Ledgers over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions import transforms as X
from stewardry.operators import ledger as L
from stewardry.queries import query
from stewardry.session import table

_CALLS = """calls as (select user_id % 3 as org, ts, case when event_type in ('view', 'click') then 'a/' || event_type else 'b/' || event_type end as model, event_id % 1000 as tokens_in, event_id % 77 as tokens_out,
  case when event_type <> 'error' then cast(((event_id % 1000) * 10 + (event_id % 77) * 25 + 1) // 2 / 10000 as decimal(14,4)) end as cost from events),
hourly as (select org, date_trunc('hour', ts) as hour, model, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out, coalesce(sum(cost), 0) as cost, count(*) filter (cost is null) as unpriced from calls group by 1, 2, 3)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of models; errors are unpriced."""
    kind = F.col("event_type")
    model = F.concat(F.when(kind.isin("view", "click"), "a/").otherwise("b/"), kind)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("org"), F.col("ts").cast("timestamp").alias("ts"), model.alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    price = lambda p: F.when(~F.endswith("model", F.lit("error")), F.lit(p))
    return e.withColumn("cost", X.cost(F.col("tokens_in"), F.col("tokens_out"), price(0.5), price(1.25)))


@query("""select 'o_orderkey' as "column", count(*) - count(o_orderkey) as nulls, count(o_orderkey) as non_nulls, count(distinct o_orderkey) as distinct_values from orders union all select 'o_custkey', count(*) - count(o_custkey), count(o_custkey), count(distinct o_custkey) from orders union all select 'o_orderstatus', count(*) - count(o_orderstatus), count(o_orderstatus), count(distinct o_orderstatus) from orders""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(f"with {_CALLS} select org, cast(hour as timestamp) as hour, model, tokens_in, tokens_out, cost, unpriced from hourly")
def cost_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cost_hourly(calls(spark, sf_dir)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"with {_CALLS} select model, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out, sum(cost) as cost, sum(unpriced) as unpriced from hourly where hour >= timestamp '2024-01-05' and hour < timestamp '2024-01-20' group by model")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp")
    return L.cost_summary(L.cost_hourly(calls(spark, sf_dir)), at("2024-01-05"), at("2024-01-20"))


@query(f"""with {_CALLS}, bills as (select 'a' as provider, date '2024-01-03' as first_day, date '2024-01-20' as last_day, (select round(sum(cost) * 1.01, 4) from hourly where model like 'a/%' and cast(hour as date) between date '2024-01-03' and date '2024-01-20') as amount union all
select 'b', date '2024-01-03', date '2024-01-20', (select round(sum(cost) * 1.5, 4) from hourly where model like 'b/%' and cast(hour as date) between date '2024-01-03' and date '2024-01-20')),
used as (select provider, amount, coalesce(sum(cost), 0) as ledger, coalesce(sum(unpriced), 0) as unpriced from bills left join hourly on split_part(model, '/', 1) = provider and cast(hour as date) between first_day and last_day group by 1, 2)
select provider, amount, ledger, case when abs(amount - ledger) <= greatest(amount * 0.02, 0.01) then 'match' when amount > ledger then 'over' else 'under' end as verdict, unpriced > 0 as provisional from used""")
def cost_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of one provider 1 % and of another 50 % above the ledger; older bills that were replaced tell nothing."""
    hourly = L.cost_hourly(calls(spark, sf_dir))
    inside = hourly.where(F.to_date("hour").between("2024-01-03", "2024-01-20")).groupBy(F.split_part("model", F.lit("/"), F.lit(1)).alias("provider")).agg(F.sum("cost").alias("c"))
    factor = F.when(F.col("provider") == "a", F.lit("1.01")).otherwise(F.lit("1.5")).cast("decimal(4,2)")
    bill = inside.select("provider", F.lit("2024-01-03").cast("date").alias("first_day"), F.lit("2024-01-20").cast("date").alias("last_day"), F.round(F.col("c") * factor, 4).cast("decimal(24,4)").alias("amount"), F.lit(2).alias("received_at"))
    old = bill.withColumn("amount", F.lit(1).cast("decimal(24,4)")).withColumn("received_at", F.lit(1))
    return L.cost_reconcile(bill.unionByName(old), hourly)


_DAILY = """daily as (select 'h' || user_id % 4 as host, user_id % 3 as org, cast(ts as date) as day, event_type as metric, sha256('{"kind":"' || case when value < 20 then 'small' else 'large' end || '","zone":"z' || event_id % 2 || '"}') as dimensions_hash, count(*) as n, sum(value) as total from events group by 1, 2, 3, 4, 5)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"), (F.col("user_id") % 3).alias("org"), "ts", F.col("event_type").alias("metric"), "value", F.concat(F.lit("z"), F.col("event_id") % 2).alias("zone"), F.when(F.col("value") < 20, "small").otherwise("large").alias("kind"))


@query(f"with {_DAILY} select host, org, day, metric, dimensions_hash, n, round(total, 4) as total from daily")
def telemetry_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.telemetry_daily(points(spark, sf_dir), ["zone", "kind"]).withColumn("total", F.round("total", 4))


@query(f"with {_DAILY} select host, day, metric, sum(n) as n from daily where day between date '2024-01-04' and date '2024-01-09' and metric in ('click', 'error') group by all")
def telemetry_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = L.telemetry_read(L.telemetry_daily(points(spark, sf_dir), ["zone", "kind"]), ["click", "error"], F.lit("2024-01-04").cast("date"), F.lit("2024-01-09").cast("date"))
    return read.groupBy("host", "day", "metric").agg(F.sum("n").alias("n"))


@query("select org, hour, runs, steps, tokens, runs > 8 or steps > 40 or tokens > 5000 as exceeded from (select user_id % 3 as org, date_trunc('hour', ts) as hour, count(*) as runs, sum(event_id % 9) as steps, sum(event_id % 1000) as tokens from events group by 1, 2)")
def budget_exceeded_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("org"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 9).alias("steps"), (F.col("event_id") % 1000).alias("tokens"))
    return L.budget_use(runs, 8, 40, 5000).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("select event_id, n as hour_sum, n > 2 as refused from (select event_id, sum(1) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n from events)")
def rolling_hour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return L.rolling_hour_sum(e, "user_id", "ts", F.lit(1), 2).select("event_id", F.col("hour_sum").cast("long").alias("hour_sum"), "refused")


@query("select o_custkey % 7 as org, count(*) as n, count(*) filter (o_orderstatus = 'F') as n_F, count(*) filter (o_orderstatus = 'O') as n_O from orders group by 1")
def authority_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.authority_split(table(spark, sf_dir, "orders").withColumn("org", F.col("o_custkey") % 7), ["org"], "o_orderstatus", ["F", "O"])


@query("select n_name as nation, count(*) filter (c_custkey % 5 <> 0) as landed, count(*) as source, count(*) filter (c_custkey % 5 <> 0) = count(*) as same from customer join nation on c_nationkey = n_nationkey group by 1")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "nation")
    return L.reconcile_counts(c.where("c_custkey % 5 <> 0"), c, "nation")


@query("""with p as (select event_type as stream, 'user_id' as c, count(*) - count(user_id) as a, count(user_id) as b, count(distinct user_id) as d from events group by 1 union all select event_type, 'props', count(*) - count(props), count(props), count(distinct props) from events group by 1)
select e.stream, sha256(e.stream || chr(10) || e.n || chr(10) || t.targets || chr(10) || q.profile) as fingerprint from (select event_type as stream, count(*) as n from events group by 1) e
join (select stream, string_agg(target || '=' || n, ';' order by target || '=' || n) as targets from (select event_type as stream, 'u' || user_id % 3 as target, count(*) as n from events group by 1, 2) group by 1) t using (stream)
join (select stream, string_agg(c || ',' || a || ',' || b || ',' || d, ';' order by c) as profile from p group by 1) q using (stream)""")
def run_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "stream")
    profile = e.groupBy("stream").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in ("user_id", "props") for name, f in (("n", F.count), ("d", F.count_distinct))])
    one = lambda c: F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"{c}_n")).alias("nulls"), F.col(f"{c}_n").alias("non_nulls"), F.col(f"{c}_d").alias("distinct_values"))
    told = profile.select("stream", F.inline(F.array(one("user_id"), one("props"))))
    targets = e.groupBy("stream", F.concat(F.lit("u"), F.col("user_id") % 3).alias("target")).agg(F.count("*").alias("n"))
    return L.run_fingerprints(e.groupBy("stream").agg(F.count("*").alias("n")), targets, told)


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select l_orderkey, max(l_linenumber) + 1 as next_version from lineitem group by 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_versions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("select c_custkey as grant_id, count(o_orderkey) as uses from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1")
def grant_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("grant_id"))
    return L.grant_uses(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grant_id")), uses)


@query("""with runs as (select o_custkey % 40 as system, o_orderkey as run_id, o_orderdate as finished_at, o_orderstatus = 'F' as completed, list_filter(['data', 'dependencies', 'authority', 'rollback', 'sign_off'], lambda g: (o_orderkey + length(g)) % 3 > 0) as checklist from orders),
last as (select system, checklist from (select *, row_number() over (partition by system order by finished_at desc, run_id desc) as n from runs where completed) where n = 1)
select s.system, g.gate, coalesce(list_contains(checklist, g.gate), false) as passed from (select distinct system from runs) s left join last using (system), (values ('data'), ('dependencies'), ('authority'), ('rollback'), ('sign_off')) g(gate)""")
def retirement_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gates = F.filter(F.array(*map(F.lit, L.GATES)), lambda g: (F.col("o_orderkey") + F.length(g)) % 3 > 0)
    return L.retirement_gates(o.select((F.col("o_custkey") % 40).alias("system"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), gates.alias("checklist")))


@query("select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n > 10")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.keep_newest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.asc("event_id")], 10)[1].select("event_id")


@query("select o_orderkey as item, o_orderpriority as priority from orders where o_orderstatus = 'O' order by o_orderpriority desc, o_orderdate, o_orderkey limit 50")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return L.claim(o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "O", "waiting").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at")), 50).select("item", "priority")
