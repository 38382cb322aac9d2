"""Lifecycles over orders, parts, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions import seal as S
from stewardry.functions import transforms as X
from stewardry.operators import lifecycle as V
from stewardry.plans.catalog import Policy
from stewardry.plans.reads import governed_read
from stewardry.queries import query
from stewardry.queries.reads import CALLER, catalog
from stewardry.session import table, written


def at(text: str = "2000-01-01"):
    return F.lit(text).cast("timestamp")


_STATE = "case o_orderkey % 4 when 0 then 'draft' when 1 then 'in_review' when 2 then 'published' else 'archived' end"
_TO = "case o_orderkey % 3 when 0 then 'published' when 1 then 'in_review' else 'archived' end"


@query(f"""with r as (select o_orderkey as record, {_STATE} as state, 'u' || o_custkey % 5 as author, {_TO} as "to", 'u' || o_custkey % 3 as actor from orders)
select record, actor, case when not ((state = 'draft' and "to" = 'in_review') or (state = 'in_review' and "to" = 'published') or (state = 'published' and "to" = 'archived') or (state = 'archived' and "to" = 'published')) then 'refused' when "to" = 'published' and actor = author then 'self_approval' else 'done' end as outcome from r
union all select o_orderkey, 'z', 'late' from orders where o_orderkey % 10 = 0 union all select -o_orderkey - 1, 'u0', 'not_found' from orders where o_orderkey % 100 = 0""")
def record_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    records = o.select(F.col("o_orderkey").alias("record"), F.expr(_STATE).alias("state"), F.concat(F.lit("u"), F.col("o_custkey") % 5).alias("author"))
    asked = o.select(F.col("o_orderkey").alias("record"), F.expr(_TO).alias("to"), F.concat(F.lit("u"), F.col("o_custkey") % 3).alias("actor"), F.lit(1).alias("at"))
    late = asked.where("record % 10 = 0").withColumn("actor", F.lit("z")).withColumn("at", F.lit(2))
    lost = asked.where("record % 100 = 0").withColumn("record", -F.col("record") - 1).withColumn("actor", F.lit("u0"))
    return V.transition(asked.unionByName(late).unionByName(lost), records, V.RECORD_STEPS).select("record", "actor", "outcome")


@query("select o_orderkey as record, a as actor, case when o_orderkey % 4 < 2 or a = 'b' then 'in_flight' else 'opened' end as outcome from orders, (values ('a'), ('b')) t(a)")
def drafts_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    drafts = o.select(F.col("o_orderkey").alias("record"), F.expr(_STATE).alias("state"))
    asked = o.select(F.col("o_orderkey").alias("record"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("actor"), F.lit(1).alias("at"))
    return V.opened_drafts(asked, drafts)


@query("""select c_custkey as request, case when c_custkey % 4 = 0 then case when c_nationkey % 5 <> 4 then c_nationkey * 10 end when c_custkey % 4 = 1 and c_nationkey % 5 <> 4 and c_custkey % 3 = 0 then c_nationkey * 10 + 1 end as version,
  case when c_custkey % 4 = 0 then case when c_nationkey % 5 = 4 then 'base' else 'version' end when c_custkey % 4 = 1 then case when c_nationkey % 5 = 4 then 'no_version' when c_custkey % 3 = 0 then 'version' else 'forbidden' end else 'no_version' end as outcome from customer""")
def version_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4")
    versions = n.select(F.col("n_nationkey").alias("object"), (F.col("n_nationkey") * 10).alias("version"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("cohort")).unionByName(n.select(F.col("n_nationkey").alias("object"), (F.col("n_nationkey") * 10 + 1).alias("version"), F.lit("canary").alias("status"), F.lit("early").alias("cohort")))
    status = F.when(F.col("c_custkey") % 4 == 1, "canary").when(F.col("c_custkey") % 4 > 1, "preview")
    asked = c.select(F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("object"), status.alias("status"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("early"))).otherwise(F.array().cast("array<string>")).alias("cohorts"))
    return V.resolve_versions(asked, versions)


_CHAIN = """v as (select distinct p_size as version, case when p_size > 1 and p_size % 8 <> 1 then p_size - 1 end as parent from part),
f as (select p_size as version, p_type as field, 't' || p_size % 6 as type from part group by 1, 2 having min(p_partkey) % 4 > 0 or p_size % 8 = 1)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sizes of parts as versions in chains of eight, the types that have the size as fields."""
    p = table(spark, sf_dir, "part")
    versions = p.select(F.col("p_size").alias("version")).distinct().withColumn("parent", F.when((F.col("version") > 1) & (F.col("version") % 8 != 1), F.col("version") - 1))
    fields = p.groupBy(F.col("p_size").alias("version"), F.col("p_type").alias("field")).agg(F.min("p_partkey").alias("k")).where("k % 4 > 0 or version % 8 = 1").select("version", "field", F.concat(F.lit("t"), F.col("version") % 6).alias("type"))
    return versions, fields


@query(f"with recursive {_CHAIN}, c(version, node, far) as (select version, version, 0 from v union all select c.version, v.parent, far + 1 from c join v on v.version = c.node where v.parent is not null) select c.version, field, arg_min(type, far) as type from c join f on f.version = node group by all")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.effective_fields(*_versions(spark, sf_dir))


@query(f"with {_CHAIN}, a as (select field, type from f where version = 9), b as (select field, type from f where version = 12) select field, case when a.type is null then 'added' when b.type is null then 'removed' else 'changed' end as change from a full join b using (field) where a.type is distinct from b.type")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fields = _versions(spark, sf_dir)
    return V.version_diff(fields.where("version = 9"), fields.where("version = 12"))


@query("select p_brand as object, p_size as version, case when p_size = m and s > 1 then 'rolled_back' when rank = 2 then 'active' when p_size = m then 'active' else 'superseded' end as status from (select p_brand, p_size, max(p_size) over (partition by p_brand) as m, count(*) over (partition by p_brand) as s, row_number() over (partition by p_brand order by p_size desc) as rank from (select distinct p_brand, p_size from part))")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    sizes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("object"), F.col("p_size").alias("version")).distinct()
    line = W.partitionBy("object").orderBy("version")
    versions = sizes.select("object", "version", F.lag("version").over(line).alias("parent"), F.when(F.lead("version").over(line).isNull(), "active").otherwise("superseded").alias("status"))
    return V.rolled_back(versions, sizes.select("object")).select("object", "version", "status")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as objects, part types as their fields, sizes as policies; later on there are more of them, and brands adopt one another."""
    p = table(spark, sf_dir, "part")
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    row = lambda kind, name, value: p.select(F.lit(kind).alias("kind"), F.col("p_brand").alias("object"), name.cast("string").alias("name"), value.cast("string").alias("value"), n.alias("n"))
    adopted = F.when((n > 3) & (n % 4 != 0), F.concat(F.lit("Brand#"), n - 1))
    fields = p.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("s")).select(F.lit("field").alias("kind"), F.col("p_brand").alias("object"), F.col("p_type").alias("name"), F.concat(F.lit("t"), F.col("s") % 3).alias("value"), n.alias("n"))
    policies = p.groupBy("p_brand").agg(F.max("p_size").alias("s")).select(F.lit("policy").alias("kind"), F.col("p_brand").alias("object"), F.lit("size").alias("name"), F.col("s").cast("string").alias("value"), n.alias("n"))
    target = written(row("object", F.lit(None), adopted).distinct().unionByName(fields).unionByName(policies))
    base = target.where("(kind = 'object' and n <= 8) or (kind = 'field' and n <= 8 and name <> 'PROMO') or (kind = 'policy' and n <= 8)").withColumn("value", F.when((F.col("kind") == "policy") & (F.col("n") % 2 == 0), "0").otherwise(F.col("value")))
    return base.drop("n"), target.drop("n")


_SNAP = r"""p as (select *, cast(regexp_extract(p_brand, '(\d+)', 1) as int) as n from part),
t as (select distinct 'object' as kind, p_brand as object, cast(null as varchar) as name, case when n > 3 and n % 4 <> 0 then 'Brand#' || n - 1 end as value, n from p union all select 'field', p_brand, p_type, 't' || min(p_size) % 3, n from p group by all union all select 'policy', p_brand, 'size', cast(max(p_size) as varchar), n from p group by all),
ops as (select *, case kind when 'object' then case when value is null then 'CreateObject' else 'AdoptObject' end when 'field' then 'AddField' else 'SetRowPolicy' end as operation from t where (kind = 'object' and n > 8) or (kind = 'field' and (n > 8 or name = 'PROMO')) or (kind = 'policy' and (n > 8 or n % 2 = 0 and value <> '0')))"""


@query(f"with {_SNAP} select operation, object, name, value, case kind when 'object' then case when value is null or n = 9 then 0 else case when n < 12 then n - 9 else n % 4 end end when 'field' then 33 else 34 end as step from ops")
def snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations, _ = V.snapshot_plan(*snapshots(spark, sf_dir), 1, 1)
    return operations.select("operation", "object", "name", "value", "step")


@query(f"with {_SNAP} select 'applied' as what, 0 as n union all select 'downgrade', count(*) from t where kind = 'object' union all select 'removed', count(*) from ops where kind <> 'policy' or n > 8 union all select 'type_changed', 0 union all select 'drift', count(*) from t where kind = 'policy' and n <= 8 and n % 2 = 0 and value <> '0'")
def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that has been applied leaves no difference; going back, an older format, and a base that has changed meanwhile are refused."""
    base, target = (written(x) for x in snapshots(spark, sf_dir))
    operations, _ = V.snapshot_plan(base, target, 1, 1)
    left = V.version_diff(V.snapshot_applied(base, operations), target, ["kind", "object", "name"], "value")
    _, back = V.snapshot_plan(target, base, 2, 1)
    # an older format is told of every object of the target: here the base, which has some of them
    down = V.snapshot_plan(target, target, 2, 1)[1]
    policies = F.col("kind") == "policy"
    seen = base.unionByName(target.where(policies).limit(0))
    fixed = target.where(policies).select("object", F.col("value").alias("__v"))
    changed = base.join(fixed, "object", "left").withColumn("value", F.when(policies, F.col("__v")).otherwise(F.col("value"))).select(*base.columns)
    drifted = V.snapshot_plan(changed, target, 1, 1, seen)[1]
    n = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = n("applied", left).unionByName(n("downgrade", down.where("reason = 'downgrade'")))
    for reason in ("removed", "type_changed"):
        out = out.unionByName(n(reason, back.where(F.col("reason") == reason)))
    return out.unionByName(n("drift", drifted.where("reason = 'drift'")))


@query(f"""with {_SNAP} select object, sha256('[' || string_agg(x, ',' order by x) || ']') as digest from (select object, '{{"kind":"' || kind || '","name":"' || name || '","value":"' || value || '"}}' as x from t where kind <> 'object') group by 1""")
def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.canonical_digest(snapshots(spark, sf_dir)[1].where("kind <> 'object'"), "object", ["value", "kind", "name"])


@query("select o_orderkey from orders where o_orderkey % 4 = 0 and o_orderdate < timestamp '1999-10-03'")
def stale_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STATE).alias("state"), F.col("o_orderdate").alias("updated_at"))
    return V.stale_drafts(drafts, at(), 90).select("o_orderkey").unionByName(V.stale_drafts(drafts, at(), 90, hold=True).select("o_orderkey"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.orphans(table(spark, sf_dir, "lineitem"), kept, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select doc_id as file from documents where doc_id not in (select doc_id from labels) and doc_id % 72 > 48")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.timestamp_add("HOUR", -(F.col("doc_id") % 72).cast("int"), at()).alias("stored_at"))
    return V.orphan_sweep(files, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file")), at(), 48).select("file")


@query("select count(*) filter (o_orderdate >= timestamp '1998-08-20') as kept, count(*) filter (o_orderdate < timestamp '1998-08-20' and o_custkey % 6 > 0) as expired, count(*) filter (o_orderdate < timestamp '1998-08-20' and o_custkey % 6 = 0) as held from orders")
def retention_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.retention_split(table(spark, sf_dir, "orders"), "o_orderdate", at("1998-08-30"), 10, F.col("o_custkey") % 6 == 0)


@query("""with m as (select c_custkey as k, c_mktsegment as authority, 1 as version from customer where c_custkey % 5 <> 0), ch as (select c_custkey as k, 'BUILDING' as authority from customer where c_custkey % 2 = 0)
select m.k, m.authority, m.version, ch.k is not null and ch.authority <> m.authority as superseded from m left join ch using (k) union all select ch.k, ch.authority, case when m.k is null then 1 else 2 end, false from ch left join m using (k) where m.k is null or m.authority <> ch.authority""")
def authority_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    matrix = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("authority"), F.lit(1).alias("version"), F.lit(None).cast("timestamp").alias("superseded_at"))
    changes = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("BUILDING").alias("authority"))
    return V.authority_matrix(matrix, changes, "k", at()).select("k", "authority", "version", F.col("superseded_at").isNotNull().alias("superseded"))


@query("""with s as (select unnest(['connected', 'mirrored', 'augmented', 'controlled', 'primary', 'draining', 'retired']) as s, unnest(range(7)) as k), t as (select c_custkey as transfer, c_custkey % 7 as a, (c_custkey // 7) % 7 as b, list_filter(['authority', 'data', 'dependencies', 'rollback', 'sign_off'], lambda g: (c_custkey + length(g)) % 4 > 0) as passed from customer),
j as (select transfer, a, b, list_filter(case b when 3 then ['authority', 'data'] when 4 then ['authority', 'data', 'rollback'] when 6 then ['authority', 'data', 'dependencies', 'rollback', 'sign_off'] else [] end, lambda g: not list_contains(passed, g)) as missing from t)
select transfer, case when b = a or b > a + 1 or (b < a and a = 6) then 'refused' when b = a + 1 and len(missing) > 0 then 'gated' else 'done' end as outcome, case when b = a + 1 and len(missing) > 0 then array_to_string(missing, ',') end as missing from j""")
def transfer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    state = lambda k: F.element_at(F.array(*map(F.lit, V.TRANSFER_STATES)), k.cast("int") + 1)
    transfers = c.select(F.col("c_custkey").alias("transfer"), state(F.col("c_custkey") % 7).alias("state"))
    asked = c.select(F.col("c_custkey").alias("transfer"), state(F.expr("c_custkey div 7") % 7).alias("to"))
    gates = c.select(F.col("c_custkey").alias("transfer"), F.explode(F.array(*map(F.lit, V.TRANSFER_GATES["retired"]))).alias("gate")).where((F.col("transfer") + F.length("gate")) % 4 > 0)
    return V.transfer_steps(asked, transfers, gates)


@query("select c_custkey as object, c_mktsegment as field from customer where c_nationkey = 7")
def retirement_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("system"), F.col("c_custkey").alias("object"), F.col("c_mktsegment").alias("field"))
    return V.retirement_blockers(refs, "n7").select("object", "field")


@query("select event_id from events where event_id % 6 not in (1, 2, 3)")
def valid_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    grants = table(spark, sf_dir, "events").select("event_id", F.when(k == 1, at("2030-01-01")).otherwise(F.col("ts").cast("timestamp")).alias("begins_at"), F.when(k == 2, at("2024-01-01")).alias("expires_at"), F.when(k == 3, at("2024-01-01")).alias("revoked_at"), F.when(k == 4, 5).alias("max_uses"), F.lit(4).alias("uses"))
    return V.valid_grants(grants, at("2024-06-01")).select("event_id")


@query("""select distinct conv_id * 100 + turn as message, 'actor' || h as actor from (select conv_id, turn, unnest([conv_id % 30, turn, 99]) as h from conversations) where h < 20 and h % 2 = conv_id % 2""")
def handle_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of another organisation, and of nobody, resolve to nothing."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("hi @User"), F.col("conv_id") % 30, F.lit(", @user"), F.col("turn"), F.lit(" and @user99."))
    texts = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("message"), (F.col("conv_id") % 2).alias("org"), said.alias("said"))
    handles = spark.range(20).select((F.col("id") % 2).alias("org"), F.concat(F.lit("user"), F.col("id")).alias("handle"), F.concat(F.lit("actor"), F.col("id")).alias("actor"))
    return V.resolve_handles(texts, handles, "message", X.mentions(F.col("said")))


@query("select thread, actor from (select user_id as thread, event_type as actor, event_id % 3 > 0 as granted, event_id % 4 = 1 as expired, row_number() over (partition by user_id, event_type order by ts desc, event_id % 3 > 0 desc) as n from events) where n = 1 and granted and not expired")
def disclosure_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("thread"), F.col("event_type").alias("actor"), F.col("ts").alias("decided_at"), (F.col("event_id") % 3 > 0).alias("granted"), F.when(F.col("event_id") % 4 == 1, at("2024-01-01")).alias("expires_at"))
    return V.disclosed(d, at("2024-06-01"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit("see ref:part:"), F.col("event_id") % 3000, F.lit(" and ref:customer:"), F.col("user_id"), F.lit(", ref:region:1"))
    return e.select(F.col("event_id").alias("message"), (F.col("user_id") % 9).alias("thread"), F.concat(F.lit("u"), F.col("user_id")).alias("author"), body.alias("body"))


def _unfurled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = catalog(spark, sf_dir).restrict("part", "clerk", Policy("size", "lt", 30)).project("customer", "clerk", ["segment"])
    cards = {"part": governed_read(c, "part", CALLER, ["name", "size"], limit=1000), "customer": governed_read(c, "customer", CALLER, ["name", "segment"], limit=1000)}
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("actor"), F.col("c_name").alias("name"))
    shown = names.select(F.when(F.length("actor") % 2 == 0, 3).cast("long").alias("thread"), "actor").where("length(actor) < 4")
    return V.unfurled(_messages(spark, sf_dir), cards, "ref", names, shown, "u7")


@query("""with p as (select p_partkey, p_name, p_size from part where p_size < 30 order by p_partkey limit 1000), c as (select c_custkey, c_mktsegment from customer order by c_custkey limit 1000)
select event_id as message, 'part' as slug, cast(p_partkey as varchar) as id, '{"name":"' || p_name || '","size":' || p_size || '}' as card from events join p on p_partkey = event_id % 3000
union all select event_id, 'customer', cast(c_custkey as varchar), '{"segment":"' || c_mktsegment || '"}' from events join c on c_custkey = user_id""")
def unfurled_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to parts, customers and regions: each under its own object's policies and projection; what is hidden gives no card."""
    return _unfurled(spark, sf_dir)[1]


@query("select event_id as message, case when user_id = 7 or (length('u' || user_id) = 2 and user_id % 9 = 3) or length('u' || user_id) = 3 then coalesce(c_name, 'actor-' || sha256('u' || user_id)[1:8]) else 'actor-' || sha256('u' || user_id)[1:8] end as author from events left join customer on c_custkey = user_id")
def disclosed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfurled(spark, sf_dir)[0].select("message", "author")


@query("select c_custkey, '••••••' as c_name, c_mktsegment from customer where c_nationkey % 3 = 0")
def support_masked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org"), F.when(F.col("n_nationkey") % 3 == 0, at("2030-01-01")).otherwise(at("2020-01-01")).alias("expires_at"))
    return V.support_read(table(spark, sf_dir, "customer"), ["c_name"], sessions, "c_nationkey", at("2024-01-01")).select("c_custkey", "c_name", "c_mktsegment")


@query("""with c as (select o_custkey as b, min(o_orderdate) as s, max(o_orderdate) as e, max(o_orderdate) filter (o_orderkey % 2 = 0) as w from orders group by 1), p as (select o_custkey as b, min(o_orderdate) as s, max(o_orderdate) as e from orders where o_orderkey % 3 > 0 group by 1)
select c.b as backup, coalesce(c.s < p.e and p.s < c.e, false) and coalesce(p.e >= c.w, false) as compatible, case when not coalesce(c.s < p.e and p.s < c.e, false) then 'windows apart' when not coalesce(p.e >= c.w, false) then 'watermark not covered' else 'fits' end as detail from c left join p using (b)""")
def restore_rehearsal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    core = o.groupBy(F.col("o_custkey").alias("backup")).agg(F.min("o_orderdate").alias("window_start"), F.max("o_orderdate").alias("window_end"), F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))).alias("watermark"))
    sealed = o.where("o_orderkey % 3 > 0").groupBy(F.col("o_custkey").alias("backup")).agg(F.min("o_orderdate").alias("window_start"), F.max("o_orderdate").alias("window_end"))
    return V.rehearsal(core, sealed)


@query("select l_orderkey, l_linenumber, l_partkey, case when p_partkey is null then 'orphan' else 'available' end as state from lineitem left join (select p_partkey from part where p_size < 40) on l_partkey = p_partkey")
def reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return V.reference_split(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), restored, "l_partkey")


@query("select 'labels' as \"table\", cast(doc_id as varchar) as record, count(*) as rows from labels where doc_id % 10 = 0 group by all union all select 'documents', cast(doc_id as varchar), count(*) from documents where doc_id % 10 = 0 group by all")
def record_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kept, proof = V.erased({"documents": (d, "doc_id"), "labels": (table(spark, sf_dir, "labels"), "doc_id")}, d.where("doc_id % 10 = 0"), "doc_id", at())
    if kept["documents"].where("doc_id % 10 = 0").limit(1).count():
        raise AssertionError("an erased record is still there")
    return proof.select("table", "record", "rows")


@query("select c_custkey as profile, case when c_custkey % 4 = 0 then 9 when c_custkey % 4 = 2 and c_custkey % 3 > 0 then 4 else 5 end as release, case when c_custkey % 4 = 0 then 5 when c_custkey % 4 = 2 or c_custkey % 3 = 0 then null else 4 end as previous, case c_custkey % 4 when 0 then 'released' when 1 then 'not_published' when 2 then case when c_custkey % 3 = 0 then 'nothing_before' else 'rolled_back' end else 'unchanged' end as outcome from customer")
def release_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pointers = c.select(F.col("c_custkey").alias("profile"), F.lit(5).alias("release"), F.when(F.col("c_custkey") % 3 > 0, 4).alias("previous"))
    releases = c.select(F.col("c_custkey").alias("profile"), F.explode(F.array(F.lit(5), F.lit(9))).alias("release")).withColumn("published", (F.col("release") == 5) | (F.col("profile") % 4 == 0))
    act = F.col("c_custkey") % 4
    acts = c.select(F.col("c_custkey").alias("profile"), F.when(act == 2, "rollback").otherwise("release").alias("act"), F.when(act < 2, 9).when(act == 3, 5).alias("release"))
    return V.release_pointers(pointers, releases, acts)


@query("select o_custkey as app, max(o_orderkey) as version from orders where o_orderstatus = 'F' and o_custkey % 2 = 0 group by 1")
def published_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    versions = o.select(F.col("o_custkey").alias("app"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"))
    return V.published_apps(o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("app")).distinct(), versions)


@query("select c_custkey, case when c_custkey % 5 = 0 then null else c_name end as plain, c_custkey % 5 <> 0 as keyed, 2 as version from customer")
def envelope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sealed under a key of each record; the master key is rotated, every fifth record is shredded, and the rest is read with the new one alone."""
    masters = {1: b"0123456789abcdef", 2: b"fedcba9876543210"}
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    keys = written(S.fresh_keys(c, "c_custkey", masters[1], 1))
    stored = written(S.sealed(c, keys, "c_custkey", ["c_name"], masters))
    rotated = written(S.shredded(S.rewrapped(keys, masters, 2), c.where("c_custkey % 5 = 0"), "c_custkey"))
    read = S.unsealed(stored, rotated, "c_custkey", ["c_name"], {2: masters[2]})
    kept = rotated.select(F.col("c_custkey").alias("k"), "version")
    return read.join(kept, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("c_name").alias("plain"), F.col("k").isNotNull().alias("keyed"), F.coalesce("version", F.lit(2)).alias("version"))
