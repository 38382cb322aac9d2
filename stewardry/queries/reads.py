"""Governed reads over the driver's tables: projections, filters, policies, joins, order; and scalar transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions import seal as S
from stewardry.functions import transforms as X
from stewardry.operators.search import index_rows, lexical_search
from stewardry.plans.catalog import DENY_ALL, Catalog, Context, Field, Object, Policy
from stewardry.plans.reads import Filter, Order, dashboard, governed_count, governed_read, governed_rows, plan_hash, visible_ids
from stewardry.queries import query
from stewardry.session import table

CALLER = Context("all", "u7", "clerk")
INDEX_KEY, PROJECTION_SECRET = b"index-key-of-the-test-tables", b"projection-secret"


def catalog(spark: SparkSession, sf_dir: str, tenants: bool = False) -> Catalog:
    """All tables as objects. With tenants, customers are of the organisation of their nation's parity and orders of their customer key's."""
    c = Catalog(spark, sf_dir, INDEX_KEY, PROJECTION_SECRET)
    c.add(
        Object("region", "region.parquet", (Field("name", source="r_name"),), "r_regionkey"),
        Object("nation", "nation.parquet", (Field("name", source="n_name"), Field("region", "relation", "n_regionkey", "region")), "n_nationkey"),
        Object(
            "customer", "customer.parquet",
            (
                Field("name", source="c_name"), Field("balance", "number", "c_acctbal"), Field("segment", "select", "c_mktsegment"), Field("nation", "relation", "c_nationkey", "nation"),
                Field("email", "email", "concat(lower(replace(c_name, '#', '.')), '@example.org')"), Field("phone", "phone", "concat('+1 (', c_nationkey, ') ', c_custkey)"),
                Field("grade", extension=True, source="grade"), Field("home", "relation", "home", "region", extension=True),
            ),
            "c_custkey", tenant="concat('o', c_nationkey % 2)" if tenants else "'all'", extension_path="unused", extension_id="record_id",
        ),
        Object("supplier", "supplier.parquet", (Field("name", source="s_name"), Field("balance", "number", "s_acctbal"), Field("nation", "relation", "s_nationkey", "nation")), "s_suppkey"),
        Object("part", "part.parquet", (Field("name", source="p_name"), Field("brand", source="p_brand"), Field("type", "select", "p_type"), Field("size", "number", "p_size"), Field("price", "currency", "p_retailprice")), "p_partkey"),
        Object(
            "deal", "orders.parquet",
            (Field("status", "select", "o_orderstatus"), Field("total", "currency", "o_totalprice"), Field("day", "datetime", "o_orderdate"), Field("priority", source="o_orderpriority"), Field("customer", "relation", "o_custkey", "customer"), Field("owner", source="concat('u', o_custkey % 10)")),
            "o_orderkey", tenant="concat('o', o_custkey % 2)" if tenants else "'all'", created_at="o_orderdate",
        ),
        Object("record", "orders.parquet", (Field("total", "currency", "o_totalprice"), Field("priority", source="o_orderpriority")), "o_orderkey", created_at="o_orderdate", lifecycle="case o_orderstatus when 'F' then 'published' when 'O' then 'draft' else 'archived' end"),
        Object("note", "documents.parquet", (Field("text", source="text"), Field("lang", "select", "lang"), Field("source", source="source"), Field("chars", "number", "n_chars")), "doc_id"),
        Object("event", "events.parquet", (Field("type", "select", "event_type"), Field("value", "number", "value"), Field("at", "datetime", "ts")), "event_id", created_at="ts"),
    )
    customers = table(spark, sf_dir, "customer")
    return c.over("customer.extension", customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("g"), F.col("c_custkey") % 4).alias("grade"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") % 5).alias("home")))


GRID = ["status", "total", "customer.name"]


@query("select o_orderkey as __id, o_orderstatus as status, o_totalprice as total, c_name as \"customer.name\" from orders left join customer on o_custkey = c_custkey where o_totalprice >= 400000 and c_mktsegment = 'BUILDING' order by o_orderdate desc, o_orderkey limit 200")
def grid_orders_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "deal", CALLER, GRID, [Filter("total", "gte", "400000"), Filter("customer.segment", "eq", "BUILDING")], limit=200)


@query("select c_custkey as __id, c_name as name, n_name as \"nation.name\" from customer left join nation on c_nationkey = n_nationkey where n_name in ('NATION_1', 'NATION_7') order by n_name, c_acctbal desc, c_custkey limit 1000")
def relation_two_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["name", "nation.name"], [Filter("nation.name", "in", ["NATION_1", "NATION_7"])], [Order("nation.name"), Order("balance", True)], 5000)


@query("select c_custkey as __id, c_name as name, '••••••' as email from customer order by c_custkey limit 1000")
def masked_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["name", "email"], limit=1000)


def _hmac_sql(key: bytes, message: str) -> str:
    """HMAC-SHA256 as hex of a blob expression."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda b: bytes(x ^ b for x in key.ljust(64, b"\0")).hex()
    return f"sha256(from_hex('{pad(0x5C)}') || from_hex(sha256(from_hex('{pad(0x36)}') || {message})))"


def _digest_sql(field: str, value: str) -> str:
    import hashlib

    head = (hashlib.sha256(b"all").digest()[:16] + hashlib.sha256(field.encode()).digest()[:16]).hex()
    return _hmac_sql(INDEX_KEY, f"from_hex('{head}') || encode({value})")


_PHONE = "regexp_replace('+1 (' || c_nationkey || ') ' || c_custkey, '[^0-9+]', '', 'g')"
_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.org'"


@query(f"select c_custkey as __id, 'pk_' || {_hmac_sql(PROJECTION_SECRET, 'encode(' + _digest_sql('customer.phone', _PHONE) + ')')}[1:40] as \"phone:key\" from customer")
def projection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_rows(catalog(spark, sf_dir), "customer", CALLER, ["phone:key"])


@query("select c_custkey as __id, c_name as name from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1000")
def role_projection_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).project("customer", "clerk", ["name", "segment"])
    return governed_read(c, "customer", CALLER, ["name", "balance"], [Filter("segment", "eq", "BUILDING")], limit=1000)


@query("select c_custkey as __id from customer")
def role_deny_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_rows(catalog(spark, sf_dir).project("customer", "clerk", [DENY_ALL]), "customer", CALLER, ["name"])


@query("select o_orderkey as __id, o_orderstatus as status, c_name as \"customer.name\" from orders left join customer on o_custkey = c_custkey where o_totalprice > 450000 order by o_orderdate desc, o_orderkey limit 500")
def related_field_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the relation's target that the role doesn't see is left out, the others stay."""
    c = catalog(spark, sf_dir).project("customer", "clerk", ["name"])
    return governed_read(c, "deal", CALLER, ["status", "customer.name", "customer.balance"], [Filter("total", "gt", 450000)], limit=500)


@query("select c_custkey as __id, c_name as name, case when c_custkey % 3 = 0 then 'g' || c_custkey % 4 end as grade from customer order by c_acctbal desc, c_custkey limit 1000")
def extension_field_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["name", "grade"], order=[Order("balance", True)], limit=1000)


@query("select c_custkey as __id, r_name as \"home.name\" from customer left join region on case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then c_nationkey % 5 end = r_regionkey where r_name is not null order by r_name desc, c_custkey limit 1000")
def extension_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, evolved relation, target: two joins in a row."""
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["home.name"], [Filter("home.name", "is_not_null")], [Order("home.name", True)], 1000)


@query("""select '{"id":' || c_custkey || ',"name":"' || c_name || '","balance":' || case when c_acctbal = floor(c_acctbal) then cast(cast(c_acctbal as bigint) as varchar) else cast(c_acctbal as varchar) end || ',"none":null}' as json from customer""")
def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(X.row_json({"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.col("c_acctbal"), "none": F.lit(None).cast("string")}, ["balance"]).alias("json"))


@query("""select * from (select 'customer' as object, 'segment' as field, c_mktsegment as value, count(*) as n from customer group by all union all select 'deal', 'status', o_orderstatus, count(*) from orders group by all union all select 'note', 'lang', lang, count(*) from documents group by all union all select 'part', 'type', p_type, count(*) from part group by all union all select 'event', 'type', event_type, count(*) from events group by all)""")
def describe_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every select field that a role may see, the values that its object holds and how often."""
    c = catalog(spark, sf_dir).project("supplier", "clerk", [DENY_ALL])
    out = None
    for r in c.describe("clerk").where("kind = 'select' and field <> 'priority' and object <> 'record'").orderBy("object", "field").collect():
        rows = c.open(r.object, CALLER).select(F.expr(c.get(r.object).find(r.field).expr()).alias("value"))
        part = rows.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(r.object).alias("object"), F.lit(r.field).alias("field"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("select o_orderkey as __id, o_orderstatus as status from orders where nullif(o_orderpriority, '1-URGENT') <> '5-LOW' and o_totalprice > 480000 order by o_orderdate desc, o_orderkey limit 1000")
def filter_ne_drops_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    frame = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return governed_read(c.over("deal", frame), "deal", CALLER, ["status"], [Filter("priority", "ne", "5-LOW"), Filter("total", "gt", 480000)], limit=1000)


@query("select p_partkey as __id, p_name as name from part where p_brand in ('Brand#2', 'Brand#17') order by p_name, p_partkey limit 1000")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "part", CALLER, ["name"], [Filter("brand", "in", ["Brand#2", "Brand#17"])], [Order("name")], 1000)


@query("select p_partkey as __id, p_name as name from part where false")
def filter_in_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "part", CALLER, ["name"], [Filter("brand", "in", [])])


@query("select p_partkey as __id, p_name as name from part where contains(lower(p_name), 'wid') order by p_partkey limit 1000")
def filter_contains_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "part", CALLER, ["name"], [Filter("name", "contains", "WID")], limit=1000)


@query("select c_custkey as __id, replace(c_name, '#', '_%') as name from customer where contains(replace(c_name, '#', '_%'), '_%0000000') order by c_custkey limit 1000")
def filter_wildcards_are_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).over("customer", table(spark, sf_dir, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit("_%"))))
    return governed_read(c, "customer", CALLER, ["name"], [Filter("name", "contains", "_%0000000")], limit=1000)


@query("select p_partkey as __id, p_name as name from part where starts_with(lower(p_name), 'red') order by p_partkey limit 1000")
def filter_starts_with_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "part", CALLER, ["name"], [Filter("name", "starts_with", "RED")], limit=1000)


@query("select c_custkey as __id, c_name as name from customer where c_custkey % 3 <> 0 order by c_custkey limit 1000")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["name"], [Filter("grade", "is_null")], limit=1000)


@query("select o_orderkey as __id, o_orderstatus as status, c_custkey as \"customer.__id\" from orders left join customer on o_custkey = c_custkey where o_orderkey in (1, 5, 9, 12, 77) and c_custkey > 100 order by o_orderdate desc, o_orderkey limit 250")
def filter_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "deal", CALLER, ["status", "customer.__id"], [Filter("__id", "in", [1, 5, 9, 12, 77]), Filter("customer.__id", "gt", 100)])


@query("select event_id as __id, event_type as type from events where ts >= timestamp '2024-01-05 06:00:00' and ts < timestamp '2024-01-05 12:30:00' and value > 12.5 order by ts desc, event_id limit 1000")
def filter_typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and numbers given as texts."""
    return governed_read(catalog(spark, sf_dir), "event", CALLER, ["type"], [Filter("at", "gte", "2024-01-05T06:00:00Z"), Filter("at", "lt", "2024-01-05 12:30:00"), Filter("value", "gt", " 12.5 ")], limit=1000)


@query(f"select c_custkey as __id, c_name as name from customer where {_EMAIL} in ('customer.000000003@example.org', 'customer.000000011@example.org') order by c_custkey limit 250")
def sealed_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["name"], [Filter("email", "in", [" Customer.000000003@Example.org", "customer.000000011@example.org"])])


@query("select o_orderkey as __id, o_totalprice as total from orders where o_totalprice < 50000 and o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 1000")
def row_policy_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).restrict("deal", "clerk", Policy("total", "lt", 50_000))
    return governed_read(c, "deal", CALLER, ["total"], [Filter("status", "eq", "F")], [Order("total", True)], 1000)


@query("select c_custkey as __id, c_name as name from customer where c_mktsegment in ('BUILDING', 'HOUSEHOLD') and c_nationkey is not null order by c_custkey limit 1000")
def row_policy_in_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).restrict("customer", "clerk", Policy("segment", "in", ["BUILDING", "HOUSEHOLD"]), Policy("nation", "is_not_null"))
    return governed_read(c, "customer", CALLER, ["name"], limit=1000)


@query("select o_orderkey as __id, o_totalprice as total from orders where o_custkey % 10 = 7 order by o_orderdate desc, o_orderkey limit 1000")
def row_policy_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir).restrict("deal", "clerk", Policy("owner", "eq", {"actor": "id"})), "deal", CALLER, ["total"], limit=1000)


@query("select o_orderkey as __id, o_totalprice as total from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 300")
def lifecycle_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "record", CALLER, ["total"], limit=300)


@query("select o_orderkey as __id, o_totalprice as total from orders where o_orderstatus <> 'P' order by o_orderdate desc, o_orderkey limit 300")
def lifecycle_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir).restrict("record", "clerk", Policy("lifecycle_state", "neq", "archived")), "record", CALLER, ["total"], limit=300)


_HITS = "select p_partkey as id, 1.0 / len(string_split(p_name, ' ')) as score from part where list_contains(string_split(p_name, ' '), 'red')"


@query(f"select id, score from ({_HITS}) join part on id = p_partkey where p_size < 20")
def policy_semi_join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).restrict("part", "clerk", Policy("size", "lt", 20))
    return lexical_search(index_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name"), "Red", visible_ids(c, "part", CALLER), None).select("id", "score")


@query("select o_orderkey as __id, o_totalprice as total, case when c_nationkey % 2 = 1 then c_name end as \"customer.name\" from orders left join customer on o_custkey = c_custkey where o_custkey % 2 = 1 order by o_orderdate desc, o_orderkey limit 1000")
def tenant_isolated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir, True), "deal", Context("o1", "u1", "clerk"), ["total", "customer.name"], limit=1000)


@query("select 'record' as object, count(*) as n from orders where o_orderstatus = 'F' and o_totalprice >= 100000")
def policy_aware_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_count(catalog(spark, sf_dir).restrict("record", "clerk", Policy("total", "gte", 100_000)), "record", CALLER)


@query("select c_custkey as __id, case when c_custkey % 3 = 0 then 'g' || c_custkey % 4 end as grade from customer where c_custkey < 900 order by grade desc nulls first, c_custkey limit 1000")
def nulls_first_when_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "customer", CALLER, ["grade"], [Filter("__id", "lt", 900)], [Order("grade", True)], 1000)


@query("select event_id as __id, event_type as type from events order by ts desc nulls first, event_id limit 250")
def default_order_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed_read(catalog(spark, sf_dir), "event", CALLER, ["type"])


@query("select 'ok' as panel, count(*) as n from (select 1 from orders where o_totalprice > 300000 limit 1000) union all select 'denied', 0 union all select 'wrong', 0")
def dashboard_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel that the viewer may not see, and one that is malformed, tell so and leave the others alone."""
    c = catalog(spark, sf_dir).project("customer", "clerk", ["name"])
    panels = {
        "ok": {"slug": "deal", "select": ["total"], "where": [Filter("total", "gt", 300000)], "limit": 1000, "x": 0, "y": 0, "w": 12, "h": 2},
        "denied": {"slug": "customer", "select": ["name"], "where": [Filter("balance", "gt", 0)], "x": 12, "y": 0, "w": 12, "h": 2}, "wrong": {"slug": "deal", "select": ["nothing"], "x": 0, "y": 2, "w": 24, "h": 1},
    }
    out = None
    for name, shown in dashboard(c, CALLER, panels).items():
        n = shown.agg(F.count("*").alias("n")) if isinstance(shown, DataFrame) else spark.range(1).select(F.lit(0).cast("long").alias("n"))
        part = n.select(F.lit(name).alias("panel"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"select c_custkey, {_digest_sql('customer.email', _EMAIL)} as digest, {_digest_sql('customer.phone', _PHONE)} as phone_digest from customer")
def blind_index_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), catalog(spark, sf_dir).get("customer")
    at = lambda name, kind: S.blind_index(INDEX_KEY, "all", f"customer.{name}", F.expr(o.find(name).expr()), kind)
    return c.select("c_custkey", at("email", "email").alias("digest"), at("phone", "phone").alias("phone_digest"))


@query("""select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, least(greatest(c_acctbal, 100.0), 9000.0) as clamped, '***' || right(c_name, 3) as masked, 'tok_' || sha256('"' || c_name || '"')[1:16] as token, try_cast(substr(c_name, 10) as double) as parsed, case when c_mktsegment = 'BUILDING' then 'b:' || c_mktsegment else '[unavailable]' end as told from customer""")
def field_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, adapter = F.col("c_name"), lambda c: F.when(c == "BUILDING", F.concat(F.lit("b:"), c))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.bucket(F.col("c_acctbal"), [0, 5000], ["debt", "low", "high"]).alias("band"), X.clamp(F.col("c_acctbal"), 100, 9000).alias("clamped"), X.mask(name, 3).alias("masked"), X.tokenised(name).alias("token"), X.number(F.substring(name, 10, 99)).alias("parsed"), X.modelled(F.col("c_mktsegment"), adapter).alias("told"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 10.0, 0) / 10.0 as rounded from lineitem")
def round_to_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.round_half_away(F.col("l_extendedprice"), 1).alias("rounded"))


@query(r"""select doc_id, array_to_string(list_transform(list_filter(list_distinct_ordered, lambda h: h <> ''), lambda h: h), ',') as handles from (select doc_id, list_reduce(list_concat([cast([] as varchar[])], list_transform(regexp_extract_all(' ' || coalesce(text, ''), '[^A-Za-z0-9._-]@([A-Za-z0-9._-]+)', 1), lambda h: [regexp_replace(h, '[.-]+$', '')])), lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end) as list_distinct_ordered from documents)""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.mentions(F.col("text")), ",").alias("handles"))


_TOLD = "'see ref:conversation:' || conv_id || ', ' || coalesce(text, '') || ' ref:conversation:' || conv_id || case when conv_id % 2 = 0 then ' (ref:turn:' || turn || ')' else '' end"


@query(rf"select conv_id, turn, array_to_string(list_filter(found, lambda x, k: list_position(found, x) = k), ',') as refs from (select conv_id, turn, regexp_extract_all({_TOLD}, '\bref:[a-z][a-z0-9_]*:[0-9A-Za-z-]+') as found from conversations)")
def object_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References around and in the whole text of every message; null where its conversation, or a turn that is told, is null."""
    c = table(spark, sf_dir, "conversations")
    told = F.concat(F.lit("see ref:conversation:"), F.col("conv_id"), F.lit(", "), F.coalesce("text", F.lit("")), F.lit(" ref:conversation:"), F.col("conv_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" (ref:turn:"), F.col("turn"), F.lit(")"))).otherwise(F.lit("")))
    refs = F.array_join(X.object_references(F.col("told"), "ref"), ",")
    return c.select("conv_id", "turn", told.alias("told")).select("conv_id", "turn", F.when(F.col("told").isNotNull(), refs).alias("refs"))


_SLUG = "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"select p_partkey, case when n > 1 then h || '-' || n else h end as handle from (select p_partkey, {_SLUG} as h, row_number() over (partition by {_SLUG} order by p_partkey) as n from part)")
def handle_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that many share are numbered by ranges, not by one task a name."""
    from stewardry.operators.numbering import numbered

    base = table(spark, sf_dir, "part").select("p_partkey", X.handle(F.col("p_name")).alias("base"))
    return numbered(base, ["base"], ["p_partkey"], "n").select("p_partkey", X.suffixed(F.col("base"), F.col("n")).alias("handle"))


@query("select user_id, 'actor-' || sha256(cast(user_id as varchar))[1:8] as handle, count(*) as n from events group by user_id")
def stable_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", X.stable_handle(F.col("user_id")).alias("handle"), "n")


@query("select event_id, strftime(ts, '%H:%M') >= '22:00' or strftime(ts, '%H:%M') < '07:30' as quiet, case when strftime(ts, '%H:%M') >= '22:00' then date_trunc('day', ts) + interval 31 hour + interval 30 minute when strftime(ts, '%H:%M') < '07:30' then date_trunc('day', ts) + interval 7 hour + interval 30 minute end as until from events")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", X.is_quiet(F.col("ts"), "22:00", "07:30").alias("quiet"), X.quiet_until(F.col("ts"), "22:00", "07:30").cast("timestamp_ntz").alias("until"))


@query("""select event_id, '{"k":"' || cast(json_extract_string(props, '$.k') as varchar) || '","type":"' || event_type || '"}' as patched from events""")
def json_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.json_set(F.col("props"), "type", F.col("event_type"), ["k"]).alias("patched"))


@query("""select event_id, case when event_id % 2 = 0 then '{"k":"' || json_extract_string(props, '$.k') || '","mail":"••••••"}' else '{"k":"' || json_extract_string(props, '$.k') || '","note":"••••••"}' end as shown from events""")
def sealed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed values and sensitive keys of JSON rows, masked wherever they stand."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    ref = F.concat(F.lit('{"k":"'), k, F.lit('","mail":{"pii_ref":"r'), F.col("event_id"), F.lit('","bidx":"x"}}'))
    note = F.concat(F.lit('{"k":"'), k, F.lit('","note":"'), F.col("event_type"), F.lit('"}'))
    return e.select("event_id", X.masked_sealed(F.when(F.col("event_id") % 2 == 0, ref).otherwise(note), ["note"], S.MASK).alias("shown"))


@query("select '# part ' || p_partkey || chr(10) || '- **name**: ' || p_name || chr(10) || '- **brand**: ' || coalesce(nullif(p_brand, 'Brand#2'), '(empty)') as page from part")
def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(X.record_page(F.lit("part"), F.col("p_partkey"), {"name": F.col("p_name"), "brand": F.nullif("p_brand", F.lit("Brand#2"))}).alias("page"))


@query("""select c_custkey, concat_ws(',', case when c_acctbal < 0 then 'balance:min' end, case when c_acctbal > 9000 then 'balance:max' end, case when c_name like '%7' then 'name:pattern' end, case when c_mktsegment not in ('BUILDING', 'HOUSEHOLD') then 'segment:options' end) as broken from customer""")
def write_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rules = {"balance": {"required": True, "min": 0, "max": 9000}, "name": {"pattern": ".*[^7]", "max_length": 40}, "segment": {"options": ["BUILDING", "HOUSEHOLD"]}}
    return rows.select("c_custkey", F.array_join(X.broken_rules(rules), ",").alias("broken"))


@query("select c_custkey, 'u7' as owner, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer")
def write_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return c.select("c_custkey", X.preset(F.col("c_name"), {"actor": "id"}, "always", "u7").alias("owner"), X.preset(segment, "none", "missing").alias("segment"))


@query("select o_orderstatus as status, count(*) as n, 64 as digits from orders group by o_orderstatus")
def plan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that differ in one value have different digests; each is told with the rows that it finds."""
    c, out, seen = catalog(spark, sf_dir), None, set()
    for status in ("F", "O", "P"):
        where = [Filter("status", "eq", status)]
        seen.add(digest := plan_hash("deal", CALLER, ["total"], where))
        part = governed_count(c.restrict("deal", "clerk", Policy("status", "eq", status)), "deal", CALLER).select(F.lit(status).alias("status"), "n", F.lit(len(digest)).alias("digits"))
        out = part if out is None else out.unionByName(part)
    if len(seen) != 3:
        raise AssertionError("requests share a digest")
    return out
