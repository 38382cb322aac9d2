"""Plans: what reaches the scan, and requests that are refused."""

from __future__ import annotations

import datetime

import pytest

from stewardry.plans.catalog import DENY_ALL, Catalog, Context, Field, Forbidden, Object, Policy, Refused, checked_grid
from stewardry.plans.reads import Filter, Order, dashboard, governed_read, plan_hash, typed
from stewardry.queries.reads import CALLER, catalog


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    df = governed_read(catalog(spark, data), "deal", CALLER, ["status"], [Filter("total", "gt", 400000)])
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in text
    assert "o_orderpriority" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in text


def test_a_relation_is_joined_once(spark, data):
    df = governed_read(catalog(spark, data), "deal", CALLER, ["customer.name", "customer.segment"], [Filter("customer.balance", "gt", 0)], [Order("customer.name")])
    assert plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Join") == 1


def test_refused_requests(spark, data):
    c = catalog(spark, data)
    read = lambda *a, **b: governed_read(c, "customer", CALLER, *a, **b)
    for bad in (lambda: read([]), lambda: read(["nothing"]), lambda: read(["nation.region.name"]), lambda: read(["name"], [Filter("balance", "eq", None)]), lambda: read(["name"], [Filter("balance", "contains", "1")]),
                lambda: read(["name"], [Filter("email", "lt", "a")]), lambda: read(["name"], order=[Order("email")]), lambda: read(["name:key"]), lambda: read(["name"], [Filter("name", "like", "x")])):
        with pytest.raises(Refused):
            bad()
    c.project("customer", "clerk", ["name"])
    with pytest.raises(Forbidden):
        read(["name"], [Filter("balance", "gt", 0)])
    with pytest.raises(Forbidden):
        read(["name"], order=[Order("balance")])
    with pytest.raises(Refused):
        read(["balance"])
    c.project("customer", "clerk", [DENY_ALL])
    assert read(["name"]).columns == ["__id"]
    with pytest.raises(Forbidden):
        governed_read(Catalog(spark, data).add(Object("customer", "customer.parquet", (Field("email", "email", "c_name"),), "c_custkey")), "customer", CALLER, ["email"], [Filter("email", "eq", "x")])


def test_policies_are_checked_before_any_is_set(spark, data):
    c = catalog(spark, data)
    c.restrict("deal", "clerk", Policy("total", "lt", 5))
    for bad in (Policy("email", "eq", "x"), Policy("grade", "eq", "x")):
        with pytest.raises(Refused):
            c.restrict("customer", "clerk", bad)
    with pytest.raises(Refused):
        c.restrict("deal", "clerk", Policy("total", "gt", 1), Policy("lifecycle_state", "eq", "draft"))
    assert c.policies_of("deal", "clerk") == (Policy("total", "lt", 5),)


def test_literals():
    assert typed("number", " 12 ") == 12 and str(typed("number", "1.50")) == "1.50"
    assert typed("boolean", "TRUE") is True and typed("date", "2024-02-29") == datetime.date(2024, 2, 29)
    assert typed("datetime", "2024-01-01 00:00:00").tzinfo is datetime.timezone.utc
    for kind, bad in (("number", "x"), ("number", True), ("boolean", 1), ("date", "2024-13-01"), ("multi_select", "a"), ("text", 5)):
        with pytest.raises(Refused):
            typed(kind, bad)


def test_packs_and_hashes(spark, data):
    pack = '[objects.thing]\npath = "part.parquet"\nid = "p_partkey"\nfields = [{name = "name", source = "p_name"}, {name = "size", kind = "number", source = "p_size"}]\n'
    c = Catalog(spark, data).load_pack(pack).load_pack(pack)
    assert governed_read(c, "thing", CALLER, ["name"], [Filter("size", "gt", 45)]).count() > 0
    ctx = Context("all", "a", "r")
    assert plan_hash("x", ctx, ["a"], [Filter("a", "eq", 1)]) != plan_hash("x", ctx, ["a"], [Filter("a", "eq", "1")])


def test_grid():
    assert checked_grid([{"x": 0, "y": 0, "w": 12, "h": 2}, {"x": 12, "y": 0, "w": 12, "h": 2}])
    for bad in ([{"x": 20, "y": 0, "w": 5, "h": 1}], [{"x": 0, "y": 0, "w": 2, "h": 2}, {"x": 1, "y": 1, "w": 2, "h": 2}], [{"x": 0, "y": k, "w": 1, "h": 1} for k in range(65)]):
        with pytest.raises(Refused):
            checked_grid(bad)


def test_a_panel_that_fails_leaves_the_others(spark, data):
    out = dashboard(catalog(spark, data), CALLER, {"a": {"slug": "part", "select": ["name"]}, "b": {"slug": "nothing", "select": ["x"]}})
    assert out["a"].count() > 0 and "nothing" in out["b"]
