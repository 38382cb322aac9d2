"""What there is and who may see it: objects over tables, fields, relations, tenancy, projections, policies, packs."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("text", "url", "select", "email", "phone", "file", "richtext", "number", "currency", "boolean", "date", "datetime", "multi_select", "relation")
SENSITIVE_KINDS = ("email", "phone")
POLICY_OPS = ("eq", "neq", "in", "lt", "lte", "gt", "gte", "is_null", "is_not_null")
RESERVED = ("id", "organization_id", "version", "created_at", "updated_at", "lifecycle_state", "select", "table", "user", "order")
DENY_ALL = "__deny_all"


class Refused(ValueError):
    """A request that is malformed."""


class Forbidden(PermissionError):
    """A request that the caller may not make."""


@dataclass(frozen=True)
class Context:
    """The caller: organisation, actor, role."""

    org: str
    actor: str
    role: str


@dataclass(frozen=True)
class Field:
    """name; kind; column or SQL expression of the table (the name if none); target of a relation; sensitive: sealed, shown masked."""

    name: str
    kind: str = "text"
    source: str | None = None
    target: str | None = None
    sensitive: bool = False
    extension: bool = False
    rules: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)

    def expr(self) -> str:
        return self.source or f"`{self.name}`"


@dataclass(frozen=True)
class Object:
    """slug; path of its table below the catalog's root; fields; SQL expressions of id, organisation, creation time and lifecycle state."""

    slug: str
    path: str
    fields: tuple[Field, ...]
    id: str
    tenant: str = "'all'"
    created_at: str | None = None
    lifecycle: str | None = None
    extension_path: str | None = None
    extension_id: str = "record_id"
    extension_tenant: str = "'all'"

    def find(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise Refused(f"{self.slug} has no field {name!r}")


@dataclass(frozen=True)
class Policy:
    """A condition on rows: a base field (or __id, lifecycle_state), an operator and a value; {"actor": "id"} is the caller."""

    field: str
    op: str
    value: Any = None


class Catalog:
    def __init__(self, spark: SparkSession, root: str, index_key: bytes | None = None, projection_secret: bytes | None = None):
        self.spark, self.root, self.index_key, self.projection_secret = spark, root, index_key, projection_secret
        self.objects: dict[str, Object] = {}
        self.projections: dict[tuple[str, str], frozenset[str]] = {}
        self.policies: dict[tuple[str, str], tuple[Policy, ...]] = {}
        self.frames: dict[str, DataFrame] = {}

    def add(self, *objects: Object) -> Catalog:
        for o in objects:
            if not re.fullmatch(r"[a-z][a-z0-9_]{0,62}", o.slug) or o.slug in RESERVED:
                raise Refused(f"{o.slug!r} is no slug")
            names = [f.name for f in o.fields]
            if len(set(names)) != len(names):
                raise Refused(f"{o.slug} has a field twice")
            for f in o.fields:
                if f.kind not in KINDS:
                    raise Refused(f"{f.name}: unknown kind {f.kind!r}")
                if (f.kind == "relation") != (f.target is not None):
                    raise Refused(f"{f.name}: a relation has a target, and nothing else has")
                if f.sensitive and f.kind not in ("text", *SENSITIVE_KINDS):
                    raise Refused(f"{f.name}: only texts, addresses and phone numbers are sealed")
            self.objects[o.slug] = o
        return self

    def over(self, slug: str, frame: DataFrame) -> Catalog:
        """Binds an object to a DataFrame rather than to its path."""
        self.frames[slug] = frame
        return self

    def get(self, slug: str) -> Object:
        if slug not in self.objects:
            raise Refused(f"no object {slug!r}")
        return self.objects[slug]

    def project(self, slug: str, role: str, fields: Iterable[str]) -> Catalog:
        """The fields a role sees of an object; an object without any projection is open. [DENY_ALL]: the id only."""
        chosen = frozenset(fields)
        for name in chosen - {DENY_ALL}:
            self.get(slug).find(name)
        self.projections[slug, role] = frozenset() if DENY_ALL in chosen else chosen
        return self

    def sees(self, slug: str, role: str, name: str) -> bool:
        open_to_all = not any(s == slug for s, _ in self.projections)
        return open_to_all or name in self.projections.get((slug, role), frozenset())

    def restrict(self, slug: str, role: str, *policies: Policy) -> Catalog:
        """Replaces the row policies of a role for an object, after all have been checked."""
        o = self.get(slug)
        for p in policies:
            if p.op not in POLICY_OPS:
                raise Refused(f"unknown policy operator {p.op!r}")
            if p.field not in ("__id", "lifecycle_state"):
                f = o.find(p.field)
                if f.extension or f.sensitive or f.kind in SENSITIVE_KINDS:
                    raise Refused(f"{p.field}: policies are on plain base fields")
            if p.field == "lifecycle_state" and o.lifecycle is None:
                raise Refused(f"{slug} has no lifecycle")
            if isinstance(p.value, dict) and (p.value != {"actor": "id"} or p.op not in ("eq", "neq", "lt", "lte", "gt", "gte")):
                raise Refused(f"{p.field}: malformed policy value")
            if p.op == "in" and not isinstance(p.value, (list, tuple)):
                raise Refused(f"{p.field}: `in` takes a list")
            if p.value is None and p.op not in ("is_null", "is_not_null"):
                raise Refused(f"{p.field}: {p.op} takes a value")
        self.policies[slug, role] = tuple(policies)
        return self

    def policies_of(self, slug: str, role: str) -> tuple[Policy, ...]:
        return self.policies.get((slug, role), ())

    def open(self, slug: str, ctx: Context) -> DataFrame:
        """The object's rows of the caller's organisation, with its system columns __id, __org, __created_at, __state beside the table's own."""
        o = self.get(slug)
        frame = self.frames[slug] if slug in self.frames else self.spark.read.parquet(f"{self.root}/{o.path}")
        with_system = frame.withColumns({
            "__id": F.expr(o.id), "__org": F.expr(o.tenant).cast("string"), "__created_at": F.expr(o.created_at) if o.created_at else F.lit(None).cast("timestamp"),
            "__state": F.expr(o.lifecycle) if o.lifecycle else F.lit("published"),
        })
        return with_system.where(F.col("__org") == ctx.org)

    def open_extension(self, slug: str, ctx: Context) -> DataFrame:
        """(__record, evolved fields) of the caller's organisation."""
        o = self.get(slug)
        key = f"{slug}.extension"
        frame = self.frames[key] if key in self.frames else self.spark.read.parquet(f"{self.root}/{o.extension_path}")
        columns = [F.expr(f.expr()).alias(f.name) for f in o.fields if f.extension]
        return frame.where(F.expr(o.extension_tenant).cast("string") == ctx.org).select(F.expr(o.extension_id).alias("__record"), *columns)

    def describe(self, role: str) -> DataFrame:
        """(object, field, kind, target, sensitive) of all that a role may see, as rows."""
        rows = [(o.slug, f.name, f.kind, f.target, f.sensitive or f.kind in SENSITIVE_KINDS) for o in self.objects.values() for f in o.fields if self.sees(o.slug, role, f.name)]
        return self.spark.createDataFrame(rows, "object string, field string, kind string, target string, sensitive boolean")

    def load_pack(self, text: str) -> Catalog:
        """Objects declared in TOML: [objects.<slug>] with path, id, and [[objects.<slug>.fields]]. Loading a pack again changes nothing."""
        made = []
        for slug, told in tomllib.loads(text).get("objects", {}).items():
            fields = tuple(Field(**f) for f in told.get("fields", []))
            made.append(Object(slug, fields=fields, **{k: v for k, v in told.items() if k != "fields"}))
        return self.add(*made)


def policy_column(p: Policy, ctx: Context, value: Column) -> Column:
    """The rows a policy lets through."""
    wanted = ctx.actor if isinstance(p.value, dict) else p.value
    if p.op in ("is_null", "is_not_null"):
        return value.isNull() if p.op == "is_null" else value.isNotNull()
    if p.op == "in":
        return value.isin(list(wanted)) if wanted else F.lit(False)
    compare = {"eq": value == wanted, "neq": value != wanted, "lt": value < wanted, "lte": value <= wanted, "gt": value > wanted, "gte": value >= wanted}
    return compare[p.op]


def checked_grid(panels: Sequence[dict[str, Any]], columns: int = 24, most: int = 64) -> Sequence[dict[str, Any]]:
    """Panels (x, y, w, h) of a dashboard: at most so many, inside the grid, none over another."""
    if len(panels) > most:
        raise Refused(f"a dashboard has at most {most} panels")
    taken: list[tuple[int, int, int, int]] = []
    for p in panels:
        x, y, w, h = (p[k] for k in ("x", "y", "w", "h"))
        if min(x, y) < 0 or min(w, h) < 1 or x + w > columns:
            raise Refused(f"panel {p.get('name')!r} lies outside the grid")
        if any(x < a + c and a < x + w and y < b + d and b < y + h for a, b, c, d in taken):
            raise Refused(f"panel {p.get('name')!r} lies over another")
        taken.append((x, y, w, h))
    return panels
