"""Governed reads: a typed request becomes one lazy plan under the caller's tenancy, projection and row policies."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.functions.seal import MASK, blind_index, projection_key
from stewardry.plans.catalog import SENSITIVE_KINDS, Catalog, Context, Field, Forbidden, Object, Policy, Refused, checked_grid, policy_column

MOST_ROWS, DEFAULT_ROWS = 1000, 250
OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "contains", "starts_with", "is_null", "is_not_null")
TEXT_KINDS = ("text", "url", "select", "file", "email", "phone")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


def typed(kind: str, value: Any) -> Any:
    """A literal of a kind, strictly: numbers from text too, booleans from true and false, dates as YYYY-MM-DD, times as RFC 3339 (UTC if naive)."""
    try:
        if kind in ("number", "currency"):
            if isinstance(value, bool):
                raise ValueError
            return value if isinstance(value, (int, float, Decimal)) else (int(value.strip()) if re.fullmatch(r"[+-]?\d{1,18}", value.strip()) else Decimal(value.strip()))
        if kind == "boolean":
            return value if isinstance(value, bool) else {"true": True, "false": False}[value.lower()]
        if kind == "date":
            return value if isinstance(value, date) and not isinstance(value, datetime) else datetime.strptime(value, "%Y-%m-%d").date()
        if kind == "datetime":
            at = value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "+00:00"))
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        if kind == "multi_select":
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ValueError
            return value
        if kind in ("relation", "id"):
            return value
        if not isinstance(value, str):
            raise ValueError
        return value
    except (ValueError, KeyError, AttributeError, InvalidOperation):
        raise Refused(f"{value!r} is no {kind}") from None


def _sensitive(f: Field) -> bool:
    return f.sensitive or f.kind in SENSITIVE_KINDS


class _Plan:
    """Joins are added as fields ask for them, each once; every column of the result is found by path."""

    def __init__(self, catalog: Catalog, slug: str, ctx: Context):
        self.catalog, self.ctx, self.object = catalog, ctx, catalog.get(slug)
        self.frame = self._opened(self.object, "b")
        self.joined: set[str] = set()

    def _opened(self, o: Object, alias: str) -> DataFrame:
        """Columns under a prefix, so that no name meets another's."""
        rows = self.catalog.open(o.slug, self.ctx)
        base = [F.expr(f.expr()).alias(f"{alias}_{f.name}") for f in o.fields if not f.extension]
        return rows.select(*[F.col(c).alias(f"{alias}{c}") for c in ("__id", "__created_at", "__state")], *base)

    def _extended(self, o: Object, alias: str) -> None:
        if f"{alias}!" in self.joined:
            return
        self.joined.add(f"{alias}!")
        ext = self.catalog.open_extension(o.slug, self.ctx)
        ext = ext.select(*[F.col(c).alias(f"{alias}x{c if c == '__record' else '_' + c}") for c in ext.columns])
        self.frame = self.frame.join(ext, F.col(f"{alias}__id") == F.col(f"{alias}x__record"), "left")

    def _own(self, o: Object, alias: str, f: Field) -> Column:
        if f.extension:
            self._extended(o, alias)
            return F.col(f"{alias}x_{f.name}")
        return F.col(f"{alias}_{f.name}")

    def find(self, path: str) -> tuple[Field | None, Column, str]:
        """(field or None for __id, its column, the object it is of). One hop over a relation at most."""
        if path == "__id":
            return None, F.col("b__id"), self.object.slug
        if "." not in path:
            f = self.object.find(path)
            return f, self._own(self.object, "b", f), self.object.slug
        name, leaf = path.split(".", 1)
        if "." in leaf:
            raise Refused(f"{path!r}: one relation at most")
        via = self.object.find(name)
        if via.kind != "relation":
            raise Refused(f"{name!r} is no relation")
        target, alias = self.catalog.get(via.target), f"r_{name}"
        if alias not in self.joined:
            self.joined.add(alias)
            key = self._own(self.object, "b", via)
            # the target is of the caller's organisation as well: what isn't, is null
            self.frame = self.frame.join(self._opened(target, alias), key == F.col(f"{alias}__id"), "left")
        if leaf == "__id":
            return None, F.col(f"{alias}__id"), target.slug
        f = target.find(leaf)
        return f, self._own(target, alias, f), target.slug

    def visible(self, path: str) -> bool:
        if path == "__id" or path.endswith(".__id"):
            return "." not in path or self.catalog.sees(self.object.slug, self.ctx.role, path.split(".")[0])
        name, _, leaf = path.partition(".")
        via = self.object.find(name)
        if not self.catalog.sees(self.object.slug, self.ctx.role, name):
            return False
        return not leaf or via.target is None or self.catalog.sees(via.target, self.ctx.role, leaf)

    def policies(self) -> None:
        rules = self.catalog.policies_of(self.object.slug, self.ctx.role)
        for p in rules:
            self.frame = self.frame.where(policy_column(p, self.ctx, self._policy_value(p)))
        if self.object.lifecycle and not any(p.field == "lifecycle_state" for p in rules):
            self.frame = self.frame.where(F.col("b__state") == "published")

    def _policy_value(self, p: Policy) -> Column:
        if p.field in ("__id", "lifecycle_state"):
            return F.col("b__id" if p.field == "__id" else "b__state")
        return F.col(f"b_{p.field}")

    def filtered(self, f: Filter) -> None:
        if f.op not in OPS:
            raise Refused(f"unknown operator {f.op!r}")
        field, column, slug = self.find(f.field)
        nulls = f.op in ("is_null", "is_not_null")
        if f.value is None and not nulls:
            raise Refused(f"{f.field}: {f.op} takes a value; is_null asks for none")
        if nulls:
            self.frame = self.frame.where(column.isNull() if f.op == "is_null" else column.isNotNull())
            return
        if field is not None and _sensitive(field):
            if f.op not in ("eq", "ne", "in"):
                raise Refused(f"{f.field} is sealed: {f.op} can't be asked of it")
            if self.catalog.index_key is None:
                raise Forbidden(f"{f.field} is sealed and there is no key to ask by")
            digest = lambda v: blind_index(self.catalog.index_key, self.ctx.org, f"{slug}.{field.name}", v, field.kind)
            column = digest(column)
            values = f.value if f.op == "in" else [f.value]
            wanted = [digest(F.lit(typed(field.kind, v))) for v in values]
            test = column == wanted[0] if f.op == "eq" else column != wanted[0] if f.op == "ne" else column.isin(wanted) if wanted else F.lit(False)
            self.frame = self.frame.where(test)
            return
        kind = field.kind if field is not None else "id"
        if f.op in ("contains", "starts_with"):
            if kind not in TEXT_KINDS:
                raise Refused(f"{f.field}: {f.op} is for texts")
            sought = F.lower(F.lit(typed("text", f.value)))
            test = F.contains(F.lower(column), sought) if f.op == "contains" else F.startswith(F.lower(column), sought)
        elif f.op == "in":
            if not isinstance(f.value, (list, tuple)):
                raise Refused(f"{f.field}: `in` takes a list")
            values = [typed(kind, v) for v in f.value]
            test = column.isin(values) if values else F.lit(False)
        else:
            v = F.lit(typed(kind, f.value))
            test = {"eq": column == v, "ne": column != v, "lt": column < v, "lte": column <= v, "gt": column > v, "gte": column >= v}[f.op]
        self.frame = self.frame.where(test)

    def shown(self, path: str) -> Column:
        keyed = path.endswith(":key")
        field, column, slug = self.find(path.removesuffix(":key"))
        if keyed:
            if field is None or not _sensitive(field):
                raise Refused(f"{path!r}: only sealed fields have keys")
            digest = blind_index(self.catalog.index_key, self.ctx.org, f"{slug}.{field.name}", column, field.kind) if self.catalog.index_key else F.lit(None).cast("string")
            return projection_key(self.catalog.projection_secret, digest).alias(path)
        if field is not None and _sensitive(field):
            column = F.when(column.isNotNull(), MASK)
        return column.alias(path)


def _governed(catalog: Catalog, slug: str, ctx: Context, select: Sequence[str], where: Sequence[Filter], order: Sequence[Order]) -> tuple[DataFrame, list[Column], list[Column]]:
    """(the rows that a caller may see, what they are sorted by, what is shown of them)."""
    if not select:
        raise Refused("a request names its fields")
    plan = _Plan(catalog, slug, ctx)
    for path in [f.field for f in where] + [o.field for o in order]:
        if not plan.visible(path):
            raise Forbidden(f"{path!r} is hidden")
    chosen = [p for p in select if plan.visible(p.removesuffix(":key"))]
    denied = (slug, ctx.role) in catalog.projections and not catalog.projections[slug, ctx.role]
    if not chosen and not denied:
        raise Refused("all fields asked for are hidden")
    plan.policies()
    for f in where:
        plan.filtered(f)
    keys = []
    for o in order:
        field, column, _ = plan.find(o.field)
        if field is not None and _sensitive(field):
            raise Refused(f"{o.field} is sealed: nothing is sorted by it")
        keys.append(column.desc_nulls_first() if o.descending else column.asc_nulls_last())
    shown = [plan.shown(p) for p in chosen]
    if "__id" not in chosen:
        shown.append(F.col("b__id").alias("__id"))
    return plan.frame, [*(keys or [F.col("b__created_at").desc_nulls_first()]), F.col("b__id")], shown


def governed_read(catalog: Catalog, slug: str, ctx: Context, select: Sequence[str], where: Sequence[Filter] = (), order: Sequence[Order] = (), limit: int | None = None) -> DataFrame:
    """The rows that a caller may see, with the fields asked for, and __id.

    Fields hidden from the role are left out; if all are, the request is refused, as it is if it filters or sorts by one.
    Without an order the newest come first; nulls sort as larger than anything. limit: 250 if none, 1 to 1000.
    """
    rows, keys, shown = _governed(catalog, slug, ctx, select, where, order)
    return rows.orderBy(*keys).limit(max(1, min(MOST_ROWS, DEFAULT_ROWS if limit is None else limit))).select(*shown)


def governed_rows(catalog: Catalog, slug: str, ctx: Context, select: Sequence[str], where: Sequence[Filter] = ()) -> DataFrame:
    """As governed_read, all rows at once and in no order: for jobs over a whole object."""
    rows, _, shown = _governed(catalog, slug, ctx, select, where, ())
    return rows.select(*shown)


def visible_ids(catalog: Catalog, slug: str, ctx: Context) -> DataFrame:
    """(__id) of all rows of an object that the caller may see: for semi joins before anything is ranked or counted."""
    plan = _Plan(catalog, slug, ctx)
    plan.policies()
    return plan.frame.select(F.col("b__id").alias("__id"))


def governed_count(catalog: Catalog, slug: str, ctx: Context) -> DataFrame:
    return visible_ids(catalog, slug, ctx).agg(F.count("*").alias("n")).select(F.lit(slug).alias("object"), "n")


def plan_hash(slug: str, ctx: Context, select: Sequence[str], where: Sequence[Filter] = (), order: Sequence[Order] = (), policies: Sequence[Policy] = ()) -> str:
    """A digest of a request and of all that governs it; values count with their types."""
    tagged = [(f.field, f.op, type(f.value).__name__, str(f.value)) for f in where]
    told = {"slug": slug, "ctx": asdict(ctx), "select": list(select), "where": tagged, "order": [asdict(o) for o in order], "policies": [(p.field, p.op, type(p.value).__name__, str(p.value)) for p in policies]}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def audited(rows: DataFrame, fetch: int = 500) -> Iterator[tuple[list[dict[str, Any]], bool]]:
    """(rows, done) in pages of `fetch`, for a caller who streams a result; `done` comes with the last one, when the read may be told as complete."""
    page: list[dict[str, Any]] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        page.append(row.asDict())
        if len(page) == fetch:
            yield page, False
            page = []
    yield page, True


def dashboard(catalog: Catalog, ctx: Context, panels: Mapping[str, Mapping[str, Any]]) -> dict[str, DataFrame | str]:
    """Each panel (a request, with its place x, y, w, h in the grid) as a DataFrame under the viewer's permissions, or why it is refused."""
    checked_grid([{"name": name, **{k: p[k] for k in ("x", "y", "w", "h")}} for name, p in panels.items() if "x" in p])
    out: dict[str, DataFrame | str] = {}
    for name, p in panels.items():
        try:
            out[name] = governed_read(catalog, p["slug"], ctx, p["select"], p.get("where", ()), p.get("order", ()), p.get("limit"))
        except Forbidden:
            out[name] = "not permitted"
        except Refused as e:
            out[name] = str(e)
    return out
