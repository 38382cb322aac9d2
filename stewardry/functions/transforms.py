"""Scalar transforms of governed data, all from built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

UNAVAILABLE = "[unavailable]"
EMPTY = "(empty)"


def number(value: Column) -> Column:
    """A number, also from text; null where it is none."""
    return value.cast("string").try_cast("double")


def bucket(value: Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first threshold above the number, else the last label; null where it is no number."""
    if len(labels) != len(thresholds) + 1:
        raise ValueError("a label for each threshold and one more")
    n, out = number(value), F.lit(labels[-1])
    for limit, label in reversed(list(zip(thresholds, labels, strict=False))):
        out = F.when(n < limit, label).otherwise(out)
    return F.when(n.isNotNull(), out)


def clamp(value: Column, low: float, high: float) -> Column:
    n = number(value)
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(float(low))), F.lit(float(high))))


def round_half_away(value: Column, places: int = 0) -> Column:
    n = number(value)
    return F.round(n * 10.0**places, 0) / 10.0**places


def mask(value: Column, keep_last: int = 4) -> Column:
    """`***` and the last characters; a shorter text is shown whole."""
    text = value.cast("string")
    return F.when(text.isNotNull(), F.concat(F.lit("***"), F.right(text, F.lit(keep_last)) if keep_last else F.lit("")))


def tokenised(value: Column) -> Column:
    """A token from the digest of the value's JSON text, quotes included."""
    told = F.to_json(F.struct(value.alias("v")))
    json = F.substring(told, F.lit(6), F.length(told) - 6)  # without {"v": and }
    return F.when(value.isNotNull(), F.concat(F.lit("tok_"), F.substring(F.sha2(json, 256), 1, 16)))


def modelled(value: Column, adapter: Callable[[Column], Column] | None) -> Column:
    """What a model's adapter makes of the value; a marker where there is no adapter or it gives nothing."""
    return F.when(value.isNotNull(), F.coalesce(adapter(value), F.lit(UNAVAILABLE)) if adapter else F.lit(UNAVAILABLE))


def mentions(text: Column) -> Column:
    """Handles after an `@` that no handle character precedes, without trailing dots and dashes, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9._-])@([A-Za-z0-9._-]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda h: F.regexp_replace(h, "[.-]+$", "")), lambda h: h != ""))


def object_references(text: Column, scheme: str) -> Column:
    """`scheme:slug:id` references that no ASCII letter, digit or underscore precedes, each once, in order.

    Java's own word boundary takes letters and marks of all scripts as parts of words. What precedes is asked behind the scheme, which is searched for faster.
    """
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{scheme}:(?<![A-Za-z0-9_]{scheme}:)[a-z][a-z0-9_]*:[0-9A-Za-z-]+"), F.lit(0)))


def handle(name: Column) -> Column:
    """Lower-case, anything but a-z0-9 one dash, 64 characters at most; `actor` if nothing is left."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.left(F.regexp_replace(plain, "^-+|-+$", ""), F.lit(64)), "-+$", "")
    return F.when(cut == "", "actor").otherwise(cut)


def suffixed(base: Column, place: Column) -> Column:
    """A handle that is taken gets the number of its place."""
    return F.when(place > 1, F.concat(base, F.lit("-"), place.cast("string"))).otherwise(base)


def stable_handle(key: Column) -> Column:
    return F.concat(F.lit("actor-"), F.substring(F.sha2(key.cast("string"), 256), 1, 8))


def hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts)


def is_quiet(at: Column, begin: str, end: str) -> Column:
    """Whether the time of day lies in [begin, end), also over midnight."""
    t = F.date_format(at, "HH:mm")
    return (t >= begin) & (t < end) if begin <= end else (t >= begin) | (t < end)


def quiet_until(at: Column, begin: str, end: str) -> Column:
    """When the quiet hours that hold at a time end: today, or tomorrow."""
    day = F.date_trunc("DAY", at)
    over = F.date_format(at, "HH:mm") >= begin if begin > end else F.lit(False)
    h, m = map(int, end.split(":"))
    ends = F.when(over, day + F.expr("interval 1 day")).otherwise(day) + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m))
    return F.when(is_quiet(at, begin, end), ends)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a call by prices a thousand tokens, in exact decimals of four places."""
    d = lambda c: c.cast("decimal(18,6)")
    return ((d(tokens_in) * d(price_in) + d(tokens_out) * d(price_out)) / 1000).cast("decimal(14,4)")


def record_page(slug: Column, record_id: Column, fields: Mapping[str, Column]) -> Column:
    """A record as a small markdown page."""
    lines = [F.concat(F.lit(f"- **{name}**: "), F.coalesce(value.cast("string"), F.lit(EMPTY))) for name, value in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), slug, F.lit(" "), record_id.cast("string")), *lines)


def row_json(columns: Mapping[str, Column], integral: Sequence[str] = ()) -> Column:
    """The row as JSON: whole numbers of `integral` columns as integers, nulls kept."""
    shown = []
    for name, value in columns.items():
        if name in integral:
            text = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
            shown.append(F.when(value.isNull(), F.lit("null")).otherwise(text))
        else:
            told = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            shown.append(F.substring(told, F.lit(6), F.length(told) - 6))
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in zip(columns, shown, strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_set(doc: Column, key: str, value: Column, fields: Sequence[str]) -> Column:
    """A flat JSON object of text with one key set; keys in order, those without a value left out."""
    names = sorted({*fields, key})
    values = [value if name == key else F.get_json_object(doc, f"$.{name}") for name in names]
    return F.to_json(F.struct(*[v.alias(name) for name, v in zip(names, values, strict=True)]))


def masked_sealed(doc: Column, sensitive: Sequence[str], shown: str) -> Column:
    """A JSON object whose sealed values ({pii_ref, bidx}) and sensitive keys are replaced by a mask."""
    values = F.from_json(doc, "map<string,string>")
    sealed = lambda k, v: k.isin(list(sensitive)) | (v.startswith("{") & F.get_json_object(v, "$.pii_ref").isNotNull() & F.get_json_object(v, "$.bidx").isNotNull())
    return F.to_json(F.transform_values(values, lambda k, v: F.when(v.isNotNull() & sealed(k, v), F.lit(shown)).otherwise(v)))


def broken_rules(rules: Mapping[str, Mapping[str, Any]]) -> Column:
    """`field:rule` of every rule that the row breaks, in the order of the fields: required, min, max, min_length, max_length, pattern, options."""
    found = []
    for field, rule in rules.items():
        c = F.col(field)
        text, missing = c.cast("string"), c.isNull() | (F.trim(c.cast("string")) == "")
        tests = {
            "required": lambda v, m=missing: m if v else F.lit(False), "min": lambda v, c=c: number(c) < v, "max": lambda v, c=c: number(c) > v, "min_length": lambda v, t=text: F.length(t) < v,
            "max_length": lambda v, t=text: F.length(t) > v, "pattern": lambda v, t=text: ~t.rlike(f"^(?:{v})$"), "options": lambda v, t=text: ~t.isin(list(v)),
        }
        for name, test in tests.items():
            if name in rule:
                broken = test(rule[name])
                found.append(F.when(broken if name == "required" else broken & ~missing, F.lit(f"{field}:{name}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def preset(value: Column, given: Any, when: str, actor: str | None = None) -> Column:
    """A field's preset: `always`, or `missing` only; {"actor": "id"} is the caller."""
    literal = F.lit(actor if given == {"actor": "id"} else given)
    if when not in ("always", "missing"):
        raise ValueError(f"a preset is set always or when missing, not {when!r}")
    return literal if when == "always" else F.coalesce(value, literal)


def condition(value: Column, op: str, wanted: Any = None, changed: Column | None = None, field: str | None = None) -> Column:
    """A condition of an automation; texts that are numbers are equal as numbers, `contains` tells cases apart."""
    def same(x: Any) -> Column:
        text = str(x)
        try:
            Decimal(text)
        except ArithmeticError:
            return value.cast("string") == text
        return F.coalesce(number(value) == float(text), value.cast("string") == text)

    if op == "changed":
        if changed is None or field is None:
            raise ValueError("changed needs the list of changed fields and the field")
        return F.array_contains(changed, field)
    if op in ("is_set", "is_empty"):
        empty = value.isNull() | (value.cast("string") == "")
        return empty if op == "is_empty" else ~empty
    if op in ("eq", "ne"):
        return F.coalesce(same(wanted), F.lit(False)) if op == "eq" else ~F.coalesce(same(wanted), F.lit(False))
    if op == "in":
        out = F.lit(False)
        for x in wanted:
            out = out | F.coalesce(same(x), F.lit(False))
        return out
    if op == "contains":
        return F.coalesce(F.contains(value.cast("string"), F.lit(wanted)), F.lit(False))
    compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    if op not in compare:
        raise ValueError(f"unknown condition {op!r}")
    return F.coalesce(compare[op](number(value), F.lit(float(wanted))), F.lit(False))
