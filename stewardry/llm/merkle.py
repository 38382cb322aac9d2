"""A Merkle manifest of a dataset: built from the leaves up, proofs pushed from the root down.

Leaves are numbered within their group without any task holding a group. Level by level, every `FAN` neighbours become
one node, whose row keeps their digests; each level is persisted. Going down, a row is joined with its parent and puts
its own siblings before the proof that the parent has inherited. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.tables import written
from stewardry.operators.numbering import numbered

#: Neighbours that make one node.
FAN = 8
_steps = "array<struct<left string, right string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as `-` if null, else the UTF-8 byte count of its text form, a colon and that text."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def _up(leaves: DataFrame) -> list[DataFrame]:
    """The levels above `leaves` (g, i, size, digest), each persisted: g, i, size, run (digests of the children), digest."""
    levels, below = [], leaves
    most = leaves.agg(F.max("size").alias("n")).first().n or 0
    while most > 1:
        # where a group has one node only, that is its root
        run = F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        runs = below.where("size > 1").groupBy("g", F.expr(f"i div {FAN}").alias("i")).agg(F.expr(f"(first(size) + {FAN - 1}) div {FAN}").alias("size"), run.alias("run"))
        below = written(runs.withColumn("digest", F.sha2(F.array_join("run", ""), 256)))
        levels.append(below)
        most = -(-most // FAN)
    return levels


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, digest): what remains of each group."""
    out = leaves.where("size = 1").select("g", "digest")
    for level in levels:
        out = out.unionByName(level.where("size = 1").select("g", "digest"))
    return out


def _inherited(nodes: DataFrame, parents: DataFrame | None, roots: DataFrame) -> DataFrame:
    """`nodes` with subroot, root and steps: their own siblings, then what the parent has inherited; roots of groups take theirs from `roots`."""
    own = roots.withColumnRenamed("g", "rg")
    alone = nodes.where("size = 1").join(own, F.col("g") == F.col("rg")).drop("rg")
    if parents is None:
        return alone
    above = parents.select(F.col("g").alias("pg"), F.col("i").alias("pi"), F.col("run").alias("prun"), "subroot", "root", F.col("steps").alias("psteps"))
    at = F.col("i") % FAN
    step = F.struct(F.array_join(F.slice("prun", 1, at.cast("int")), "").alias("left"), F.array_join(F.slice("prun", at.cast("int") + 2, FAN), "").alias("right"))
    met = nodes.where("size > 1").join(above, (F.col("g") == F.col("pg")) & (F.expr(f"i div {FAN}") == F.col("pi")))
    return met.withColumn("steps", F.concat(F.array(step), F.col("psteps"))).drop("pg", "pi", "prun", "psteps").unionByName(alone)


def _down(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    above = None
    for level in reversed(levels):
        above = _inherited(level, above, roots)
    return _inherited(leaves, above, roots)


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: the id, group, leaf, subroot, root, steps and the columns of `carry`.

    A leaf is the digest of the row's `fields` (null: `-`). Within a group (a null is one) leaves ascend by id, a null id
    first, then by digest; subroots ascend by group, a null first, else by bytes. steps, from the leaf to the root: the
    digests that stand left and right of one's own in its run, each joined to one text, both empty for a run of one. Rows
    alike in all fields are leaves of their own, in any order among themselves. Extra columns don't matter whatever their
    names; an empty table gives an empty result; empty and very long texts are leaves like any other.
    """
    extra = {f"__c{k}": column for k, column in enumerate((carry or {}).values())}
    leaves = docs.select(F.struct(F.col(group_col).alias("v")).alias("g"), F.col(id_col).alias("id"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("tie"), *[c.alias(n) for n, c in extra.items()])
    # digests are taken once; the row's number in the table tells rows alike in id and digest apart
    placed = numbered(written(leaves), ["g"], ["id", "digest", "tie"], "i", "size")
    base = written(placed.withColumn("i", F.col("i") - 1).drop("tie"))
    levels = _up(base)
    groups = written(_roots(base, levels))
    one = F.struct(F.lit(0).alias("v"))
    top = written(numbered(groups.select(F.col("g").alias("of"), "digest"), [], [F.col("of.v").asc_nulls_first()], "i", "size").select(one.alias("g"), "of", (F.col("i") - 1).alias("i"), "size", "digest"))
    tops = _up(top)
    root = _roots(top, tops).select("g", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_steps).alias("steps"))
    subroots = _down(top, tops, root).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", "steps")
    out = _down(base, levels, written(subroots))
    return out.select(F.col("id").alias(id_col), F.col("g.v").alias(group_col), F.col("digest").alias("leaf"), "subroot", "root", "steps", *[F.col(n).alias(name) for n, name in zip(extra, carry or {}, strict=True)])


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to with these siblings."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
