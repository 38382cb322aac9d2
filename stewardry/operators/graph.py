"""Budgeted expansion over declared relations: joins per depth, caps per record and relation, budgets by running sums, resumable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.operators.numbering import running
from stewardry.operators.search import cosine
from stewardry.session import written


@dataclass(frozen=True)
class Budget:
    depth: int = 2
    records: int = 200
    tokens: int = 8_000
    fan_out: int = 25


@dataclass(frozen=True)
class Expansion:
    """records: (node, depth, tokens); edges: (src, relation, dst, depth) walked to them; open: (src, relation, depth, offset, left, reason), where to go on."""

    records: DataFrame
    edges: DataFrame
    open: DataFrame


def similarity(focus: Sequence[float], embedding: str = "embedding") -> Column:
    """A rank: nearness to a focus; null without an embedding, which puts an edge behind those with one, in the order of nodes."""
    return F.when(F.col(embedding).isNotNull(), F.round(cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in focus])), 9))


def _afford(candidates: DataFrame, records: int, tokens: int) -> tuple[DataFrame, int, int]:
    """(candidates with `cut`: null if taken, else why, records taken, tokens taken).

    In one order of all (src, relation, place). A node that can't be paid for any more cuts the rest of its own relation; other
    relations go on. Each round takes all that fits before the first such node, so a round takes at least one node and there
    are at most as many rounds as records are left, mostly a handful.
    """
    rest, taken, reasons, n_taken, paid = candidates, None, None, 0, 0
    while True:
        left = tokens - paid
        # what costs more than is left cuts its relation from there on, all of them at once
        first = rest.where(F.col("tokens") > left).groupBy("src", "relation").agg(F.min("place").alias("from"))
        cut = rest.join(first, ["src", "relation"]).where(F.col("place") >= F.col("from")).select("dst", F.lit("tokens").alias("cut"))
        reasons = cut if reasons is None else reasons.unionByName(cut)
        rest = written(rest.join(cut.select("dst"), "dst", "left_anti"))
        if rest.limit(1).count() == 0:
            break
        one = rest.withColumn("__one", F.lit(1).cast("long"))
        line = running(running(one, ["src", "relation", "place", "dst"], "tokens", "__cost"), ["src", "relation", "place", "dst"], "__one", "__count")
        line = written(line)
        fits = (F.col("__cost") <= left) & (F.col("__count") <= records - n_taken)
        now = written(line.where(fits).select(*candidates.columns))
        told = now.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
        taken = now if taken is None else taken.unionByName(now)
        n_taken, paid = n_taken + told.n, paid + told.t
        rest = line.where(~fits).select(*candidates.columns)
        if n_taken >= records:
            reasons = reasons.unionByName(rest.select("dst", F.lit("records").alias("cut")))
            break
        # the first that didn't fit costs more than is left by now: the next round cuts it
    out = candidates.join(reasons, "dst", "left")
    return written(out), n_taken, paid


def expand(roots: DataFrame, edges: DataFrame, nodes: DataFrame, budget: Budget, kinds: Sequence[str] | None = None, rank: Column | None = None, resume: Expansion | None = None) -> Expansion:
    """Records that lie within `depth` steps of the roots, as far as the budgets go.

    roots: (node); edges: (src, dst, relation); nodes: (node, tokens, …), only those the caller may see. Per record and
    relation the neighbours stand in the order of the rank (over an edge and the node it leads to; largest first, nulls last),
    then of the node; `fan_out` of them are walked. A node that several edges lead to is reached by the first of them.
    resume: an expansion to go on with from its open ends, under new budgets; what it had reached counts as seen.
    """
    usable = edges if kinds is None else edges.where(F.col("relation").isin(list(kinds)))
    if resume is None:
        seen = written(roots.select("node").distinct().join(nodes, "node").select("node", F.lit(0).alias("depth"), F.col("tokens").cast("long").alias("tokens")))
        n, paid = seen.count(), seen.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
        walked, waiting = None, None
    else:
        seen, walked, waiting, n, paid = resume.records, None, written(resume.open), 0, 0
    frontier = seen if resume is None else seen.where("false")
    opened = []
    for d in range(1, budget.depth + 1):
        steps = frontier.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("only"), F.lit(0).cast("long").alias("offset"))
        if waiting is not None:
            steps = steps.unionByName(waiting.where(F.col("depth") == d).select("src", F.col("relation").alias("only"), "offset"))
        met = steps.join(usable, "src").where("only is null or relation = only").join(nodes.withColumnRenamed("node", "dst"), "dst")
        ranked = met.withColumn("__rank", rank if rank is not None else F.lit(None).cast("double")).select("src", "relation", "dst", F.col("tokens").cast("long").alias("tokens"), "offset", "__rank").distinct()
        # the filter on the place lets Spark cut each task's rows to the first ones of a group before they are shuffled
        most = int(steps.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("o")).first().o) + budget.fan_out
        place = F.row_number().over(W.partitionBy("src", "relation").orderBy(F.col("__rank").desc_nulls_last(), "dst"))
        near = written(ranked.withColumn("place", place).where(F.col("place") <= most).where("place > offset").where(F.col("place") <= F.col("offset") + budget.fan_out))
        sizes = ranked.groupBy("src", "relation").agg(F.count("*").alias("all"), F.max("offset").alias("offset"))
        wide = sizes.where(F.col("all") > F.col("offset") + budget.fan_out).select("src", "relation", F.lit(d).alias("depth"), (F.col("offset") + budget.fan_out).cast("long").alias("offset"), (F.col("all") - F.col("offset") - budget.fan_out).cast("long").alias("left"), F.lit("fan_out").alias("reason"))
        fresh = near.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = fresh.groupBy("dst").agg(F.min(F.struct("src", "relation", "place", "tokens")).alias("e")).select("dst", "e.*")
        judged, took, cost = _afford(written(first), budget.records - n, budget.tokens - paid)
        n, paid = n + took, paid + cost
        frontier = written(judged.where("cut is null").select(F.col("dst").alias("node"), F.lit(d).alias("depth"), "tokens"))
        edge = judged.where("cut is null").select("src", "relation", "dst", F.lit(d).alias("depth"))
        walked = edge if walked is None else walked.unionByName(edge)
        stopped = judged.where("cut is not null").groupBy("src", "relation").agg(F.min(F.struct("place", "cut")).alias("p"), F.count("*").alias("left"))
        stopped = stopped.select("src", "relation", F.lit(d).alias("depth"), (F.col("p.place") - 1).cast("long").alias("offset"), "left", F.col("p.cut").alias("reason"))
        # a relation that a budget has cut goes on from there, and what lies beyond its fan-out comes with it
        both = stopped.unionByName(wide.join(stopped.select("src", "relation"), ["src", "relation"], "left_anti"))
        opened.append(written(both))
        seen = seen.unionByName(frontier)
    ends = opened[0]
    for more in opened[1:]:
        ends = ends.unionByName(more)
    return Expansion(seen, walked, ends)


def manifest(expansion: Expansion) -> DataFrame:
    """(src, relation, dst, depth, state, left): edges walked, and for each relation that was cut how many neighbours are left."""
    walked = expansion.edges.select("src", "relation", "dst", "depth", F.lit("traversed").alias("state"), F.lit(0).cast("long").alias("left"))
    kind = expansion.edges.schema["dst"].dataType
    return walked.unionByName(expansion.open.select("src", "relation", F.lit(None).cast(kind).alias("dst"), "depth", F.col("reason").alias("state"), "left"))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)
