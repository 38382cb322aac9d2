"""Numbers without gaps, however large a group is: rows are ranged, counted per range, and numbered within it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.session import written


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "seq", total: str | None = None) -> DataFrame:
    """`rows` with a long `name` that runs from 1 without gaps within each group by `order`; `total`: a column for the group's number of rows.

    A null is a group of its own. No task holds a group: rows are dealt into ranges of (groups, order), a table of one row per
    range and group tells how many rows come before, and each range is numbered by itself. Rows alike in all of `order` are
    numbered in any order among themselves and stay in one range, so `order` should end with something that tells rows apart.
    """
    key = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))
    by = [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]
    placed = written(rows.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *by).withColumn("__range", F.spark_partition_id())).withColumn("__group", key)
    sizes = placed.groupBy("__range", "__group").agg(F.count("*").alias("__rows"))
    every = W.partitionBy("__group")
    before = F.coalesce(F.sum("__rows").over(every.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", "__group", before.alias("__before"), F.sum("__rows").over(every).alias("__total"))
    inside = placed.withColumn("__n", F.row_number().over(W.partitionBy("__range", "__group").orderBy(*by)))
    out = inside.join(offsets, ["__range", "__group"])
    return out.select(*[F.col(c) for c in rows.columns], (F.col("__before") + F.col("__n")).alias(name), *([F.col("__total").alias(total)] if total else []))


def running(rows: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over all rows up to each by `order`, which must tell rows apart; no task holds all rows."""
    by = [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]
    placed = written(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    sums = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy().orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = placed.withColumn("__n", F.sum(value).over(W.partitionBy("__range").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)))
    out = inside.join(sums.select("__range", before.alias("__before")), "__range")
    return out.select(*[F.col(c) for c in rows.columns], (F.col("__before") + F.col("__n")).alias(name))
