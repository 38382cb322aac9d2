"""Connected components by alternating large and small stars: a few joins a round, whatever the shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.tables import written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every end of the edges (u, v) with the smallest end of its component. Rounds are written, so a lost executor costs one."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest one; small star: smaller ones and oneself
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        now = written(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == told:
            return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select(F.col("v"), F.col("v").alias("c")).distinct())
        mark = told
    raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
