"""Exact ledgers: rollups, reconciliations, budgets, limits, queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GATES = ("data", "dependencies", "authority", "rollback", "sign_off")


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, non_nulls, distinct_values), in one pass."""
    counted = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{k}") for k, c in enumerate(columns)], *[F.count_distinct(c).alias(f"d_{k}") for k, c in enumerate(columns)])
    told = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"n_{k}")).alias("nulls"), F.col(f"n_{k}").alias("non_nulls"), F.col(f"d_{k}").alias("distinct_values")) for k, c in enumerate(columns)])
    return counted.select(F.inline(told))


def cost_hourly(calls: DataFrame) -> DataFrame:
    """Calls (org, ts, model, tokens_in, tokens_out, cost; null where unpriced) by organisation, hour and model."""
    hour = F.date_trunc("HOUR", "ts").alias("hour")
    return calls.groupBy("org", hour, "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(24,4)").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def cost_summary(hourly: DataFrame, begin: Column, end: Column) -> DataFrame:
    """By model, of the hours in [begin, end)."""
    inside = hourly.where((F.col("hour") >= begin) & (F.col("hour") < end))
    return inside.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").cast("decimal(24,4)").alias("cost"), F.sum("unpriced").alias("unpriced"))


def cost_reconcile(bills: DataFrame, hourly: DataFrame) -> DataFrame:
    """Latest bill (provider, first_day, last_day, amount, received_at) of each provider against the ledger of its days, both included.

    A model is of the provider before its slash. Within 2 % or 0.01, whichever is more, they match; unpriced calls make it provisional.
    """
    latest = bills.withColumn("n", F.row_number().over(W.partitionBy("provider").orderBy(F.desc("received_at"), F.desc("amount")))).where("n = 1").drop("n")
    used = hourly.select(F.split_part("model", F.lit("/"), F.lit(1)).alias("p"), F.to_date("hour").alias("day"), "cost", "unpriced").groupBy("p", "day").agg(F.sum("cost").alias("cost"), F.sum("unpriced").alias("unpriced"))
    met = latest.join(used, (F.col("provider") == F.col("p")) & F.col("day").between(F.col("first_day"), F.col("last_day")), "left")
    summed = met.groupBy("provider", "amount").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(24,4)").alias("ledger"), F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced"))
    off = F.col("amount") - F.col("ledger")
    near = F.abs(off) <= F.greatest(F.col("amount") * F.lit("0.02").cast("decimal(4,2)"), F.lit("0.01").cast("decimal(4,2)"))
    return summed.select("provider", "amount", "ledger", F.when(near, "match").when(off > 0, "over").otherwise("under").alias("verdict"), (F.col("unpriced") > 0).alias("provisional"))


def telemetry_daily(points: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Points (host, org, ts, metric, value, dimensions) by day; dimensions count by the digest of their canonical JSON."""
    told = F.to_json(F.struct(*[F.col(d) for d in sorted(dimensions)]))
    return points.groupBy("host", "org", F.to_date("ts").alias("day"), "metric", F.sha2(told, 256).alias("dimensions_hash")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def telemetry_read(daily: DataFrame, metrics: Sequence[str], first: Column, last: Column, enabled: bool = True) -> DataFrame:
    """Days from first to last of 1 to 64 metrics, in order; nothing where telemetry is off."""
    if not 1 <= len(metrics) <= 64:
        raise ValueError("1 to 64 metrics")
    return daily.where(F.lit(enabled) & F.col("day").between(first, last) & F.col("metric").isin(list(metrics))).orderBy("day", "metric", "host", "dimensions_hash")


def budget_use(runs: DataFrame, most_runs: int, most_steps: int, most_tokens: int) -> DataFrame:
    """(org, hour, runs, steps, tokens, exceeded) of runs (org, ts, steps, tokens)."""
    used = runs.groupBy("org", F.date_trunc("HOUR", "ts").alias("hour")).agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"), F.sum("tokens").alias("tokens"))
    return used.withColumn("exceeded", (F.col("runs") > most_runs) | (F.col("steps") > most_steps) | (F.col("tokens") > most_tokens))


def rolling_hour_sum(events: DataFrame, key: str, ts: str, value: Column, most: float) -> DataFrame:
    """Each event with the sum of its key over the hour up to it, and whether that is refused."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    line = W.partitionBy(key).orderBy(at).rangeBetween(-3_600_000_000, 0)
    return events.withColumn("hour_sum", F.sum(value).over(line)).withColumn("refused", F.col("hour_sum") > most)


def authority_split(rows: DataFrame, by: Sequence[str], authority: str, kinds: Sequence[str]) -> DataFrame:
    """How many rows of each kind there are, beside all."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(authority) == k).alias(f"n_{k}") for k in kinds])


def reconcile_counts(landed: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, landed, source, same) of all keys of either side."""
    a = landed.groupBy(F.col(key)).agg(F.count("*").alias("landed"))
    b = source.groupBy(F.col(key)).agg(F.count("*").alias("source"))
    return a.join(b, key, "full").select(key, F.coalesce("landed", F.lit(0)).alias("landed"), F.coalesce("source", F.lit(0)).alias("source")).withColumn("same", F.col("landed") == F.col("source"))


def run_fingerprints(landed: DataFrame, targets: DataFrame, profile: DataFrame) -> DataFrame:
    """(stream, fingerprint): the digest of the stream, its landed rows, the count of each target, and the profile of its columns, both in order of their names.

    landed: (stream, n); targets: (stream, target, n); profile: (stream, column, nulls, non_nulls, distinct_values).
    """
    joined = lambda x: F.array_join(F.array_sort(F.collect_list(x)), ";")
    t = targets.groupBy("stream").agg(joined(F.concat_ws("=", "target", "n")).alias("targets"))
    p = profile.groupBy("stream").agg(joined(F.concat_ws(",", "column", "nulls", "non_nulls", "distinct_values")).alias("profile"))
    told = landed.join(t, "stream", "left").join(p, "stream", "left")
    return told.select("stream", F.sha2(F.concat_ws("\n", "stream", F.col("n").cast("string"), F.coalesce("targets", F.lit("")), F.coalesce("profile", F.lit(""))), 256).alias("fingerprint"))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `order`, whose columns tell rows of a key apart; by a bounded aggregate, also of a hot key."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row.{c}").alias(c) for c in others])


def next_versions(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.max(version) + 1).alias("next_version"))


def grant_uses(grants: DataFrame, uses: DataFrame) -> DataFrame:
    """Every grant (grant_id, …) with how often it was used, also never."""
    counted = uses.groupBy(F.col("grant_id").alias("used")).agg(F.count("*").alias("uses"))
    return grants.join(counted, F.col("grant_id") == F.col("used"), "left").drop("used").withColumn("uses", F.coalesce("uses", F.lit(0)))


def retirement_gates(runs: DataFrame) -> DataFrame:
    """(system, gate, passed) by the checklist (an array of passed gates) of each system's latest completed run."""
    done = runs.where("status = 'completed'").groupBy("system").agg(F.max_by("checklist", F.struct("finished_at", "run_id")).alias("checklist"))
    every = runs.select("system").distinct().join(done, "system", "left")
    gate = F.explode(F.array(*map(F.lit, GATES)))
    return every.select("system", "checklist", gate.alias("gate")).select("system", "gate", F.coalesce(F.array_contains("checklist", F.col("gate")), F.lit(False)).alias("passed"))


def keep_newest(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first n of each key."""
    placed = rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return placed.where(F.col("__n") <= n).drop("__n"), placed.where(F.col("__n") > n).drop("__n")


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The next n waiting items: of highest priority, then oldest."""
    return queue.where("status = 'waiting'").orderBy(F.desc("priority"), "created_at", "item").limit(n)
