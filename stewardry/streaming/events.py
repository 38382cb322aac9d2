"""Events: change logs, automations, digests and routing; the batch plan and the stream share their logic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators.numbering import numbered

MOST_DEPTH = 3


def change_log(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind, changed) of every row that was created, updated or deleted between two states."""
    a = before.select(F.col(key), F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = after.select(F.col(key), F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    changed = F.filter(F.array(*[F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    kind = F.when(F.col("__a").isNull(), "created").when(F.col("__b").isNull(), "deleted").otherwise("updated")
    return a.join(b, key, "full").select(key, kind.alias("kind"), changed.alias("changed")).where("kind != 'updated' or size(changed) > 0")


def triggered(events: DataFrame, automations: DataFrame) -> DataFrame:
    """Each event with the automations that it sets off: same object and trigger, and for updates one of the watched fields (none: any).

    Automations are configuration, a few thousand at most.
    """
    a = automations.select("automation", F.col("object").alias("on_object"), "trigger", "fields")
    same = (F.col("object") == F.col("on_object")) & (F.col("kind") == F.col("trigger"))
    watched = (F.col("trigger") != "updated") | (F.size("fields") == 0) | F.arrays_overlap("fields", "changed")
    return events.join(a, same).where(watched)


def holds(op: Column, value: Column, wanted: Column, changed: Column, field: Column) -> Column:
    """A condition given as data: its operator and operand are columns, so that any number of them is one expression.

    eq and ne take texts that are numbers as numbers; `in` takes texts joined by bars; contains tells cases apart.
    """
    n, w = value.try_cast("double"), wanted.try_cast("double")
    same = F.coalesce(n == w, value == wanted, F.lit(False))
    among = F.exists(F.split(wanted, "[|]"), lambda x: F.coalesce(n == x.try_cast("double"), value == x, F.lit(False)))
    tests = {
        "eq": same, "ne": ~same, "in": among, "gt": n > w, "gte": n >= w, "lt": n < w, "lte": n <= w, "contains": F.contains(value, wanted),
        "is_set": F.coalesce(value != "", F.lit(False)), "is_empty": F.coalesce(value == "", F.lit(True)), "changed": F.array_contains(changed, field),
    }
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(op == name, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def runs(events: DataFrame, automations: DataFrame, conditions: DataFrame, fields: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """(automation, event_id, outcome): once per automation and event; an event that automations made too deep is blocked.

    conditions: rows (automation, field, op, wanted), all of which must hold; an automation without any runs whenever it is set
    off. fields: the columns of events that conditions may ask; an unknown field holds for nothing.
    """
    met = triggered(events, automations).dropDuplicates(["automation", "event_id"])
    if done is not None:
        met = met.join(done.select("automation", "event_id"), ["automation", "event_id"], "left_anti")
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    asked = conditions.groupBy("automation").agg(F.collect_list(F.struct("field", "op", "wanted")).alias("conditions"))
    joined = met.withColumn("__values", values).join(asked, "automation", "left")
    known = lambda c: c["field"].isin(list(fields))
    passes = F.forall(F.coalesce("conditions", F.array().cast(asked.schema["conditions"].dataType)), lambda c: known(c) & holds(c["op"], F.try_element_at("__values", c["field"]), c["wanted"], F.col("changed"), c["field"]))
    return joined.select("automation", "event_id", F.when(F.col("depth") >= MOST_DEPTH, "loop_blocked").when(passes, "ran").otherwise("skipped").alias("outcome"))


#: What a change may be of.
SIGNAL_KINDS = ("Record", "SchemaVersion")


def signals(changes: DataFrame, org: str, order: list[str]) -> DataFrame:
    """Changes with a number that rises by one within each organisation; ids only, no values. An organisation of any size is numbered by ranges."""
    return numbered(changes, [org], order, "seq")


def digest_items(items: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Items with the beginning of the digest that they go into; windows tumble at multiples of their length since the epoch."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    return items.withColumn("window_start", F.timestamp_seconds(at - F.pmod(at, F.lit(minutes * 60))))


def digest_windows(items: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """The digests of a recipient; their items are told by digest_items."""
    return digest_items(items, ts, minutes).groupBy(key, "window_start").agg(F.count("*").alias("n_items"))


def next_events(log: DataFrame, after: Column, oldest_kept: Column) -> DataFrame:
    """(seq, …, resync) of a change log behind a client's number; a client that lags behind what is kept must read anew."""
    return log.where(F.col("seq") > after).withColumn("resync", after < oldest_kept - 1)


def route(preference: Column, is_quiet: Column) -> Column:
    """Where a notification goes."""
    return F.when(preference == "off", "suppressed").when(is_quiet, "deferred").when(preference == "digest", "batched").otherwise("queued")


def deliveries(requests: DataFrame, sent: DataFrame) -> DataFrame:
    """Requests not sent yet, one per idempotency key, the earliest."""
    others = [c for c in requests.columns if c != "idempotency_key"]
    first = requests.groupBy("idempotency_key").agg(F.min_by(F.struct(*others), F.struct("requested_at", "request_id")).alias("r")).select("idempotency_key", "r.*")
    return first.join(sent.select("idempotency_key"), "idempotency_key", "left_anti")


def approvals(requests: DataFrame, decisions: DataFrame, at: Column, executed: DataFrame | None = None) -> DataFrame:
    """(request, status): decided by somebody other than the requester, or expired, or pending; approved ones that have run are executed. The first valid decision counts."""
    d = decisions.withColumnRenamed("request", "r").join(requests.select(F.col("request").alias("r"), "requester"), "r").where(~F.col("decider").eqNullSafe(F.col("requester")))
    first = d.groupBy("r").agg(F.min_by("verdict", "decided_at").alias("verdict"))
    joined = requests.join(first, F.col("request") == F.col("r"), "left")
    status = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("expires_at") < at, "expired").otherwise("pending")
    if executed is not None:
        joined = joined.join(executed.select(F.col("request").alias("__e")).distinct(), F.col("request") == F.col("__e"), "left")
        status = F.when((F.col("verdict") == "approved") & F.col("__e").isNotNull(), "executed").otherwise(status)
    return joined.select("request", status.alias("status"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over what is there; its result is the table at `path`, which each batch writes anew."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Counts and sums per key and tumbling window, with a watermark: the same on a stream and a batch.

    Events without a time are counted by key under a null start. F.window would drop them, so they stand at the epoch, apart
    from the events that are really there; a stream that drops late rows takes them as late once its watermark has passed that.
    """
    at = F.col(ts).cast("timestamp")
    timed = events.withColumns({"__untimed": at.isNull(), ts: F.coalesce(at, F.timestamp_seconds(F.lit(0)))})
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    counted = timed.groupBy(F.window(ts, window).alias("w"), "__untimed", key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.when(~F.col("__untimed"), F.col("w.start")).alias("window_start"), key, "n", "total")


def executed_once(requests: DataFrame, keys: Sequence[str], ts: str, kept: str) -> DataFrame:
    """Requests of a stream, each key once: state by key, which goes when the watermark has passed a request by `kept`.

    What a batch costs depends on its rows and on the state that is alive, not on the batches before. A key that comes again
    later than that counts as new.
    """
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, kept).dropDuplicatesWithinWatermark(list(keys))


def into_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that may be called again for a batch: each has a folder of its own, which it writes anew. Earlier ones aren't read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_steps(requests: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ts: str, kept: str = "7 days") -> DataFrame:
    """Runs a stream of requests over what is there; the table of those executed, each once."""
    once = executed_once(requests, keys, ts, kept)
    q = once.writeStream.foreachBatch(into_batches(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return requests.sparkSession.read.schema(once.schema).parquet(path)
