"""Ingest and master data: extract, land, resolve, survive, promote — set at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.functions.seal import blind_index
from stewardry.operators.ledger import latest_per_key

CONFIDENCE = {"registry": 1.0, "email": 0.9}
SURE = 0.95
STALE_SECONDS = 300
MOST_NAMES = 5000


def record_hash(source_id: str, deleted: str, at: str, fields: Sequence[str]) -> Column:
    """A digest of a source row: id, deletion, time, and its fields in order of their names; a missing field counts not as null but not at all."""
    told = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "\0"), F.to_json(F.struct(F.col(f).alias("v"))), F.lit("\0"))).otherwise(F.lit("")) for f in sorted(fields)]
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.sha2(F.concat(F.col(source_id).cast("string"), F.lit("\0"), F.when(F.col(deleted), "1").otherwise("0"), F.lit("\0"), stamp, F.lit("\0"), *told), 256)


def incremental(rows: DataFrame, order: Sequence[str], after: Mapping[str, object] | None, full: bool = False) -> DataFrame:
    """Rows behind a cursor ({column: value} by `order`); all of them without one, or where a full resync clears it first."""
    if after is None or full:
        return rows
    return rows.where(F.struct(*order) > F.struct(*[F.lit(after[c]).cast(rows.schema[c].dataType).alias(c) for c in order]))


def cursor(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the place of the last row by `order`."""
    return rows.agg(F.max(F.struct(*order)).alias("at")).select("at.*")


def snapshot_diff(landed: DataFrame, snapshot: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action): insert, update or delete; rows of equal content are left out. landed: with _deleted."""
    a = landed.select(F.col(key), F.col(content).alias("__old"), F.col("_deleted").alias("__gone"))
    b = snapshot.select(F.col(key), F.col(content).alias("__new"), F.lit(True).alias("__here"))
    action = F.when(F.col("__gone").isNull(), "insert").when(F.col("__here").isNull(), F.when(~F.col("__gone"), "delete")).when(F.col("__gone") | ~F.col("__old").eqNullSafe(F.col("__new")), "update")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action is not null")


def landed_upsert(landing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The landing table with a batch's rows, the latest by `order` of each key; new columns are null in old rows."""
    return latest_per_key(landing.unionByName(batch, allowMissingColumns=True), keys, order)


def mark_deleted(landing: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows that a complete snapshot doesn't hold are marked, and stay."""
    here = seen.select(F.col(key).alias("__seen")).distinct()
    return landing.join(here, F.col(key) == F.col("__seen"), "left").withColumn("_deleted", F.col("_deleted") | F.col("__seen").isNull()).drop("__seen")


def schema_fingerprints(fields: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint) of fields (by, field, type): the digest of `field:type` in order, joined by bars."""
    return fields.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "field", "type"))), "|"), 256).alias("fingerprint"))


def drift(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(by, field, change, breaking): added, removed or type_changed; what is removed or changed breaks."""
    a, b = before.select(by, "field", F.col("type").alias("__a")), after.select(by, "field", F.col("type").alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "type_changed")
    return a.join(b, [by, "field"], "full").select(by, "field", change.alias("change")).where("change is not null").withColumn("breaking", F.col("change") != "added")


def drift_reviews(changes: DataFrame, by: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(streams whose promotion pauses, one open review item for each of them with what broke it)."""
    broken = changes.where("breaking").groupBy(by).agg(F.array_sort(F.collect_list(F.concat_ws(":", "field", "change"))).alias("found"))
    item = broken.select(F.sha2(F.concat_ws("|", F.col(by).cast("string"), F.array_join("found", ",")), 256).alias("item"), by, F.lit("schema_drift").alias("kind"), "found", F.lit("open").alias("status"), at.alias("raised_at"))
    return broken.select(by), item


def mapping_proposals(source: DataFrame, target: DataFrame) -> DataFrame:
    """(stream, field, target, score) for source fields (stream, field) and target fields (target): the same normalised name 1.0, one inside the other 0.6; ties go to the first by name.

    Target names are configuration: more than MOST_NAMES are refused, so that pairs stay a bounded factor of the source's names.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = target.select("target", plain(F.col("target")).alias("__t")).distinct()
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} target fields")
    fields = source.select("stream", "field", plain(F.col("field")).alias("__f")).where("__f <> ''")
    same = F.col("__f") == F.col("__t")
    near = F.contains("__f", "__t") | F.contains("__t", "__f")
    pairs = fields.join(F.broadcast(names.where("__t <> ''")), same | near).withColumn("score", F.when(same, 1.0).otherwise(0.6))
    first = pairs.groupBy("stream", "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("b"))
    return first.select("stream", "field", F.col("b.target").alias("target"), (-F.col("b.s")).alias("score"))


#: What may become of a mapping.
MAPPING_STEPS = {"draft": ("proposed", "approved"), "proposed": ("approved", "rejected"), "approved": ("activated", "rejected"), "activated": ("retired",)}


def suggested(fields: DataFrame, suggest: Callable[[list[str]], Mapping[str, str]], targets: Iterable[str]) -> DataFrame:
    """(field, target, status) that an adapter suggests: it sees names only, what isn't a target is dropped, and nothing is activated."""
    names = sorted(r.field for r in fields.select("field").distinct().limit(MOST_NAMES + 1).collect())
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} fields")
    known = set(targets)
    rows = [(f, t, "proposed") for f, t in suggest(names).items() if f in names and t in known]
    return fields.sparkSession.createDataFrame(rows, "field string, target string, status string")


def mapped(landing: DataFrame, mappings: Mapping[str, str], key: str) -> DataFrame:
    """(key, field, value) by activated mappings {source field: field}; nulls and unmapped fields are dropped."""
    values = F.array(*[F.struct(F.lit(t).alias("field"), F.col(f).cast("string").alias("value")) for f, t in mappings.items()])
    return landing.select(key, F.inline(values)).where("value is not null")


def typed_values(triples: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """With `bound` (text, canonical) and `error`: numbers may be texts, dates are YYYY-MM-DD, booleans true or false; texts always bind."""
    v, kind = F.trim("value"), F.lit("text")
    for f, k in kinds.items():
        kind = F.when(F.col("field") == f, k).otherwise(kind)
    num = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), canonical_number(v))
    bound = F.when(kind == "number", num).when(kind == "date", F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date").cast("string"))).when(kind == "boolean", F.when(F.lower(v).isin("true", "false"), F.lower(v))).otherwise(F.col("value"))
    return triples.withColumn("bound", bound).withColumn("error", F.when(bound.isNull(), F.concat(F.lit("not a "), kind)))


def canonical_number(text: Column) -> Column:
    """50000, 50000.0 and 5e4 alike, without trailing zeros; null where it is no number of 38 digits."""
    d = text.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def identity_outcomes(incoming: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """(source_id, outcome, record, confidence, candidates) of incoming (source_id, registry_id, email).

    linked: the source id has a link already, or there is one candidate and it is sure; created: there is none; else review.
    Candidates: links (source_id, record) by registry id, of confidence 1.0, and people (record, email) by equal address, of 0.9.
    """
    norm = lambda c: F.lower(F.trim(c))
    linking = links.select(F.col("source_id").alias("__l"), "record")
    by_link = incoming.join(linking, F.col("source_id") == F.col("__l")).select("source_id", "record")
    registry = incoming.join(linking, F.col("registry_id") == F.col("__l")).select("source_id", "record").distinct()
    asked = incoming.select("source_id", norm(F.col("email")).alias("__m")).where("__m <> ''").distinct()
    known = people.select(norm(F.col("email")).alias("__p"), F.col("record").alias("__r")).where("__p <> ''").distinct()
    # an address stands for all of its people: they are counted once for it, not once for each source that has it
    of = known.groupBy("__p").agg(F.count("*").alias("n"), F.max("__r").alias("most"))
    mail = asked.join(of, F.col("__m") == F.col("__p")).groupBy("source_id").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    # what that counts twice: people of several addresses, for sources of several, and those whom the registry names as well
    many = asked.join(asked.groupBy("source_id").agg(F.count("*").alias("__k")).where("__k > 1").select("source_id"), "source_id")
    known_by = known.groupBy("__r").agg(F.count("*").alias("__k")).where("__k > 1").select(F.col("__r").alias("__s"))
    several = known.join(known_by, F.col("__r").eqNullSafe(F.col("__s")), "left_semi")
    again = many.join(several, F.col("__m") == F.col("__p")).groupBy("source_id", "__r").agg((F.count("*") - 1).alias("n")).groupBy("source_id").agg(F.sum("n").alias("twice"))
    named = registry.join(asked, "source_id").join(known, (F.col("__m") == F.col("__p")) & F.col("record").eqNullSafe(F.col("__r")), "left_semi").select("source_id", "record").distinct()
    sure_of = registry.groupBy("source_id").agg(F.count("*").alias("rn"), F.max("record").alias("rmost"))
    both = named.groupBy("source_id").agg(F.count("*").alias("shared"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = sure_of.join(mail, "source_id", "full").join(again, "source_id", "left").join(both, "source_id", "left")
    best = F.when(F.col("rn").isNotNull(), F.struct(F.col("rmost").alias("record"), F.lit(CONFIDENCE["registry"]).alias("confidence"))).otherwise(F.struct(F.col("most").alias("record"), F.lit(CONFIDENCE["email"]).alias("confidence")))
    found = found.select("source_id", (zero("rn") + zero("n") - zero("twice") - zero("shared")).alias("candidates"), best.alias("best"))
    linked = by_link.groupBy(F.col("source_id").alias("__s")).agg(F.min("record").alias("__linked"))
    met = incoming.select("source_id").distinct().join(found, "source_id", "left").join(linked, F.col("source_id") == F.col("__s"), "left")
    n, sure = F.coalesce("candidates", F.lit(0)), F.col("best.confidence") >= SURE
    outcome = F.when(F.col("__linked").isNotNull(), "linked").when(n == 0, "created").when((n == 1) & sure, "linked").otherwise("review")
    record = F.coalesce("__linked", F.when((n == 1) & sure, F.col("best.record")))
    return met.select("source_id", outcome.alias("outcome"), record.alias("record"), F.when(F.col("__linked").isNotNull(), 1.0).otherwise(F.col("best.confidence")).alias("confidence"), n.cast("long").alias("candidates"))


def survivors(proposals: DataFrame, held: DataFrame) -> DataFrame:
    """(record, field, value, source) of proposals (record, field, value, source, priority, ordinal): lowest priority number, then the first; blanks never win, and what is held already (record, field, value) isn't won again."""
    real = proposals.where("value is not null and trim(value) <> ''")
    won = real.groupBy("record", "field").agg(F.min_by(F.struct("value", "source"), F.struct("priority", "ordinal", "source")).alias("w")).select("record", "field", "w.value", "w.source")
    now = held.select("record", "field", F.col("value").alias("__held"))
    return won.join(now, ["record", "field"], "left").where(~F.col("value").eqNullSafe(F.col("__held"))).drop("__held")


def provenance(winners: DataFrame, run: str, at: Column) -> DataFrame:
    """A row for each winner: where its value is from."""
    return winners.select("record", "field", "source", F.sha2("value", 256).alias("value_sha256"), F.lit(run).alias("run"), at.alias("at"))


def promoted(triples: DataFrame, kinds: Mapping[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """(records whose values all bind, reviews of the others): a record is promoted whole or not at all."""
    bound = typed_values(triples, kinds)
    whole = bound.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("field", "bound"))))).alias("fields"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "field", "error")))).alias("errors"))
    return whole.where(F.size("errors") == 0).select(key, "fields"), whole.where(F.size("errors") > 0).select(key, "errors")


def promotion_conflicts(bound: DataFrame) -> DataFrame:
    return bound.where("error is not null")


def runs_to_start(asked: DataFrame, runs: DataFrame, at: Column, paused: DataFrame | None = None) -> DataFrame:
    """(stream, outcome) of streams asked to run: busy while one runs whose heartbeat is fresh, paused, else started."""
    alive = runs.where((F.col("status") == "running") & (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("heartbeat").cast("timestamp")) <= STALE_SECONDS)).select(F.col("stream").alias("__r")).distinct()
    out = asked.select("stream").distinct().join(alive, F.col("stream") == F.col("__r"), "left")
    held = F.lit(False)
    if paused is not None:
        out = out.join(paused.select(F.col("stream").alias("__p")).distinct(), F.col("stream") == F.col("__p"), "left")
        held = F.col("__p").isNotNull()
    return out.select("stream", F.when(F.col("__r").isNotNull(), "busy").when(held, "paused").otherwise("started").alias("outcome"))


def stale_runs(runs: DataFrame, at: Column) -> DataFrame:
    """Runs that are to be given up: running, without a heartbeat for STALE_SECONDS."""
    return runs.where((F.col("status") == "running") & (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("heartbeat").cast("timestamp")) > STALE_SECONDS))


def reviewed(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open reviews (source_id, candidates, status) with the first decision (source_id, verdict, record, decided_at) on each: link to one of the candidates, or reject."""
    first = decisions.groupBy(F.col("source_id").alias("__s")).agg(F.min_by(F.struct("verdict", "record"), "decided_at").alias("d"))
    joined = reviews.join(first, F.col("source_id") == F.col("__s"), "left")
    valid = (F.col("d.verdict") == "link") & F.array_contains("candidates", F.col("d.record"))
    status = F.when(F.col("status") != "open", F.col("status")).when(valid, "linked").when(F.col("d.verdict") == "reject", "rejected").otherwise(F.col("status"))
    return joined.select("source_id", status.alias("status"), F.when((F.col("status") == "open") & valid, F.col("d.record")).alias("record"))


def scrubbed(landing: DataFrame, fields: Mapping[str, str], key: bytes, org: str) -> DataFrame:
    """Plain values of sensitive fields {field: kind} replaced by a marker with their digest; what is one already stays."""
    out = {}
    for f, kind in fields.items():
        mark = F.concat(F.lit(f'{{"${kind}_sealed": "'), blind_index(key, org, f, F.col(f), kind), F.lit('"}'))
        out[f] = F.when(F.col(f).isNull() | F.startswith(f, F.lit(f'{{"${kind}_sealed": "')), F.col(f)).otherwise(mark)
    return landing.withColumns(out)


def retrofit(path: str, landing: DataFrame, partition: str, fields: Mapping[str, str], key: bytes, org: str) -> list:
    """Rewrites in place the partitions of a landing table (partitioned by `partition`) that hold plain values of fields which have become sensitive.

    Only those are read whole and overwritten, each at once; the others' files stay. Run again it finds nothing to do. Returns
    the partitions rewritten.
    """
    from stewardry.session import written

    plain = F.lit(False)
    for f, kind in fields.items():
        plain = plain | F.coalesce(~F.startswith(f, F.lit(f'{{"${kind}_sealed": "')), F.lit(False))
    touched = [r[0] for r in landing.where(plain).select(partition).distinct().orderBy(partition).collect()]
    if touched:
        # aside first: a table can't be overwritten while it is read
        aside = written(scrubbed(landing.where(F.col(partition).isin(touched)), fields, key, org))
        aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched


def compare_and_set(records: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records after, outcomes): an update (key, expected, value) is applied if the record's version is the expected one; else conflict or not_found.

    Of several updates of one record the one of the largest value is looked at; the others conflict with it.
    """
    ranked = updates.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("value"), "expected")))
    held = records.select(F.col(key).alias("__k"), F.col("version").alias("__v"))
    judged = ranked.join(held, F.col(key) == F.col("__k"), "left")
    outcome = F.when(F.col("__v").isNull(), "not_found").when((F.col("__n") > 1) | (F.col("__v") != F.col("expected")), "conflict").otherwise("applied")
    decided = judged.select(key, "expected", "value", outcome.alias("outcome"))
    good = decided.where("outcome = 'applied'").select(F.col(key).alias("__k"), F.col("value").alias("__new"))
    after = records.join(good, F.col(key) == F.col("__k"), "left")
    return after.select(*[F.coalesce("__new", "value").alias("value") if c == "value" else (F.col("version") + F.when(F.col("__k").isNotNull(), 1).otherwise(0)).alias("version") if c == "version" else F.col(c) for c in records.columns]), decided.select(key, "outcome")


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
