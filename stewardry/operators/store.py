"""Several tables that change together: parts are written first, and one manifest makes them visible."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from stewardry.functions.seal import blind_index
from stewardry.functions.transforms import broken_rules, preset
from stewardry.operators.ledger import latest_per_key
from stewardry.session import written


class Conflict(RuntimeError):
    """Somebody else has committed meanwhile."""


class Store:
    """Tables below a folder. A commit's number names its manifest, which is created only if there is none: of two writers one wins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        where = self._hadoop.Path(f"{path}/_commits")
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(where)

    def _manifests(self) -> list[dict[str, Any]]:
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/_commits")) if s.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            stream = self._fs.open(self._hadoop.Path(f"{self.path}/_commits/{name}"))
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return out

    def version(self) -> int:
        found = self._manifests()
        return found[-1]["n"] if found else 0

    def read(self, table: str, schema: StructType | str, at: int | None = None) -> DataFrame:
        """All committed rows of a table; at: as of a commit."""
        folders = [m["parts"][table] for m in self._manifests() if table in m["parts"] and (at is None or m["n"] <= at)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def put(self, table: str, rows: DataFrame, expected: int) -> str:
        """Writes rows of a table aside; the folder's name is a part of the commit after `expected`, and nobody sees it before."""
        told = f"{table}/{expected + 1:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{told}")
        return told

    def commit(self, parts: Mapping[str, DataFrame | str], expected: int) -> int:
        """Appends rows, or what `put` has written, to several tables, all or none, if `expected` is still the last commit."""
        n = expected + 1
        told = {table: rows if isinstance(rows, str) else self.put(table, rows, expected) for table, rows in parts.items()}
        name = self._hadoop.Path(f"{self.path}/_commits/{n:012d}.json")
        try:
            stream = self._fs.create(name, False)
        except Exception as e:
            raise Conflict(f"commit {n} is taken") from e
        try:
            stream.write(bytearray(json.dumps({"n": n, "parts": told}).encode()))
        finally:
            stream.close()
        return n


RECORDS = "id string, version long, state string, fields map<string,string>"
AUDIT = "id string, version long, actor string, action string, at timestamp"
CHANGES = "id string, kind string, changed array<string>, depth int, commit long"


@dataclass(frozen=True)
class WriteRules:
    """rules: as for broken_rules; presets: {field: (value, when)}; sealed: {field: kind}, whose digests are stored in place of the values."""

    rules: Mapping[str, Mapping[str, Any]]
    presets: Mapping[str, tuple[Any, str]]
    sealed: Mapping[str, str]
    key: bytes = b""
    org: str = "all"


def current(store: Store) -> DataFrame:
    """The latest version of every record: (id, version, state, fields)."""
    return latest_per_key(store.read("records", RECORDS), ["id"], ["version"])


def governed_write(store: Store, requests: DataFrame, fields: Sequence[str], told: WriteRules, actor: str, at: Column, depth: int = 0) -> DataFrame:
    """Presets, rules, sealing and compare-and-set for a batch of requests (id, expected: the version seen, null to create; the fields), in one commit.

    Returns (id, outcome, errors): written, invalid, conflict, missing, duplicate (of requests for one record in a batch none is
    written: there is no order between them). What is written makes a version, an audit row and a change row with `depth`, and
    a reader sees all of them or none; a write that fails half-way leaves nothing to be seen.
    """
    seen = store.version()
    filled = requests.withColumns({f: preset(F.col(f), value, when, actor) for f, (value, when) in told.presets.items()})
    judged = filled.withColumn("errors", broken_rules(told.rules))
    # both zeros are one value, so they are one text
    plain = {f: F.col(f) + F.lit(0.0).cast(filled.schema[f].dataType) if isinstance(filled.schema[f].dataType, (FloatType, DoubleType)) else F.col(f) for f in fields}
    stored = {f: blind_index(told.key, told.org, f, plain[f], told.sealed[f]) if f in told.sealed else plain[f].cast("string") for f in fields}
    rows = judged.select(F.col("id").cast("string").alias("id"), F.col("expected").cast("long").alias("expected"), "errors", F.create_map(*[x for f, c in stored.items() for x in (F.lit(f), c)]).alias("fields"))
    counted = rows.join(rows.groupBy("id").agg(F.count("*").alias("asked")), "id")
    held = current(store).select("id", F.col("version").alias("held"), F.col("fields").alias("before"))
    met = counted.join(held, "id", "left")
    outcome = (
        F.when(F.col("asked") > 1, "duplicate").when(F.size("errors") > 0, "invalid").when(F.col("expected").isNotNull() & F.col("held").isNull(), "missing")
        .when(~F.col("expected").eqNullSafe(F.col("held")), "conflict").otherwise("written")
    )
    decided = written(met.withColumn("outcome", outcome))
    done = decided.where("outcome = 'written'")
    version = (F.coalesce("held", F.lit(0)) + 1).cast("long").alias("version")
    created = F.col("held").isNull()
    changed = F.filter(F.array(*map(F.lit, fields)), lambda f: ~F.coalesce(F.try_element_at("before", f), F.lit("")).eqNullSafe(F.coalesce(F.try_element_at("fields", f), F.lit(""))))
    kind = F.when(created, "created").otherwise("updated")
    parts = {
        "records": done.select("id", version, F.lit("published").alias("state"), "fields"),
        "audit": done.select("id", version, F.lit(actor).alias("actor"), kind.alias("action"), at.cast("timestamp").alias("at")),
        "changes": done.select("id", kind.alias("kind"), changed.alias("changed"), F.lit(depth).alias("depth"), F.lit(seen + 1).cast("long").alias("commit")),
    }
    store.commit(parts, seen)
    return decided.select("id", "outcome", "errors")
