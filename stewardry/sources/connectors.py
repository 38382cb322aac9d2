"""Connectors: the contract of a source, a restartable stream over a table's files, content-addressed files, inbound messages."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from stewardry.functions.seal import hmac_sha256

#: Rows of a page at most, and pages of an extract.
MOST_PAGE, MOST_PAGES = 1000, 10_000
#: Sensitivity of files, least first.
CLASSES = ("public", "internal", "pii", "secret")


def cursor_of(order: Sequence[str]) -> Column:
    """A row's place in the source as text: its order columns joined by bars, times in UTC with all their digits."""
    return F.concat_ws("|", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if k == 0 else F.col(c).cast("string") for k, c in enumerate(order)])


@dataclass(frozen=True)
class Connector:
    """Tables of a source: {object: (DataFrame, (time column, id column))}, told as `discover`, `fetch_page` and `count`."""

    tables: Mapping[str, tuple[DataFrame, tuple[str, str]]]

    def discover(self, spark: SparkSession) -> DataFrame:
        """(object, field, type) of all that the source holds."""
        rows = [(name, f.name, f.dataType.simpleString()) for name, (frame, _) in self.tables.items() for f in frame.schema]
        return spark.createDataFrame(rows, "object string, field string, type string")

    def count(self, name: str) -> DataFrame:
        return self.tables[name][0].agg(F.count("*").alias("n"))

    def after(self, name: str, cursor: str | None) -> DataFrame:
        """Rows behind a cursor, at any size at once. A cursor that can't be read starts anew."""
        frame, (at, key) = self.tables[name]
        if cursor is None:
            return frame
        told, _, last = cursor.partition("|")
        place = frame.sparkSession.range(1).select(F.lit(told).try_cast("timestamp").alias("t"), F.lit(last).try_cast(frame.schema[key].dataType).alias("k")).first()
        if place.t is None or place.k is None:
            return frame
        t = F.lit(told).cast("timestamp")
        return frame.where((F.col(at).cast("timestamp") > t) | ((F.col(at).cast("timestamp") == t) & (F.col(key) > F.lit(place.k))))

    def fetch_page(self, name: str, cursor: str | None, size: int) -> tuple[DataFrame, str | None]:
        """(the next rows in order, the cursor behind them or None at the end)."""
        page = self.after(name, cursor).orderBy(*self.tables[name][1]).limit(max(1, min(MOST_PAGE, size)))
        last = page.agg(F.max_by(cursor_of(self.tables[name][1]), F.struct(*self.tables[name][1])).alias("c"), F.count("*").alias("n")).first()
        return page, last.c if last.n == max(1, min(MOST_PAGE, size)) else None


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class TableStream(DataSource):
    """`spark.readStream.format("table_stream")`: the rows of a table's files in the order of their names, page by page.

    Options: path (a folder or a file), page_rows (rows of a task at least: it takes whole row groups, so that each is read once). The offset is a number of rows; Spark commits it in the query's
    checkpoint, so that a query that was stopped goes on behind the last row committed. Files are only added, under later names.
    """

    @classmethod
    def name(cls) -> str:
        return "table_stream"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_files(self.options["path"])[0][1].schema_arrow, prefer_timestamp_ntz=True)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TableReader(self.options["path"], int(self.options.get("page_rows", 100_000)), [f.name for f in schema])


def _files(path: str) -> list[tuple[str, Any]]:
    """(file, its Parquet footer) in the order of the files' names."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    info = store.get_file_info(root)
    names = [root] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    if not names:
        raise ValueError(f"{path} holds no Parquet files")
    return [(n, pq.ParquetFile(store.open_input_file(n))) for n in names]


class _TableReader(DataSourceStreamReader):
    def __init__(self, path: str, page_rows: int, columns: list[str]):
        self.path, self.page_rows, self.columns = path, page_rows, columns

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": sum(f.metadata.num_rows for _, f in _files(self.path))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out, before = [], 0
        for name, file in _files(self.path):
            n = file.metadata.num_rows
            lo, hi = max(0, start["row"] - before), min(n, end["row"] - before)
            at = 0
            for g in range(file.metadata.num_row_groups):
                at += file.metadata.row_group(g).num_rows
                if lo < min(at, hi) and (at - lo >= self.page_rows or at >= hi):
                    out.append(_Rows(name, lo, min(at, hi)))
                    lo = min(at, hi)
            before += n
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        ((_, file),) = _files(partition.path)
        before = 0
        for g in range(file.metadata.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            lo, hi = max(partition.first - before, 0), min(partition.end - before, n)
            if lo < hi:
                at = 0
                for batch in file.iter_batches(row_groups=[g], columns=self.columns):
                    part = batch.slice(max(lo - at, 0), max(min(hi - at, batch.num_rows) - max(lo - at, 0), 0))
                    if part.num_rows:
                        yield part
                    at += batch.num_rows
            before += n


def altered(rows: DataFrame, remove: Column | None = None, rewrite: Mapping[str, Column] | None = None, append: DataFrame | None = None, field: Mapping[str, Column] | None = None) -> DataFrame:
    """A later state of a source: rows removed, columns rewritten or added, rows appended."""
    out = rows if remove is None else rows.where(~F.coalesce(remove, F.lit(False)))
    out = out.withColumns({**(rewrite or {}), **(field or {})})
    return out if append is None else out.unionByName(append, allowMissingColumns=True)


def landing_page(landing: DataFrame, after: Column | None, n: int) -> DataFrame:
    """The next n rows of a landing table in the order of _source_id, without deleted ones."""
    rows = landing.where("not _deleted")
    return (rows if after is None else rows.where(F.col("_source_id") > after)).orderBy("_source_id").limit(n)


def stored_files(files: DataFrame, ceiling: str = "internal", verify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) of files (path, content, class): the kept ones by the digest of their content, each content once.

    A class above the ceiling is refused, as is an unknown one and content that doesn't have the digest that `verify` names.
    """
    allowed = CLASSES[: CLASSES.index(ceiling) + 1]
    told = files.withColumn("sha256", F.sha2("content", 256))
    reason = F.when(~F.coalesce(F.col("class").isin(*CLASSES), F.lit(False)), "unknown_class").when(~F.col("class").isin(*allowed), "class").when(~(F.col(verify) == F.col("sha256")) if verify else F.lit(False), "digest")
    judged = told.withColumn("reason", reason)
    kept = judged.where("reason is null").groupBy("sha256").agg(F.min("path").alias("path"), F.max("class").alias("class"), F.count("*").alias("copies"), F.first("content").alias("content"))
    return kept, judged.where("reason is not null").select("path", "sha256", "reason")


def expired_files(files: DataFrame, at: Column, days: Mapping[str, int]) -> DataFrame:
    """Files (sha256, class, stored_at, hold) that retention lets go: older than their class allows, and not held."""
    limit = F.lit(None).cast("int")
    for name, n in days.items():
        limit = F.when(F.col("class") == name, F.lit(n)).otherwise(limit)
    return files.where(~F.coalesce(F.col("hold"), F.lit(False)) & (F.col("stored_at") < F.timestamp_add("DAY", -limit, at)))


def inbound_messages(payloads: DataFrame, key: bytes) -> DataFrame:
    """(message_id, sender, body, n_attachments) of payloads (body_json, signature) whose HMAC-SHA256 is right, each message once, the first received."""
    right = payloads.where(hmac_sha256(key, F.col("body_json")) == F.col("signature"))
    told = F.from_json("body_json", "message_id string, sender string, body string, attachments array<string>")
    parts = right.select("received_at", told.alias("m")).select("received_at", "m.*").where("message_id is not null")
    first = parts.groupBy("message_id").agg(F.min_by(F.struct("sender", "body", F.coalesce(F.size("attachments"), F.lit(0)).alias("n")), F.struct("received_at", "body")).alias("m"))
    return first.select("message_id", "m.sender", "m.body", F.greatest(F.col("m.n"), F.lit(0)).alias("n_attachments"))


def digest_of(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def with_deadline(rows: DataFrame, seconds: float) -> list:
    """All rows of a small result, or an error when they take longer."""
    import threading

    context = rows.sparkSession.sparkContext
    tag = f"deadline-{id(rows)}"
    context.addJobTag(tag)
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    timer.start()
    try:
        return rows.collect()
    except Exception as e:
        if not timer.is_alive():
            raise TimeoutError(f"the read took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
