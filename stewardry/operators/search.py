"""Search under permissions: the rows a caller may see are fixed before anything is matched or ranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.operators.store import Store
from stewardry.session import written

#: Words that a query and an index leave out.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")
EMBED_DIMS = 64
#: FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
HIDDEN = "▪▪▪"


def stem(w: Column) -> Column:
    """Plural and verb endings of English are cut off words of five letters and more."""
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    ends = lambda *x: reduce(lambda p, q: p | q, [F.endswith(w, F.lit(e)) for e in x])
    return F.when(F.length(w) <= 4, w).when(ends("ies", "ing"), cut(3)).when(ends("ed", "es"), cut(2)).when(ends("s"), cut(1)).otherwise(w)


def terms(text: Column) -> Column:
    """Stems of the lower-case words without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP))
    return F.transform(words, stem)


def guarded(rows: DataFrame, storage_class: str = "storage_class") -> DataFrame:
    """Rows whose storage class may be indexed at all."""
    c = F.col(storage_class)
    return rows.where(~((c == "pii") | F.startswith(c, F.lit("pii.")) | F.startswith(c, F.lit("secret."))))


def index_rows(rows: DataFrame, id_col: str, text_col: str, order: str | None = None) -> DataFrame:
    """(id, text, terms), one row a record: the last by `order`, without it the one of the largest text."""
    told = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(order) if order else F.lit(0)).alias("o"))
    # a text is sent once, beside its id; that also deals the work on its words to all tasks, however the rows were filed
    last = told.groupBy("id").agg(F.max(F.struct("o", "text")).alias("last"))
    return last.select("id", "last.text", terms(F.col("last.text")).alias("terms"))


def counted(words: Column) -> Column:
    """(term, tf) of an array of terms: the runs of the sorted array."""
    n, s = F.size(words), F.sort_array(words)
    begins = lambda s: F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(s, k) != F.get(s, k - 1)))
    runs = lambda s, b: F.transform(b, lambda k, j: F.struct(F.get(s, k).alias("term"), (F.coalesce(F.get(b, j + 1), n) - k).cast("long").alias("tf")))
    # each step once: a column that is named twice in a plan may be computed twice
    once = F.transform(F.array(F.struct(s.alias("s"))), lambda x: F.transform(F.array(begins(x["s"])), lambda b: runs(x["s"], b)))
    return F.when(n > 0, F.flatten(F.flatten(once))).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    got = spark.range(1).select(F.array_distinct(terms(F.lit(query))).alias("t")).first().t
    if not got:
        raise ValueError("the query has no words")
    return got


def lexical_search(index: DataFrame, query: str, scope: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """(id, score, snippet) of rows that have every word of the query; score: their share of the row's words. scope: ids (__id) the caller may see. limit: 1 to 100, or None for all hits, in no order."""
    wanted = query_terms(index.sparkSession, query)
    rows = index if scope is None else index.join(scope, index["id"] == scope["__id"], "left_semi")
    for t in wanted:
        rows = rows.where(F.array_contains("terms", t))
    hits = F.size(F.filter("terms", lambda w: w.isin(wanted)))
    ranked = rows.select("id", (hits / F.size("terms")).alias("score"), "text")
    if limit is not None:
        ranked = ranked.orderBy(F.desc("score"), "id").limit(max(1, min(100, limit)))
    return ranked.select("id", "score", snippet(F.col("text"), wanted).alias("snippet"))


def bm25_search(index: DataFrame, query: str, scope: DataFrame | None = None, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, snippet) by BM25 over the rows the caller may see; statistics are those of the whole index."""
    wanted = query_terms(index.sparkSession, query)
    stats = index.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"), *[F.count_if(F.array_contains("terms", t)).alias(f"df{i}") for i, t in enumerate(wanted)])
    total = stats.select(F.struct("*")).scalar()
    rows = index if scope is None else index.join(scope, index["id"] == scope["__id"], "left_semi")
    met = rows.where(F.arrays_overlap("terms", F.array(*map(F.lit, wanted)))).withColumns({c: total[c] for c in stats.columns})
    score = F.lit(0.0)
    for i, t in enumerate(wanted):
        tf = F.size("terms") - F.size(F.array_remove("terms", t))
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("terms") / F.col("mean")))
    ranked = met.select("id", score.alias("score"), "text").orderBy(F.desc("score"), "id").limit(max(1, min(100, limit)))
    return ranked.select("id", "score", snippet(F.col("text"), wanted).alias("snippet"))


@dataclass(frozen=True)
class Stored:
    """A stored index: segments that are only ever added, each the postings and texts of one upsert.

    postings: (term, id, tf, size, segment), each file ordered by term, so that a query reads the pages of its words of each file, and
    a common word lies in all; documents: (id, text, size, segment); gone: (id, segment), what is dead in all earlier segments.
    """

    store: Store

    def _read(self, table: str) -> DataFrame:
        return self.store.read(table, _TABLES[table](self.store.id_type))

    @property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @property
    def documents(self) -> DataFrame:
        return self._read("documents")

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, segment, …) of segments in which their record is alive."""
        dead = self._read("gone").groupBy(F.col("id").alias("__gone")).agg(F.max("segment").alias("__until"))
        return rows.join(dead, F.col("id") == F.col("__gone"), "left").where("__until is null or segment >= __until").drop("__gone", "__until")

    def totals(self) -> tuple[int, float]:
        """(records, mean number of words)."""
        t = self._read("totals").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        return (t.n, t.words / t.n) if t.n else (0, 0.0)


_TABLES = {
    "postings": lambda t: f"term string, id {t}, tf long, size int, segment long", "documents": lambda t: f"id {t}, text string, size int, segment long",
    "gone": lambda t: f"id {t}, segment long", "totals": lambda t: "n long, words long",
}


class _IndexStore(Store):
    def __init__(self, spark: SparkSession, path: str, id_type: str):
        super().__init__(spark, path)
        self.id_type = id_type


def _segment(stored: Stored, changed: DataFrame | None, removed: DataFrame | None) -> None:
    """Adds one segment: changed rows (as index_rows gives them), and ids that are no more."""
    store = stored.store
    seen, t = store.version(), store.id_type
    n = F.lit(seen + 1).cast("long").alias("segment")
    empty = store.spark.createDataFrame([], f"id {t}, text string, terms array<string>")
    told = (empty if changed is None else changed).select(F.col("id").cast(t).alias("id"), "text", counted(F.col("terms")).alias("counts"), F.size("terms").alias("size"), n)
    # texts are written once, where they stay, with their words beside them
    put = store.put("documents", told, seen)
    new = store.spark.read.schema(told.schema).parquet(f"{store.path}/{put}")
    if new.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a record comes twice: index_rows gives the latest text of each")
    parts: dict[str, DataFrame | str] = {"documents": put}
    gained = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("words"))
    if seen:
        ids = new.select("id") if removed is None else new.select("id").unionByName(removed.select(F.col("id").cast(t).alias("id")))
        ids = written(ids.distinct())
        before = stored.live(stored.documents.select("id", "size", "segment")).join(ids.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left_semi")
        gained = gained.unionByName(before.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("size"), F.lit(0))).cast("long").alias("words")))
        parts["gone"] = ids.select("id", n)
    # a text's words are counted within it, so that no posting is shuffled
    parts["postings"] = new.select("id", "size", F.inline("counts")).select("term", "id", "tf", "size", n).sortWithinPartitions("term", "id")
    parts["totals"] = gained
    store.commit(parts, seen)


def store_index(index: DataFrame, path: str) -> Stored:
    """Writes an index (as index_rows gives it) as its first segment."""
    stored = Stored(_IndexStore(index.sparkSession, path, index.schema["id"].dataType.simpleString()))
    _segment(stored, index, None)
    return stored


def open_index(spark: SparkSession, path: str, id_type: str = "bigint") -> Stored:
    return Stored(_IndexStore(spark, path, id_type))


def upsert_index(stored: Stored, changed: DataFrame) -> None:
    """Adds a segment of the changed rows only; what they replace is dead from then on."""
    _segment(stored, changed, None)


def remove_from_index(stored: Stored, ids: DataFrame) -> None:
    _segment(stored, None, ids)


def compact_index(stored: Stored, path: str) -> Stored:
    """The live rows as one segment of a new index: worth its cost when many segments, or many dead rows, have gathered."""
    live = stored.live(stored.documents)
    return store_index(live.select("id", "text", terms(F.col("text")).alias("terms")), path)


def _postings(stored: Stored, wanted: list[str]) -> DataFrame:
    return stored.live(stored.postings.where(F.col("term").isin(wanted)))


#: Words of a snippet.
LEAST_WORDS, MOST_WORDS = 10, 24


def snippet(text: Column, wanted: list[str]) -> Column:
    """The words around a text's best place: of all stretches of MOST_WORDS words that begin with one of the query's, the first that has most of them, cut behind the last one, of LEAST_WORDS at least. Never part of a word."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    query = F.array(*map(F.lit, wanted))
    # the word of the query that a piece holds, else an empty one
    met = F.transform(pieces, lambda w: F.coalesce(F.get(F.array_intersect(terms(w), query), F.lit(0)), F.lit("")))
    places = F.filter(F.transform(met, lambda m, k: F.when(m != "", k + 1)), lambda k: k.isNotNull())
    seen = lambda k: F.array_remove(F.array_distinct(F.slice(met, k, MOST_WORDS)), "")
    best = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(1).alias("at")), lambda b, k: F.when(F.size(seen(k)) > b["n"], F.struct(F.size(seen(k)).alias("n"), k.cast("int").alias("at"))).otherwise(b))
    begin = best["at"]
    last = F.array_max(F.transform(F.slice(met, begin, MOST_WORDS), lambda m, k: F.when(m != "", k + 1).otherwise(0)))
    return F.array_join(F.slice(pieces, begin, F.greatest(F.coalesce(last, F.lit(0)), F.lit(LEAST_WORDS))), " ")


def _best(scored: DataFrame, stored: Stored, wanted: list[str], limit: int) -> DataFrame:
    # at most a hundred rows fetch their texts
    top = scored.orderBy(F.desc("score"), "id").limit(max(1, min(100, limit)))
    texts = stored.documents.select(F.col("id").alias("__id"), F.col("segment").alias("__segment"), "text").join(F.broadcast(top), (F.col("__id") == F.col("id")) & (F.col("__segment") == F.col("segment")))
    return texts.select("id", "score", snippet(F.col("text"), wanted).alias("snippet")).orderBy(F.desc("score"), "id")


def _within(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    return rows if scope is None else rows.join(scope, rows["id"] == scope["__id"], "left_semi")


def stored_lexical(stored: Stored, query: str, scope: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """As lexical_search, from the postings of the query's words."""
    wanted = query_terms(stored.store.spark, query)
    rows = _within(_postings(stored, wanted), scope)
    met = rows.groupBy("id", "segment").agg((F.sum("tf") / F.first("size")).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return _best(met.select("id", "segment", "score"), stored, wanted, limit)


def stored_bm25(stored: Stored, query: str, scope: DataFrame | None = None, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As bm25_search, from the postings of the query's words."""
    wanted = query_terms(stored.store.spark, query)
    rows = _postings(stored, wanted)
    n, mean = stored.totals()
    seen = {r.term: r["count"] for r in rows.groupBy("term").count().collect()}
    idf = F.create_map(*[F.lit(x) for t, df in seen.items() for x in (t, float(np.log(1 + (n - df + 0.5) / (df + 0.5))))]) if seen else F.lit(None).cast("map<string,double>")
    weight = F.try_element_at(idf, F.col("term")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(mean)))
    return _best(_within(rows, scope).groupBy("id", "segment").agg(F.sum(weight).alias("score")), stored, wanted, limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bag of words hashed (FNV-1a) into EMBED_DIMS counts, normalised. (id, text) becomes (id, embedding)."""
    import re

    for batch in batches:
        out, cells = [], {}
        for text in batch.column("text").to_pylist():
            v = np.zeros(EMBED_DIMS, np.float64)
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                cell = cells.get(word)
                if cell is None:  # each word of a batch is hashed once
                    h = FNV_OFFSET
                    for byte in word.encode():
                        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
                    cells[word] = cell = h % EMBED_DIMS
                v[cell] += 1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])


def embed(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(hashed_words, f"id {kind}, embedding array<float>")


def cached_vectors(index: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(vectors that still hold, rows that need a new one). cache: (id, model, dimensions, text_sha256, embedding)."""
    now = index.select("id", "text", F.sha2("text", 256).alias("h"))
    held = cache.where((F.col("model") == model) & (F.size("embedding") == F.col("dimensions"))).select(F.col("id").alias("cid"), F.col("text_sha256").alias("ch"), "embedding")
    valid = now.join(held, (F.col("id") == F.col("cid")) & (F.col("h") == F.col("ch"))).select("id", "embedding")
    return valid, now.join(valid, "id", "left_anti").select("id", "text")


def rerank(pool: DataFrame, vectors: DataFrame, query_vector: list[float], limit: int) -> DataFrame:
    """pool: (id, score) in lexical order; those nearest to the query first, ties as they were."""
    place = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # the pool is at most 100 rows
    placed = written(pool.select("id", place.alias("place")))
    # they go to the vectors, so that only theirs are shuffled
    ranked = placed.join(vectors.join(F.broadcast(placed.select("id")), "id", "left_semi"), "id", "left")
    near = F.coalesce(F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), 9), F.lit(0.0))
    return ranked.select("id", near.alias("similarity"), "place").orderBy(F.desc("similarity"), "place").limit(limit).select("id", "similarity")


def semantic_search(index: DataFrame | Stored, vectors: DataFrame, query: str, query_vector: list[float], scope: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """A lexical pool of four times the limit (at most 200, of which the lexical search gives up to 100), reordered by similarity."""
    find = stored_lexical if isinstance(index, Stored) else lexical_search
    return rerank(find(index, query, scope, max(min(4 * limit, 200), limit)), vectors, query_vector, limit)


def nearest(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """The k vectors nearest to the query by cosine; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def message_search(messages: DataFrame, threads: DataFrame, query: str, scope: DataFrame, limit: int = 20, body_visible: bool = True, indexed: DataFrame | None = None) -> DataFrame:
    """Messages (id, thread, body) of threads (thread, subject) that the caller may see (__id of messages); a hidden body is not shown.

    indexed: the rows of an index that may be older than the messages; a hit whose message is no more is dropped.
    """
    rows = indexed
    if rows is None:
        joined = messages.join(threads, "thread", "left")
        rows = joined.select("id", F.concat(F.coalesce("body", F.lit("")), F.lit("\nThread: "), F.coalesce("subject", F.lit(""))).alias("text"))
    here = scope.join(messages.select(F.col("id").alias("__here")), F.col("__id") == F.col("__here"), "left_semi")
    found = lexical_search(index_rows(rows, "id", "text"), query, here, limit)
    return found if body_visible else found.withColumn("snippet", F.lit(HIDDEN))
