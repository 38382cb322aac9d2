"""Importance resampling towards a target distribution, over inverted postings partitioned by bucket.

Features are runs of one to three words, hashed into buckets. Scans turn chunks of documents into postings (bucket, document,
count), which are shuffled in blocks: a block holds the postings of one range of buckets over one chunk of documents, so a
bucket that every document has is spread over as many blocks as there are chunks. The blocks of both corpora give each
bucket's totals, and these its gain; the blocks then meet the gains of their own range and emit one number a document, which
are added up by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.llm.tables import written
from stewardry.operators.numbering import numbered

BUCKETS = 10_000
#: Ranges that the buckets are dealt into; a document's weight is added up from one number of each.
RANGES = 8
WIDTH = BUCKETS // RANGES
LONGEST = 3
#: Features of a chunk, its documents (their places take 16 bits), and bytes of a text that are cut into words at once.
CHUNK_FEATURES, CHUNK_DOCS, PIECE = 1 << 20, 1 << 16, 1 << 20

_words = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _words[_c] = _c
for _c in range(26):
    _words[65 + _c] = 97 + _c
_words = bytes(_words)


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, lower-cased (A-Z), in lists of bounded size. Words are runs of 0-9, letters and everything beyond ASCII."""
    at = 0
    while at < len(text):
        size = PIECE
        while True:
            part = text[at : at + size].translate(_words)
            end = len(part) if at + size >= len(text) else part.rfind(b" ")
            if end >= 0:
                break
            size *= 2  # one word fills the piece
        yield part[:end].split()
        at += max(end, 1)


def feature_buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them), list by list."""
    tail: list[bytes] = []
    for new in word_lists(text):
        words = tail + new
        spaced = [b" " + w for w in words]
        hashes, kept = list(map(crc32, words)), []
        for n in range(LONGEST):  # a run's hash goes on from that of the run without its last word
            if n:
                hashes = list(map(crc32, spaced[n:], hashes))
            kept += hashes[max(0, len(tail) - n) :]
        yield len(new), np.array(kept, np.uint32) % BUCKETS
        tail = words[-(LONGEST - 1) :]


def _blocks(parts: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(range, bytes, packed postings) of a chunk. parts: bucket << 16 | document's place."""
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    bucket = keys >> 16
    edges = np.searchsorted(bucket, np.arange(RANGES + 1) * WIDTH)
    for r, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if hi > lo:
            sizes = np.bincount(bucket[lo:hi] - r * WIDTH, minlength=WIDTH).astype(np.uint32)
            raw = sizes.tobytes() + (keys[lo:hi] & 0xFFFF).astype(np.uint16).tobytes() + counts[lo:hi].astype(np.uint32).tobytes()
            yield r, len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw_size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket within its range, document's place, count) of a block's postings."""
    raw = pa.decompress(packed, raw_size, "zstd", asbytes=True)
    sizes = np.frombuffer(raw, np.uint32, WIDTH)
    n = int(sizes.sum())
    return np.repeat(np.arange(WIDTH), sizes), np.frombuffer(raw, np.uint16, n, 4 * WIDTH), np.frombuffer(raw, np.uint32, n, 4 * WIDTH + 2 * n)


def _posted(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("row", pa.int64()), ("id", id_type), ("n_words", pa.int64()), ("n_features", pa.int64()), ("range", pa.int32()), ("size", pa.int64()), ("packed", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = base = TaskContext.get().partitionId() << 40
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            made = list(_blocks(parts))
            n = len(made)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([base] * n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())], schema=schema)

        for batch in batches:
            told: list[tuple[int, int, int]] = []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n_words = n_features = 0
                for words, buckets in feature_buckets(raw):
                    n_words, n_features = n_words + words, n_features + len(buckets)
                    parts.append(buckets.astype(np.int64) << 16 | (row - base))
                    held += len(buckets)
                    if held >= CHUNK_FEATURES:
                        yield flush()
                        base, held = row, 0
                told.append((row, n_words, n_features))
                row += 1
                if row - base >= CHUNK_DOCS:
                    if held:
                        yield flush()
                    base, held = row, 0
            n = len(told)
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.int64()), batch.column("id"), pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.int64()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        if held:
            yield flush()

    return post


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): the counts of all blocks of a task, added up by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for r, size, packed in zip(*(batch.column(c).to_pylist() for c in ("range", "size", "packed")), strict=True):
            bucket, _, count = _unpacked(size, packed)
            total[r * WIDTH : (r + 1) * WIDTH] += np.bincount(bucket, count, WIDTH).astype(np.int64)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, weight): what a block's buckets give each of its documents."""
    for batch in batches:
        for base, size, packed, gains in zip(*(batch.column(c).to_pylist() for c in ("row", "size", "packed", "gains")), strict=True):
            bucket, place, count = _unpacked(size, packed)
            # whole numbers, exact in doubles far beyond what a chunk holds
            given = np.bincount(place, np.array(gains, np.float64)[bucket] * count)
            met = np.unique(place)
            yield pa.RecordBatch.from_arrays([pa.array(base + met.astype(np.int64)), pa.array(given[met].astype(np.int64))], names=["row", "weight"])


def _postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of a corpus' documents (range -1) and blocks of postings, dealt by range of buckets and chunk."""
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ddl = f"row long, id {kind.simpleString()}, n_words long, n_features long, range int, size long, packed binary"
    return written(rows.mapInArrow(_posted(to_arrow_type(kind)), ddl).repartition("range", "row"))


def bucket_gains(s: Column, t: Column, all_s: Column, all_t: Column) -> Column:
    """What one feature of a bucket tells in favour of the target, in thousandths."""
    return F.floor(1000 * F.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: str = "42", id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_features, weight, score, rank, n_words.

    weight: the gains of all of a text's features; score: the weight and a Gumbel draw from the seed and id; rank: 1, 2, 3 … of
    the drawn ones, null for others. Of the documents of `least_words` and more, `percent` of a hundred are drawn, those of the
    highest scores, ties to the smaller id (a null id is smallest), then as the rows lie. Null and empty texts have no words and
    weigh 0. Repeated rows and ids are documents of their own. Very long texts are cut into words piece by piece. Extra
    columns don't matter whatever their names; an empty table gives an empty result, an empty target only counts of nothing.
    `docs` is to be read from files, or anything else whose rows lie alike when a lost task is run again.
    """
    posted = _postings(docs, id_col, text_col)
    blocks = posted.where("range >= 0").select("row", "range", "size", "packed")
    aimed = _postings(target, target_id, target_text).where("range >= 0").select("range", "size", "packed")
    total = lambda x, n: x.mapInArrow(_totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(n))
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(total(blocks.drop("row"), "s"), "bucket", "left").join(total(aimed, "t"), "bucket", "left").fillna(0)
    every = W.partitionBy()  # one row per bucket
    gain = bucket_gains(F.col("s"), F.col("t"), F.sum("s").over(every), F.sum("t").over(every))
    by_range = both.select("bucket", gain.alias("gain")).groupBy(F.expr(f"bucket div {WIDTH}").cast("int").alias("range"))
    gains = by_range.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))
    # BUCKETS numbers at all sizes of the corpora
    given = blocks.join(F.broadcast(written(gains)), "range").select("row", "size", "packed", "gains").mapInArrow(_contributions, "row long, weight long")
    told = posted.where("range < 0").select("row", "id", "n_words", "n_features", F.lit(0).cast("long").alias("weight"))
    parts = told.unionByName(given, allowMissingColumns=True)
    summed = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296))).cast("long")
    scored = written(summed.withColumn("score", F.col("weight") + noise))
    ranked = numbered(scored.where(F.col("n_words") >= least_words), [], [F.desc("score"), F.col("id").asc_nulls_first(), F.asc("row")], "rank", "of")
    rank = F.when(F.col("rank") <= F.floor(percent * F.col("of") / 100), F.col("rank"))
    out = ranked.withColumn("rank", rank).drop("of").unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")
