"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

A word of a class counts by the different words that it follows (Kneser-Ney's continuation counts); discounts are estimated
from counts of counts, and what they take off goes to the counts that both classes share, so a rare expression is as likely
in either. A text is told by its length-normalised log-likelihood ratio and by those of its most telling words, as a few
insults in a long text hardly move the first; a logistic curve, fitted on labelled rows that the model scoring them hasn't seen,
puts them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stewardry.llm.decontaminate import words_of
from stewardry.llm.tables import bitmap, bits_for, in_bitmap, kept_rows, text_key, written

#: From here on a text is predicted toxic.
THRESHOLD = 0.7
#: Telling words of a text that are looked at one by one.
TELLING = 4
#: Labelled rows that the curve is fitted on, those of the smallest hashes.
TUNE_ROWS = 40_000
#: Words whose values a task holds at once; more take another scan for each block of them.
BLOCK_WORDS = 4_000_000
#: Labels (ids and classes) that are sent to all tasks, so that texts meet them where they lie; with more, texts that may be labelled are shuffled.
MOST_SENT = 1_000_000
#: Words of a chunk of labelled texts, and bytes of labelled texts for each task that counts.
CHUNK, SHARD_BYTES = 1 << 20, 8 << 20
#: A word that is so large a part of any chunk is dealt by its contexts.
HOT = 1 / 256
_start = np.uint64(0x5BD1E9955BD1E995)
_mul = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a pair: toxic and ordinary, in the first and in the second fold.
_BITS = {"tA": 1, "oA": 2, "tB": 4, "oB": 8}
_STATS = {"tA": 1, "oA": 2, "sA": 3, "tB": 4, "oB": 8, "sB": 12, "tC": 5, "oC": 10, "sC": 15}


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def hashed(text: bytes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _raw(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that are a large part of a chunk: a few hundred of each at most."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words[counts >= max(n * HOT, 64)].view(np.int64))], names=["w"])

    for b in batches:
        for x in b.column("text"):
            held.append(hashed(_raw(x)))
            n += len(held[-1])
            if n >= CHUNK:
                yield flush()
                n = 0
    if n:
        yield flush()


def _merged(w: np.ndarray, pair: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with all bits of its occurrences."""
    order = np.argsort(pair, kind="stable")
    w, pair, mask = w[order], pair[order], mask[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return w[first], pair[first], np.bitwise_or.reduceat(mask, first)


def _packed(w: np.ndarray, pair: np.ndarray, mask: np.ndarray) -> bytes:
    """Pairs in the order of their words: each word once with its number of pairs, 48 bits of each pair, and the bits."""
    words, counts = np.unique(w, return_counts=True)
    low = (pair & np.uint64((1 << 48) - 1)).view(np.uint16).reshape(-1, 4)[:, :3]
    raw = np.uint32(len(words)).tobytes() + words.tobytes() + counts.astype(np.uint32).tobytes() + low.tobytes() + mask.tobytes()
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, keys of the pairs (of a word and its 48 bits) and bits."""
    raw = pa.decompress(packed[4:], int(np.frombuffer(packed, np.uint32, 1)[0]), "zstd", asbytes=True)
    m = int(np.frombuffer(raw, np.uint32, 1)[0])
    w = np.repeat(np.frombuffer(raw, np.uint64, m, 4), np.frombuffer(raw, np.uint32, m, 4 + 8 * m))
    at = 4 + 12 * m
    low = np.zeros((n, 4), np.uint16)
    low[:, :3] = np.frombuffer(raw, np.uint16, 3 * n, at).reshape(n, 3)
    return w, (w * _mul) ^ low.view(np.uint64)[:, 0], np.frombuffer(raw, np.uint8, n, at + 6 * n)


def _paired(hot: np.ndarray, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, pairs, masks, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            w, pair, mask = _merged(np.concatenate(ws), np.concatenate(pairs), np.concatenate(masks))
            shard = np.where(np.isin(w, hot), pair, w) % np.uint64(shards)
            order = np.lexsort((w, shard))
            w, pair, mask, shard = w[order], pair[order], mask[order], shard[order]
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            blobs = [_packed(w[a:z], pair[a:z], mask[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            for x in (ws, pairs, masks):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int64)), pa.array(np.diff(edges)), pa.array(blobs, pa.binary())], names=["shard", "n", "packed"])

        for b in batches:
            for x, bit in zip(b.column("text"), b.column("bit").to_pylist(), strict=True):
                h = hashed(_raw(x))
                for lo in range(0, len(h), CHUNK):
                    part = h[lo : lo + CHUNK]
                    before = np.concatenate(([h[lo - 1] if lo else _start], part[:-1]))
                    pair = (part * _mul) ^ (before + (part >> np.uint64(7)))
                    ws.append(part)
                    pairs.append((pair ^ (pair >> np.uint64(31))) * _mul)
                    masks.append(np.full(len(part), bit, np.uint8))
                    n += len(part)
                    if n >= CHUNK:
                        yield flush()
                        n = 0
        if n:
            yield flush()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, contexts of each kind) of the shards of a task."""
    ws, pairs, masks = [], [], []
    for b in batches:
        for n, packed in zip(b.column("n").to_pylist(), b.column("packed").to_pylist(), strict=True):
            for x, found in zip((ws, pairs, masks), _unpacked(n, packed), strict=True):
                x.append(found)
    if not ws:
        return
    w, _, mask = _merged(np.concatenate(ws), np.concatenate(pairs), np.concatenate(masks))
    order = np.argsort(w, kind="stable")
    w, mask = w[order], mask[order]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    counts = [np.add.reduceat(((mask & bits) > 0).astype(np.int64), first) for bits in _STATS.values()]
    yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), *map(pa.array, counts)], names=["w", *_STATS])


def continuation_counts(labelled: DataFrame) -> DataFrame:
    """(w, n by class and fold): of every word of the labelled texts (text, bit), its different contexts. Every occurrence counts."""
    size = labelled.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(32, int(size) // SHARD_BYTES)
    hot = np.array([r.w for r in labelled.select("text").mapInArrow(_hot, "w long").distinct().collect()], np.int64).view(np.uint64)
    packed = labelled.select("text", "bit").mapInArrow(_paired(hot, shards), "shard long, n long, packed binary").repartition(shards, "shard")
    parts = packed.mapInArrow(_counted, "w long, " + ", ".join(f"{s} long" for s in _STATS))
    return parts.groupBy("w").agg(*[F.sum(s).alias(s) for s in _STATS])


def model(counts: DataFrame, of: str) -> tuple[DataFrame, float]:
    """((w, v): the log-ratio of each word that differs from unknown ones; that of an unknown word) of a model: A, B, or C of both folds."""
    names = {c: f"{c}{of}" for c in "tos"}
    stats = counts.agg(*[x for c, n in names.items() for x in (F.sum(n).alias(f"{c}n"), F.count_if(F.col(n) > 0).alias(f"{c}v"), F.count_if(F.col(n) == 1).alias(f"{c}1"), F.count_if(F.col(n) == 2).alias(f"{c}2"))]).first()
    if not stats.tn or not stats.on:
        return counts.where("false").select("w", F.lit(0.0).alias("v")), 0.0
    d = {c: min(0.95, max(0.1, stats[f"{c}1"] / max(1, stats[f"{c}1"] + 2 * stats[f"{c}2"]))) for c in "tos"}
    share = {c: d[c] * stats[f"{c}v"] / stats[f"{c}n"] for c in "tos"}
    direct = lambda c: F.greatest(F.col(names[c]) - d[c], F.lit(0.0)) / float(stats[f"{c}n"])
    shared = direct("s") + share["s"] / (stats.sv + 1)
    value = F.log(direct("t") + share["t"] * shared) - F.log(direct("o") + share["o"] * shared)
    unknown = float(np.log(share["t"] / share["o"]))
    return counts.where(F.col(names["s"]) > 0).select("w", value.alias("v")).where(F.abs(F.col("v") - unknown) > 1e-6), unknown


def _told(words: np.ndarray, values: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row: number of words, of those that the block knows and the sum of their values, and the largest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, value = words.value, values.value
        for b in batches:
            n, known, sums, top = [], [], [], []
            for x in b.column("text"):
                h = hashed(_raw(x))
                v = value[:0]
                if len(h) and len(table):
                    k = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    v = value[k[table[k] == h]]
                n.append(len(h))
                known.append(len(v))
                sums.append(float(v.sum()))
                top.append(np.sort(v)[: -TELLING - 1 : -1].tolist())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(top, pa.list_(pa.float64()))], names=["row", "n", "known", "total", "top"])

    return run


def told(rows: DataFrame, values: DataFrame, unknown: float) -> DataFrame:
    """(row, mean, t1 … of the most telling words) of rows (row, text): the mean log-ratio of all words, and the means of the 1, 2 and TELLING largest ones above that of unknown words."""
    spark, kind = rows.sparkSession, rows.schema["row"].dataType.simpleString()
    held = written(values)
    blocks = max(1, -(-held.count() // BLOCK_WORDS))
    out = None
    for k in range(blocks):
        part = held.where(F.pmod("w", F.lit(blocks)) == k).toArrow()
        w = part.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        w, v = spark.sparkContext.broadcast(w[order]), spark.sparkContext.broadcast(part.column("v").to_numpy()[order])
        found = rows.mapInArrow(_told(w, v), f"row {kind}, n long, known long, total double, top array<double>")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        # narrow rows meet again; rows alike in all that tells them are alike in these as well, and counted by block
        out = out.groupBy("row", "n").agg(F.sum("known").alias("known"), F.sum("total").alias("total"), F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, TELLING).alias("top"))
    above = F.transform("top", lambda x: F.greatest(x - unknown, F.lit(0.0)))
    mean = F.when(F.col("n") > 0, (F.col("total") + (F.col("n") - F.col("known")) * unknown) / F.col("n")).otherwise(0.0)
    best = lambda m: F.aggregate(F.slice(above, 1, m), F.lit(0.0), lambda a, x: a + x) / m
    return out.select("row", (mean - F.lit(unknown)).alias("mean"), best(1).alias("t1"), best(2).alias("t2"), best(TELLING).alias("t4"), F.log1p("n").alias("size"))


FEATURES = ("mean", "t1", "t2", "t4", "size")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, offset): a logistic regression with a small ridge, moved so that THRESHOLD stands where F1 is best on these rows."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    ridge = np.diag([*[1.0] * x.shape[1], 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(-s, kind="stable")
    hit, said = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hit / (said + y.sum())
    best = int(np.argmax(f1))
    middle = (s[order][best] + s[order][min(best + 1, len(s) - 1)]) / 2
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - middle
    weights = w[:-1] / scale
    return weights, float(w[-1] - (weights * mean).sum() + shift)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted.

    labels: (id, toxic). Models are of the labelled rows outside fold 1, whose rows are scored by a model that hasn't seen them.
    Null and empty texts have no words and get the score of a text that says nothing. Where labels hold one class only, all scores are alike.
    Repeated rows are scored each; of several labels of an id the largest counts; other columns don't matter whatever their names; empty tables give an empty result or scores
    that are all alike. Texts count whole.
    """
    scored = _scored(docs, labels, id_col, text_col)
    return scored.select(F.col("row.id").alias(id_col), F.coalesce(fold(F.col("row.id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h")).alias("row"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    marks = written(labels.where("toxic is not null").groupBy(F.col(id_col).cast(kind).alias("lid")).agg((F.max("toxic") > 0).alias("toxic")).where(F.coalesce(fold(F.col("lid")) != 1, F.lit(False))))
    known = marks.count()
    bits = bits_for(known)
    # only texts that may be labelled meet their labels, and are shuffled for it where these are too many to be sent
    near = rows.where(in_bitmap(F.xxhash64("row.id"), bitmap(marks.select(F.xxhash64("lid").alias("k")), bits), bits))
    first = fold(F.col("row.id")) == 0
    bit = F.when(first, F.when(F.col("toxic"), _BITS["tA"]).otherwise(_BITS["oA"])).otherwise(F.when(F.col("toxic"), _BITS["tB"]).otherwise(_BITS["oB"]))
    labelled = written(near.join(F.broadcast(marks) if known <= MOST_SENT else marks, F.col("row.id") == F.col("lid")).select("row", "text", bit.cast("int").alias("bit")))
    counts = written(continuation_counts(labelled))
    tuned = None
    for of, bits_of in (("A", (_BITS["tB"], _BITS["oB"])), ("B", (_BITS["tA"], _BITS["oA"]))):
        part = labelled.where(F.col("bit").isin(*bits_of)).select(F.struct("row", "bit").alias("row"), "text")
        found = told(part, *model(counts, of)).select(F.col("row.row").alias("row"), (F.col("row.bit") == bits_of[0]).cast("int").alias("y"), *FEATURES)
        tuned = found if tuned is None else tuned.unionByName(found)
    sample = tuned.orderBy(F.xxhash64("row"), "y").limit(TUNE_ROWS).select("y", *FEATURES).toPandas()
    full, unknown = model(counts, "C")
    features = told(rows, full, unknown)
    if sample.y.nunique() < 2:
        return features.select("row", F.lit(0.5).alias("score"))
    weights, offset = curve(sample[list(FEATURES)].to_numpy(), sample.y.to_numpy())
    logit = F.lit(offset)
    for f, w in zip(FEATURES, weights, strict=True):
        logit = logit + F.col(f) * float(w)
    return features.select("row", (1 / (1 + F.exp(-logit))).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those predicted toxic, with their own columns; repeated rows stay or go together."""
    judged = _scored(docs, labels, id_col, text_col).select(F.col("row.id").alias("id"), F.col("row.h").alias("h"), (F.col("score") < THRESHOLD).alias("kept"))
    return kept_rows(docs, judged, id_col, text_col, repeats=True)
