"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only narrow rows (id, lengths, hashes) are shuffled. The full hash is taken on a second scan, and only of texts whose
(length, prefix hash) class was met more than once; which classes those are is told to the scan by a bit map of bounded
size, so nothing that grows with the corpus is broadcast and no text is ever shuffled. A bit set by another class only
costs one needless hash: the final grouping is by length, prefix hash and full hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.tables import bitmap, bits_for, in_bitmap, kept_rows, written

def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in (" ", "\n", "\t", "\r", "\v", "\f"):
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False, bitmap_bits: int | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, full_hash.

    Texts are equal when identical without whitespace ([\\x20\\x09-\\x0D]); null counts as empty, and all empty texts are one
    group. Of a group stays the row whose original text has the most code points, then the smallest id (a null id counts as
    smallest), then, among rows of one id, the smallest hash of the text. Every row is a member of its own; rows alike in id and
    text are kept or dropped together. full_hash is null for texts that length or prefix told apart, unless `digest_all` asks
    for the digests of those as well. Other columns don't matter. An empty table gives an empty result.
    """
    return _resolved(docs, id_col, text_col, prefix_chars, digest_all, bitmap_bits).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "full_hash")


def _resolved(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool, bitmap_bits: int | None) -> DataFrame:
    """As exact_dedup, with the hash h of each row's own text."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), normalised(F.col(text_col)).alias("norm")).select("id", F.xxhash64("body").alias("h"), F.length("body").alias("chars"), F.octet_length("norm").alias("n"), F.xxhash64(F.left("norm", F.lit(prefix_chars))).alias("prefix_hash"), "norm")
    # one pass counts both levels: a length met once has only prefix classes met once
    classes = written(rows.groupBy("n", "prefix_hash").agg(F.count("*").alias("rows")).where("rows > 1").select(F.xxhash64("n", "prefix_hash").alias("k")))
    bits = bitmap_bits or bits_for(classes.count())
    hit = in_bitmap(F.xxhash64("n", "prefix_hash"), bitmap(classes, bits), bits)
    full = F.when(hit, F.sha2("norm", 256))
    # a caller's wish for every digest adds a column; what is grouped by stays the refinement's
    hashed = written(rows.select("id", "h", "chars", "n", "prefix_hash", full.alias("full"), *([F.sha2("norm", 256).alias("digest")] if digest_all else [])))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").alias("id"), F.col("h").alias("h")))
    groups = hashed.groupBy("n", "prefix_hash", "full").agg(best.alias("best"), F.count("*").alias("group_size"))
    # a row alone in its class needs no join: only classes of two or more are looked up, on narrow rows that AQE can split
    many = written(groups.where("group_size > 1").select(F.col("n").alias("gn"), F.col("prefix_hash").alias("gp"), F.col("full").alias("gf"), F.col("best.id").alias("best_id"), F.col("best.h").alias("best_h"), "group_size"))
    out = hashed.join(many, (F.col("n") == F.col("gn")) & (F.col("prefix_hash") == F.col("gp")) & F.col("full").eqNullSafe(F.col("gf")), "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("best_id")).otherwise(F.col("id"))
    kept = ~grouped | (F.col("id").eqNullSafe(F.col("best_id")) & (F.col("h") == F.col("best_h")))
    return out.select("id", "h", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("digest" if digest_all else "full").alias("full_hash"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that exact_dedup drops, with their own columns; of rows alike in id and text one stays."""
    return kept_rows(docs, _resolved(docs, id_col, text_col, 256, False, None).select("id", "h", "kept"), id_col, text_col)
