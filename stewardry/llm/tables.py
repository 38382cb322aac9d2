"""Cutting lineage, and bit maps of bounded size that tell a scan which rows may meet a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.session import fresh_dir


def written(df: DataFrame) -> DataFrame:
    """`df`, computed once, as a table in the shared folder that the cluster names in spark.checkpoint.dir; it survives the loss of executors."""
    path = fresh_dir(df.sparkSession, "stewardry")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the smallest and of the largest bit map: 128 KB and 2 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 24


def bits_for(keys: int) -> int:
    """A power of two, some 16 bits a key, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys).bit_length()))


def bitmap(keys: DataFrame, bits: int) -> Column:
    """keys: one column of 64-bit hashes. The bits that they set, as an array of longs, to be asked with `in_bitmap`."""
    name = keys.columns[0]
    spot = f"pmod({name}, {bits})"
    words = keys.groupBy(F.expr(f"shiftright({spot}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({spot} % 64 as int))")).alias("b"))
    # at most bits / 64 rows meet the row numbers, and are then put in order: a map would be searched from its start for each
    dense = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits")).scalar()


def in_bitmap(hashed: Column, held: Column, bits: int) -> Column:
    """False only for a hash that set no bit; a true one may be another key's bit."""
    spot = F.pmod(hashed, F.lit(bits))
    word = F.coalesce(F.get(held, F.shiftright(spot, 6).cast("int")), F.lit(0).cast("long"))
    return F.getbit(word, F.pmod(spot, F.lit(64)).cast("int")) == 1


def text_key(text: Column) -> Column:
    """A hash of the text (null as empty) that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kept_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str, repeats: bool = False) -> DataFrame:
    """The rows of `docs`, with their own columns, that `decided` (id, h, kept: a row per row) keeps; of rows alike in id and text one, or with `repeats` all.

    Only rows that a bit map of the dropped and the repeated ones meets are shuffled; the others stay where they lie.
    """
    marked = written(decided.groupBy("id", "h").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).where("not kept" if repeats else "not kept or rows > 1").select(F.col("id").alias("__id"), F.col("h").alias("__h"), "kept"))
    bits = bits_for(marked.count())
    held = bitmap(marked.select(F.xxhash64("__id", "__h").alias("k")), bits)
    # the rows travel as one column, so that no name of theirs meets one of these
    rows = docs.select(F.col(id_col).cast(decided.schema["id"].dataType).alias("id"), text_key(F.col(text_col)).alias("h"), F.struct("*").alias("row"))
    met = in_bitmap(F.xxhash64("id", "h"), held, bits)
    gone = marked.where("not kept").select("__id", "__h")
    rest = rows.where(met).join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left_anti")
    return rows.where(~met).unionAll(rest if repeats else rest.dropDuplicates(["id", "h"])).select("row.*")


def unused(name: str, taken: list[str]) -> str:
    """`name`, or with so many underscores before it that no column of a table has it."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name = "_" + name
    return name
