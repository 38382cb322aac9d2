"""Jaccard self-join of shingle sets by set-relation skipping.

Texts of one set are one. Sets that may be alike meet by bands of minima of many hash functions, so many that a pair at the
threshold is missed with a probability below e^-25; what is connected is a family. Within a family the join is exact: index lists
are cut into blocks that are skipped by their sets' sizes and the tokens' positions, and a set that is much like the one
before derives its overlaps from that one's, looking only at the lists of the tokens in which they differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from stewardry.llm.components import components
from stewardry.llm.tables import bitmap, bits_for, in_bitmap, kept_rows, text_key, written

#: Minima of a band; bands follow from the threshold and MISS, the exponent of a missed pair's probability.
ROWS, MISS = 6, 25
#: Sets of a family's block; a larger family is joined block by block.
BLOCK_SETS = 4096
#: Entries of a list's block, which is skipped as a whole.
LIST_BLOCK = 64
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_mul = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the different runs of k words (of the whole sequence, if it is shorter)."""
    words = text.translate(_lower).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    m = min(k, n)
    x = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        x = (x ^ h[j : n - m + 1 + j]) * _mul
        x ^= x >> np.uint64(29)
    return np.unique(x)


def bands(similar: int) -> int:
    """Bands of ROWS minima, by which a pair of that similarity (percent) is missed with a probability of e^-MISS."""
    return int(np.ceil(MISS / -np.log1p(-((similar / 100) ** ROWS))))


def band_keys(tokens: np.ndarray, n_bands: int) -> np.ndarray:
    """A key for each band, of the minima of its hash functions over the set."""
    seeds = np.random.default_rng(7).integers(1, 1 << 32, n_bands * ROWS, dtype=np.uint64).astype(np.uint32)
    low = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    short = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    for lo in range(0, len(short), 512):
        x = (short[lo : lo + 512, None] ^ seeds) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(0), out=low)
    key = np.arange(n_bands, dtype=np.uint64) * _mul
    for row in low.reshape(n_bands, ROWS).T.astype(np.uint64):
        key = (key ^ row) * _mul
        key ^= key >> np.uint64(31)
    return key


def _described(k: int, n_bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sets, keys = [], [], []
            for x in b.column("text"):
                t = shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", k)
                n.append(len(t))
                sets.append(xxh128_digest(t.tobytes()) if len(t) else None)
                keys.append(band_keys(t, n_bands).view(np.int64) if len(t) else None)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "n", "set", "keys"])

    return run


class Family:
    """Sets of tokens in the order of their sizes, with index lists over their prefixes and over all tokens."""

    def __init__(self, tokens: list[np.ndarray], similar: int):
        self.similar = similar
        self.order = sorted(range(len(tokens)), key=lambda k: (len(tokens[k]), k))
        flat = np.concatenate([tokens[k] for k in self.order]) if tokens else np.zeros(0, np.uint64)
        self.sizes = np.array([len(tokens[k]) for k in self.order], np.int64)
        ends = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(self.order)), self.sizes)
        _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare ones first
        ids = rank[ids]
        at = np.lexsort((ids, owner))
        ids = ids[at]
        self.sets = [ids[e - n : e] for e, n in zip(ends, self.sizes, strict=True)]
        place = np.arange(len(ids)) - np.repeat(ends - self.sizes, self.sizes)
        by = np.lexsort((owner, ids))
        self.owner, self.place = owner[by], place[by]
        self.starts = np.searchsorted(ids[by], np.arange(len(counts) + 1))

    def need(self, a: int, b: np.ndarray | int) -> np.ndarray | int:
        """The least overlap of sets of sizes a and b that link."""
        return -(-self.similar * (a + b) // (100 + self.similar))

    def window(self, x: int) -> tuple[int, int]:
        """The sets whose sizes allow a link with set x."""
        n = int(self.sizes[x])
        return int(np.searchsorted(self.sizes, -(-self.similar * n // 100), "left")), int(np.searchsorted(self.sizes, 100 * n // self.similar, "right"))

    def linked(self, x: int, overlaps: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return lo + np.flatnonzero(overlaps >= self.need(int(self.sizes[x]), self.sizes[lo:hi]))

    def counted(self, x: int, lo: int, hi: int) -> np.ndarray:
        """Overlaps of set x with the sets lo to hi, from all lists of its tokens."""
        out = np.zeros(hi - lo, np.int64)
        for t in self.sets[x]:
            a, z = self.starts[t], self.starts[t + 1]
            part = self.owner[a:z]
            out[part[np.searchsorted(part, lo) : np.searchsorted(part, hi)] - lo] += 1
        return out

    def derived(self, x: int, before: int, overlaps: np.ndarray) -> np.ndarray:
        """Overlaps with all sets from those of another set: only the lists of the tokens in which they differ are read."""
        out = overlaps.copy()
        for t in np.setdiff1d(self.sets[before], self.sets[x], assume_unique=True):
            out[self.owner[self.starts[t] : self.starts[t + 1]]] -= 1
        for t in np.setdiff1d(self.sets[x], self.sets[before], assume_unique=True):
            out[self.owner[self.starts[t] : self.starts[t + 1]]] += 1
        return out

    def answers(self, x: int) -> np.ndarray:
        """The sets that link with set x (itself too), by the lists of its prefix, whose blocks are skipped by size and position."""
        n = int(self.sizes[x])
        lo, hi = self.window(x)
        met = []
        for i, t in enumerate(self.sets[x][: n - -(-self.similar * n // 100) + 1]):
            a, z = int(self.starts[t]), int(self.starts[t + 1])
            a, z = a + int(np.searchsorted(self.owner[a:z], lo)), a + int(np.searchsorted(self.owner[a:z], hi))
            for s in range(a, z, LIST_BLOCK):
                block = self.owner[s : min(s + LIST_BLOCK, z)]
                sizes = self.sizes[block]  # sets come by size: the block's ends are its extremes
                # what a set may still share from this token on, at the best place of the block
                most = 1 + min(n - i - 1, int(sizes[-1]) - int(self.place[s : s + len(block)].min()) - 1) + min(i, int(self.place[s : s + len(block)].max()))
                if most >= self.need(n, int(sizes[0])):
                    met.append(block)
        if not met:
            return np.zeros(0, np.int64)
        own = self.sets[x]
        found = []
        for y in np.unique(np.concatenate(met)):
            other = self.sets[y]
            if np.isin(other, own, assume_unique=True).sum() >= self.need(n, len(other)):
                found.append(y)
        return np.array(found, np.int64)

    def all_answers(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(set, the sets that link with it), set by set in an order that puts like ones side by side."""
        chosen = np.arange(len(self.sets)) if wanted is None else wanted
        # by the two most frequent tokens, then the size: near copies of one text share those
        line = sorted(chosen.tolist(), key=lambda x: (tuple(self.sets[x][-2:]), int(self.sizes[x]), x))
        before, overlaps = -1, None
        for k, x in enumerate(line):
            near = lambda y: len(np.setxor1d(self.sets[x], self.sets[y], assume_unique=True)) * 2 <= self.sizes[x]  # noqa: B023, E731
            if overlaps is not None and near(before):
                overlaps = self.derived(x, before, overlaps)
            elif k + 1 < len(line) and near(line[k + 1]):
                overlaps = self.counted(x, 0, len(self.sets))
            else:
                overlaps = None
            before = x
            if overlaps is None:
                yield x, self.answers(x)
            else:
                lo, hi = self.window(x)
                yield x, self.linked(x, overlaps[lo:hi], lo, hi)


def _joined(k: int, similar: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of one task: a family's sets, or two blocks of a large family; (set, links: texts linked with it beyond its own, root)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("set").sort_values("set").reset_index(drop=True)
        left, right = part.i.iloc[0], part.j.iloc[0]
        family = Family([shingles(t.encode(), k) for t in part.text], similar)
        order = np.array(family.order)
        copies, block = part.copies.to_numpy()[order], part.block.to_numpy()[order]
        root = np.arange(len(order))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = np.zeros(len(order), np.int64)
        # two blocks: only links across count here, those within a block have a task of their own
        for x, found in family.all_answers(None if left == right else np.flatnonzero(block == left)):
            found = found[found != x]
            if left != right:
                found = found[block[found] == right]
                np.add.at(links, found, copies[x])
            links[x] += copies[found].sum()
            for y in found.tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
        sets = part.set.to_numpy()[order]
        return pd.DataFrame({"set": sets, "links": links, "root": sets[[find(x) for x in range(len(order))]]})

    return run


def _resolved(docs: DataFrame, id_col: str, text_col: str, shingle: int, similar: int) -> DataFrame:
    """(id, h, n_shingles, component_id, n_links, first: the row of the component that has the smallest id)."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h")).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    base = written(rows.mapInArrow(_described(shingle, bands(similar)), f"row {kind}, n long, set binary, keys array<long>"))
    members = written(base.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.min("row").alias("first"), F.first("n").alias("n")))
    # keys are shuffled once, beside 64 bits of their set; those of one set only are the most, and go no further
    keys = base.where("set is not null").select(F.xxhash64("set").alias("s"), F.explode("keys").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("s").alias("least"), F.max("s").alias("most")).where("least <> most").select("key", "least"))
    spots = bits_for(shared.count())
    met = keys.where(in_bitmap(F.col("key"), bitmap(shared.select("key"), spots), spots))
    stars = met.join(shared, "key").where("s <> least").select(F.col("s").alias("u"), F.col("least").alias("v")).distinct()
    families = written(components(stars).select(F.col("v").alias("s"), F.col("c").alias("family")))
    # the text of one row of each set that has a family
    picked = written(families.join(members.withColumn("s", F.xxhash64("set")), "s").select("set", "family", "copies", "first", "n"))
    bits = bits_for(picked.count())
    near = rows.where(in_bitmap(F.xxhash64("row.id", "row.h"), bitmap(picked.select(F.xxhash64("first.id", "first.h").alias("k")), bits), bits))
    sizes = picked.groupBy("family").agg(F.count("*").alias("sets"))
    placed = picked.join(sizes, "family").withColumn("blocks", F.ceil(F.col("sets") / BLOCK_SETS).cast("int")).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    # a family of one block has one task; else each pair of blocks has one
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    tasks = placed.withColumn("o", F.explode(other)).select("set", "family", "copies", "first", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    texts = near.select(F.col("row").alias("first"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["first"])
    joined = tasks.join(texts, "first").select("set", "family", "i", "j", "copies", "block", "text")
    told = written(joined.groupBy("family", "i", "j").applyInPandas(_joined(shingle, similar), "set binary, links long, root binary"))
    links = told.groupBy("set").agg(F.sum("links").alias("links"))
    spans = told.where("set <> root").select(F.col("set").alias("u"), F.col("root").alias("v")).distinct()
    groups = components(spans).select(F.col("v").alias("set"), F.col("c").alias("group"))
    met = members.join(groups, "set", "left").join(links, "set", "left").select("set", "copies", "first", "n", F.coalesce("group", "set").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    met = written(met)
    firsts = met.groupBy("group").agg(F.min("first").alias("head"))
    by_set = met.join(firsts, "group").select("set", (F.col("links") + F.col("copies") - 1).alias("n_links"), "head")
    out = base.select("row", F.col("n").alias("n_shingles"), F.col("set").alias("s")).join(by_set, F.col("s") == F.col("set"), "left")
    return out.select("row.id", "row.h", "n_shingles", F.when(F.col("head").isNull(), F.col("row.id")).otherwise(F.col("head.id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similar: int = 85) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id that links lead to, its own included), n_links.

    A text's set: the different runs of `shingle` words (A-Z lower-cased; words are runs without [\\x20\\x09-\\x0D]); a shorter text's
    whole sequence is one. Two texts link when 100 times the intersection is at least `similar` times the union. Null, empty and
    wordless texts have an empty set and link with nothing. Repeated rows and ids are texts of their own and link with one another; a null
    id counts as smallest. Other columns don't matter whatever their names; an empty table gives an empty result. Texts count whole.
    """
    found = _resolved(docs, id_col, text_col, shingle, similar)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: int = 80) -> DataFrame:
    """`docs` with one row of each component, that of the smallest id (then text hash), with their own columns; texts without words stay, of rows alike in id and text one."""
    decided = _resolved(docs, id_col, text_col, shingle, similar).select("id", "h", F.col("first").alias("kept"))
    return kept_rows(docs, decided, id_col, text_col)
