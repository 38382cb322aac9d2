"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of an item's words. Within a table all have one length m; a text is read by blocks of B words. The shift table
tells by a block's hash how far the window may be moved on without missing a pattern; where it may not, the bucket of that
suffix block is asked by the hash of the window's first block, and what is left is compared word by word. All texts of a batch are
searched at once: a position a text, moved on in numpy until all have ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.tables import kept_rows, text_key, written

WINDOW, BLOCK = 10, 2
#: Windows that the driver and a task hold at once; a larger benchmark takes a scan for each block of them.
WINDOWS_PER_PASS = 50_000
#: Bytes of texts that are searched at once in a task.
GROUP = 4 << 20
_table = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _table[_c] = _c
for _c in range(26):
    _table[65 + _c] = 97 + _c
_table = bytes(_table)
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of 0-9, letters and everything beyond ASCII."""
    return (text or b"").translate(_table).split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M) ^ (b + np.uint64(0x7F4A7C15) + (a << np.uint64(6)))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Table:
    """Wu-Manber over patterns of one length, given as numbers of their words; all patterns are kept, whatever they share."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        self.m = len(patterns[0])
        self.b = min(BLOCK, self.m)
        p = np.array(patterns, np.int64)
        self.patterns = p
        # shift of a block: how far its last place in any pattern is from the end; unknown blocks move the window past themselves
        blocks = np.stack([self.hash(p, k) for k in range(self.m - self.b + 1)], 1)
        far = np.broadcast_to(np.arange(self.m - self.b, -1, -1), blocks.shape)
        order = np.lexsort((far.ravel(), blocks.ravel()))
        keys, first = np.unique(blocks.ravel()[order], return_index=True)
        self.keys, self.shifts, self.most = keys, far.ravel()[order][first], self.m - self.b + 1
        # buckets: patterns by their last block, then their first
        both = _mix(blocks[:, -1], blocks[:, 0])
        self.order = np.argsort(both, kind="stable")
        self.both = both[self.order]

    def hash(self, words: np.ndarray, at: int) -> np.ndarray:
        x = words[..., at].astype(np.uint64)
        for k in range(1, self.b):
            x = _mix(x, words[..., at + k].astype(np.uint64))
        return x

    def find(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of all occurrences within texts [start, end) of one array of word numbers; unknown words are -1."""
        at, end = starts[ends - starts >= self.m].copy(), ends[ends - starts >= self.m]
        found_at, found = [], []
        places = np.arange(self.m)
        while len(at):
            tail = words[at[:, None] + np.arange(self.m - self.b, self.m)]
            h = self.hash(tail, 0)
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            shift = np.where(self.keys[k] == h, self.shifts[k], self.most)
            stop = np.flatnonzero(shift == 0)
            if len(stop):
                window = words[at[stop][:, None] + places]
                both = _mix(h[stop], self.hash(window, 0))
                lo, hi = np.searchsorted(self.both, both, "left"), np.searchsorted(self.both, both, "right")
                row = np.repeat(np.arange(len(stop)), hi - lo)
                if len(row):
                    candidate = self.order[np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]]
                    same = (window[row] == self.patterns[candidate]).all(1)
                    found_at.append(at[stop][row[same]])
                    found.append(candidate[same])
            at += np.maximum(shift, 1)
            going = at + self.m <= end
            at, end = at[going], end[going]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (empty, empty)


class Search:
    """Tables by pattern length, over one numbering of all patterns' words."""

    def __init__(self, windows: list[tuple[list[bytes], list[int]]]):
        """windows: (words, places of the items that hold them), each window once."""
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, list[int]] = {}
        for k, (words, _) in enumerate(windows):
            for w in words:
                self.ids.setdefault(w, len(self.ids))
            by_length.setdefault(len(words), []).append(k)
        self.items = [items for _, items in windows]
        self.tables = [(Table([tuple(self.ids[w] for w in windows[k][0]) for k in ks]), np.array(ks)) for ks in by_length.values()]

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[int], set[int]]]:
        """Of each text the stretches of words that are hit (starts and ends in turn), and the items met."""
        counts = np.array([len(t) for t in texts])
        ends = np.cumsum(counts)
        starts = ends - counts
        get = self.ids.get
        words = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, ends[-1] if len(ends) else 0)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        for table, names in self.tables:
            at, which = table.find(words, starts, ends)
            for p, k, row in zip(at.tolist(), names[which].tolist(), (np.searchsorted(ends, at, "right")).tolist(), strict=True):
                spans[row].append((p - int(starts[row]), p - int(starts[row]) + table.m))
                items[row].update(self.items[k])
        out = []
        for row in range(len(texts)):
            merged: list[int] = []
            for s, e in sorted(spans[row]):
                if merged and s <= merged[-1]:
                    merged[-1] = max(merged[-1], e)
                else:
                    merged += [s, e]
            out.append((merged, items[row]))
        return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, window) of all items: ten words each, or all of an item of fewer."""
    for b in batches:
        items, windows = [], []
        for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of((text or "").encode())
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                items.append(item)
                windows.append(b" ".join(words[i : i + WINDOW]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], names=["item", "window"])


def _searched(windows: list[tuple[str, list[str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = sorted({i for _, items in windows for i in items})
    place = {i: k for k, i in enumerate(names)}
    packed = [(w, [place[i] for i in items]) for w, items in windows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search([(w.encode().split(b" "), items) for w, items in packed])
        for b in batches:
            n_words, spans, items = [], [], []
            group: list[list[bytes]] = []
            size = 0
            column = b.column("text")

            def done() -> None:
                for words, (merged, met) in zip(group, search.hits(group), strict=True):
                    n_words.append(len(words))
                    spans.append(merged)
                    items.append(sorted(names[k] for k in met))
                group.clear()

            for k in range(len(column)):
                text = column[k]
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                group.append(words_of(raw))
                size += len(raw)
                if size >= GROUP:
                    done()
                    size = 0
            done()
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[str]]]]:
    """Windows with their items, each window once, in blocks; Spark cuts and gathers them, and the driver holds one block."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(_cut, "item string, window string")
    windows = written(rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")))
    n = max(1, -(-windows.count() // WINDOWS_PER_PASS))
    for k in range(n):
        yield [(r.window, r["items"]) for r in windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).collect()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated, h (a hash of the text), items.

    A window of an item is ten of its words in a row, or all of an item of fewer; a word of a text is hit where it lies in an occurrence of one. Null
    and empty texts and items have no words. Repeated rows and ids are judged each; other columns don't matter whatever their
    names; empty tables give an empty result, or no hits. Texts count whole, whatever their length.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h")).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out, several = None, False
    for windows in _blocks(benchmark, item_col, item_text):
        found = rows.mapInArrow(_searched(windows), f"row {kind}, n_words long, spans array<long>, items array<string>")
        out = found if out is None else out.unionByName(found)
        several = out is not found
    if several:
        # blocks of windows: each row's spans and items meet again, on narrow rows; rows alike are alike in these as well
        spread = out.where(F.size("spans") > 0).groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        first = rows.mapInArrow(_searched([]), f"row {kind}, n_words long, spans array<long>, items array<string>").select("row", "n_words")
        out = first.join(spread.select(F.col("row").alias("r"), "spans", "items"), F.col("row").eqNullSafe(F.col("r")), "left").select("row", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    hit = covered(F.col("spans"))
    items = F.array_sort("items")
    return out.select(F.col("row.id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("row.h").alias("h"), "items")


def covered(spans):
    """Words in the union of spans (starts and ends in turn)."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.size(spans) - 2, F.lit(0)), F.lit(2)), lambda k: F.struct(F.get(spans, k).alias("s"), F.get(spans, k + 1).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), p["e"] - F.greatest(p["s"], a["last"]))).alias("n"), F.greatest(a["last"], p["e"]).alias("last"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, step, lambda a: a["n"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those that hold a window of the benchmark, with their own columns; repeated rows stay or go together."""
    judged = benchmark_hits(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("id"), "h", (~F.col("contaminated")).alias("kept"))
    return kept_rows(docs, judged, id_col, text_col, repeats=True)
