"""Substring dedup of words: prefix-partitioned suffix trees.

Suffixes are split by prefixes of variable length, one word longer wherever a group is still too large; each group becomes a subtree, whose
internal nodes are the places where its suffixes part. Deep nodes, as deep as the window, are the repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from stewardry.llm.repeats import SPAN, Units, remove_repeats

#: Suffixes of a group that becomes a subtree at once.
GROUP = 256


def subtree(rows: np.ndarray, members: np.ndarray, depth: int) -> list[int]:
    """The leaves of the subtree of suffixes that agree in `depth` words, in order: children by their words at the node's depth, which is where they first part."""
    out: list[int] = []
    stack = [(members, depth)]
    while stack:
        part, at = stack.pop()
        if len(part) == 1:
            out.append(int(part[0]))
            continue
        # the edge goes on as long as all agree
        tail = rows[part, at:]
        differ = np.flatnonzero((tail != tail[0]).any(0))
        if not len(differ):
            out += part.tolist()
            continue
        at += int(differ[0])
        by = np.argsort(rows[part, at], kind="stable")
        part = part[by]
        w = rows[part, at]
        edges = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
        stack += [(part[a:z], at + 1) for a, z in reversed(list(zip(edges[:-1], edges[1:], strict=True)))]
    return out


def prefix_partitioned(rows: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """The order of rows of words, within groups (ascending numbers, one for all rows if None): large groups are split by one word more, small ones become subtrees."""
    n, width = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64) if groups is None else groups
    done = np.zeros(n, bool)
    for k in range(width):
        by = np.lexsort((np.where(done, 0, rows[order, k]), group))
        order, group, done = order[by], group[by], done[by]
        w = np.where(done, 0, rows[order, k])
        group = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]) | (w[1:] != w[:-1])))) if n else group
        sizes = np.bincount(group, minlength=1)[group] if n else group
        small = ~done & (sizes <= GROUP)
        if small.any():
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if small[a] and z - a > 1:
                    order[a:z] = subtree(rows, order[a:z], k + 1)
            done |= small
        if done.all():
            break
    return order


def _words(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


WORDS = Units(_words, np.uint64, 12, prefix_partitioned)


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = text.split()
    n = len(words)
    if ranges and ranges[0][1] > n:
        return (n, n, b"") if n >= SPAN else (n, 0, b" ".join(words))
    kept, at = [], 0
    for a, z in ranges:
        kept += words[at:a]
        at = z
    kept += words[at:]
    return n, n - len(kept), b" ".join(kept)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept (the words left, joined by one space, binary).

    Words are runs without [\\x20\\x09-\\x0D], told apart by 64-bit hashes. Every word is removed that a window of SPAN words covers whose words also stand in a row in a
    text of a smaller id; windows are judged on the texts as they are given. Null has no words; texts of fewer than SPAN words stay whole. Rows of one id don't repeat one
    another. Ids are whole numbers, a null one is no smaller than any and keeps its text. Other columns don't matter whatever their names; an empty table gives an empty result.
    """
    out = remove_repeats(docs, WORDS, _cut, id_col, text_col)
    return out.withColumnRenamed("n", "n_words").drop("n_spans")
