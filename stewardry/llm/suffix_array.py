"""Suffix-array dedup of bytes: deep-shallow sorting.

Multikey quicksort orders rows by words of eight bytes down to a shallow depth; groups that still agree there, whose common prefixes
are long, are ordered by blind tries, which branch on the first byte in which two rows differ and look at no other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from stewardry.llm.repeats import SPAN, Units, remove_repeats

#: Bytes to which multikey quicksort goes.
SHALLOW = 24


class BlindTrie:
    """Rows in order by a trie that holds branching places only: a search goes down blindly, and one comparison tells where the row belongs."""

    def __init__(self, rows: np.ndarray):
        self.rows = [r.tobytes() for r in rows]
        self.width = rows.shape[1]
        # a node is (place, {byte: child}) or a list of rows that are the same
        self.root: tuple[int, dict] | list[int] | None = None
        for k in range(len(self.rows)):
            self._put(k)

    def _put(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        row, node = self.rows[k], self.root
        while isinstance(node, tuple):  # blindly: where a byte has no child, any leaf below will do
            place, children = node
            node = children.get(row[place]) or next(iter(children.values()))
        other = self.rows[node[0]]
        if row == other:
            node.append(k)
            return
        at = next(i for i in range(self.width) if row[i] != other[i])
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < at:
            above, node = node, node[1][row[node[0]]]
        if isinstance(node, tuple) and node[0] == at:
            node[1][row[at]] = [k]
            return
        split = (at, {other[at]: node, row[at]: [k]})
        if above is None:
            self.root = split
        else:
            above[1][row[above[0]]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node:
                out += node
        return out


def deep_shallow(rows: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """The order of rows of bytes, within groups (ascending numbers, one for all rows if None)."""
    n, width = rows.shape
    order, edge = np.arange(n), np.zeros(n + 1, bool)
    edge[[0, n]] = True
    if groups is not None and n:
        edge[1:n] = groups[1:] != groups[:-1]
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    # multikey quicksort: groups that agree so far are ordered by their next word, all of a depth at once
    for k in range(min(SHALLOW // 8, words.shape[1])):
        at = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(at):
            return order
        part = order[at]
        by = np.lexsort((words[part, k], np.cumsum(edge[at])))
        order[at] = part = part[by]
        w = words[part, k]
        edge[at[1:]] |= w[1:] != w[:-1]
    # of what still agrees, groups whose rows are not all the same
    deep = words[:, SHALLOW // 8 :]
    at = np.flatnonzero(~edge[:n])
    at = at[(deep[order[at]] != deep[order[at - 1]]).any(1)]
    edges = np.flatnonzero(edge)
    for g in np.unique(np.searchsorted(edges, at, "right")):
        a, z = edges[g - 1], edges[g]
        part = order[a:z]
        order[a:z] = part[BlindTrie(rows[part][:, SHALLOW:]).order()]
    return order


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


BYTES = Units(_bytes, np.uint8, 24, deep_shallow)


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    n = len(text)
    if ranges and ranges[0][1] > n:
        return (n, n, b"") if n >= SPAN else (n, 0, text)
    kept, at = [], 0
    for a, z in ranges:
        kept.append(text[at:a])
        at = z
    kept.append(text[at:])
    left = b"".join(kept)
    return n, n - len(left), left


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept (binary).

    Every byte is removed that a string of SPAN bytes covers which also starts in a text of a smaller id; strings are judged on the texts as
    they are given. Null counts as empty; texts shorter than SPAN stay whole. Rows of one id don't repeat one another. Ids are whole numbers, a
    null one is no smaller than any and keeps its text. Other columns don't matter whatever their names; an empty table gives an empty result.
    """
    out = remove_repeats(docs, BYTES, _cut, id_col, text_col)
    return out.withColumnRenamed("n", "n_bytes")
