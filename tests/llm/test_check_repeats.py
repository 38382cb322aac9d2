"""What the check's failures of round 3 came from: repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stewardry.llm import repeats, suffix_array
from stewardry.llm.repeats import SPAN, Units
from stewardry.llm.suffix_array import BYTES, remove_repeated_bytes
from tests.llm.test_corpus_operators import frame, runs_removed, texts


def test_contexts_of_anchors_are_sent_once(spark, monkeypatch):
    """op1 and op10 had shuffled and written all contexts several times, by which op1 went beyond its disk."""
    seen, close = [], repeats.closely_written
    monkeypatch.setattr(repeats, "closely_written", lambda df: seen.append(df.columns) or close(df))
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 500]
    got = remove_repeated_bytes(frame(spark, rows)).collect()
    assert len(seen) == 1 and "c" not in seen[0]
    want = runs_removed(rows, lambda t: (t or "").encode())
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in got) == sorted((i, g, s) for i, _, g, s, _ in want)


def test_stretches_of_windows():
    ids, firsts = [7, None], [[1, 9, 2, 3, 9], [0, 0, 0, 0, 0]]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array([0, 0], pa.int64())], ["id", "h"]), pa.array([100, 50]), pa.array(firsts, pa.list_(pa.int64()))], names=["row", "pos", "firsts"])
    (got,) = repeats._covered(iter([batch]))
    # windows that start 0, 2 and 3 units before position 100
    assert list(zip(got.column("a").to_pylist(), got.column("z").to_pylist(), strict=True)) == [(97, 98), (100, 100)]
    assert np.array_equal([x["id"] for x in got.column("row").to_pylist()], [7, 7])


def test_texts_are_looked_through_together(monkeypatch):
    """op1 was beyond its CPU seconds: each text by itself, twice, took a third of them."""
    r = np.random.default_rng(3)
    texts = [r.integers(0, 3, n).astype(np.uint8).tobytes() for n in (0, 49, 50, 51, 400, 7, 90_000, 75, 1000)]
    alone = [repeats.anchors(np.frombuffer(x, np.uint8), BYTES.k) for x in texts]
    calls, look = [], repeats.anchors
    monkeypatch.setattr(repeats, "anchors", lambda *x: calls.append(len(x[0])) or look(*x))
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(9), pa.int64()), "text": pa.array(texts, pa.binary())})
    list(repeats._hashes(BYTES, 4)(iter([batch])))
    assert len(calls) == 1
    ((_, starts, sizes, at, h),) = repeats._joined(BYTES, iter(texts))
    assert sizes.tolist() == [len(x) for x in texts] and len(alone[6][0]) > 1000
    assert np.array_equal(at, np.concatenate([p + s for (p, _), s in zip(alone, starts, strict=True)]))
    assert np.array_equal(h, np.concatenate([x for _, x in alone]))


def test_windows_of_contexts(monkeypatch):
    """The units of the anchor itself are not sorted, and tries only take what parts beyond the shallow depth; anchors whose hashes met by chance stay apart."""
    r = np.random.default_rng(8)
    tries, put = [], suffix_array.BlindTrie
    monkeypatch.setattr(suffix_array, "BlindTrie", lambda rows: tries.append(len(np.unique(rows, axis=0))) or put(rows))
    for chance in (False, True):
        widths = []
        u = Units(BYTES.cut, BYTES.dtype, BYTES.k, lambda rows, *x: widths.append(rows.shape[1]) or BYTES.sort(rows, *x))
        n = 120
        base = r.integers(0, 256, (3, u.most_left + SPAN)).astype(np.uint8)
        anchor = np.sort(r.integers(0, 3, n))
        ctx = base[anchor]
        for k in range(n):  # most differ in one unit outside the anchor
            at = int(r.choice([*range(u.most_left), *range(SPAN, u.most_left + SPAN)]))
            ctx[k, at] ^= int(r.integers(0, 3))
        if chance:
            ctx[1::2, u.most_left] ^= 1
        nl, nr = r.integers(20, u.most_left + 1, n), r.integers(40, SPAN + 1, n)
        least = r.permutation(n)
        got = repeats.firsts(u, anchor, ctx, nl, nr, least)
        for l in range(u.most_left + 1):
            met = {}
            for k in range(n):
                if nl[k] >= l and nr[k] >= SPAN - l:
                    w = (anchor[k], ctx[k, u.most_left - l : u.most_left - l + SPAN].tobytes())
                    met.setdefault(w, []).append(k)
            want = np.full(n, np.iinfo(np.int64).max)
            for who in met.values():
                want[who] = least[who].min()
            assert np.array_equal(got[:, l], want)
        assert widths == [SPAN if chance else SPAN - u.k, u.most_left]
    assert tries and min(tries) > 1


def test_ranges_are_made_apart():
    rows = [[(0, 60), (10, 55), (60, 70), (71, 90)], None, [], [(0, 2**62)], [(3, 53), (5, 2**62)], [(7, 57)], [(0, 100), (20, 70), (99, 160), (170, 220)]]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
    ranges = pa.array([None if x is None else [{"a": a, "z": z} for a, z in x] for x in rows], kind)
    far = repeats.FAR
    want = [[(0, 70), (71, 90)], [], [], [(0, far)], [(3, far)], [(7, 57)], [(0, 160), (170, 220)]]
    assert repeats._merged(ranges) == want
    assert repeats._merged(ranges.slice(2)) == want[2:]
    assert repeats._merged(ranges.slice(1, 2)) == want[1:3]


def test_keys_are_counted(monkeypatch):
    """What occurs very often is told by the keys' numbers, so that contexts need not be written to count it."""
    monkeypatch.setattr(repeats, "HOT", 100)
    r = np.random.default_rng(9)
    line = r.integers(0, 256, 60).astype(np.uint8).tobytes()
    # one id has a run of one byte to itself; a line stands twice in 40 texts; the rest is nobody else's
    texts = [b"a" * 200, *(r.integers(0, 256, 80).astype(np.uint8).tobytes() + line + b"-" + line for _ in range(40))]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([*range(41)], pa.int64()), "text": pa.array(texts, pa.binary())})
    got = {k: n for b in repeats._shared(repeats._hashes(BYTES, 4)(iter([batch]))) for k, n in zip(b.column("a").to_pylist(), b.column("n").to_pylist(), strict=True)}
    mask = (1 << repeats.KEY_BITS) - 1
    h = [repeats.anchors(np.frombuffer(x, np.uint8), BYTES.k)[1] & np.uint64(mask) for x in texts]
    k, times = np.unique(np.concatenate(h), return_counts=True)
    who = {int(x): {i for i, y in enumerate(h) if x in y} for x in k}
    assert got == {int(x): int(n) if len(who[int(x)]) > 1 else -int(n) for x, n in zip(k, times, strict=True) if len(who[int(x)]) > 1 or n > 100}
    assert min(got.values()) == -177 and max(got.values()) >= 80
