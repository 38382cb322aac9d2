"""Repeats of fixed length across documents: shared anchors find where texts may agree, sorted suffixes tell how far they do.

A window of SPAN units (bytes or words) has an anchor, its run of k units of smallest hash; equal windows have the same anchor at the same
place. Texts send the hashes of their anchors and learn which ones several documents have; around those they send a context, as far
as windows with that anchor reach. A task gets whole anchors, makes equal contexts one with their smallest id, sorts what follows each
anchor and what stands before it, backwards, and so knows by common prefixes which windows are equal, and the smallest id of each.
Of an anchor that occurs very often Spark makes equal contexts one row before a task gets it; with very many different ones it isn't gathered:
its windows are grouped by Spark, one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.tables import bitmap, bits_for, in_bitmap, kept_rows, text_key, written
from stewardry.session import fresh_dir

SPAN = 50
#: Units of texts that are held, and looked through at once; different contexts of an anchor that a task takes; bits of the map of shared anchors at most.
PIECE, LOOK, HOT, MOST_ANCHOR_BITS = 1 << 20, 1 << 15, 50_000, 1 << 28
#: Bits of an anchor's hash that tell which ones documents share, and bytes of text for each task that finds out.
KEY_BITS, SHARD_BYTES = 40, 16 << 20
#: Beyond the end of any text: where the range of a whole copy ends.
FAR = 1 << 40
_base, _mul = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Units:
    """What a text is cut into: `cut` gives its units as an array of `dtype`; an anchor is of `k` units; `sort` gives the order of rows of units
    within groups, whose numbers (ascending) come with the rows."""

    cut: Callable[[bytes], np.ndarray]
    dtype: type
    k: int
    sort: Callable[[np.ndarray, np.ndarray], np.ndarray]

    @property
    def most_left(self) -> int:
        return SPAN - self.k


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _running(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """The best of each w in a row, from those of 1, 2, 4 and so on in a row."""
    have = 1
    while 2 * have <= w:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def anchors(units: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the runs of k units that are the smallest of some window; all of those that tie. within: which starts of windows count, all if None."""
    at, found = [], []
    for lo in range(0, max(1, len(units) - SPAN + 1), LOOK):
        part = (units[lo : lo + LOOK + SPAN - 1].astype(np.uint64) + np.uint64(1)) * _mul
        if len(part) < SPAN:
            break
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(part * _power(_base, n), dtype=np.uint64, out=sums[1:])
        grams = (sums[k:] - sums[: n - k + 1]) * _power(pow(_base, -1, 1 << 64), n - k + 1)
        # the upper half tells which is smallest; odd, so that it is above what stands for no window
        upper = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        w = SPAN - k + 1
        edged = np.zeros(n - SPAN + 1 + 2 * (w - 1), np.uint32)
        least = edged[w - 1 : n - SPAN + w]
        least[:] = _running(upper, w, np.minimum)
        if within is not None:
            least *= within[lo : lo + len(least)]
        p = np.flatnonzero(_running(edged, w, np.maximum) == upper)
        at.append(p + lo)
        found.append(_mix(grams[p]))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(at) == 1:
        return at[0], found[0]
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")  # in order but for the pieces' edges
    order = order[np.diff(at[order], prepend=-1) > 0]
    return at[order], found[order]


def _joined(u: Units, texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together, as many as PIECE units hold: their units with SPAN zeros before, between and behind; where each starts; its length; positions and hashes of anchors."""
    held, n = [], 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in held])
        starts = np.cumsum(sizes + SPAN) - sizes
        gap = np.zeros(SPAN, u.dtype)
        units = np.concatenate([gap, *(y for x in held for y in (x, gap))])
        within = np.zeros(len(units) + 1, np.int8)
        long = sizes >= SPAN
        within[starts[long]] = 1
        within[starts[long] + sizes[long] - SPAN + 1] = -1
        return units, starts, sizes, *anchors(units, u.k, np.cumsum(within, dtype=np.int8).astype(np.uint32))

    for x in texts:
        held.append(u.cut(x))
        n += len(held[-1]) + SPAN
        if n >= PIECE:
            yield together()
            held, n = [], 0
    if held:
        yield together()


def _raw(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _packed(k: np.ndarray, ids: np.ndarray, times: np.ndarray) -> bytes:
    """Keys in order by what each is above the one before, ids, and how often keys occur; byte by byte, so that bytes that hardly vary lie together."""
    step = np.diff(k, prepend=np.uint64(0))
    planes = [x.view(np.uint8).reshape(-1, 8).T for x in (step, ids, times)]
    return pa.compress(planes[0][: KEY_BITS // 8].tobytes() + planes[1].tobytes() + planes[2].tobytes(), "zstd", asbytes=True)


def _unpacked(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = KEY_BITS // 8
    raw = np.frombuffer(pa.decompress(packed, (size + 16) * n, "zstd", asbytes=True), np.uint8).reshape(-1, n)
    step = np.zeros((n, 8), np.uint8)
    step[:, :size] = raw[:size].T
    ids, times = (np.ascontiguousarray(x.T).view(np.int64)[:, 0] for x in (raw[size : size + 8], raw[size + 8 :]))
    return np.cumsum(step.view(np.uint64)[:, 0], dtype=np.uint64), ids, times


def _order(k: np.ndarray) -> np.ndarray:
    """The order of numbers of at most KEY_BITS bits: sorted together with their places, as long as one number holds both."""
    bits = 64 - KEY_BITS
    if len(k) > 1 << bits:
        return np.argsort(k, kind="stable")
    return (np.sort(k << np.uint64(bits) | np.arange(len(k), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _ends(k: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its smallest and its largest id and how often it occurs."""
    order = _order(k)
    k, ids = k[order], ids[order]
    edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[edges], np.minimum.reduceat(ids, edges), np.maximum.reduceat(ids, edges), np.add.reduceat(times[order], edges)


def _hashes(u: Units, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors' keys with the smallest and the largest id that has them, and their numbers, packed by shard. Rows of a null id are told by nothing and tell nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, n = [], [], 0

        def flush() -> pa.RecordBatch:
            k, least, most, times = _ends(np.concatenate(keys), np.concatenate(ids), np.ones(sum(map(len, keys)), np.int64))
            keys.clear()
            ids.clear()
            twice = least < most
            rows = 1 + twice
            last = np.cumsum(rows) - 1
            k, i, t = (np.repeat(x, rows) for x in (k, least, times))
            i[last[twice]], t[last[twice]] = most[twice], 0
            shard = (k * np.uint64(shards)) >> np.uint64(KEY_BITS)
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            blobs = [_packed(k[a:z], i[a:z], t[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int64)), pa.array(np.diff(edges)), pa.array(blobs, pa.binary())], names=["shard", "n", "packed"])

        for b in batches:
            b = b.filter(b.column("id").is_valid())
            told, done = b.column("id").to_numpy(), 0
            for _, starts, _, at, h in _joined(u, map(_raw, b.column("text"))):
                keys.append(h & np.uint64((1 << KEY_BITS) - 1))
                ids.append(told[done + np.searchsorted(starts, at, "right") - 1])
                done += len(starts)
                n += len(at)
                if n >= PIECE:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that different ids have, and how often they occur, of the shards of a task; less than nothing for one id's own that occur more than HOT times."""
    found = [_unpacked(n, p) for b in batches for n, p in zip(b.column("n").to_pylist(), b.column("packed").to_pylist(), strict=True)]
    if found:
        k, least, most, times = _ends(*map(np.concatenate, zip(*found, strict=True)))
        times = np.where(least < most, times, -times)
        met = (times > 0) | (times < -HOT)
        yield pa.RecordBatch.from_arrays([pa.array(k[met].view(np.int64)), pa.array(times[met])], names=["a", "n"])


def _batched(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _contexts(u: Units, shared, hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts of shared anchors, of those that occur very often or of the others. Rows of a null id have nothing to tell or to learn."""
    left, size = u.most_left, np.dtype(u.dtype).itemsize
    width = (left + SPAN) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = shared.value
        for b in batches:
            b = b.filter(b.column("row").field("id").is_valid())
            row, done = b.column("row"), 0
            for units, starts, sizes, at, h in _joined(u, map(_raw, b.column("text"))):
                spot = h & np.uint64(8 * len(bits) - 1)
                met = (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                met[met] = np.isin(h[met] & np.uint64((1 << KEY_BITS) - 1), often) == hot
                at, h = at[met], h[met]
                around = np.lib.stride_tricks.sliding_window_view(units, left + SPAN)
                for lo in range(0, len(at), 20_000):
                    p = at[lo : lo + 20_000]
                    of = np.searchsorted(starts, p, "right") - 1
                    pos = p - starts[of]
                    ctx = np.ascontiguousarray(around[p - left])
                    whole = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(np.arange(len(p) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(ctx)])
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(done + of)), pa.array(pos), pa.array(h[lo : lo + 20_000].view(np.int64)), pa.array(np.minimum(pos, left).astype(np.int32)), pa.array(np.minimum(sizes[of] - pos, SPAN).astype(np.int32)), whole], names=["row", "pos", "a", "nl", "nr", "ctx"])
                done += len(starts)

    return run


def _wide(rows: np.ndarray) -> np.ndarray:
    """Rows as fewer, wider numbers, to be told equal by."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return rows.view(next(x for x in (np.uint64, np.uint32, np.uint16, np.uint8) if size % np.dtype(x).itemsize == 0))


def _units_of(u: Units, ctx: pa.ChunkedArray) -> np.ndarray:
    """Contexts as rows of units; all are of the same size."""
    size = (u.most_left + SPAN) * np.dtype(u.dtype).itemsize
    parts = [np.frombuffer(c.buffers()[2], np.uint8, size * len(c), int(np.frombuffer(c.buffers()[1], np.int32, 1, 4 * c.offset)[0])) for c in ctx.cast(pa.binary()).chunks if len(c)]
    return np.concatenate(parts).view(u.dtype).reshape(len(ctx), -1)


def firsts(u: Units, anchor: np.ndarray, ctx: np.ndarray, nl: np.ndarray, nr: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context (in order of anchors) and l, the smallest id of those whose window from l units before the anchor is the same; the largest number where there is no such window."""
    n, left = len(anchor), u.most_left
    out = np.full((n, left + 1), np.iinfo(np.int64).max)
    key = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
    # an anchor's own units are the same, and needn't be sorted, unless hashes met by chance
    own = _wide(ctx[:, left : left + u.k])
    start = left + u.k if (own == own[np.searchsorted(key, key)]).all() else left

    def depths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by anchor, then by the row, and how far each goes along with the one before; another anchor not at all."""
        order = u.sort(rows, key)
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        differ = rows[order[again + 1]] != rows[order[again]]
        along = differ.argmax(1)
        far = np.full(n, -1)
        far[again + 1] = np.where(differ[np.arange(len(along)), along], along, rows.shape[1])
        return order, far

    right, far = depths(np.ascontiguousarray(ctx[:, start:]))
    far[far >= 0] += start - left
    back, near = depths(np.ascontiguousarray(ctx[:, :left][:, ::-1]))

    def most(order: np.ndarray, along: np.ndarray) -> np.ndarray:
        told = np.empty(n, np.int64)
        told[order] = np.maximum(along, np.concatenate((along[1:], [-1])))
        return told

    most_right, most_left = most(right, far), most(back, near)
    bits = np.uint64(int(n).bit_length())
    g_right, g_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(left + 1):
        d = SPAN - l
        valid = (nr >= d) & (nl >= l)
        out[valid, l] = least[valid]
        # no other one has the window of a context that goes along with none so far, to the right or to the left
        some = np.flatnonzero(valid & (most_right >= d) & (most_left >= l))
        if not len(some):
            continue
        g_right[right] = np.cumsum(far < d)
        g_left[back] = np.cumsum(near < l)
        if 3 * int(bits) <= 64:  # sorted together with their places
            both = np.sort((g_right[some].astype(np.uint64) << bits | g_left[some].astype(np.uint64)) << bits | np.arange(len(some), dtype=np.uint64))
            some, s = some[(both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)], both >> bits
        else:
            both = g_right[some] * (n + 1) + g_left[some]
            order = np.argsort(both, kind="stable")
            some, s = some[order], both[order]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        out[some, l] = np.repeat(np.minimum.reduceat(least[some], starts), np.diff(np.concatenate((starts, [len(s)]))))
    return out


def _resolved(u: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        a = t.column("a").to_numpy()
        order = np.argsort(a, kind="stable")
        a = a[order]
        column = lambda c: t.column(c).to_numpy()[order]
        ctx = _units_of(u, t.column("ctx"))[order]
        c, nl, nr, least, most = (column(x) for x in ("c", "nl", "nr", "least", "most"))
        edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
        lo = 0
        while lo < len(edges) - 1:  # some anchors at once, whole ones
            hi = max(int(np.searchsorted(edges, edges[lo] + HOT, "right")) - 1, lo + 1)
            s = slice(edges[lo], edges[hi])
            found = firsts(u, a[s], ctx[s], nl[s], nr[s], least[s])
            keep = np.flatnonzero(found.min(1) < most[s])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * found.shape[1], pa.int32()), pa.array(found[keep].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(c[s][keep]), flat], names=["c", "firsts"])
            lo = hi

    return run


def _windows(contexts: DataFrame, u: Units) -> DataFrame:
    """(c, firsts) of contexts of anchors with very many of them: each window by itself, so that no task gathers an anchor."""
    size = np.dtype(u.dtype).itemsize
    each = contexts.select("a", "c", "nl", "nr", "ctx", "least", "most", F.explode(F.sequence(F.lit(0), F.lit(u.most_left))).alias("l")).where(f"nl >= l and nr >= {SPAN} - l")
    window = F.substring("ctx", (F.lit(u.most_left) - F.col("l")) * size + 1, F.lit(SPAN * size))
    each = each.select("c", "l", "most", "least", F.sha2(F.concat(F.col("a").cast("string").cast("binary"), F.lit(b":"), F.col("l").cast("string").cast("binary"), F.lit(b":"), window), 256).alias("w"))
    smallest = each.groupBy("w").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("w", "first")
    met = each.join(smallest, "w").groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("l", "first"))).alias("m"))
    none = F.lit(2**63 - 1).cast("long")
    return met.select("c", F.transform(F.sequence(F.lit(0), F.lit(u.most_left)), lambda l: F.coalesce(F.try_element_at("m", l), none)).alias("firsts"))


def _stretches(row: pa.Array, pos: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """(row, a, z): the first and the last start of each stretch of windows; hit: by l, whether a smaller id has the window that starts l before pos."""
    hit = np.pad(hit[:, ::-1], ((0, 0), (1, 1)))  # starts in ascending order
    left = hit.shape[1] - 3
    at, a = np.nonzero(hit[:, 1:-1] & ~hit[:, :-2])
    _, z = np.nonzero(hit[:, 1:-1] & ~hit[:, 2:])
    return pa.RecordBatch.from_arrays([row.take(pa.array(at)), pa.array(pos[at] - left + a), pa.array(pos[at] - left + z)], names=["row", "a", "z"])


def _ids(row: pa.Array, null: int) -> np.ndarray:
    return row.field("id").fill_null(null).to_numpy()


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            firsts = b.column("firsts").flatten().to_numpy().reshape(b.num_rows, -1)
            yield _stretches(b.column("row"), b.column("pos").to_numpy(), firsts < _ids(b.column("row"), -(2**63))[:, None])


def _gathered(u: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches of the contexts of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        order = np.lexsort((t.column("c").to_numpy(), t.column("a").to_numpy()))
        row = t.column("row").combine_chunks().take(pa.array(order))
        a, c, pos, nl, nr = (t.column(x).to_numpy()[order] for x in ("a", "c", "pos", "nl", "nr"))
        least, most = _ids(row, 2**63 - 1), _ids(row, -(2**63))
        ctx = _units_of(u, t.column("ctx"))
        del parts, t  # all of it is copied
        edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
        # an anchor of one id alone has nothing to tell
        own = np.maximum.reduceat(most, edges[:-1]) > np.minimum.reduceat(least, edges[:-1])
        lo = 0
        while lo < len(edges) - 1:  # some anchors at once, whole ones
            hi = max(int(np.searchsorted(edges, edges[lo] + HOT, "right")) - 1, lo + 1)
            at = edges[lo] + np.flatnonzero(np.repeat(own[lo:hi], np.diff(edges[lo : hi + 1])))
            lo = hi
            if not len(at):
                continue
            units = ctx[order[at]]
            new = np.concatenate(([True], (c[at[1:]] != c[at[:-1]]) | (a[at[1:]] != a[at[:-1]])))
            again = np.flatnonzero(~new)
            wide = _wide(units)
            same = (wide[again] == wide[again - 1]).all(1) & (nl[at[again]] == nl[at[again - 1]]) & (nr[at[again]] == nr[at[again - 1]])
            new[again] = ~same
            if not same.all():  # hashes that met by chance: each context by itself
                new[:] = True
            first, which = np.flatnonzero(new), np.cumsum(new) - 1
            one = at[first]
            found = firsts(u, a[one], units[first], nl[one], nr[one], np.minimum.reduceat(least[at], first))
            tell = np.flatnonzero(found.min(1)[which] < most[at])
            at, which = at[tell], which[tell]
            yield _stretches(row.take(pa.array(at)), pos[at], found[which] < most[at][:, None])

    return run


def _shared_map(keys: DataFrame, spark) -> tuple[object, bool]:
    """The anchors that documents of different ids have, as bits of their hashes, of MOST_ANCHOR_BITS at most (a false one costs a context), with the keys that
    occur more than HOT times; broadcast. Whether there are such ones."""
    told = written(keys)
    keys = told.where("n > 0")
    n = keys.count()
    bits = min(MOST_ANCHOR_BITS, max(1 << 16, 1 << (32 * n).bit_length()))
    spots = keys.select(F.pmod("a", F.lit(bits)).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 3).alias("w")).agg(F.bit_or(F.expr("shiftleft(1, cast(spot % 8 as int))")).cast("int").alias("b")).toArrow()
    held = np.zeros(bits // 8, np.uint8)
    held[words.column("w").to_numpy()] = words.column("b").to_numpy()
    often = np.sort(told.where(F.abs("n") > HOT).select("a").toArrow().column("a").to_numpy().astype(np.uint64))
    return spark.sparkContext.broadcast((held, often)), len(often) > 0


def closely_written(df: DataFrame) -> DataFrame:
    """As `written`, by Zstandard: contexts that lie beside one another have most of their units in common, ranges most of their bytes."""
    path = fresh_dir(df.sparkSession, "stewardry")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_ranges(rows: DataFrame, u: Units, size: int | None = None) -> DataFrame:
    """(row, ranges: starts and ends in turn, in units, apart and in order) of rows (row: id and h, text) of different texts: what windows cover that also start under a smaller id."""
    spark, kind = rows.sparkSession, rows.schema["row"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n if size is None else size
    shards = max(32, int(size) // SHARD_BYTES)
    hashes = rows.select(F.col("row.id").alias("id"), "text").mapInArrow(_hashes(u, shards), "shard long, n long, packed binary")
    shared, some = _shared_map(hashes.repartition(shards, "shard").mapInArrow(_shared, "a long, n long"), spark)

    def contexts(hot: bool) -> DataFrame:
        return rows.select("row", "text").mapInArrow(lambda b, f=_contexts(u, shared, hot): _batched(f(b), 20_000), f"row {kind}, pos long, a long, nl int, nr int, ctx binary")

    # asked for after the shuffle: eight bytes that no compression makes fewer need not be sent
    c = F.xxhash64("a", "nl", "nr", "ctx").alias("c")
    found = contexts(False).repartition("a").select(c, "*").mapInArrow(_gathered(u), f"row {kind}, a long, z long")
    if some:
        found = found.unionByName(_by_context(closely_written(contexts(True)), u, c))
    return found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", (F.col("z") + SPAN).alias("z")))).alias("ranges"))


def _by_context(met: DataFrame, u: Units, c: Column) -> DataFrame:
    """As `_gathered`, of anchors that occur very often: what is gathered, or grouped, is a row for all equal contexts."""
    contexts = closely_written(met.groupBy("a", "nl", "nr", "ctx").agg(F.coalesce(F.min("row.id"), F.lit(2**63 - 1)).alias("least"), F.coalesce(F.max("row.id"), F.lit(-(2**63 - 1))).alias("most")))
    counted = contexts.groupBy("a").agg(F.count("*").alias("n"), F.min("least").alias("x"), F.max("most").alias("y")).where("x < y")
    counted = written(counted.select(F.col("a").alias("k"), "n"))
    true = contexts.join(counted, F.col("a") == F.col("k"))
    small = true.where(F.col("n") <= HOT).select("a", "nl", "nr", "ctx", "least", "most").repartition("a").select(c, "*")
    told = small.mapInArrow(_resolved(u), "c long, firsts array<long>")
    # asked of the counts, as contexts would be shuffled once more to tell
    if counted.where(F.col("n") > HOT).limit(1).count():
        told = told.unionByName(_windows(true.where(F.col("n") > HOT).select(c, "*"), u))
    kind = met.schema["row"].dataType.simpleString()
    # windows of one anchor lie side by side: their range is told by the first and the last of each stretch
    return met.select("row", "pos", c).join(told, "c").select("row", "pos", "firsts").mapInArrow(_covered, f"row {kind}, a long, z long")


def _merged(ranges: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Ranges of each row, in order of their starts, made apart. Ends lie below FAR, or are it."""
    sizes = ranges.value_lengths().fill_null(0).to_numpy()
    flat = ranges.flatten()
    of = np.repeat(np.arange(len(sizes)), sizes)
    a, z = flat.field("a").to_numpy(), np.minimum(flat.field("z").to_numpy(), FAR)
    # the furthest end so far, of the same row: rows lie apart
    far = np.maximum.accumulate(z + of * (2 * FAR))
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + of[1:] * (2 * FAR) > far[:-1]
    starts = np.flatnonzero(new)
    ends = far[np.append(starts[1:], len(a)) - 1] - of[starts] * (2 * FAR) if len(a) else far
    pairs = list(zip(a[starts].tolist(), ends.tolist(), strict=True))
    cuts = np.searchsorted(of[starts], np.arange(len(sizes) + 1)).tolist()
    return [pairs[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def remove_repeats(docs: DataFrame, u: Units, cut: Callable[[bytes, list[tuple[int, int]]], tuple[int, int, bytes]], id_col: str, text_col: str) -> DataFrame:
    """(id, n, n_removed, n_spans, kept) of every row: cut gives units, units removed, and the bytes that are left."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # whole copies meet by a digest: of a text only the row of the smallest id goes on
    digests = written(rows.select(F.struct("id", "h").alias("row"), F.sha2("text", 256).alias("d")).distinct())
    firsts_of = digests.groupBy("d").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = written(digests.join(firsts_of, "d").where("row.id > first.id").select("row"))
    alike = written(digests.join(firsts_of, "d").select("row", (F.col("row") == F.col("first")).alias("kept")))
    decided = digests.join(alike.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left").select("row.id", "row.h", F.coalesce("kept", F.lit(True)).alias("kept"))
    own = kept_rows(rows.select("id", "text"), decided, "id", "text").select(F.struct(F.col("id"), text_key(F.col("text")).alias("h")).alias("row"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first().n
    ranges = closely_written(repeated_ranges(own, u, size))
    # a later copy has what the first one has, and all of its own besides: it is one range
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(2**62).cast("long").alias("z")))
    # rows alike under one id have the first one's ranges
    marks = written(ranges.unionByName(later.select("row", whole.alias("ranges"))).groupBy("row").agg(F.max_by("ranges", F.element_at("ranges", -1)["z"]).alias("ranges")))
    bits = bits_for(marks.count())
    held = bitmap(marks.select(F.xxhash64("row.id", "row.h").alias("k")), bits)
    every = rows.select(F.struct("id", "h").alias("row"), "text")
    near = in_bitmap(F.xxhash64("row.id", "row.h"), held, bits)
    met = every.where(near).join(marks.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left").select("row", "text", "ranges")
    rest = every.where(~near).withColumn("ranges", F.lit(None).cast(marks.schema["ranges"].dataType))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [(len(r), cut(_raw(t), r)) for t, r in zip(b.column("text"), _merged(b.column("ranges")), strict=True)]
            # a range that goes beyond the text is a whole copy: of a text too short for a window it is none
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array([c[j] for _, c in told], pa.int64()) for j in (0, 1)], pa.array([s if c[1] else 0 for s, c in told], pa.int64()), pa.array([c[2] for _, c in told], pa.binary())], names=["row", "n", "n_removed", "n_spans", "kept"])

    kind = every.schema["row"].dataType.simpleString()
    out = met.unionByName(rest).mapInArrow(apply, f"row {kind}, n long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("row.id").cast(docs.schema[id_col].dataType).alias(id_col), "n", "n_removed", "n_spans", "kept")
