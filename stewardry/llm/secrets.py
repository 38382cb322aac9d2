"""Secret scans: base patterns, and formats learned by grammar inference.

The patterns' matches are labelled credentials. From a bounded sample of them, per kind, a prefix tree over character classes
is built and its statistically compatible states are merged (Hoeffding bounds on the frequencies of ending and of each
symbol) into a probabilistic automaton; another is inferred from ordinary runs of the same characters. Every run of the credentials'
characters that is as long as a credential may be, and that no base span covers, is then scored by all automata; one that is as
likely, a symbol, beside the ordinary ones as labelled credentials are is reported too, as `format`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.llm.tables import text_key, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
#: Labelled credentials per kind, and ordinary runs, that an automaton is inferred from, those of the smallest hashes; rows that lend the latter.
SAMPLE_PER_KIND, ORDINARY, ORDINARY_ROWS = 400, 1500, 200
#: Shortest labelled credential, and so the shortest run that is scored.
LEAST = 12
#: Share of the labelled sample that the threshold may leave out; confidence of the Hoeffding bounds.
QUANTILE, ALPHA = 0.02, 0.05
#: Bytes of texts that a task looks at together.
GROUP = 8 << 20

_hex = np.zeros(256, bool)
_hex[list(b"0123456789abcdef")] = True
_token = np.zeros(256, bool)
_token[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
#: Character classes: a class's probability is shared evenly by its characters.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
_class = np.full(256, len(CLASSES) - 1, np.int64)
for _k, _members in enumerate(CLASSES):
    _class[list(_members.encode())] = _k
_share = np.log([1 / len(m) for m in CLASSES])


class Automaton:
    """A probabilistic automaton inferred from words (sequences of classes): states, where symbols lead, and their log-probabilities."""

    def __init__(self, words: Iterable[Iterable[int]], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.seen: list[dict[int, int]] = [{}]
        self.end = [0]
        for word in words:
            at = 0
            for c in word:
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.end.append(0)
                at = self.next[at][c]
            self.end[at] += 1
        self._merge(np.sqrt(0.5 * np.log(2 / alpha)))
        self._tabulate()

    def _total(self, q: int) -> int:
        return self.end[q] + sum(self.seen[q].values())

    def _alike(self, a: int, b: int, bound: float) -> bool:
        """Whether two states, and all that follows them, differ no more than their counts allow."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            most = bound * (1 / np.sqrt(n) + 1 / np.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > most:
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a].get(c, 0) / n - self.seen[b].get(c, 0) / m) > most:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """State b, the root of a tree, into state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, bound: float) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.next[p][c]
            for r in red:
                if self._alike(r, q, bound):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known]
        self.states = red

    def _tabulate(self) -> None:
        """Arrays over states and classes; what was never seen leads nowhere, and costs what one in a few hundred does."""
        place = {q: k for k, q in enumerate(self.states)}
        n, k = len(place) + 1, len(CLASSES)
        self.to, self.log, self.log_end = np.full((n, k), n - 1), np.full((n, k), np.log(1 / (k + 1)) - 3), np.full(n, np.log(1 / (k + 1)) - 3)
        for q, row in place.items():
            total = self._total(q) + 0.5 * (k + 1)
            self.log[row] = np.log(0.5 / total)
            self.log_end[row] = np.log((self.end[q] + 0.5) / total)
            for c, m in self.seen[q].items():
                self.log[row, c] = np.log((m + 0.5) / total)
                self.to[row, c] = place[self.next[q][c]]
        self.log = self.log + _share

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood a symbol of each run data[start:end]; all runs take a step together."""
        order = np.argsort(starts - ends, kind="stable")
        s, n = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(s), np.int64), np.zeros(len(s))
        running = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
        for t, m in enumerate(running):
            c = _class[data[s[:m] + t]]
            total[:m] += self.log[state[:m], c]
            state[:m] = self.to[state[:m], c]
        out = np.empty(len(s))
        out[order] = (total + self.log_end[state]) / (n + 1)
        return out


class Formats:
    """An automaton for each kind, one for ordinary runs, and the least advantage over it of each kind."""

    def __init__(self, labelled: dict[str, list[bytes]], ordinary: list[bytes]):
        codes = lambda words: [_class[np.frombuffer(w, np.uint8)].tolist() for w in words]
        # in halves, of which the less likely one counts: a credential among the ordinary runs speaks in one of them only
        self.ordinary = [Automaton(codes(ordinary[k::2])) for k in (0, 1)]
        self.kinds = {}
        for kind, words in labelled.items():
            if words:
                # the threshold is of words that the automaton scoring them hasn't seen
                own = [self._beyond(Automaton(codes(words[1 - k :: 2])), words[k::2]) for k in (0, 1) if words[1 - k :: 2] and words[k::2]]
                least = float(np.quantile(np.concatenate(own), QUANTILE)) if own else np.inf
                self.kinds[kind] = (Automaton(codes(words)), max(0.0, least))

    def _beyond(self, automaton: Automaton, words: list[bytes]) -> np.ndarray:
        data, starts, ends = _joined(words)
        return automaton.scores(data, starts, ends) - self._usual(data, starts, ends)

    def _usual(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.minimum(*(a.scores(data, starts, ends) for a in self.ordinary))

    def advantage(self, kind: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.kinds[kind][0].scores(data, starts, ends) - self._usual(data, starts, ends)

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a run has the format of any kind."""
        out = np.zeros(len(starts), bool)
        for kind, (_, least) in self.kinds.items():
            out |= self.advantage(kind, data, starts, ends) > least
        return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes of all texts together) of maximal runs of at least `least` bytes within a text."""
    hit = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
    ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    group, size = [], 0
    for x in column:
        group.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def found(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the base spans (start, kind, end) in bytes, in order; and (data, row, start, end) of the longer runs, in bytes of all texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    s, e = runs(data, offsets, _hex, 16)
    for row, a, z in zip(np.searchsorted(offsets, s, "right") - 1, s, e, strict=True):
        spans[row].append((int(a - offsets[row]), 2, int(z - offsets[row])))
    for row, t in enumerate(texts):
        if b"AKIA" in t:
            spans[row] += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        low = t.lower()
        if any(n in low for n in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
            spans[row] += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN.pattern.encode(), t, re.I) if m.end(2) - m.start(2) >= 12]
        spans[row].sort()
    s, e = runs(data, offsets, _token, LEAST)
    return spans, (data, np.searchsorted(offsets, s, "right") - 1, s, e)


def _uncovered(spans: list[list[tuple[int, int, int]]], texts: list[bytes], row: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Runs that no base span covers wholly; those of texts without base spans are the most, and told at once."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    keep = np.ones(len(s), bool)
    some = np.array([bool(x) for x in spans])
    for k in np.flatnonzero(some[row]) if len(s) else ():
        a, z = s[k] - offsets[row[k]], e[k] - offsets[row[k]]
        keep[k] = not any(x <= a and z <= y for x, _, y in spans[row[k]])
    return keep


def _code_points(text: bytes, at: list[int]) -> list[int]:
    """Places in bytes as places in code points."""
    if len(text) == len(text.decode()):
        return at
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return before[at].tolist()


_span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_NAMES = (*KINDS, "format")


def _scanned(formats: Formats | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts in _groups(b.column("text")):
                spans, (data, row, s, e) = found(texts)
                if formats is not None and len(s):
                    keep = _uncovered(spans, texts, row, s, e)
                    row, s, e = row[keep], s[keep], e[keep]
                    hit = formats.hits(data, s, e)
                    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                    for k in np.flatnonzero(hit):
                        spans[row[k]].append((int(s[k] - offsets[row[k]]), 3, int(e[k] - offsets[row[k]])))
                for t, found_here in zip(texts, spans, strict=True):
                    found_here.sort()
                    places = _code_points(t, [p for a, _, z in found_here for p in (a, z)])
                    out.append([{"kind": _NAMES[k], "start": places[2 * j], "end": places[2 * j + 1]} for j, (_, k, _) in enumerate(found_here)])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, _span_type)], names=["row", "spans"])

    return run


def _ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, run): the longer runs of rows (k, text) that no base span covers, as often as they occur."""
    for b in batches:
        keys, at = b.column("k").to_numpy(), 0
        for texts in _groups(b.column("text")):
            spans, (data, row, s, e) = found(texts)
            keep = _uncovered(spans, texts, row, s, e)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at + row[keep]]), pa.array([data[x:y].tobytes() for x, y in zip(s[keep], e[keep], strict=True)], pa.binary())], names=["k", "run"])
            at += len(texts)


def learned(rows: DataFrame) -> Formats:
    """Formats of the credentials in rows (row, text). Plain values are held in the driver's memory only, SAMPLE_PER_KIND of each kind."""
    kind = rows.schema["row"].dataType.simpleString()
    base = written(rows.mapInArrow(_scanned(None), f"row {kind}, spans array<struct<kind: string, start: long, end: long>>").where(F.size("spans") > 0))
    each = base.select("row", F.explode("spans").alias("s"))
    place = F.row_number().over(W.partitionBy("s.kind").orderBy(F.xxhash64("row", "s"), "row", "s.start"))
    picked = written(each.withColumn("place", place).where(F.col("place") <= SAMPLE_PER_KIND).select(F.col("row").alias("r"), "s"))
    value = F.substring("text", F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int"))
    # at most SAMPLE_PER_KIND rows of each kind; repeated rows lend their values once
    met = rows.join(F.broadcast(picked), F.col("row") == F.col("r")).select("row", "s", value.alias("v")).distinct().collect()
    labelled: dict[str, list[bytes]] = {k: [] for k in KINDS}
    for r in sorted(met, key=lambda r: (r.s.kind, r.v)):
        v = ASSIGN.match(r.v)[2] if r.s.kind == "assign" else r.v
        labelled[r.s.kind].append(v.encode())
    held = rows.select("text", F.xxhash64("row").alias("k")).where("text is not null")
    least = [r.k for r in held.select("k").distinct().orderBy("k").limit(ORDINARY_ROWS).collect()]
    some = held.where(F.col("k") <= least[-1]).dropDuplicates(["k"]).select("k", "text").mapInArrow(_ordinary, "k long, run binary") if least else None
    plain = [bytes(r.run) for r in some.orderBy(F.xxhash64("k", "run"), "run").limit(ORDINARY).collect()] if least else []
    return Formats(labelled, plain)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, spans (kind, start, end) by start, then kind, in code points, the end exclusive.

    Kinds: assign, access and hex of the base patterns, and format. Null and empty texts have none. Repeated rows are scanned each; other
    columns don't matter whatever their names; an empty table gives an empty result. Without labelled credentials there are no formats. Texts count whole.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h")).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_scanned(learned(rows)), f"row {kind}, spans array<struct<kind: string, start: long, end: long>>")
    return out.select(F.col("row.id").alias(id_col), "spans")


def digest(scanned: DataFrame) -> DataFrame:
    """The spans told as counts, a digest of the base ones, and a text of all."""
    rank: Column = F.col("spans")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(rank, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    others = [c for c in scanned.columns if c != "spans"]
    return scanned.select(*others, *[count(k) for k in KINDS], F.sha2(told(F.filter(rank, lambda s: s["kind"] != "format")), 256).alias("base_sha256"), told(rank).alias("spans"))
