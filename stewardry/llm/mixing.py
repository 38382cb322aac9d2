"""Mixing to target weights by soft membership: posteriors of domains, and rates fitted by projected-gradient least squares.

A softmax classifier of words, fitted on a bounded sample of labelled rows, tells how much of each document belongs to each
domain. Rates begin at 1 and take projected steps, max(0, rate - posterior · v), until the expected shares of tokens meet the
targets. A step is K numbers, found from one pass that adds up K (K + 1) numbers of all documents in each task; a rate is what all steps
so far make of 1, so nothing but the posteriors is ever stored beside the rows, which are looked at by the classifier once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.tables import bitmap, bits_for, in_bitmap, written
from stewardry.llm.toxicity import hashed

#: Labelled rows of each domain that the classifier is fitted on, those of the smallest hashes. All of their words count.
SAMPLE_PER_DOMAIN = 1500
#: Weights of the quality domains in the mix.
MIX = {"high": 0.85, "low": 0.13, "toxic": 0.02}
#: Shares that are met to this are met; steps taken at most before that is told as an error.
TOLERANCE, STEPS = 1e-6, 200
#: Where targets can't be met: so many steps in a row that each take off less than so much of the squared distance end the fit.
SLOW, SLOWLY = 4, 2e-4


def quality_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain): toxic rows, and the others by their quality. Of several labels of an id, toxic counts before low, low before high."""
    rank = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    least = labels.groupBy(id_col).agg(F.min(rank).alias("r"))
    return least.select(id_col, F.element_at(F.array(*map(F.lit, ("toxic", "low", "high"))), F.col("r") + 1).alias("domain"))


def _features(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, different ones, their weights: roots of counts, of length 1)."""
    h = hashed(text)
    words, counts = np.unique(h, return_counts=True)
    value = np.sqrt(counts)
    return len(h), words, value / max(np.sqrt((value * value).sum()), 1e-12)


def _raw(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_features(_raw(x)) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array([w.view(np.int64) for _, w, _ in found], pa.list_(pa.int64())), pa.array([v for _, _, v in found], pa.list_(pa.float64()))], names=["domain", "words", "value"])


class Classifier:
    """Softmax over words: sorted word hashes, a weight for each domain, and biases."""

    def __init__(self, domains: Sequence[str], words: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.domains, self.words, self.weights, self.bias = list(domains), words, weights, bias

    @staticmethod
    def fit(domains: Sequence[str], rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 150, ridge: float = 1e-4) -> Classifier:
        """By gradient steps with Adam over all rows at once; domains count alike, however many rows they have."""
        y = np.array([list(domains).index(d) for d, _, _ in rows])
        flat = np.concatenate([w for _, w, _ in rows]) if rows else np.zeros(0, np.uint64)
        words, column = np.unique(flat, return_inverse=True)
        value = np.concatenate([v for _, _, v in rows]) if rows else np.zeros(0)
        row = np.repeat(np.arange(len(rows)), [len(w) for _, w, _ in rows])
        k = len(domains)
        weight = 1 / np.maximum(np.bincount(y, minlength=k), 1)[y] if rows else np.zeros(0)
        weight = weight / max(weight.sum(), 1e-12)
        w, b = np.zeros((len(words), k)), np.zeros(k)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, b)]
        truth = np.eye(k)[y] if rows else np.zeros((0, k))
        for t in range(1, rounds + 1) if rows else ():
            z = np.column_stack([np.bincount(row, w[column, j] * value, len(rows)) for j in range(k)]) + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - truth) * weight[:, None]
            grads = [np.column_stack([np.bincount(column, d[row, j] * value, len(words)) for j in range(k)]) + ridge * w / max(len(words), 1), d.sum(0)]
            for x, g, (m, v) in zip((w, b), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return Classifier(domains, words, w.astype(np.float32), b)

    def posterior(self, text: bytes) -> tuple[int, np.ndarray]:
        """(words, share of each domain)."""
        n, words, value = _features(text)
        z = self.bias.copy()
        if len(words) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            z = z + value[known] @ self.weights[at[known]]
        p = np.exp(z - z.max())
        return n, p / p.sum()


def _placed(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for b in batches:
            told = [c.posterior(_raw(x)) for x in b.column("text")]
            kept = {x: b.column(x) for x in b.schema.names if x != "text"}
            kept |= {"n": pa.array([n for n, _ in told], pa.int64()), "p": pa.array([p for _, p in told], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    return run


def classifier(docs: DataFrame, domains: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: Sequence[str] = ()) -> Classifier:
    """Fitted on SAMPLE_PER_DOMAIN rows of each domain (id, domain); repeated ids are taken once."""
    kind = docs.schema[id_col].dataType
    marks = written(domains.where(F.col("domain").isin(list(names))).groupBy(F.col(id_col).cast(kind).alias("lid")).agg(F.min("domain").alias("domain")))
    bits = bits_for(marks.count())
    # only ids, and no texts, meet the labels; the sample's texts are fetched when it has been picked
    ids = docs.select(F.col(id_col).alias("id")).where(in_bitmap(F.xxhash64("id"), bitmap(marks.select(F.xxhash64("lid").alias("k")), bits), bits)).distinct()
    met = written(ids.join(marks, F.col("id") == F.col("lid")).select("id", "domain"))
    # each task tells its first ones of a domain: no task holds a domain
    each = [met.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_DOMAIN) for d in names]
    picked = written(reduce(DataFrame.unionAll, each, met.where("false")))
    # at most SAMPLE_PER_DOMAIN ids of each domain
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.withColumnRenamed("id", "pid")), F.col("id") == F.col("pid"))
    once = rows.groupBy("id", "domain").agg(F.min("text").alias("text"))
    sample = once.select("domain", "text").mapInArrow(_sampled, "domain string, words array<long>, value array<double>").toArrow()
    sample = sample.combine_chunks()
    words, value = (pa.concat_arrays([x.flatten() for x in sample.column(c).chunks]).to_numpy() if len(sample) else np.zeros(0) for c in ("words", "value"))
    edges = np.cumsum([0, *pc.list_value_length(sample.column("words")).to_pylist()])
    found = [(d, words[a:z].view(np.uint64), value[a:z]) for d, a, z in zip(sample.column("domain").to_pylist(), edges[:-1], edges[1:], strict=True)]
    found.sort(key=lambda r: (r[0], r[1].tobytes()))
    return Classifier.fit(list(names), found)


def rate(p: Column, steps: Sequence[np.ndarray]) -> Column:
    """What the steps make of a rate of 1."""
    if not steps:
        return F.lit(1.0)
    told = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in steps])
    dot = lambda v: sum((F.get(p, F.lit(j)) * F.get(v, F.lit(j)) for j in range(1, len(steps[0]))), F.get(p, F.lit(0)) * F.get(v, F.lit(0)))
    return F.aggregate(told, F.lit(1.0), lambda r, v: F.greatest(F.lit(0.0), r - dot(v)))


def _summed(steps: Sequence[np.ndarray], tries: np.ndarray, total: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a task: after the steps and each of the tries, the sums of shares and of second moments of (n, p)."""
    k = tries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, moments = np.zeros((len(tries), k)), np.zeros((len(tries), k, k))
        for b in batches:
            p = b.column("p").flatten().to_numpy().reshape(-1, k)
            w = b.column("n").to_numpy(zero_copy_only=False) / total
            r = np.ones(len(p))
            for v in steps:
                r = np.maximum(0.0, r - p @ v)
            for t, v in enumerate(tries):
                after = np.maximum(0.0, r - p @ v)
                shares[t] += (w * after) @ p
                moments[t] += (p * (w * (after > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([shares.ravel()], pa.list_(pa.float64())), pa.array([moments.ravel()], pa.list_(pa.float64()))], names=["s", "g"])

    return run


def fitted_steps(placed: DataFrame, targets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, shares) of placed (n, p): shares of all tokens, by which the sum of squared distances from the targets is least.

    A step goes along the residual, scaled by the inverse of the second moments of the posteriors of those documents whose rate can
    move, or along the residual itself; one pass looks at several lengths of both, and the best is taken. It ends when the targets
    are met; or, as these documents can't meet them, when SLOW steps in a row have each taken off less than SLOWLY of the sum: then
    the shares are the nearest to that measure. An error if STEPS don't suffice for either.
    """
    k = len(targets)
    total = placed.agg(F.sum("n").alias("n")).first().n or 0
    if not total:
        return [], np.zeros(k)

    def looked(steps: list[np.ndarray], tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(shares, moments) after the steps and each of the tries."""
        got = placed.select("n", "p").mapInArrow(_summed(steps, np.array(tries), float(total)), "s array<double>, g array<double>").collect()
        shares, moments = (np.sum([r[c] for r in got], 0) for c in ("s", "g"))
        return list(zip(shares.reshape(-1, k), moments.reshape(-1, k, k), strict=True))

    steps: list[np.ndarray] = []
    (shares, moments), slow = looked(steps, [np.zeros(k)])[0], 0
    # with every rate free: a step along the residual by its inverse always leads down, if anything does
    most = max(np.linalg.eigvalsh(moments)[-1], 1e-12)
    for _ in range(STEPS):
        e = shares - targets
        if np.abs(e).max() <= TOLERANCE:
            return steps, shares
        along = np.linalg.solve(moments + (1e-9 * np.trace(moments) + 1e-15) * np.eye(k), e)
        plain = e / most
        tries = [along * 4.0**x for x in range(-4, 2)] + [plain * 8.0**x for x in range(8)]
        if steps:  # momentum: the last step again, and more of it
            tries += [plain + steps[-1], steps[-1], steps[-1] * 4]
        found = looked(steps, tries)
        best = min(range(len(tries)), key=lambda t: ((found[t][0] - targets) ** 2).sum())
        gain = 1 - ((found[best][0] - targets) ** 2).sum() / (e**2).sum()
        if gain > 0:
            steps, (shares, moments) = [*steps, tries[best]], found[best]
        slow = slow + 1 if gain < SLOWLY else 0
        if slow >= SLOW or gain <= 0:
            return steps, shares
    raise RuntimeError(f"after {STEPS} steps the shares are still {np.abs(shares - targets).max():.2g} away from the targets")


def mixing_rates(docs: DataFrame, domains: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of `docs`: id, the columns of `keep`, n_tokens, p_<domain>, rate, distance.

    rate: how often a document enters the mix, at least 0; expected tokens of the domains, sum of rate * n_tokens * p, are to the corpus' tokens
    as the targets (normalised to 1). distance: by how much the worst share misses its target, the same in all rows; 0 to TOLERANCE where the
    documents can meet them. Null and empty texts have no tokens, the classifier's prior as posterior, and move nothing. Repeated rows are
    documents of their own; columns of `docs` that are not in `keep` don't matter, those named like one of the result's are left out; an empty table gives an empty result. Texts count whole.
    """
    names = sorted(targets)
    aims = np.array([float(targets[d]) for d in names])
    if (aims < 0).any() or aims.sum() <= 0:
        raise ValueError("targets are shares of at least 0")
    aims = aims / aims.sum()
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(classifier(docs, domains, id_col, text_col, names))
    own = {id_col.lower(), "n_tokens", "rate", "distance", *(f"p_{d}".lower() for d in names)}
    kept = [c for c in keep if c.lower() not in own]
    rows = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(kept)]).alias("row"), F.col(text_col).alias("text"))
    out = written(rows.mapInArrow(_placed(model), f"row {rows.schema['row'].dataType.simpleString()}, n long, p array<double>"))
    steps, shares = fitted_steps(out, aims)
    shown = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(names)]
    away = float(np.abs(shares - aims).max()) if len(steps) or shares.sum() else 0.0
    # told before any column of the documents gets its name back
    told = out.select("row", F.col("n").alias("n_tokens"), *shown, rate(F.col("p"), steps).alias("rate"))
    return told.select(F.col("row.id").alias(id_col), *[F.col(f"row.k{j}").alias(c) for j, c in enumerate(kept)], "n_tokens", *[f"p_{d}" for d in names], "rate", F.lit(away).alias("distance"))
