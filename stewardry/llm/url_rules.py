"""URL rules as a sort-merge range join: reversed-host keys turn rules into intervals, a sorted sweep keeps a stack of those that hold.

Pages are never shuffled: each task sorts the keys of its own batch and sweeps them against the sorted rules, which come in
blocks of bounded size; the longest rule of all blocks wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a task holds at once; more take another scan of the pages for each block.
RULES_PER_PASS = 100_000
#: Sorts before every other byte, and ends a host: a rule without a path fits no host that merely begins alike.
END = "\x00"
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    until = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(until, r"^[^/]*", 0)
    return F.translate(host, _upper, _lower), F.substring(until, F.length(host) + 1, F.length(until))


def host_key(host: str) -> str:
    """Labels from the last to the first, each with an end: a domain's key begins those of its subdomains."""
    return "".join(label + "." for label in reversed(host.split(".")))


def sweep(rules: Sequence[tuple[str, str]], hosts: Sequence[str], paths: Sequence[str]) -> list[int]:
    """For each (host, path) the longest rule (host, path) that fits, by its place in `rules`, or -1; of equal ones the first.

    A rule on a domain fits its subdomains, so its interval is one of host keys, within which the path decides. Both lists are swept
    in the order of the host keys; the stack holds the domains whose intervals are open, which are nested.
    """
    by_key: dict[str, dict[str, int]] = {}
    for k, (host, path) in enumerate(rules):
        by_key.setdefault(host_key(host), {}).setdefault(path, k)
    starts = sorted(by_key)
    probes = sorted(range(len(hosts)), key=lambda i: (host_key(hosts[i]), i))
    out, stack, at = [-1] * len(hosts), [], 0
    lengths = {key: sorted({len(p) for p in found}, reverse=True) for key, found in by_key.items()}
    for i in probes:
        key = host_key(hosts[i])
        while at < len(starts) and starts[at] <= key:
            while stack and not starts[at].startswith(stack[-1]):
                stack.pop()
            stack.append(starts[at])
            at += 1
        while stack and not key.startswith(stack[-1]):
            stack.pop()
        best = (-1, 0)
        for domain in stack:
            for n in lengths[domain]:
                k = by_key[domain].get(paths[i][:n]) if len(paths[i]) >= n else None
                if k is not None:
                    best = max(best, (len(rules[k][0]) + n, -k))
                    break
        out[i] = -best[1] if best[0] >= 0 else -1
    return out


def _swept(rules: list[tuple[str, str]], first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array(sweep(rules, b.column("host").to_pylist(), b.column("path").to_pylist()), np.int64)
            # a rule of an earlier block stays where this one has none that is longer
            size = np.array([len(h) + len(p) for h, p in rules] + [-1])
            before, length = b.column("rule_no").to_numpy(zero_copy_only=False), b.column("rule_size").to_numpy(zero_copy_only=False)
            better = size[found] > length
            new = {"rule_no": np.where(better, found + first, before), "rule_size": np.where(better, size[found], length)}
            yield pa.RecordBatch.from_arrays([pa.array(new[n]) if n in new else b.column(n) for n in b.schema.names], names=b.schema.names)

    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict.

    rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts with its own; the longest wins
    (of equal ones the first), else `default` holds and rule is null. Host and path of a null url, or one without `://`, are empty.
    Repeated rows and ids are judged each; very long urls count whole; other columns don't matter whatever their names; an empty table gives an empty result.
    """
    host, path = split_url(F.col(url_col))
    out = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.lit(-1).cast("long").alias("rule_no"), F.lit(-1).cast("long").alias("rule_size"))
    for lo in range(0, len(rules), RULES_PER_PASS):
        out = out.mapInArrow(_swept([(h, p) for _, h, p in rules[lo : lo + RULES_PER_PASS]], lo), out.schema)
    named = out.sparkSession.createDataFrame([(k, h + p, v) for k, (v, h, p) in enumerate(rules)], "k long, rule string, v string") if rules else None
    if named is None:
        return out.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    met = out.join(named if len(rules) > 1000 else F.broadcast(named), F.col("rule_no") == F.col("k"), "left")
    return met.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))
