"""The pipeline: what each stage drops, against plain versions on its own input, and odd rows."""

from __future__ import annotations

import random

import corpus_pipeline as P
from stewardry.llm.decontaminate import words_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near duplicates", "decontamination", "mixing"] and P.ORACLE_SQL is None


def test_stages_against_plain_versions(spark, data):
    r = random.Random(1)
    say = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    near = say(120)
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "a  b c"), (2, "ab c"), (3, near), (4, near + " end"), (5, say(80)), (6, say(30) + " " + item + " " + say(5)), (7, None), (8, ""), (None, say(40)), (9, say(60)), (9, say(60)), (5, "other " + say(50))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)
    told = lambda df: sorted((str(x.doc_id), x.text or "") for x in df.collect())
    rows = [(str(i), t or "") for i, t in rows]
    exact = P.exact(spark, docs, data)
    assert exact.columns == docs.columns and told(exact) == sorted(x for x in rows if x not in (("2", "ab c"), ("8", "")))
    left = P.near(spark, exact, data)
    assert left.columns == docs.columns and told(left) == sorted(x for x in told(exact) if x[0] != "4")
    clean = P.decontaminate(spark, left, data)
    windows = {tuple(w[i : i + 10]) for x in spark.read.parquet(f"{data}/benchmark.parquet").collect() if (w := words_of((x.text or "").encode())) for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words_of(t.encode())] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert told(clean) == sorted(x for x in told(left) if not hit(x[1])) and "6" not in [i for i, _ in told(clean)]
    mixed = P.mix(spark, clean, data)
    assert told(mixed) == told(clean) and mixed.where("rate < 0").count() == 0
    kept = P.toxicity(spark, docs, data)
    assert kept.columns == docs.columns and P.exact(spark, docs.where("false"), data).count() == 0
