"""What the check's failures of round 3 came from: mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.llm import mixing
from tests.llm.test_corpus_operators import frame


def test_mixing_looks_at_texts_once(spark, monkeypatch):
    """op2 and the pipeline had the classifier read all texts a second time for the result."""
    seen, placed = [], mixing._placed
    monkeypatch.setattr(mixing, "_placed", lambda m: seen.append(m) or placed(m))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    rows = [(k, ("good fine " if k % 2 else "bad poor ") * 5) for k in range(30)]
    got = mixing.mixing_rates(frame(spark, rows), mixing.quality_domains(labels), {"high": 0.5, "low": 0.5}, keep=("text",))
    assert got.count() == 30 and len(seen) == 1
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_sample_of_a_domain_is_of_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE_PER_DOMAIN", 5)
    rows = [(k, f"w{k}") for k in range(40)]
    domains = spark.createDataFrame([(k, "high" if k % 2 else "low") for k in range(40)], "doc_id long, domain string")
    order = [x.id for x in spark.range(40).orderBy(F.xxhash64("id")).collect()]
    want = {f"w{k}" for half in (0, 1) for k in [x for x in order if x % 2 == half][:5]}
    got = mixing.classifier(frame(spark, rows), domains, names=["high", "low"])
    assert set(got.words.tolist()) == {int(mixing.hashed(w.encode())[0]) for w in want}
