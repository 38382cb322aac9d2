"""What the check's failures of round 3 came from: toxicity."""

from __future__ import annotations

from stewardry.llm import toxicity
from tests.llm.test_corpus_operators import frame


def test_texts_meet_their_labels_where_they_lie(spark, monkeypatch):
    """op8 had shuffled the labelled texts as soon as the labels were too many for Spark's own threshold; with too many to be sent it still does, and finds the same."""
    seen, kept, found = [], toxicity.written, []
    monkeypatch.setattr(toxicity, "written", lambda df: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or kept(df))
    rows = [(k, ("vile rotten " if k % 5 == 0 else "good fine plain ") * 3 + f"w{k % 7}") for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(50)] + [(None, 1)], "doc_id long, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for sent in (1_000_000, 0):
            monkeypatch.setattr(toxicity, "MOST_SENT", sent)
            found.append(sorted((r.doc_id, round(r.score, 6), r.predicted) for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found[0]) == 60 and found[0] == found[1] and len({x[1] for x in found[0]}) > 1
    assert ["BroadcastHashJoin" in p for c, p in seen if c == ["row", "text", "bit"]] == [True, False]
