"""Deduplication keeps or drops rows, not ids."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stewardry.llm.exact_dedup import drop_exact_copies
from stewardry.llm.jaccard import Family, keep_one_of_each

SCHEMA = "doc_id long, text string, h long, kept boolean, id long, __id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, True, 2, 3) for i, t in rows], SCHEMA)


def kept(frame_):
    return sorted((str(r.doc_id), str(r.text)) for r in frame_.collect())


@pytest.mark.parametrize("drop", [drop_exact_copies, keep_one_of_each])
def test_a_copy_under_a_repeated_id_takes_no_other_text_along(spark, drop):
    rows = [(1, "foo bar baz qux"), (5, "foo bar baz qux"), (5, "another wholly unique text here"), (None, "of no id at all"), (7, "of no id at all"), (8, "twice the same row"), (8, "twice the same row")]
    given_ = frame(spark, rows)
    out = drop(given_)
    assert out.columns == given_.columns
    assert kept(out) == sorted([("1", "foo bar baz qux"), ("5", "another wholly unique text here"), ("None", "of no id at all"), ("8", "twice the same row")])
    assert kept(drop(given_.where("false"))) == []


def test_exact_copies_of_one_id(spark):
    out = drop_exact_copies(frame(spark, [(3, "a b"), (3, "a\tb"), (3, "a  b"), (4, None), (4, ""), (2, None)]))
    assert kept(out) == [("2", "None"), ("3", "a  b")]


def test_near_copies_of_one_id(spark):
    r = random.Random(3)
    base = " ".join(f"w{r.randrange(10**6)}" for _ in range(100))
    rows = [(3, base + " x"), (3, base + " y"), (9, base), (4, None), (4, ""), (4, None)]
    out = keep_one_of_each(frame(spark, rows))
    assert len(kept(out)) == 2 and {i for i, _ in kept(out)} == {"3", "4"}


@settings(deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=12), st.sampled_from([80, 85, 100]))
def test_blocks_that_are_skipped_hold_no_answer(sets, similar):
    tokens = [np.array(sorted(x), np.uint64) for x in sets]
    family = Family(tokens, similar)
    for x in range(len(sets)):
        a = sets[family.order[x]]
        want = [y for y in range(len(sets)) for b in [sets[family.order[y]]] if 100 * len(a & b) >= similar * len(a | b)]
        assert family.answers(x).tolist() == want
        lo, hi = family.window(x)
        assert family.counted(x, lo, hi).tolist() == [len(a & sets[family.order[y]]) for y in range(lo, hi)]


@settings(deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=12), st.sampled_from([80, 85]))
def test_answers_that_are_derived_are_those_of_the_sets(sets, similar):
    family = Family([np.array(sorted(x), np.uint64) for x in sets], similar)
    ordered = [sets[k] for k in family.order]
    got = {x: sorted(found.tolist()) for x, found in family.all_answers()}
    assert got == {x: [y for y, b in enumerate(ordered) if 100 * len(a & b) >= similar * len(a | b)] for x, a in enumerate(ordered)}
    overlaps = family.counted(0, 0, len(sets))
    for x in range(len(sets)):
        overlaps = family.derived(x, max(x - 1, 0), overlaps)
        assert overlaps.tolist() == [len(ordered[x] & b) for b in ordered]
