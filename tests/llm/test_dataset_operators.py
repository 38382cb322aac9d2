"""Manifest, extraction and resampling against plain versions of themselves, on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stewardry.llm import resample as R
from stewardry.llm.blocks import blocks
from stewardry.llm.extract import extract_main_text, main_texts, sample_words
from stewardry.llm.labeller import KEPT, Labeller, PageMaker, fit
from stewardry.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(digests):
    """(root, siblings of each from the leaf up)."""
    level, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append("".join(run[: i % 8] + run[i % 8 + 1 :]))
        at = [i // 8 for i in at]
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


DOCS = "doc_id long, text string, lang string, source string, n_chars long, g int, i int, digest int, row int, id int, h int, kept int, size int, n int, range int, url string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, "u") for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 75])
def test_manifest(spark, n):
    rows = [(k * 7 % 101, f"Text {k} Ä", None if k % 5 == 0 else "ab"[k % 2]) for k in range(n)] + ([(None, None, "b"), (None, "", "b"), (3, "x" * 100_000, "é")] if n > 2 else [])
    frame = docs(spark, rows)
    now = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.when(F.col("doc_id") == 7, F.lower("text")).otherwise(F.col("text")))
    made = merkle_manifest(frame, carry={"now": now}).withColumn("proof", proof_digest(F.col("steps"))).withColumn("folded", folded(F.col("now"), F.col("steps"))).collect()
    groups = defaultdict(list)
    for i, t, lang in rows:
        groups[lang].append((i is not None, i or 0, H(told(i), told("s"), told(lang), told(None if t is None else len(t)), told(t))))
    trees = {g: plain_tree([d for *_, d in sorted(x)]) for g, x in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, above = plain_tree([trees[g][0] for g in order]) if order else (None, [])
    want = sorted((d, trees[g][0], root, H(*trees[g][1][k], *above[order.index(g)])) for g, x in groups.items() for k, (*_, d) in enumerate(sorted(x)))
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in made) == want
    assert all((r.folded == r.root) == (r.doc_id != 7 or "Text" not in str(rows)) for r in made)


def test_rows_alike_are_leaves_of_their_own(spark):
    made = merkle_manifest(docs(spark, [(1, "a", "x")] * 20)).collect()
    assert len(made) == 20 and len({r.leaf for r in made}) == 1 and len({r.root for r in made}) == 1


class Blocks(HTMLParser):
    """Texts of p and li elements that are closed."""

    def __init__(self):
        super().__init__()
        self.out, self.on = [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li"):
            self.out.append("")
            self.on = True

    def handle_endtag(self, tag):
        self.on = self.on and tag not in ("p", "li")

    def handle_data(self, data):
        if self.on:
            self.out[-1] += data


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab <>&;#\"'x\n1", max_size=12), max_size=6))
def test_blocks_read_what_a_parser_reads(texts):
    import html

    page = "<ul>" + "".join(f"<{t}><b>{html.escape(x)}</b></{t}>" for x, t in zip(texts, ["p", "li"] * 3, strict=False)) + "</ul>"
    plain = Blocks()
    plain.feed(page)
    assert blocks(page).texts == [" ".join(x.split()) for x in plain.out if x.split()]


def test_markup_that_breaks_off():
    assert blocks("<p>a<!-- <p>b").texts == ["a"] and blocks("<p>a<script>var t='</p>'; b</script >c").texts == ["ac"]
    assert blocks("a < b &amp c &am d&nbsp;e<br>f").texts == ["a < b & c &am d e f"]
    assert blocks("<p>a<a href='x").texts == ["a"] and blocks("<p><p>x<div title='</div>'>y</p>z").texts == ["x", "y", "z"] and blocks("").texts == []
    deep = "<div>" * 50_000 + "<p>x"
    assert blocks(deep).texts == ["x"] and blocks("<a " * 50_000).texts == []


def test_gradients_are_those_of_differences():
    r = np.random.default_rng(3)
    pages = [PageMaker("a b c d e f".split(), 5).page() for _ in range(3)]
    x, lengths, y = np.concatenate([p[0] for p in pages]), np.array([len(p[1]) for p in pages]), np.concatenate([p[1] for p in pages])
    model = Labeller([w.astype(np.float64) for w in Labeller.fresh(1).w])

    def loss():
        s = model.scores(x, lengths)
        return float(np.mean(np.logaddexp(0, s) - y * s))

    for w, g in zip(model.w, model.gradients(x, lengths, y), strict=True):
        at = tuple(r.integers(0, n) for n in w.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - g[at]) < 2e-3
        w[at] += 1e-3


@pytest.fixture(scope="module")
def model(spark, data):
    return fit(sample_words(spark.read.parquet(f"{data}/pages.parquet")))


def test_labels_of_pages_not_seen(model):
    maker = PageMaker("other words than those it was made with".split(), 77)
    pages = [p for p in (maker.page() for _ in range(200)) if len(p[1])]
    s = model.scores(np.concatenate([p[0] for p in pages]), np.array([len(p[1]) for p in pages]))
    y = np.concatenate([p[1] for p in pages])
    assert ((s > 0) == (y > 0)).mean() > 0.97 and KEPT == ""


def test_the_article_of_every_given_page(spark, data, model):
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages, model=model).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html or "", re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[p.page_id] == "\n".join(x for x in parts if x)


def test_a_page_is_labelled_alike_alone_and_in_a_group(model):
    pages = ["<nav><a>x</a></nav><article><h1>t</h1><p>one two three four.</p></article>", "", "<div class=footer>f</div>", "<article>" + "<p>long text here.</p>" * 3000 + "</article>"]
    assert main_texts(model, pages) == [main_texts(model, [p])[0] for p in pages]
    assert main_texts(model, pages)[3].count("\n") == 2999


def test_odd_pages(spark, model):
    rows = [(1, None), (1, ""), (None, "<article><p>text of it, and more of it.</p></article>"), (2, "<article><p>text of it, and more of it.</p></article>"), (2, "<article><p>text of it, and more of it.</p></article>")]
    frame = spark.createDataFrame([(i, h, ["u"], "t", 3, 4) for i, h in rows], "page_id long, html string, url array<string>, text string, row int, n_chars int")
    out = extract_main_text(frame, model=model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out.collect()) == sorted([("1", "", 0)] * 2 + [(i, "text of it, and more of it.", 27) for i in ("None", "2", "2")])
    assert extract_main_text(frame.where("false")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(rows, target, percent=5, least=20):
    feats = lambda t: [" ".join(w[i : i + k]) for w in [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    buckets = lambda t: Counter(crc32(f.encode()) % 10000 for f in feats(t))
    s, t = Counter(), Counter()
    for _, x in rows:
        s += buckets(x)
    for x in target:
        t += buckets(x)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in rows:
        c = buckets(x)
        w = sum(gain(b) * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(x or ""))])
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(long):
        r.append(k + 1 if k < percent * len(long) // 100 else None)
    return sorted((str(r[0]), *r[1:4], str(r[5] if len(r) > 5 else None)) for r in out)


@pytest.mark.parametrize("pieces", [False, True])
def test_resampling(spark, monkeypatch, pieces):
    if pieces:  # in tasks too: the functions are sent with what they are set to here
        monkeypatch.setattr(R, "PIECE", 64)
        monkeypatch.setattr(R, "CHUNK_FEATURES", 50)
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "X9", "é"]
    text = lambda n: " ".join(r.choice(words, n)) + "-" + "! ".join(r.choice(words, 3))
    rows = [(k, text(int(r.integers(1, 60)))) for k in range(120)] + [(5, None), (None, ""), (7, text(25)), (7, "a"), (8, "???"), (9, "long " * 30000)]
    target = [text(30) for _ in range(5)] + [None, ""]
    frame = docs(spark, [(i, t, "x") for i, t in rows])
    aim = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, range int")
    got = R.resample(frame, aim, percent=20).collect()
    assert sorted((str(x.doc_id), x.n_features, x.weight, x.score, str(x["rank"])) for x in got) == plain_resample(rows, target, 20)


def test_resampling_of_nothing(spark):
    aim = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(docs(spark, []), aim).count() == 0
    assert R.resample(docs(spark, [(1, "a b", "x")]), aim).first().n_features == 3


@settings(deadline=None)
@given(st.text(max_size=40), st.integers(3, 12))
def test_pieces_have_the_words_of_the_whole(text, size):
    before = R.PIECE
    try:
        R.PIECE = size
        assert [w.decode() for part in R.word_lists(text.encode()) for w in part] == WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    finally:
        R.PIECE = before
