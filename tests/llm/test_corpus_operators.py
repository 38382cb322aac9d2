"""The corpus operators against plain versions of themselves, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stewardry.llm import mixing, pii, repeats, secrets, toxicity
from stewardry.llm.components import components
from stewardry.llm.decontaminate import Search, benchmark_hits, drop_contaminated, words_of
from stewardry.llm.exact_dedup import exact_dedup
from stewardry.llm.jaccard import near_duplicates
from stewardry.llm.suffix_array import BlindTrie, deep_shallow, remove_repeated_bytes
from stewardry.llm.suffix_tree import prefix_partitioned, remove_repeated_words
from stewardry.llm.url_rules import judge_urls, sweep

ODD = "doc_id long, text string, id int, h int, row int, n int, p int, a int, c int, ctx int, kept boolean, spans int, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, 8, True, 9, "l", "s", 0) for i, t in rows], ODD)


def prose(r, n, words=200):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def texts(seed=1):
    """Copies, near copies, shared passages, odd and long texts, repeated ids and rows."""
    r = random.Random(seed)
    a, b, shared = prose(r, 150), prose(r, 90), prose(r, 60)
    rows = [(10, a), (11, a), (12, a + " end"), (13, prose(r, 40) + " " + shared + " " + prose(r, 40)), (14, shared + " " + prose(r, 30)), (3, prose(r, 5) + shared), (20, b), (20, b), (20, b + " x"), (21, "é" + b)]
    rows += [(30, None), (31, ""), (32, "  \t\n"), (33, "one two"), (34, "one two"), (None, shared), (None, "of no id " + prose(r, 60)), (40, "x" * 300), (41, "x" * 200 + "y"), (50, prose(r, 20_000, 50)), (51, "ab " * 4000)]
    return rows


def runs_removed(rows, cut):
    """The plain version: units that a window of 50 covers which starts under a smaller id too."""
    first = {}
    for i, t in rows:
        u = cut(t)
        for s in range(len(u) - 49):
            key = tuple(u[s : s + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        u = cut(t)
        gone = np.zeros(len(u) + 1, bool)
        for s in range(len(u) - 49):
            if i is not None and first[tuple(u[s : s + 50])] < i:
                gone[s : s + 50] = True
        out.append((str(i), len(u), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), [x for x, g in zip(u, gone, strict=False) if not g]))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 3000]
    got = remove_repeated_bytes(frame(spark, rows)).collect()
    want = runs_removed(rows, lambda t: (t or "").encode())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((i, n, g, s, bytes(u)) for i, n, g, s, u in want)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeated_words(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(i, t) for i, t in texts(2) if t is None or len(t) < 30_000]
    got = remove_repeated_words(frame(spark, rows)).collect()
    want = runs_removed(rows, lambda t: (t or "").encode().split())
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in got) == sorted((i, n, g, b" ".join(u)) for i, n, g, _, u in want)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(min_size=40, max_size=40).map(lambda b: bytes(x % 2 for x in b[:30]) * 2), max_size=30))
def test_orders(rows):
    data = np.frombuffer(b"".join(r[:50] for r in rows), np.uint8).reshape(len(rows), 50) if rows else np.zeros((0, 50), np.uint8)
    for order in (deep_shallow(data), prefix_partitioned(data.astype(np.uint64))):
        assert [bytes(data[k]) for k in order] == sorted(bytes(r) for r in data)
    if rows:
        assert [bytes(data[k]) for k in BlindTrie(data).order()] == sorted(bytes(r) for r in data)


@settings(deadline=None, max_examples=40)
@given(st.binary(min_size=50, max_size=300))
def test_equal_windows_have_an_anchor_at_the_same_place(text):
    at, h = repeats.anchors(np.frombuffer(text * 2, np.uint8), 24)
    seen = dict(zip(at.tolist(), h.tolist(), strict=True))
    for s in range(len(text) - 49):
        assert {p - s: seen[p] for p in seen if s <= p <= s + 26}.items() & {p - s - len(text): seen[p] for p in seen if s <= p - len(text) <= s + 26}.items()


def test_near_copies(spark):
    rows = texts(3)
    got = near_duplicates(frame(spark, rows)).collect()
    sets = [frozenset(tuple(w[i : i + min(4, len(w))]) for i in range(max(1, len(w) - 3))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    ids = [-1 if i is None else i for i, _ in rows]
    link = [[b for b in range(len(rows)) if b != a and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])] for a in range(len(rows))]
    want = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(ids[b] for b in seen)
        want.append((str(rows[a][0]), len(sets[a]), "None" if least == -1 else str(least), len(link[a])))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == sorted(want)


def test_families_in_blocks(spark, monkeypatch):
    from stewardry.llm import jaccard

    r = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(200)] = f"z{k}"
        rows.append((k, " ".join(w)))
    whole = sorted(map(tuple, near_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows)).collect())) == whole


def test_components(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 80)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)]
    got = {x.v: x.c for x in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_windows_of_a_benchmark(spark):
    r = random.Random(7)
    items = [prose(r, 25, 30), prose(r, 12, 30), "Just, three words", "", None, prose(r, 10, 30), "w1"]
    rows = [(k, prose(r, 30, 60) + " " + (items[k % 4] or "").upper() + "." + prose(r, 5, 60)) for k in range(12)] + [(1, None), (None, ""), (3, items[0])]
    benchmark = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, spans int")
    windows = {}
    for k, t in enumerate(items):
        w = words_of((t or "").encode())
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    want = []
    for i, t in rows:
        w, hit, met = words_of((t or "").encode()), set(), set()
        for win, its in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    met |= its
        want.append((str(i), len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    from stewardry.llm import decontaminate

    before = decontaminate.WINDOWS_PER_PASS
    for size in (before, 7):
        decontaminate.WINDOWS_PER_PASS = size
        got = benchmark_hits(frame(spark, rows), benchmark).collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == sorted(want)
    decontaminate.WINDOWS_PER_PASS = before
    kept = drop_contaminated(frame(spark, rows), benchmark)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(not w[5] for w in want)
    assert benchmark_hits(frame(spark, rows), benchmark.where("false")).where("contaminated").count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=5), min_size=1, max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=20))
def test_search_finds_every_occurrence(patterns, text):
    unique = [list(p) for p in {tuple(p) for p in patterns}]
    ((spans, items),) = Search([(p, [k]) for k, p in enumerate(unique)]).hits([text])
    hit = {x for p in unique for s in range(len(text) - len(p) + 1) if text[s : s + len(p)] == p for x in range(s, s + len(p))}
    assert {x for a, z in zip(spans[::2], spans[1::2], strict=True) for x in range(a, z)} == hit
    assert items == {k for k, p in enumerate(unique) if any(text[s : s + len(p)] == p for s in range(len(text)))}


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["org", "a.org", "b.a.org", "aorg", "com"]), st.sampled_from(["/", "/x", "/x/y", ""])), min_size=1, max_size=6), st.lists(st.tuples(st.sampled_from(["org", "a.org", "c.a.org", "b.a.org", "xorg", "com", ""]), st.sampled_from(["", "/", "/x", "/x/yz"])), max_size=6))
def test_the_longest_rule_that_fits(rules, urls):
    for (host, path), got in zip(urls, sweep(rules, [h for h, _ in urls], [p for _, p in urls]), strict=True):
        fit = [k for k, (h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got == (max(fit, key=lambda k: (len(rules[k][0]) + len(rules[k][1]), -k)) if fit else -1)


def test_odd_urls(spark):
    rows = [(1, None), (1, None), (None, "no scheme"), (2, "http://A.Org?x/"), (3, "x://h" + "y" * 100_000 + "/p")]
    df = spark.createDataFrame([(i, u, 1, "r") for i, u in rows], "page_id long, url string, k int, rule string")
    got = sorted((str(r.page_id), r.host[:6], r.path, r.rule) for r in judge_urls(df, [("block", "org", "")]).collect())
    assert got == [("1", "", "", None), ("1", "", "", None), ("2", "a.org", "", "org"), ("3", "hyyyyy", "/p", None), ("None", "", "", None)]
    assert judge_urls(df.where("false"), []).count() == 0 and judge_urls(df, []).where("verdict = 'allow'").count() == 5


def plain_private(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, v):
        d = re.sub("[^0-9]", "", v)
        if k == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if k == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k == "email" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t or "") if ok(k, m[0])]


def test_private_data(spark):
    r = random.Random(8)
    bits = ["a@b.co", "x.y+z@q-r.example.org_m@n.de", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1 2", "é", "@", "..", "word"]
    rows = [(k, " ".join(r.choice(bits) for _ in range(r.randrange(12)))) for k in range(60)] + [(1, None), (2, ""), (None, "m@n.oo"), (7, "m@n.oo"), (7, "m@n.oo"), (8, "many@at.ex " * 5000)]
    got = pii.sanitise(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), [(s.kind, s.start, s.end) for s in x.spans if s.kind != "term"]) for x in got) == sorted((str(i), plain_private(t)) for i, t in rows)
    assert pii.sanitise(frame(spark, [])).count() == 0


def test_terms_that_reveal_are_found_and_removed(spark):
    r = random.Random(9)
    rows = [(k, prose(r, 30) + " common") for k in range(60)]
    rows += [(100 + k, f"{prose(r, 10)} zanzibar common call ann{k % 2}@corp.org {prose(r, 10)}".replace("ann1", "ann0" if k < 6 else "ann1")) for k in range(8)]
    frame_ = frame(spark, rows)
    spans = {x.doc_id: x.spans for x in pii.sanitise(frame_).collect()}
    texts_ = dict(rows)
    told = {texts_[i][s.start : s.end] for i, found in spans.items() for s in found if s.kind == "term"}
    assert told == {"zanzibar"} or told == {"zanzibar", "call"}
    clean = {x.doc_id: x.text for x in pii.redacted(frame_).collect()}
    assert all("zanzibar" not in t and "@" not in t for t in clean.values()) and "[email]" in clean[100] and clean[5] == texts_[5] and "common" in clean[100]


def test_secrets(spark):
    r = random.Random(10)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    rows = [(k, f"{prose(r, 20)} somewhatlongerwords thoroughlyordinary password = \"{key(24)}\" é token:{key(24)}") for k in range(60)]
    rows += [(200, "é and the key " + key(24) + " stands alone"), (201, None), (None, ""), (202, "AKIA" + key(16)), (203, "secret=short token: 0123456789abcdef0"), (204, "thoroughlyordinary somewhatlongerwords"), (202, "AKIA" + "B" * 16)]
    got = {}
    for x in secrets.scan_secrets(frame(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append([(s.kind, s.start, s.end) for s in x.spans])
    assert [s for s in got[200][0]] == [("format", 14, 38)] and got[201] == [[]] and got[None] == [[]] and got[204] == [[]]
    assert sorted(got[202]) == [[("access", 0, 20)]] * 2
    for i, t in rows[:60] + [rows[64]]:
        want = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 12] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [s for s in got[i][0] if s[0] != "format"] == sorted(want, key=lambda s: s[1])


def test_an_automaton_is_a_distribution():
    made = secrets.Automaton([[0, 1, 0], [0, 1, 1], [0, 1, 0, 1], [2]] * 40)
    mass = {0: 1.0}
    ended = 0.0
    for _ in range(60):
        new = {}
        for q, m in mass.items():
            ended += m * np.exp(made.log_end[q])
            for c in range(len(secrets.CLASSES)):
                to = made.to[q, c]
                if to != len(made.to) - 1:
                    new[to] = new.get(to, 0) + m * np.exp(made.log[q, c] - secrets._share[c])
        mass = new
    assert 0.9 < ended < 1.0001
    assert secrets.digest is not None


def test_toxic_rows_that_were_held_out(spark, data):
    d, lab = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet")
    got = toxicity.toxicity_scores(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.4 and got[got.toxic == 0].predicted.mean() < 0.03
    got = got.sort_values("score", ascending=False)
    assert got.toxic.head(8).mean() > 0.8


def test_continuation_counts(spark):
    rows = [("a b a b c", 1), ("b a c", 2), ("a b", 8), ("", 1), ("c " * 50, 2)]
    counts = {x.w: x for x in toxicity.continuation_counts(spark.createDataFrame(rows, "text string, bit int")).collect()}
    want = {}
    for t, bit in rows:
        w = t.split()
        for v, x in zip(["^", *w], w, strict=False):
            want.setdefault(x, {}).setdefault(v, set()).add(bit)
    for x, ctx in want.items():
        got = counts[int(toxicity.hashed(x.encode()).view(np.int64)[0])]
        for name, bits in toxicity._STATS.items():
            assert got[name] == sum(any(b & bits for b in bit) for bit in ctx.values()), (x, name)


def test_scores_of_nothing(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(frame(spark, [(1, "a"), (None, None), (2, ""), (2, "b")]), labels).collect()
    assert len(got) == 4 and {x.score for x in got} == {0.5} and {x.predicted for x in got} == {0}
    assert toxicity.toxicity_scores(frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("targets", [(0.3, 0.3, 0.4), (0.05, 0.05, 0.9)])
def test_rates_are_those_of_a_plain_solver(spark, targets):
    r = np.random.default_rng(11)
    p, n = r.dirichlet((4, 2, 1), 200), r.integers(0, 300, 200)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    steps, shares = mixing.fitted_steps(df, np.array(targets))
    a, x = (n / n.sum())[:, None] * p, np.ones(200)
    for _ in range(100_000):
        x = np.maximum(0, x - p @ (x @ a - targets))
    assert abs(((shares - targets) ** 2).sum() - ((x @ a - targets) ** 2).sum()) < 1e-6
    rates = np.array([row.r for row in df.select(mixing.rate(F.col("p"), steps).alias("r")).collect()])
    assert (rates >= 0).all() and np.allclose(rates @ a, shares)
    # at an optimum no rate can move along the gradient: it is nonnegative, and nothing where a rate is positive
    g = p @ (shares - targets)
    assert (g[n > 0] > -2e-3).all() and (np.abs(g[(rates > 1e-9) & (n > 0)]) < 0.02).all()


def test_mixing_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(k, ("good fine " if k % 2 else "bad poor ") * 5 + f"w{k}") for k in range(60)] + [(3, None), (None, ""), (5, "x")]
    got = mixing.mixing_rates(frame(spark, rows), mixing.quality_domains(labels), {"high": 0.5, "low": 0.5}, keep=("text", "p", "n"))
    assert got.columns == ["doc_id", "text", "p", "n", "n_tokens", "p_high", "p_low", "rate", "distance"] and got.count() == 63
    s = got.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col("p_high")) / F.sum("n_tokens")).first()[0]
    assert abs(s - 0.5) < 1e-4
    assert mixing.mixing_rates(frame(spark, []), mixing.quality_domains(labels), {"high": 1.0, "low": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mixing_rates(frame(spark, rows), mixing.quality_domains(labels), {"high": -1.0})


def test_exact_groups(spark):
    got = exact_dedup(frame(spark, [(3, "a b"), (2, "ab"), (9, None), (8, " "), (7, "c")]), digest_all=True).collect()
    assert sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in got) == [(2, 3, 2, False), (3, 3, 2, True), (7, 7, 1, True), (8, 8, 2, True), (9, 8, 2, False)]


@pytest.mark.parametrize("made", [remove_repeated_bytes, remove_repeated_words, near_duplicates, exact_dedup, pii.sanitise, secrets.scan_secrets])
def test_empty_tables(spark, made):
    assert made(frame(spark, [])).count() == 0
