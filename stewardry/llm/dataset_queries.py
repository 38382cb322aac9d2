"""Queries of the operators on whole datasets: manifest, extraction and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm.extract import extract_main_text
from stewardry.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest
from stewardry.llm.resample import resample
from stewardry.session import ship, table


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, and which of its rows still fold to the root after some texts were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.when(tampered, lowered).otherwise(F.col("text")))
    made = merkle_manifest(docs, carry={"now": now})
    told = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("now"), F.col("steps")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 9) -> str:
    """Trees of up to 8 ** levels leaves a group. n: nodes of a level; what a node takes along while it goes up is its leaf's."""
    def climb(name: str, first: str, key: str) -> str:
        # a0: every leaf with its digest (and its tampered one), its place and its siblings so far; each level replaces the digests by those of the run
        parts = [f"{name}0 as ({first})"]
        for k in range(levels):
            parts.append(
                f"{name}d{k} as (select {key}, i, any_value(size) as size, any_value(d) as d from {name}{k} group by {key}, i), "
                f"{name}r{k} as (select {key}, i // 8 as p, list(d order by i) as run from {name}d{k} where size > 1 group by {key}, i // 8), "
                f"{name}{k + 1} as (select a.{key}, a.leaf_key, case when r.run is null then a.i else a.i // 8 end as i, case when r.run is null then a.size else (a.size + 7) // 8 end as size, "
                "case when r.run is null then a.d else sha256(array_to_string(r.run, '')) end as d, "
                "case when r.run is null then a.proof else a.proof || array_to_string(r.run[1 : a.i % 8] || r.run[a.i % 8 + 2 : 8], '') end as proof, "
                "case when r.run is null then a.f else sha256(array_to_string(r.run[1 : a.i % 8], '') || a.f || array_to_string(r.run[a.i % 8 + 2 : 8], '')) end as f "
                f"from {name}{k} a left join {name}r{k} r on a.{key} is not distinct from r.{key} and a.i // 8 = r.p)"
            )
        return ", ".join(parts)

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    told = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(told, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::ubigint], flatten([[ascii(x)::ubigint, 0, 0, 0, 0, 0, 0, 0] for x in string_split(cast(doc_id as varchar), '')])), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"
    first = f"select lang, doc_id as leaf_key, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as size, {leaf('text')} as d, '' as proof, case when {crc} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as f from documents"
    tops = f"select 0 as one, lang as leaf_key, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as size, d, '' as proof, d as f from (select lang, any_value(d) as d from a{levels} group by lang)"
    # the second tree is folded with each leaf's own subroot: from the top's siblings, taken per level
    steps = ", ".join(f"s{k} as (select a.leaf_key, array_to_string(r.run[1 : a.i % 8], '') as l, array_to_string(r.run[a.i % 8 + 2 : 8], '') as r from t{k} a join tr{k} r on a.i // 8 = r.p)" for k in range(3))
    fold = "a.f"
    for k in range(3):
        fold = f"case when s{k}.l is null then {fold} else sha256(s{k}.l || {fold} || s{k}.r) end"
    return f"""
with {climb('a', first, 'lang')}, {climb('t', tops, 'one')}, {steps},
done as (select a.leaf_key as doc_id, a.lang, a.d as subroot, t.d as root, sha256(a.proof || t.proof) as proof_sha256, {fold} as folded_root
  from a{levels} a join t{levels} t on a.lang is not distinct from t.leaf_key {' '.join(f'left join s{k} on a.lang is not distinct from s{k}.leaf_key' for k in range(3))})
select doc_id, a0.d as leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from done join a0 on done.doc_id = a0.leaf_key
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is linear: each byte counts by itself, told by its value and the number of bytes behind it; zeros gives the rest by length.
_CRC_SQL = """
bytes0(b, k, c) as (select b, 0, cast(b as ubigint) from range(256) r(b) union all select b, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from bytes0 where k < 8),
one as (select b, c from bytes0 where k = 8),
behind(j, b, c) as (select 0, b, c from one union all select j + 1, s.b, xor(s.c >> 8, one.c) from behind s join one on one.b = (s.c & 255) where j < (select max(octet_length(encode(x))) from distinct_features)),
zeros(n, c) as (select 0, cast(4294967295 as ubigint) union all select n + 1, xor(z.c >> 8, one.c) from zeros z join one on one.b = (z.c & 255) where n < (select max(octet_length(encode(x))) from distinct_features))"""

_RESAMPLE_SQL = r"""
with recursive texts as (select 'd' as side, doc_id as id, coalesce(text, '') as x from documents union all select 't', item_id, coalesce(text, '') from benchmark),
w as (select side, id, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as (select side, id, x, count(*) as n from (select side, id, array_to_string(w[i : i + k - 1], ' ') as x from (select side, id, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 4) t(k) where len(w) >= k)) group by all),
distinct_features as (select distinct x from f),""" + _CRC_SQL + r""",
hashed as (select x, xor(xor(any_value(z.c), 4294967295), bit_xor(s.c)) % 10000 as bucket
  from (select x, e, n, unnest(range(n)) as i from (select x, hex(encode(x)) as e, octet_length(encode(x)) as n from distinct_features)) q
  join behind s on s.j = n - 1 - i and s.b = (instr('0123456789ABCDEF', e[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', e[2 * i + 2]) - 1
  join zeros z on z.n = q.n group by x),
b as (select side, id, bucket, sum(n) as n from f join hashed using (x) group by all),
g as (select bucket, cast(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) as bigint) as gain
  from (select bucket, cast(s as double) as s, cast(t as double) as t, sum(s) over () as ss, sum(t) over () as tt from (select bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 't'), 0) as t from b group by bucket))),
weights as (select id, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from b join g using (bucket) where side = 'd' group by id),
scored as (select w.id as doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('42:' || w.id)[1:8] as bigint) + 0.5) / 4294967296))) as bigint) as score
  from w left join weights using (id) where side = 'd'),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where words >= 20)
select doc_id, n_features, weight, score, r as rank from scored left join (select * from ranked where r <= 5 * n // 100) using (doc_id)
"""

def op12_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extract_main_text(table(spark, sf_dir, "pages"))


#: What the labeller has to find on the given pages, whose articles are marked as such; it is told nothing of that.
_ARTICLE_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') as body from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) as parts from a),
c as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as parts from b)
select page_id, url, text, length(text) as n_chars from (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) as text from c)
"""

QUERIES = {f.__name__: f for f in (op11_merkle, op12_extract, op13_resample)}
ORACLES = {"op11_merkle": _merkle_sql(), "op12_extract": _ARTICLE_SQL, "op13_resample": _RESAMPLE_SQL}
