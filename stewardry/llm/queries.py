"""The corpus operators' queries: production parameters, whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import dataset_queries, pii, secrets
from stewardry.llm.decontaminate import benchmark_hits
from stewardry.llm.exact_dedup import exact_dedup
from stewardry.llm.jaccard import near_duplicates
from stewardry.llm.mixing import MIX, mixing_rates, quality_domains
from stewardry.llm.suffix_array import remove_repeated_bytes
from stewardry.llm.suffix_tree import remove_repeated_words
from stewardry.llm.toxicity import toxicity_scores
from stewardry.llm.url_rules import judge_urls
from stewardry.session import ship, table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing_rates(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")), MIX)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's digest column covers texts that length or prefix told apart as well
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OPS = (op1_suffix_dedup, op2_mixing, op3_decontaminate, op4_secrets, op5_pii, op6_url_rules, op7_jaccard_join, op8_toxicity, op9_exact_dedup, op10_substring_dedup)
QUERIES = {f.__name__: f for f in _OPS} | dataset_queries.QUERIES


ORACLES = {
    "op1_suffix_dedup": r"""
with t as (select doc_id, encode(coalesce(text, '')) as b from documents),
h as (select doc_id, hex(b) as x, octet_length(b) as n from t),
win as (select doc_id, s, substr(x, 2 * s + 1, 100) as w from (select doc_id, x, unnest(range(0, n - 49)) as s from h where n >= 50)),
marked as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by w) as first from win) where first < doc_id),
runs as (select doc_id, min(s) as a, max(s) + 50 as z from (select doc_id, s, sum(new) over (partition by doc_id order by s) as g from (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 50 then 0 else 1 end as new from marked)) group by doc_id, g),
ordered as (select *, lag(z, 1, 0) over (partition by doc_id order by a) as before from runs),
cut as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans, string_agg(substr(x, cast(2 * before + 1 as bigint), cast(2 * (a - before) as bigint)), '' order by a) as head, max(z) as last from ordered join h using (doc_id) group by doc_id)
select h.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(head || substr(x, cast(2 * last + 1 as bigint)), x))) as kept_sha256
from h left join cut using (doc_id)
""",
    "op10_substring_dedup": r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, array_to_string(w[s : s + 49], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from t where len(w) >= 50)),
marked as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by x) as first from win) where first < doc_id),
gone as (select doc_id, list(distinct k) as ks from (select doc_id, unnest(range(s, s + 50)) as k from marked) group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ks), 0) as bigint) as n_removed,
  sha256(array_to_string(case when ks is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(ks, i)] end, ' ')) as kept_sha256
from t left join gone using (doc_id)
""",
    "op3_decontaminate": r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_windows as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)
), lengths as (select distinct m from item_windows),
doc_windows as (
  select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from doc_words, lengths where len(w) >= m)
), hits as (select doc_id, i, d.m, item_id from doc_windows d join item_windows b on d.win = b.win and d.m = b.m),
hit_words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from hits) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words using (doc_id) left join hit_items using (doc_id)
""",
    "op6_url_rules": r"""
with parts as (
  select page_id, case when url is null or position('://' in url) = 0 then '' else regexp_extract(substr(url, position('://' in url) + 3), '^[^?#]*') end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from parts
), rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select s.page_id, host, path, rule, coalesce(v, 'allow') as verdict from split s left join best using (page_id)
""",
    "op7_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as inter from g a join g b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * inter >= 85 * (na.n + nb.n - inter)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, coalesce(any_value(n), 0) as n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) as component_id, coalesce(any_value(c.n_links), 0) as n_links
from w left join n using (doc_id) left join reach on reach.a = w.doc_id left join (select a, count(*) as n_links from links group by a) c on c.a = w.doc_id group by w.doc_id
""",
    "op9_exact_dedup": r"""
with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = first_value(doc_id) over (partition by norm order by n desc, doc_id) as kept, sha256(norm) as text_sha256 from t
""",
}
ORACLES |= dataset_queries.ORACLES
