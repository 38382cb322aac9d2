"""Personal data: base patterns, and information-theoretic sanitisation of what gives protected entities away. Built-in functions only.

An entity is a value that a base pattern finds. A term reveals one when, over all different texts, the pointwise mutual information of the
two is nearly the entity's own information: whoever reads the term knows the entity. Terms and entities that occur in the same texts
are counted as one, by a signature of those texts, so that a text with many of both gives one pair rather than all. Terms
that reveal are spans of kind `term`; `redacted` generalises base spans and removes terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stewardry.llm.tables import bitmap, bits_for, in_bitmap, kept_rows, text_key, written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; possessive, and begun only where a run begins or a match has ended, which finds the same without trying every place of a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
_MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){16}", "phone": r"\+[0-9]"}
#: Terms: letters, three and more. A term reveals an entity from so large a share of its information, met together in so many different texts.
TERM, SHARE, TOGETHER = r"\p{L}{3,}", 0.9, 3
GENERAL = {"email": "[email]", "ip": "[address]", "card": "[number]", "phone": "[phone]"}


def _luhn(digits: Column) -> Column:
    """Whether a text of up to 19 digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(digits, k, F.lit(1)).cast("int") * F.when((n - k) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # a part of any length: without leading zeros it has three digits at most
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _matches(rows: DataFrame, kind: str, pattern: str, maybe: str | None) -> DataFrame:
    """(row, start, end, value) of all matches in rows (row, text): the k-th begins behind k matches and the k + 1 gaps before it."""
    if maybe is not None:
        rows = rows.where(F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(maybe))
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    told = rows.select("row", found.alias("v"), gaps.alias("g")).where(F.size("v") > 0).dropDuplicates(["row"])
    each = told.select("row", F.posexplode(F.arrays_zip("v", F.slice("g", 1, F.size("v")).alias("g"))).alias("k", "m")).select("row", "k", F.col("m.v").alias("value"), F.col("m.g").alias("gap"))
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn("end", end).select("row", (F.col("end") - size).alias("start"), "end", "value")


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of rows (row, text); the end is exclusive, in code points."""
    out = None
    for k, kind in enumerate(KINDS):
        found = _matches(rows, kind, PATTERNS[kind], _MAYBE[kind]).where(_valid(kind, F.col("value")))
        part = found.select("row", F.lit(k).alias("kind"), "start", "end", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _plain(text: Column) -> Column:
    """The text in lower case without anything that looks like an entity."""
    for kind in KINDS:
        maybe = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_MAYBE[kind])
        text = F.when(maybe, F.regexp_replace(text, PATTERNS[kind], " ")).otherwise(text)
    return F.lower(text)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_plain(text), F.lit(f"({TERM})"), F.lit(1)))


def revealing_terms(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(term: its hash) of terms that reveal an entity; rows (id, h, row, text) are all documents, spans their base spans.

    Copies of a text count once. A pair counts where the entity is met in TOGETHER texts and more with a term that is rare enough to tell it.
    """
    firsts = rows.select("id", "h", "row").dropDuplicates(["row"]).groupBy("h").agg(F.min("row").alias("first"))
    decided = rows.select("id", "h", "row").join(firsts.withColumnRenamed("h", "fh"), F.col("h") == F.col("fh")).select("id", "h", (F.col("row") == F.col("first")).alias("kept"))
    texts = kept_rows(rows.select("id", "text"), decided, "id", "text").select(text_key(F.col("text")).alias("d"), "text")
    n = rows.select("h").distinct().count()
    signature = [F.count("*").alias("n"), F.sum(F.xxhash64("d").cast("decimal(38,0)")).alias("s")]
    entities = written(spans.select(F.col("row.h").alias("d"), F.xxhash64("kind", "value").alias("e")).distinct())
    by_entity = entities.groupBy("e").agg(*signature).where(F.col("n") >= TOGETHER)
    told = entities.join(by_entity, "e").select("d", F.col("n").alias("ne"), F.col("s").alias("se")).distinct()
    told = written(told)
    most = told.agg(F.max(F.pow(F.col("ne"), F.lit(SHARE)) * F.pow(F.lit(float(max(n, 1))), F.lit(1 - SHARE))).alias("m")).first().m
    if most is None:
        return rows.where("false").select(F.xxhash64("text").alias("term"))
    words = texts.select("d", F.explode(_words(F.coalesce("text", F.lit("")))).alias("w")).select("d", F.xxhash64("w").alias("term"))
    rare = words.groupBy("term").agg(*signature).where(F.col("n").between(TOGETHER, int(most)))
    rare = written(rare.select("term", F.col("n").alias("nt"), F.col("s").alias("st")))
    # only texts that hold entities are looked through for pairs, and of their words only those rare enough
    bits = bits_for(told.count())
    near = texts.where(in_bitmap(F.xxhash64("d"), bitmap(told.select(F.xxhash64("d").alias("k")), bits), bits))
    held = near.select("d", F.explode(_words(F.coalesce("text", F.lit("")))).alias("w")).select("d", F.xxhash64("w").alias("term"))
    groups = held.join(rare, "term").select("d", "nt", "st").distinct()
    bound = F.pow(F.col("ne"), F.lit(SHARE)) * F.pow(F.lit(float(n)), F.lit(1 - SHARE))
    pairs = groups.join(told, "d").where(F.col("nt") <= bound).groupBy("nt", "st", "ne", "se").agg(F.count("*").alias("both"))
    # log(both * n / (nt * ne)) >= SHARE * log(n / ne)
    tells = (F.col("both") >= TOGETHER) & (F.log(F.col("both") * float(n) / (F.col("nt") * F.col("ne"))) >= SHARE * F.log(float(n) / F.col("ne")) - 1e-12)
    groups = pairs.where(tells).select(F.col("nt").alias("gn"), F.col("st").alias("gs")).distinct()
    return rare.join(groups, (F.col("nt") == F.col("gn")) & (F.col("st") == F.col("gs")), "left_semi").select("term")


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, (row, kind, start, end) of base and term spans)."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.struct("id", "h"))
    base = written(base_spans(rows))
    terms = written(revealing_terms(rows, base))
    bits = bits_for(terms.count())
    held = bitmap(terms.select(F.xxhash64("term").alias("k")), bits)
    words = rows.select("row", F.explode(_words(F.col("text"))).alias("w")).select("row", F.xxhash64("w").alias("t"))
    hits = written(words.where(in_bitmap(F.xxhash64("t"), held, bits)).join(terms, F.col("t") == F.col("term"), "left_semi").select("row").distinct())
    # positions are those of the words of the text itself, and only of texts that have one
    at = bits_for(hits.count())
    may = rows.where(in_bitmap(F.xxhash64("id", "h"), bitmap(hits.select(F.xxhash64("row.id", "row.h").alias("k")), at), at))
    said = _matches(may, "term", TERM, None).withColumn("t", F.xxhash64(F.lower("value")))
    met = said.join(terms, F.col("t") == F.col("term"), "left_semi").select("row", F.lit(len(KINDS)).alias("kind"), "start", "end")
    inside = base.select(F.col("row").alias("r"), F.col("start").alias("a"), F.col("end").alias("z"))
    # words within a base span are that span's
    free = met.join(inside, (F.col("row") == F.col("r")) & (F.col("start") < F.col("z")) & (F.col("a") < F.col("end")), "left_anti")
    return rows, base.select("row", "kind", "start", "end").unionByName(free)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, spans (kind, start, end) by kind, then start, in code points, the end exclusive.

    Kinds: email, ip, card, phone of the base patterns, and term. Null and empty texts have none. Repeated rows have the same spans; rows of one id and
    different texts their own. Other columns don't matter whatever their names; an empty table gives an empty result. Texts count whole.
    """
    rows, spans = _spans(docs, id_col, text_col)
    names = F.array(*map(F.lit, (*KINDS, "term")))
    each = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("s")).select(F.col("row").alias("r"), F.transform("s", lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    out = rows.select("row").join(each, F.col("row").eqNullSafe(F.col("r")), "left")
    return out.select(F.col("row.id").alias(id_col), F.coalesce("spans", F.array().cast(each.schema["spans"].dataType)).alias("spans"))


def digest(sanitised: DataFrame) -> DataFrame:
    """The spans told as counts, a digest of the base ones, and a text of all."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    others = [c for c in sanitised.columns if c != "spans"]
    return sanitised.select(*others, *[count(k) for k in KINDS], F.sha2(told(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with base spans generalised and revealing terms removed from their texts; all other columns and rows stay as they are."""
    _, spans = _spans(docs, id_col, text_col)
    # overlapping spans are one, told by its first kind
    line = W.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.when(F.col("start") < F.coalesce(reach, F.lit(-1)), 0).otherwise(1)).withColumn("g", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    merged = begun.groupBy("row", "g").agg(F.min("start").alias("a"), F.max("end").alias("z"), F.min("kind").alias("kind"))
    cuts = written(merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "z", "kind"))).alias("cuts")))
    general = F.array(*[F.lit(GENERAL[k]) for k in KINDS], F.lit(""))
    table = docs.select(F.struct(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h")).alias("__row"), F.struct("*").alias("__all"))
    met = table.join(cuts, F.col("__row").eqNullSafe(F.col("row")), "left")
    text = F.col(f"__all.`{text_col}`")
    before = lambda k: F.coalesce(F.get("cuts", k - 1)["z"], F.lit(0))
    kept = F.transform("cuts", lambda c, k: F.concat(F.substring(text, (before(k) + 1).cast("int"), (c["a"] - before(k)).cast("int")), F.get(general, c["kind"])))
    last = F.element_at("cuts", -1)["z"]
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), F.substring(text, (last + 1).cast("int"), F.length(text))))
    return met.select(*[new.alias(c) if c == text_col else F.col(f"__all.`{c}`").alias(c) for c in docs.columns])
