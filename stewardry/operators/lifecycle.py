"""Lifecycles of records, schema versions, snapshots and transfers: transition tables and set-at-a-time plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.functions.seal import MASK
from stewardry.functions.transforms import object_references, stable_handle
from stewardry.operators.ledger import latest_per_key
from stewardry.session import written

#: The steps that there are.
RECORD_STEPS = {"draft": ("in_review",), "in_review": ("published", "rejected", "draft"), "published": ("archived",), "rejected": ("draft",), "archived": ("published",)}
VERSION_STEPS = {"draft": ("preview", "canary", "active"), "preview": ("canary", "active", "rolled_back"), "canary": ("active", "rolled_back"), "active": ("superseded", "rolled_back"), "superseded": ("active",)}
TRANSFER_STATES = ("connected", "mirrored", "augmented", "controlled", "primary", "draining", "retired")
#: What a transfer must have passed before a state.
TRANSFER_GATES = {"controlled": ("data", "authority"), "primary": ("data", "authority", "rollback"), "retired": ("data", "dependencies", "authority", "rollback", "sign_off")}
MOST_PARENTS = 32


def _allowed(state: Column, to: Column, steps: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(False)
    for s, targets in steps.items():
        out = F.when(state == s, to.isin(list(targets))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def transition(requests: DataFrame, records: DataFrame, steps: Mapping[str, Sequence[str]], self_approval: bool = False) -> DataFrame:
    """(record, outcome, state) of requests (record, to, actor, at) on records (record, state, author).

    Of several requests for a record the first counts, the others are late. not_found; refused: there is no such step;
    self_approval: an author may not publish or reject what they wrote; else done.
    """
    first = requests.groupBy(F.col("record").alias("__r")).agg(F.min(F.struct("at", "actor", "to")).alias("__first"))
    met = requests.join(first, F.col("record") == F.col("__r")).join(records.select(F.col("record").alias("__k"), "state", "author"), F.col("record") == F.col("__k"), "left")
    late = F.struct("at", "actor", "to") != F.col("__first")
    own = F.lit(not self_approval) & F.col("to").isin("published", "rejected") & F.col("actor").eqNullSafe(F.col("author"))
    outcome = F.when(F.col("__k").isNull(), "not_found").when(late, "late").when(~_allowed(F.col("state"), F.col("to"), steps), "refused").when(own, "self_approval").otherwise("done")
    out = met.withColumn("outcome", outcome)
    return out.select("record", "actor", "outcome", F.when(F.col("outcome") == "done", F.col("to")).otherwise(F.col("state")).alias("state"))


def opened_drafts(asked: DataFrame, drafts: DataFrame) -> DataFrame:
    """(record, actor, outcome): one draft of a record is in flight at a time; of several who ask at once the first by time, then actor, gets it."""
    busy = drafts.where(F.col("state").isin("draft", "in_review")).select(F.col("record").alias("__b")).distinct()
    first = asked.groupBy(F.col("record").alias("__r")).agg(F.min(F.struct("at", "actor")).alias("__first"))
    met = asked.join(first, F.col("record") == F.col("__r")).join(busy, F.col("record") == F.col("__b"), "left")
    return met.select("record", "actor", F.when(F.col("__b").isNotNull() | (F.struct("at", "actor") != F.col("__first")), "in_flight").otherwise("opened").alias("outcome"))


def resolve_versions(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """(request, version, outcome) of asked (request, object, status, cohorts) over versions (object, version, status, cohort).

    A canary or preview is for its cohort only: others are forbidden. Without a status the active version, else the base one (base).
    """
    wanted = versions.select(F.col("object").alias("__o"), "version", F.col("status").alias("__s"), "cohort")
    met = asked.join(wanted, (F.col("object") == F.col("__o")) & (F.coalesce("status", F.lit("active")) == F.col("__s")), "left")
    gated = F.col("__s").isin("canary", "preview") & ~F.coalesce(F.array_contains("cohorts", F.col("cohort")), F.lit(False))
    outcome = F.when(F.col("__o").isNull(), F.when(F.col("status").isNull(), "base").otherwise("no_version")).when(gated, "forbidden").otherwise("version")
    return met.select("request", F.when(outcome == "version", F.col("version")).alias("version"), outcome.alias("outcome"))


def effective_fields(versions: DataFrame, fields: DataFrame) -> DataFrame:
    """(version, field, type): a version's own fields (version, field, type) and those of its parents (version, parent), the nearest first."""
    chain = versions.select("version", F.col("version").alias("at"), F.lit(0).alias("far"))
    every, parents = chain, written(versions.select(F.col("version").alias("__v"), "parent").where("parent is not null"))
    for k in range(1, MOST_PARENTS + 2):
        chain = written(chain.join(parents, F.col("at") == F.col("__v")).select("version", F.col("parent").alias("at"), F.lit(k).alias("far")))
        if not chain.limit(1).count():
            break
        if k > MOST_PARENTS:
            raise ValueError(f"a version has more than {MOST_PARENTS} parents")
        every = every.unionByName(chain)
    met = every.join(fields.withColumnRenamed("version", "__f"), F.col("at") == F.col("__f"))
    return met.groupBy("version", "field").agg(F.min_by("type", F.struct("far", "type")).alias("type"))


def version_diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("field",), value: str = "type") -> DataFrame:
    """(keys, change): added, removed, changed."""
    # as one column a null of a key meets a null
    key = F.struct(*keys).alias("__key")
    a, b = before.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), after.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    change = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, "__key", "full").select("__key.*", change.alias("change")).where("change is not null")


def rolled_back(versions: DataFrame, objects: DataFrame) -> DataFrame:
    """Versions (object, version, parent, status) after the active ones of `objects` (object) are rolled back: their parents are active again. Without a parent nothing changes."""
    gone = versions.where("status = 'active' and parent is not null").join(objects.select("object").distinct(), "object", "left_semi").select(F.col("object").alias("__o"), F.col("version").alias("__v"), F.col("parent").alias("__p"))
    met = versions.join(gone, F.col("object") == F.col("__o"), "left")
    status = F.when(F.col("version") == F.col("__v"), "rolled_back").when(F.col("version") == F.col("__p"), "active").otherwise(F.col("status"))
    return met.select("object", "version", "parent", status.alias("status"))


#: Kinds of a snapshot's rows in the order in which they are applied.
SNAPSHOT_ORDER = {"object": 0, "field": 1, "policy": 2}


def snapshot_plan(base: DataFrame, target: DataFrame, base_format: int, target_format: int, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(operations in order, refusals) that turn one snapshot into another; additive only.

    Snapshots are rows (kind: object, field or policy; object; name; value); an object's value is the object it adopts, or null.
    Operations: (step, operation, kind, object, name, value); an object comes after the one it adopts, fields after all objects,
    policies last. Refusals: (reason, kind, object, name): downgrade, of an older format; removed and type_changed, which aren't additive;
    drift: the base is no longer what the plan was made from (`seen`); unknown_object; cycle.
    """
    key = ["kind", "object", "name"]
    diff = version_diff(base, target, key, "value")
    policies = F.col("kind") == "policy"
    refused = diff.where((F.col("change") == "removed") | ((F.col("change") == "changed") & ~policies)).select(F.when(F.col("change") == "removed", "removed").otherwise("type_changed").alias("reason"), *key)
    if target_format < base_format:
        refused = refused.unionByName(target.where("kind = 'object'").select(F.lit("downgrade").alias("reason"), *key))
    if seen is not None:
        refused = refused.unionByName(version_diff(seen, base, key, "value").select(F.lit("drift").alias("reason"), *key))
    new = diff.where((F.col("change") == "added") | ((F.col("change") == "changed") & policies)).select(F.struct(*key).alias("__key"))
    added = written(target.withColumn("__key", F.struct(*key)).join(new, "__key", "left_semi").drop("__key"))
    # objects level by level: one is ready when what it adopts is there
    there = base.where("kind = 'object'").select(F.col("object").alias("__there"))
    todo, placed = written(added.where("kind = 'object'")), None
    for level in range(MOST_PARENTS + 1):
        met = todo.join(there, F.col("value") == F.col("__there"), "left")
        ready = written(met.where("value is null or __there is not null").select(*todo.columns).withColumn("step", F.lit(level)))
        if not ready.limit(1).count():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        there = there.unionByName(ready.select(F.col("object").alias("__there")))
        todo = written(todo.join(ready.select("object"), "object", "left_anti"))
    known = target.where("kind = 'object'").select(F.col("object").alias("__k"))
    lost = todo.join(known, F.col("value") == F.col("__k"), "left").select(F.when(F.col("__k").isNull(), "unknown_object").otherwise("cycle").alias("reason"), *key)
    owners = base.where("kind = 'object'").select("object").unionByName(target.where("kind = 'object'").select("object")).distinct()
    rest = added.where("kind <> 'object'")
    stray = rest.join(owners, "object", "left_anti").select(F.lit("unknown_object").alias("reason"), *key)
    later = rest.join(owners, "object", "left_semi").withColumn("step", F.lit(MOST_PARENTS) + F.when(policies, 2).otherwise(1))
    every = later if placed is None else placed.unionByName(later)
    operation = F.when(F.col("kind") == "object", F.when(F.col("value").isNull(), "CreateObject").otherwise("AdoptObject")).when(F.col("kind") == "field", "AddField").otherwise("SetRowPolicy")
    return every.select("step", operation.alias("operation"), *key, "value"), refused.unionByName(lost).unionByName(stray)


def snapshot_applied(base: DataFrame, operations: DataFrame) -> DataFrame:
    """The base after the operations of a plan; later values of a policy replace earlier ones."""
    new = operations.select("kind", "object", "name", "value")
    kept = base.join(new.select(F.col("kind").alias("__k"), F.col("object").alias("__o"), F.col("name").alias("__n")), (F.col("kind") == F.col("__k")) & (F.col("object") == F.col("__o")) & F.col("name").eqNullSafe(F.col("__n")), "left_anti")
    return kept.unionByName(new)


def canonical_digest(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, digest) of a snapshot's canonical JSON: objects with keys in order, in the order of their texts."""
    told = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return rows.groupBy(by).agg(F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(told)), ","), F.lit("]")), 256).alias("digest"))


def stale_drafts(drafts: DataFrame, at: Column, days: int, hold: bool = False) -> DataFrame:
    """Drafts untouched for so many days; a legal hold stops the purge."""
    return drafts.where(~F.lit(hold) & (F.col("state") == "draft") & (F.col("updated_at") < F.timestamp_add("DAY", F.lit(-days), at)))


def orphans(versions: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Versions whose record is no more."""
    return versions.join(records.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def orphan_sweep(files: DataFrame, references: DataFrame, at: Column, grace_hours: int) -> DataFrame:
    """Files (file, stored_at) that nothing refers to, older than a grace."""
    free = files.join(references.select(F.col("file").alias("__f")), F.col("file") == F.col("__f"), "left_anti")
    return free.where(F.col("stored_at") < F.timestamp_add("HOUR", F.lit(-grace_hours), at))


def retention_split(rows: DataFrame, ts: str, at: Column, days: int, hold: Column) -> DataFrame:
    """(kept, expired, held) counts: rows older than so many days expire unless they are held."""
    old = F.col(ts).cast("timestamp") < F.timestamp_add("DAY", F.lit(-days), at)
    return rows.agg(F.count_if(~old).alias("kept"), F.count_if(old & ~hold).alias("expired"), F.count_if(old & hold).alias("held"))


def authority_matrix(matrix: DataFrame, changes: DataFrame, key: str, at: Column) -> DataFrame:
    """The matrix (key, authority, version, superseded_at) with changes (key, authority): the row in force is superseded and one of the next version added; a change to what holds already changes nothing. Of several changes of a key the last by name counts."""
    last = changes.groupBy(key).agg(F.max("authority").alias("__new"))
    held = matrix.where("superseded_at is null").select(F.col(key).alias("__k"), F.col("authority").alias("__held"), F.col("version").alias("__v"))
    real = written(last.join(held, F.col(key) == F.col("__k"), "left").where(~F.col("__held").eqNullSafe(F.col("__new"))))
    marked = matrix.join(real.select(F.col(key).alias("__c")), F.col(key) == F.col("__c"), "left")
    old = marked.withColumn("superseded_at", F.when(F.col("superseded_at").isNull() & F.col("__c").isNotNull(), at).otherwise(F.col("superseded_at"))).select(*matrix.columns)
    new = real.select(key, F.col("__new").alias("authority"), (F.coalesce("__v", F.lit(0)) + 1).cast(matrix.schema["version"].dataType).alias("version"), F.lit(None).cast("timestamp").alias("superseded_at"))
    return old.unionByName(new)


def transfer_steps(asked: DataFrame, transfers: DataFrame, gates: DataFrame) -> DataFrame:
    """(transfer, outcome, missing) of asked (transfer, to) over transfers (transfer, state) and gates passed (transfer, gate).

    One state forward at a time, or back to any earlier one before retirement; forward into a state with gates only when all have been passed.
    """
    order = F.create_map(*[F.lit(x) for k, s in enumerate(TRANSFER_STATES) for x in (s, k)])
    need = F.lit(None).cast("array<string>")
    for state, needed in TRANSFER_GATES.items():
        need = F.when(F.col("to") == state, F.array(*map(F.lit, needed))).otherwise(need)
    passed = gates.groupBy(F.col("transfer").alias("__g")).agg(F.collect_set("gate").alias("__passed"))
    met = asked.join(transfers.select(F.col("transfer").alias("__t"), "state"), F.col("transfer") == F.col("__t"), "left").join(passed, F.col("transfer") == F.col("__g"), "left")
    far = F.try_element_at(order, F.col("to")) - F.try_element_at(order, F.col("state"))
    missing = F.array_sort(F.array_except(F.coalesce(need, F.array().cast("array<string>")), F.coalesce("__passed", F.array().cast("array<string>"))))
    back = (far < 0) & (F.col("state") != "retired")
    outcome = F.when(F.col("__t").isNull(), "not_found").when(far.isNull() | (far == 0) | (far > 1) | ((far < 0) & ~back), "refused").when((far == 1) & (F.size(missing) > 0), "gated").otherwise("done")
    return met.select("transfer", outcome.alias("outcome"), F.when(outcome == "gated", F.array_join(missing, ",")).alias("missing"))


def retirement_blockers(references: DataFrame, system: str) -> DataFrame:
    """What still refers to an external system, in order; none: it may be retired."""
    return references.where(F.col("system") == system).orderBy("object", "field")


def valid_grants(grants: DataFrame, at: Column) -> DataFrame:
    """Grants in force: begun, not expired, not revoked, and not used up."""
    return grants.where((F.col("begins_at") <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") > at)) & F.col("revoked_at").isNull() & (F.col("max_uses").isNull() | (F.col("uses") < F.col("max_uses"))))


def resolve_handles(texts: DataFrame, handles: DataFrame, key: str, mentions: Column) -> DataFrame:
    """(key, actor) of all handles that a text mentions, of the text's own organisation: texts (key, org), handles (org, handle, actor)."""
    said = texts.select(F.col(key), F.col("org"), F.explode(mentions).alias("handle"))
    known = handles.select(F.col("org").alias("__o"), F.lower("handle").alias("__h"), "actor")
    return said.join(known, (F.col("org") == F.col("__o")) & (F.lower("handle") == F.col("__h"))).select(key, "actor").distinct()


def disclosed(disclosures: DataFrame, at: Column) -> DataFrame:
    """(thread, actor) whose name may be shown: the latest decision on them is a grant that hasn't expired. A null thread means all threads."""
    last = latest_per_key(disclosures.select("thread", "actor", "decided_at", "granted", "expires_at"), ["thread", "actor"], ["decided_at", "granted"])
    return last.where(F.col("granted") & (F.col("expires_at").isNull() | (F.col("expires_at") > at))).select("thread", "actor")


def unfurled(messages: DataFrame, cards: Mapping[str, DataFrame], scheme: str, names: DataFrame, shown: DataFrame, viewer: str) -> tuple[DataFrame, DataFrame]:
    """(messages with the author as the viewer may see them, cards of what they refer to).

    messages: (message, thread, author, body). Cards: {slug: governed rows with __id}, each under the viewer's own projection and
    policies of that object, so that a hidden record gives no card; references are those of the raw body, also where that is hidden.
    Cards come as (message, slug, id, card: JSON), one for each reference, all messages' at once. names: (actor, name); shown: as disclosed.
    """
    refs = messages.select("message", F.explode(object_references(F.col("body"), scheme)).alias("ref"))
    parts = F.split("ref", ":")
    refs = written(refs.select("message", F.get(parts, F.lit(1)).alias("slug"), F.get(parts, F.lit(2)).alias("id")))
    out = None
    for slug, rows in cards.items():
        fields = [F.col(f"`{c}`").alias(c) for c in rows.columns if c != "__id"]
        told = rows.select(F.col("__id").cast("string").alias("__key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("card"))
        met = refs.where(F.col("slug") == slug).join(told, F.col("id") == F.col("__key")).select("message", "slug", "id", "card")
        out = met if out is None else out.unionByName(met)
    told = shown.where("thread is not null").select(F.col("thread").alias("__t"), F.col("actor").alias("__a"), F.lit(True).alias("__here"))
    everywhere = shown.where("thread is null").select(F.col("actor").alias("__e")).distinct()
    met = messages.join(names.select(F.col("actor").alias("__n"), "name"), F.col("author") == F.col("__n"), "left")
    met = met.join(told, (F.col("thread") == F.col("__t")) & (F.col("author") == F.col("__a")), "left").join(everywhere, F.col("author") == F.col("__e"), "left")
    known = (F.col("author") == viewer) | F.col("__here").isNotNull() | F.col("__e").isNotNull()
    return met.select("message", F.when(known, F.coalesce("name", stable_handle(F.col("author")))).otherwise(stable_handle(F.col("author"))).alias("author"), "body"), out


def support_read(rows: DataFrame, sensitive: Sequence[str], sessions: DataFrame, org: str, at: Column) -> DataFrame:
    """What a support session of an organisation sees: its rows with sensitive columns masked, nothing without a session in force (org, expires_at)."""
    live = sessions.where(F.col("expires_at") > at).select(F.col("org").alias("__o")).distinct()
    seen = rows.join(live, F.col(org) == F.col("__o"), "left_semi")
    return seen.withColumns({c: F.when(F.col(c).isNotNull(), MASK) for c in sensitive})


def rehearsal(core: DataFrame, sealed: DataFrame) -> DataFrame:
    """(backup, compatible, detail) of restore manifests (backup, window_start, window_end, watermark) of the core and of the sealed store: their windows must overlap, and the sealed one reach the core's watermark."""
    b = sealed.select(F.col("backup").alias("__b"), F.col("window_start").alias("__s"), F.col("window_end").alias("__e"))
    met = core.join(b, F.col("backup") == F.col("__b"), "left")
    overlap = F.coalesce((F.col("window_start") < F.col("__e")) & (F.col("__s") < F.col("window_end")), F.lit(False))
    covered = F.coalesce(F.col("__e") >= F.col("watermark"), F.lit(False))
    return met.select("backup", (overlap & covered).alias("compatible"), F.when(~overlap, "windows apart").when(~covered, "watermark not covered").otherwise("fits").alias("detail"))


def reference_split(references: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """References with whether what they refer to has been restored; those that aren't must fail closed."""
    there = restored.select(F.col(key).alias("__k")).distinct()
    return references.join(there, F.col(key) == F.col("__k"), "left").withColumn("state", F.when(F.col("__k").isNull(), "orphan").otherwise("available")).drop("__k")


def erased(tables: Mapping[str, tuple[DataFrame, str]], gone: DataFrame, key: str, at: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the rows of erased records, (table, record, rows, erased_at) as the proof of it). tables: {name: (rows, column of the record)}."""
    ids = written(gone.select(F.col(key).cast("string").alias("__gone")).distinct())
    kept, proof = {}, None
    for name, (rows, column) in tables.items():
        same = F.col(column).cast("string") == F.col("__gone")
        kept[name] = rows.join(ids, same, "left_anti")
        lost = rows.join(ids, same).groupBy(F.col("__gone").alias("record")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "record", "rows", at.alias("erased_at"))
        proof = lost if proof is None else proof.unionByName(lost)
    return kept, proof


def release_pointers(pointers: DataFrame, releases: DataFrame, acts: DataFrame) -> DataFrame:
    """(profile, release, previous, outcome) after acts (profile, act, release): `release` moves a profile's pointer to a published release and remembers the one before; `rollback` goes back to that, once."""
    known = releases.where("published").select(F.col("profile").alias("__p"), F.col("release").alias("__r"))
    held = pointers.select("profile", F.col("release").alias("__now"), F.col("previous").alias("__before"))
    met = acts.join(held, "profile", "left").join(known, (F.col("profile") == F.col("__p")) & (F.col("release") == F.col("__r")), "left")
    forward = F.col("act") == "release"
    outcome = F.when(forward & F.col("__r").isNull(), "not_published").when(forward & F.col("__now").eqNullSafe(F.col("release")), "unchanged").when(forward, "released").when(F.col("__before").isNull(), "nothing_before").otherwise("rolled_back")
    met = met.withColumn("outcome", outcome)
    now = F.when(F.col("outcome") == "released", F.col("release")).when(F.col("outcome") == "rolled_back", F.col("__before")).otherwise(F.col("__now"))
    before = F.when(F.col("outcome") == "released", F.col("__now")).when(F.col("outcome") == "rolled_back", F.lit(None)).otherwise(F.col("__before"))
    return met.select("profile", now.alias("release"), before.alias("previous"), "outcome")


def published_apps(apps: DataFrame, versions: DataFrame) -> DataFrame:
    """(app, version) of apps and their latest published version."""
    last = versions.where("status = 'published'").groupBy(F.col("app").alias("__a")).agg(F.max("version").alias("version"))
    return apps.join(last, F.col("app") == F.col("__a")).select("app", "version")
