"""Duplicates and identities: incoming against stored, candidate pairs, decisions, ledgers of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import end_states, numbered
from .rounds import running, settled


def resolved(incoming: DataFrame, stored: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """create, return_existing or conflict for each incoming identity; the first of a batch is what the others meet."""
    w = Window.partitionBy(*keys).orderBy("seq")
    old = stored.select(*keys, F.col(digest).alias("stored_digest"))
    out = incoming.join(old, keys, "left").withColumn("first_digest", F.first(digest).over(w)).withColumn("place_", F.row_number().over(w))
    known = F.coalesce(F.col("stored_digest"), F.when(F.col("place_") > 1, F.col("first_digest")))
    return out.withColumn("resolution", F.when(known.isNull(), "create").when(known == F.col(digest), "return_existing").otherwise("conflict")).drop("place_", "first_digest", "stored_digest")


def candidate_classes(df: DataFrame, features: list[str], company: str = "company_id", id_: str = "id") -> DataFrame:
    """``company, class_id, id`` of what one company has more than once, equal in all features; a missing one counts as empty. The class is named by its
    smallest id: a class of n rows takes n rows and not n squared. Nothing is merged."""
    same = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in features]
    keyed = df.select(company, id_, F.sha2(F.to_json(F.array(*same)), 256).alias("key_"))
    classes = keyed.groupBy(company, "key_").agg(F.min(id_).alias("class_id"), F.max(id_).alias("last_")).where("class_id <> last_").drop("last_")
    return keyed.join(classes, [company, "key_"]).select(company, "class_id", id_)


def ordered_pair(a: str, b: str) -> tuple[Column, Column]:
    """The two ids of a pair, the smaller first, so that a pair has one form."""
    return F.least(a, b), F.greatest(a, b)


def unique_findings(constraints: DataFrame, forbidden: tuple[str, ...] = ("amount", "description", "dedupe_fingerprint", "occurred_on")) -> DataFrame:
    """Constraints (name, fields) that make what only looks alike unique."""
    bad = F.array_intersect("fields", F.array(*[F.lit(f) for f in forbidden]))
    return constraints.select("name", bad.alias("fields")).where(F.size("fields") > 0)


#: What a decision must say, and what it may decide.
REQUIRED = ("company_id", "candidate_id", "left_movement_id", "right_movement_id", "decision", "reason_code", "evidence_refs", "decided_by", "decided_at", "rule_version", "engine_release_id", "audit_event_id")
DECISIONS = ("open", "confirmed_same_event", "confirmed_distinct", "dismissed", "superseded")


def decision_findings(decisions: DataFrame, states: tuple[str, ...] = DECISIONS) -> DataFrame:
    """Decisions on pairs (decision_id, reverses_decision_id and the fields of ``REQUIRED``) with their findings: what is missing, ids out of order,
    deletions, and reversals that name no decision or another than the one before, or come from the person who took that."""
    w = Window.partitionBy("candidate_id").orderBy("decided_at", "decision_id")
    before, by = F.lag("decision_id").over(w), F.lag("decided_by").over(w)
    missing = [F.when(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0, f"missing_{c}") for c in REQUIRED]
    reverses = F.col("reverses_decision_id")
    return decisions.withColumn("findings", F.array_compact(F.array(
        *missing,
        F.when(~F.coalesce(F.col("decision").isin(*states), F.lit(False)), "decision_state"),
        F.when(F.col("left_movement_id") > F.col("right_movement_id"), "pair_order"),
        F.when(F.coalesce("physically_deletes_movement", F.lit(False)), "deletes_movement"),
        F.when(F.coalesce("deletes_source_evidence", F.lit(False)), "deletes_evidence"),
        F.when(before.isNotNull() & ~F.coalesce(reverses == before, F.lit(False)), "reversal_reference").when(before.isNull() & reverses.isNotNull(), "reversal_of_nothing"),
        F.when(by == F.col("decided_by"), "reversal_by_same_person"),
    )))


#: The states of a delivery and what leads from one to the next.
TRANSITIONS = {
    ("received", "claim"): "processing",
    ("processing", "succeed"): "succeeded",
    ("processing", "retryable_failure"): "retryable_failed",
    ("processing", "terminal_failure"): "terminal_failed",
    ("processing", "conflict"): "conflict",
    ("retryable_failed", "claim"): "processing",
}


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; an event that does not apply changes nothing."""
    out = state
    for (a, e), to in TRANSITIONS.items():
        out = F.when((state == a) & (event == e), F.lit(to)).otherwise(out)
    return out


STATES = ["received", "processing", "retryable_failed", "succeeded", "terminal_failed", "conflict"]


def folded(events: DataFrame, key: str) -> DataFrame:
    """The last state of each delivery from its events (seq, event, token), and how many of them were stale. An event with a token older than one before it comes from a
    worker whose lease is over and is passed by."""
    known = events.where(F.col(key).isNotNull()).select(F.to_json(F.array(F.col(key).cast("string"))).alias("k_"), F.col(key).alias("key_"), "seq", "event", "token")
    order = [F.col("seq"), F.col("event"), F.col("token")]
    leased = running(known, "k_", order, F.max, "token", F.greatest)
    stale = F.col("token") < F.greatest(F.coalesce("token_before", F.lit(0)), F.lit(0))
    marked = settled(numbered(leased.withColumn("stale", F.coalesce(stale, F.lit(False))), "k_", order))
    ends = end_states(marked.withColumn("event", F.when(~F.col("stale"), F.col("event"))), "k_", STATES, next_state)
    counts = marked.groupBy("k_").agg(F.first("key_").alias(key), F.count_if("stale").cast("int").alias("stale"))
    return ends.join(counts, "k_").select(key, "state", "stale")


def ledger_difference(events: DataFrame, observed: DataFrame, key: str = "ref") -> DataFrame:
    """References that the ledger (seq, action created or removed) says exist but nobody sees, and the other way round."""
    alive = events.groupBy(key).agg(F.max_by("action", "seq").alias("action")).where("action = 'created'").select(key, F.lit(True).alias("in_ledger"))
    both = alive.join(observed.select(key, F.lit(True).alias("in_store")).distinct(), key, "full_outer")
    return both.where("in_ledger IS NULL OR in_store IS NULL").select(key, F.when(F.col("in_ledger").isNull(), "unrecorded").otherwise("missing").alias("difference"))


def scoped(df: DataFrame, company: str | None, column: str = "company_id") -> DataFrame:
    """Rows of one company only; without a company there are none."""
    return df.where(F.lit(False)) if company is None else df.where(F.col(column) == company)


def authorised(df: DataFrame, engagements: DataFrame, memberships: DataFrame, grants: DataFrame, subject: str) -> DataFrame:
    """Rows of companies that a subject may see: an active engagement of the firm, an active membership there, a live grant."""
    mine = memberships.where((F.col("subject_id") == subject) & (F.col("status") == "active")).select("firm_id")
    engaged = engagements.where("status = 'active'").join(mine, "firm_id", "left_semi").select("company_id")
    granted = grants.where((F.col("subject_id") == subject) & F.col("revoked_at").isNull()).select("company_id")
    return df.join(engaged, "company_id", "left_semi").join(granted, "company_id", "left_semi")


def permissions(roles: Column, table: dict[str, list[str]]) -> Column:
    """What an array of roles may do, all taken together."""
    known = F.create_map(*[x for r, ps in table.items() for x in (F.lit(r), F.array(*[F.lit(p) for p in ps]))])
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(roles, lambda r: F.element_at(known, r))))))


#: Permissions that one person must not use on the same object.
SEGREGATED = (("match.propose", "match.confirm"), ("close.prepare", "close.approve"), ("close.reopen.request", "close.reopen.approve"), ("dataset.map", "dataset.publish"))


def segregation_breaches(acts: DataFrame) -> DataFrame:
    """``object_id, subject_id, first, second``: who used both of a segregated pair on one object (acts: object_id, subject_id, permission)."""
    used = acts.groupBy("object_id", "subject_id").agg(*[F.bool_or(F.col("permission") == p).alias(p.replace(".", "_")) for pair in SEGREGATED for p in pair])
    pairs = F.array_compact(F.array(*[F.when(F.col(a.replace(".", "_")) & F.col(b.replace(".", "_")), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for a, b in SEGREGATED]))
    return used.select("object_id", "subject_id", F.inline(pairs))
