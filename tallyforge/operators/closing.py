"""Closing of accounting periods: readiness, coverage of accounts, overlaps, sealed manifests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import canonical_json
from .latest import latest


def overlapping(spans: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end) with each closed period (period_start, period_end) of their keys that they touch; both ends count.

    Both sides are laid out by month, so that the join has an equal key besides the company and no pair is tried twice.
    """
    by_month = lambda a, b: F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))
    a = spans.withColumn("month_", by_month("start", "end"))
    b = closed.withColumn("month_", by_month("period_start", "period_end"))
    met = a.join(b, [*keys, "month_"]).where((F.col("start") <= F.col("period_end")) & (F.col("period_start") <= F.col("end")))
    # of the months that both have, the first tells the pair
    return met.where(F.col("month_") == F.greatest(F.trunc("start", "month"), F.trunc("period_start", "month"))).drop("month_")


def closed_writes(rows: DataFrame, closed: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Rows that must not be written: their day is in a closed period."""
    spans = rows.withColumn("start", F.col(day)).withColumn("end", F.col(day))
    return overlapping(spans, closed, keys).select(*rows.columns)


#: The controls of a close, and the metric of each that must be zero. The last one is for a product that closes by itself, and
#: never passes; it does not count for readiness.
CONTROLS = {
    "expected_sources": "no_sources",
    "expectations_satisfied": "pending_expectations",
    "dataset_evidence": "missing_datasets",
    "published_datasets": "unpublished",
    "verified_completeness": "incomplete",
    "complete_lineage": "lineage_gaps",
    "rejected_rows": "rejected_rows",
    "accounting_dates": "missing_dates",
    "reconciliation_reviews": "open_reviews",
    "quality_alerts": "high_issues",
    "pending_corrections": "pending_corrections",
    "account_balances": "missing_balances",
    "completeness_assessments": "missing_assessments",
    "reconciliation_statements": "uncovered_accounts",
    "reconciliation_statement_lineage": "statement_lineage_gaps",
}
NEED_ACCOUNTS = ("reconciliation_statements", "reconciliation_statement_lineage")
UNAVAILABLE = "product_close"


def period_metrics(sources: DataFrame, datasets: DataFrame, evidence: dict[str, DataFrame], balances: DataFrame, assessments: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of each period, in one row.

    sources      ``keys``, expectation_id, state, dataset_version_id, financial_account_id and the balance_type that the source's family asks for
    datasets     dataset_version_id, state, completeness_state, lineage_state, rejected_count
    evidence     for each of missing_dates, open_reviews, high_issues and pending_corrections the open things: dataset_version_id and id; an id
                 of several datasets counts once a period
    balances     dataset_version_id, financial_account_id, balance_type, lineage_state
    assessments  expectation_id, dataset_version_id, state, lineage_state, seq: the last of each pair counts
    statements   financial_account_id, period_start, state, lineage_state, seq: the last of each account and period counts
    """
    ds = datasets.select("dataset_version_id", F.col("state").alias("ds_state"), "completeness_state", "lineage_state", "rejected_count")
    good = balances.where("lineage_state = 'complete'").select("dataset_version_id", "financial_account_id", "balance_type", F.lit(True).alias("has_balance")).distinct()
    last = latest(assessments, ["expectation_id", "dataset_version_id"], F.desc("seq"))
    last = last.select("expectation_id", "dataset_version_id", ((F.col("state") == "verified") & (F.col("lineage_state") == "complete")).alias("assessed"))
    one = sources.join(ds, "dataset_version_id", "left").join(good, ["dataset_version_id", "financial_account_id", "balance_type"], "left").join(last, ["expectation_id", "dataset_version_id"], "left")
    lacks = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    out = one.groupBy(*keys).agg(
        F.when(F.count("*") > 0, 0).otherwise(1).alias("no_sources"), F.count_if(F.col("state") != "satisfied").alias("pending_expectations"), F.count_if(F.col("dataset_version_id").isNull()).alias("missing_datasets"),
        F.count_if(F.col("ds_state") != "published").alias("unpublished"), F.count_if(F.col("completeness_state") != "verified").alias("incomplete"), F.count_if(F.col("lineage_state") != "complete").alias("lineage_gaps"),
        F.coalesce(F.sum("rejected_count"), F.lit(0)).alias("rejected_rows"), lacks("has_balance").alias("missing_balances"), lacks("assessed").alias("missing_assessments"),
    )
    selected = sources.where("dataset_version_id IS NOT NULL").select(*keys, "dataset_version_id").distinct()
    # the evidence of all kinds meets the periods at once
    kinds = None
    for metric, rows in evidence.items():
        part = rows.select("dataset_version_id", F.col("id").cast("string").alias("id"), F.lit(metric).alias("metric"))
        kinds = part if kinds is None else kinds.unionByName(part)
    if kinds is not None:
        found = selected.join(kinds.where("id IS NOT NULL"), "dataset_version_id").select(*keys, "metric", "id").distinct()
        out = out.join(found.groupBy(*keys).agg(*[F.count_if(F.col("metric") == m).alias(m) for m in evidence]), keys, "left")
    said = latest(statements, ["financial_account_id", "period_start"], F.desc("seq")).select("financial_account_id", "period_start", F.col("state").alias("said"), (F.col("lineage_state") == "complete").alias("traced"))
    accounts = sources.where("financial_account_id IS NOT NULL").select(*keys, "financial_account_id").distinct().join(said, ["financial_account_id", "period_start"], "left")
    by = accounts.groupBy(*keys).agg(F.count("*").alias("accounts"), F.count_if(~F.coalesce(F.col("said") == "balanced", F.lit(False))).alias("uncovered_accounts"), F.count_if(~F.col("traced")).alias("statement_lineage_gaps"))
    return out.join(by, keys, "left").fillna(0, [*evidence, "accounts", "uncovered_accounts", "statement_lineage_gaps"])


def controls(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each period and control, from metrics in one row; a metric that is missing fails, and so do controls of accounts where there is none."""
    passed = lambda c, m: (F.coalesce(F.col(m), F.lit(1)) == 0) & ((F.col("accounts") > 0) if c in NEED_ACCOUNTS else F.lit(True))
    row = lambda c, n, ok, state: F.struct(F.lit(c).alias("control"), n.cast("long").alias("open"), ok.alias("passed"), state.alias("state"))
    rows = [row(c, F.coalesce(F.col(m), F.lit(1)), passed(c, m), F.when(passed(c, m), "pass").otherwise("blocked")) for c, m in CONTROLS.items()]
    never = row(UNAVAILABLE, F.lit(1), F.lit(False), F.lit("unavailable"))
    return metrics.select(*keys, F.inline(F.array(*rows, never)))


def ready(control_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ready only if all controls but the unavailable one are there and pass."""
    counted = control_rows.where(F.col("control") != UNAVAILABLE)
    return counted.groupBy(*keys).agg((F.bool_and("passed") & (F.countDistinct("control") == len(CONTROLS))).alias("ready"), F.count_if(~F.col("passed")).alias("failed"))


def coverage(accounts: DataFrame, assessed: DataFrame, stated: DataFrame) -> DataFrame:
    """Accounts (account, sources, statement_state) with their coverage. ``assessed`` has the assessments of each account (account, id), ``stated`` those that its statement
    rests on; a statement is stale if it rests on others than those that now are."""
    both = assessed.select("account", "id", F.lit(1).alias("now"), F.lit(0).alias("then")).unionByName(stated.select("account", "id", F.lit(0).alias("now"), F.lit(1).alias("then")))
    each = both.groupBy("account", "id").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    sums = each.groupBy("account").agg(F.sum("now").alias("assessments"), F.bool_or(F.col("now") != F.col("then")).alias("differs"))
    state = (
        F.when(F.coalesce("assessments", F.lit(0)) != F.col("sources"), "missing_assessment")
        .when(F.col("statement_state").isNull(), "missing_statement")
        .when(F.col("differs"), "stale_inputs")
        .when(F.col("statement_state") != "balanced", "review_required")
        .otherwise("covered")
    )
    return accounts.join(sums, "account", "left").withColumn("coverage_state", state).drop("assessments", "differs")


def required_balance(family: Column) -> Column:
    return F.when(family == "accounting_ledger", "ledger").otherwise("closing")


def manifests(entries: DataFrame, keys: list[str], **fields: Column) -> DataFrame:
    """``keys, entries, digest``: a sealed digest for each period, sha256 of the array of its entries as canonical JSON, in order.

    The digest is of one text, so that one task reads a period's entries; they come to it sorted by Spark and go through it one by one, and
    no row or task holds a period."""
    shape = entries.select(*keys).schema
    rows = entries.select(*keys, canonical_json(**fields).alias("json_"))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, digest, n = None, None, 0

        def row():
            digest.update(b"]")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, n, digest.hexdigest()), types, strict=True)], names=[*keys, "entries", "digest"])

        for batch in batches:
            types = [*batch.schema.types[:-1], pa.int64(), pa.string()]
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if now is not None:
                        yield row()
                    now, digest, n = key, hashlib.sha256(b"["), 0
                digest.update(("," if n else "").encode() + text.encode())
                n += 1
        if now is not None:
            yield row()

    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "json_")
    return dealt.mapInArrow(run, T.StructType([*shape.fields, T.StructField("entries", T.LongType()), T.StructField("digest", T.StringType())]))


def close_status(events: DataFrame, keys: list[str]) -> DataFrame:
    """closed, reopen_requested or reopened, by the last event (seq, event) of each period."""
    last = latest(events, keys, F.desc("seq"))
    return last.select(*keys, F.when(F.col("event") == "reopened", "reopened").when(F.col("event") == "reopen_requested", "reopen_requested").otherwise("closed").alias("status"))


def packet_versions(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packets (seq, digest, prepared_by, reviewed_by) with their version; one that repeats the digest before it is a replay, and one's own
    review is refused."""
    w = Window.partitionBy(*keys).orderBy("seq")
    replay = F.coalesce(F.lag("digest").over(w) == F.col("digest"), F.lit(False))
    out = packets.withColumn("replay", replay)
    version = F.sum(F.when(F.col("replay"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("version", version).withColumn("accepted", ~F.col("replay") & (F.col("prepared_by") != F.col("reviewed_by")))


#: Steps of a closed period; the first is its close.
CLOSE_STEPS = {None: ("closed",), "closed": ("reopen_requested",), "reopen_requested": ("reopened",), "reopened": ("closed",)}


def close_history(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events of periods (seq, event, subject_id) with what is wrong in each: a step that does not follow from the one before, and a reopening by who asked for it."""
    w = Window.partitionBy(*keys).orderBy("seq")
    before, by = F.lag("event").over(w), F.lag("subject_id").over(w)
    allowed = F.lit(False)
    for a, to in CLOSE_STEPS.items():
        allowed = allowed | ((before.isNull() if a is None else before == a) & F.col("event").isin(*to))
    why = F.when(~F.coalesce(allowed, F.lit(False)), "step_not_allowed").when((F.col("event") == "reopened") & (by == F.col("subject_id")), "same_person")
    return events.withColumn("problem", why)


def stale_packets(packets: DataFrame, manifests_: DataFrame, keys: list[str]) -> DataFrame:
    """Packets (manifest_digest) whose period has another manifest by now, or none: they must be prepared again."""
    now = manifests_.select(*keys, F.col("digest").alias("now_"))
    return packets.join(now, keys, "left").where(~F.col("manifest_digest").eqNullSafe(F.col("now_"))).drop("now_")
