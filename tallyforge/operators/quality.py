"""Data-quality and risk signals over movements, and the ledger of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled

from ..functions.money import times_ten
from .latest import latest

#: Severities of the rules, and the version that is part of an issue's key.
SEVERITY = {
    "duplicate_fingerprint": "high",
    "reference_amount_conflict": "warning",
    "posting_delay_over_31_days": "warning",
    "amount_outlier_10x_median": "warning",
    "cross_dataset_duplicate_fingerprint": "warning",
    "reference_reuse_high_frequency": "info",
    "same_day_same_amount_burst": "warning",
    "rapid_reversal_pair": "warning",
    "multiple_risk_indicators": "high",
}
RISK = ("cross_dataset_duplicate_fingerprint", "reference_reuse_high_frequency", "same_day_same_amount_burst", "rapid_reversal_pair")
SCOPE = 100
CAP = 500


def recent(m: DataFrame, datasets: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Movements of the most recent datasets. The list is short, so that it travels to the movements."""
    ids = datasets.orderBy(F.desc_nulls_last("prepared_on"), "dataset_version_id").limit(scope).select("dataset_version_id")
    return m.join(F.broadcast(ids), "dataset_version_id", "left_semi")


def duplicate_fingerprint(m: DataFrame) -> DataFrame:
    return m.groupBy("dataset_version_id", "dedupe_fingerprint").agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def reference_amount_conflict(m: DataFrame) -> DataFrame:
    """One reference within a dataset for different amounts, currencies or directions."""
    by = m.where(F.col("reference_normalised").isNotNull()).groupBy("dataset_version_id", "reference_normalised")
    out = by.agg(F.count("*").alias("occurrences"), F.countDistinct(F.struct("amount", "currency_code", "direction")).alias("variants"))
    return out.where("variants > 1").drop("variants")


def posting_delay(m: DataFrame, days: int = 31) -> DataFrame:
    return m.where(F.datediff("posted_on", "occurred_on") > days).select("movement_id")


#: Digits by which a median is narrowed down at a time, and how often, before the amounts left are put in order.
DIGITS, NARROWED = 4, 2


def medians(m: DataFrame) -> DataFrame:
    """The discrete median amount of each dataset, currency and direction, exactly: the first to reach half the rows.

    Amounts are counted by size and first digits, of which there are few; of the amounts with the median's digits the next ones are
    looked at in the same way, and only what shares all of them is put in order. So no group's amounts meet in one task.
    """
    keys = ["dataset_version_id", "currency_code", "direction"]
    counted = m.groupBy(*keys, "amount").agg(F.count("*").alias("n"))
    # unscaled digits, so that the order of texts is the order of amounts, which are not negative
    digits = F.lpad(F.regexp_replace(F.col("amount").cast("decimal(38,12)").cast("string"), "[.]", ""), 40, "0")
    left = counted.withColumn("digits", digits).withColumn("size", F.length(F.regexp_replace("digits", "^0+", "")))
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("sample_size"))
    left = left.join(sizes, keys).withColumn("below", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys)
    for k in range(NARROWED):
        part = F.concat_ws("|", F.lpad(F.col("size").cast("string"), 2, "0"), F.expr(f"substring(digits, 41 - size + {k * DIGITS}, {DIGITS})"))
        left = left.withColumn("part", part)
        sums = left.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.max("below").alias("below"), F.max("sample_size").alias("sample_size"))
        upto = sums.withColumn("upto", F.col("below") + F.sum("n").over(w.orderBy("part")))
        at = upto.where("upto * 2 >= sample_size").groupBy(*keys).agg(F.min("part").alias("part"), F.min_by(F.col("upto") - F.col("n"), "part").alias("before"))
        left = left.join(at, [*keys, "part"]).withColumn("below", F.col("before")).drop("before", "part")
    ranked = left.withColumn("upto", F.col("below") + F.sum("n").over(w.orderBy("amount")))
    return ranked.where("upto * 2 >= sample_size").groupBy(*keys).agg(F.min("amount").alias("median_amount"), F.max("sample_size").alias("sample_size"))


def amount_outlier(m: DataFrame, least: int = 20) -> DataFrame:
    base = medians(m).where(F.col("sample_size") >= least)
    out = m.join(base, ["dataset_version_id", "currency_code", "direction"])
    return out.where(F.col("amount") > times_ten(F.col("median_amount"))).select("movement_id")


def cross_dataset_duplicate(m: DataFrame) -> DataFrame:
    repeated = m.groupBy("dedupe_fingerprint").agg(F.min("dataset_version_id").alias("a"), F.max("dataset_version_id").alias("b")).where("a <> b")
    return m.join(repeated.select("dedupe_fingerprint"), "dedupe_fingerprint", "left_semi").select("movement_id").distinct()


def reference_reuse(m: DataFrame, least: int = 5) -> DataFrame:
    keys = ["dataset_version_id", "reference_normalised"]
    reused = m.where(F.col("reference_normalised").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return m.join(reused.select(*keys), keys, "left_semi").select("movement_id")


def same_day_burst(m: DataFrame, rows: int = 4, prints: int = 3) -> DataFrame:
    keys = ["dataset_version_id", "financial_account_id", "occurred_on", "currency_code", "direction", "amount"]
    bursts = m.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("dedupe_fingerprint").alias("d")).where((F.col("n") >= rows) & (F.col("d") >= prints))
    return m.join(bursts.select(*keys), keys, "left_semi").select("movement_id")


def rapid_reversal(m: DataFrame, days: int = 3) -> DataFrame:
    """Ends of pairs that undo each other within days. Each end is found by a semi join of its own: no pair is written out."""
    keys = ["financial_account_id", "currency_code", "amount", "reference_normalised"]
    some = m.where(F.col("reference_normalised").isNotNull()).select("movement_id", "direction", "occurred_on", *keys)
    # movements of one key, direction and day stand for each other
    kinds = some.select("direction", "occurred_on", *keys).distinct()
    other = kinds.select(F.col("direction").alias("o_direction"), F.col("occurred_on").alias("o_day"), *[F.col(k).alias(f"o_{k}") for k in keys])
    same = [F.col(k) == F.col(f"o_{k}") for k in keys] + [F.col("direction") != F.col("o_direction")]
    first = kinds.join(other, [*same, F.datediff("o_day", "occurred_on").between(0, days)], "left_semi")
    second = kinds.join(other, [*same, F.datediff("occurred_on", "o_day").between(0, days)], "left_semi")
    return some.join(first.unionByName(second).distinct(), ["direction", "occurred_on", *keys], "left_semi").select("movement_id")


RISK_RULES = {
    "cross_dataset_duplicate_fingerprint": cross_dataset_duplicate,
    "reference_reuse_high_frequency": reference_reuse,
    "same_day_same_amount_burst": same_day_burst,
    "rapid_reversal_pair": rapid_reversal,
}


def risk_signals(m: DataFrame, cap: int | None = None) -> DataFrame:
    """``rule_code, movement_id`` of the advanced rules; ``cap`` keeps so many of each, by id, as a report does."""
    out = None
    for rule, f in RISK_RULES.items():
        found = f(m)
        found = (found if cap is None else found.orderBy("movement_id").limit(cap)).select(F.lit(rule).alias("rule_code"), "movement_id")
        out = found if out is None else out.unionByName(found)
    return out


#: What the rules look at.
RISK_COLUMNS = ("movement_id", "dataset_version_id", "dedupe_fingerprint", "reference_normalised", "financial_account_id", "occurred_on", "currency_code", "direction", "amount")


def multiple_risk(m: DataFrame, cap: int | None = None) -> DataFrame:
    """Movements that two rules or more find. The movements are made once, for all rules."""
    return risk_signals(settled(m.select(*RISK_COLUMNS)), cap).groupBy("movement_id").agg(F.countDistinct("rule_code").alias("rules")).where("rules >= 2")


def capped(findings: DataFrame, order: list[str], cap: int = CAP) -> DataFrame:
    """The first ``cap`` findings of each rule, and whether the rule has more: what a report shows. Rules are few, so their findings are
    counted first and only as many as the cap of each are put in order."""
    counts = findings.groupBy("rule_code").agg(F.count("*").alias("total"))
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    # the first of each part come before the first of all
    some = findings.withColumn("part_", part).withColumn("place_", F.row_number().over(Window.partitionBy("rule_code", "part_").orderBy(*order))).where(F.col("place_") <= cap)
    first = some.withColumn("place_", F.row_number().over(Window.partitionBy("rule_code").orderBy(*order))).where(F.col("place_") <= cap)
    return first.drop("part_", "place_").join(counts, "rule_code").withColumn("truncated", F.col("total") > cap).drop("total")


def dataset_findings(datasets: DataFrame) -> DataFrame:
    """One row for each thing that is wrong with a dataset as a whole."""
    finding = lambda when, rule, severity, count=F.lit(1): F.when(when, F.struct(F.lit(rule).alias("rule_code"), F.lit(severity).alias("severity"), count.cast("int").alias("occurrences")))
    found = F.array_compact(F.array(
        finding(F.col("completeness_state") == "mismatch", "dataset_completeness_mismatch", "high"),
        finding(F.col("completeness_state") == "unknown", "dataset_completeness_unknown", "warning"),
        finding(F.col("rejected_count") > 0, "dataset_rejected_records", "warning", F.col("rejected_count")),
        finding(F.col("lineage_state") == "invalidated", "lineage_invalidated", "high"),
    ))
    return datasets.select("dataset_version_id", F.inline(found))


def issue_key(rule: Column, kind: Column, ref: Column, discriminator: Column, version: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), rule, kind, ref, discriminator), 256)


def upserted(issues: DataFrame, found: DataFrame) -> DataFrame:
    """The ledger of issues (issue_key, occurrence_count, status, first_seen_on, last_seen_on) after a scan (issue_key, occurrence_count, seen_on).

    New keys come in as open; known ones keep status and first sight, take the larger count and the later sight.
    """
    f = found.select("issue_key", F.col("occurrence_count").alias("n"), "seen_on")
    both = issues.join(f, "issue_key", "full_outer")
    change = F.when(F.col("first_seen_on").isNull(), "created").when(F.col("seen_on").isNotNull(), "refreshed").otherwise("unchanged")
    return both.select(
        "issue_key", F.greatest("occurrence_count", "n").alias("occurrence_count"), F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("first_seen_on", "seen_on").alias("first_seen_on"), F.greatest("last_seen_on", "seen_on").alias("last_seen_on"), change.alias("change"),
    )


#: Steps that a person may take with an issue.
TRIAGE = {"open": ("acknowledged", "resolved", "dismissed"), "acknowledged": ("resolved", "dismissed")}


def triage_history(events: DataFrame) -> DataFrame:
    """Events (issue_key, seq, status) with whether each step was allowed from the one before."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("issue_key").orderBy("seq")), F.lit("open"))
    allowed = F.lit(False)
    for a, to in TRIAGE.items():
        allowed = allowed | ((before == a) & F.col("status").isin(*to))
    return events.withColumn("allowed", allowed)


def current(events: DataFrame) -> DataFrame:
    return latest(events, ["issue_key"], F.desc("seq"))
