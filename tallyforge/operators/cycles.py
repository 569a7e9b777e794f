"""Calendars of expected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import civil_date, days_late, next_start, reminder_state
from .rounds import running

#: Periods that one calendar may have.
MOST = 120


def periods(cycles: DataFrame, until: Column) -> DataFrame:
    """The periods of each cycle (anchor, periodicity, custom_days, due_offset, grace) that start up to ``until``, MOST at most.

    A monthly cycle's first period runs from its anchor to the end of that month; then months follow.
    """
    step = F.when(F.col("periodicity") == "fortnightly", 15).when(F.col("periodicity") == "weekly", 7).otherwise(F.coalesce("custom_days", F.lit(1)))
    days = F.transform(F.sequence(F.lit(0), F.least(F.lit(MOST - 1), F.floor(F.datediff(until, "anchor") / step).cast("int"))), lambda k: F.date_add("anchor", (k * step).cast("int")))
    later = F.sequence(F.date_add(F.last_day("anchor"), 1), until, F.expr("interval 1 month"))
    months = F.slice(F.when(F.date_add(F.last_day("anchor"), 1) <= until, F.concat(F.array("anchor"), later)).otherwise(F.array("anchor")), 1, MOST)
    starts = F.when(F.col("anchor") > until, F.array().cast("array<date>")).when(F.col("periodicity") == "monthly", months).otherwise(days)
    out = cycles.withColumn("period_start", F.explode(starts))
    out = out.withColumn("period_end", F.date_sub(next_start(F.col("period_start"), F.col("periodicity"), F.col("custom_days")), 1))
    return out.withColumn("due_on", F.date_add("period_end", F.col("due_offset"))).withColumn("late_after", F.date_add(F.col("due_on"), F.col("grace")))


def generated(cycles: DataFrame, until: Column, stored: DataFrame) -> DataFrame:
    """Expectations that are not stored yet."""
    return periods(cycles, until).join(stored, ["data_source_id", "period_start", "period_end"], "left_anti")


def classified(expectations: DataFrame, now: Column) -> DataFrame:
    """Expectations (state, due_on, late_after, timezone) with the local day, how they stand, and their days."""
    zone = F.coalesce("timezone", F.lit("UTC"))
    out = expectations.withColumn("local_today", civil_date(now, zone))
    today, settled = F.col("local_today"), F.col("state").isin("satisfied", "waived")
    return (
        out.withColumn("reminder_state", reminder_state(F.col("state"), F.col("due_on"), F.col("late_after"), today))
        .withColumn("days_late", F.when(settled, 0).otherwise(days_late(F.col("late_after"), today)))
        .withColumn("days_until_due", F.when(~settled, F.datediff("due_on", today)))
    )


def satisfied(expectations: DataFrame, uploads: DataFrame) -> DataFrame:
    """Which expectation each upload (upload_id, data_source_id, uploaded_on) satisfies: the pending one that started and is due last.

    Of several uploads that point at one expectation the first takes it.
    """
    open_ = expectations.where("state = 'pending' AND data_source_id IS NOT NULL").select(F.col("data_source_id").alias("source"), F.col("period_start").alias("at"), F.lit(0).alias("kind"), F.struct("due_on", "expectation_id").alias("open"))
    asks = uploads.where("data_source_id IS NOT NULL").select(F.col("data_source_id").alias("source"), F.col("uploaded_on").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(open_.schema["open"].dataType).alias("open"), "upload_id")
    # both sides in one order, the best of those that started before carried on: no upload meets every open period
    both = open_.withColumn("upload_id", F.lit(None).cast(asks.schema["upload_id"].dataType)).unionByName(asks)
    met = running(both, "source", [F.col("at"), F.col("kind")], F.max, "open", lambda a, b: F.when(a >= b, a).otherwise(b))
    best = met.where("kind = 1 AND open_before IS NOT NULL").select("upload_id", F.col("source").alias("data_source_id"), F.col("at").alias("uploaded_on"), F.col("open_before.expectation_id").alias("expectation_id"))
    first = F.min(F.struct("uploaded_on", "upload_id", "data_source_id")).alias("first")
    return best.groupBy("expectation_id").agg(first).select("first.upload_id", "first.data_source_id", "first.uploaded_on", "expectation_id")


def reminders(classified_: DataFrame, sent: DataFrame, quiet_from: int = 20, quiet_to: int = 7) -> DataFrame:
    """Reminders that were not sent yet, once for each expectation and state; in the quiet hours of the local day they wait until these end."""
    due = classified_.where(F.col("reminder_state").isin("due_soon", "due_today", "in_grace", "overdue"))
    new = due.join(sent, ["expectation_id", "reminder_state"], "left_anti")
    hour = F.hour("local_now")
    wait = F.when(hour >= quiet_from, 24 - hour + quiet_to).when(hour < quiet_to, quiet_to - hour).otherwise(0)
    return new.withColumn("wait_hours", wait)


def settlement_gap() -> Column:
    """Zero where gross - fee - tax - withholding - refund + adjustment is net."""
    return F.col("gross") - F.col("fee") - F.col("tax") - F.col("withholding") - F.col("refund") + F.col("adjustment") - F.col("net")


def late_counts(expectations: DataFrame, today) -> DataFrame:
    """For each source the pending expectations that are over their last day."""
    return expectations.groupBy("data_source_id").agg(F.count_if((F.col("state") == "pending") & (F.col("late_after") < today)).alias("late"))
