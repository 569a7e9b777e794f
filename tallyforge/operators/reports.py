"""Operational reports: counts, money totals, and monthly series without gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = (30, 90, 180, 365)


def window(days: int, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """First day, and the day after the last."""
    if days not in WINDOWS:
        raise ValueError(f"a report covers one of {WINDOWS} days")
    return as_of - dt.timedelta(days=days - 1), as_of + dt.timedelta(days=1)


def within(day: str, start: dt.date, end: dt.date) -> Column:
    return (F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(end))


def state_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def money_totals(m: DataFrame) -> DataFrame:
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).cast("decimal(38,12)")
    return m.groupBy("currency_code").agg(F.count("*").alias("movement_count"), side("inflow").alias("inflow_amount"), side("outflow").alias("outflow_amount"))


def months(spark, start: dt.date, last: dt.date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start), "month"), F.trunc(F.lit(last), "month"), F.expr("interval 1 month"))).alias("month"))


def activity_series(spark, start: dt.date, end: dt.date, **sources: tuple[DataFrame, str]) -> DataFrame:
    """A row for each month, with the count of each source (a frame and its date column); months without any are zero."""
    out = months(spark, start, end - dt.timedelta(days=1))
    for name, (df, day) in sources.items():
        counted = df.where(within(day, start, end)).groupBy(F.trunc(day, "month").alias("month")).agg(F.count("*").alias(name))
        out = out.join(counted, "month", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def money_series(spark, m: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Months by currencies. Movements are summed first, so that the grid is joined with sums and not with rows."""
    some = m.where(within("occurred_on", start, end))
    sums = money_totals(some.withColumn("month", F.trunc("occurred_on", "month")).withColumn("currency_code", F.struct("month", "currency_code")))
    sums = sums.select("currency_code.month", "currency_code.currency_code", "movement_count", "inflow_amount", "outflow_amount")
    grid = months(spark, start, end - dt.timedelta(days=1)).crossJoin(sums.select("currency_code").distinct())
    zero = F.lit(0).cast("decimal(38,12)")
    return grid.join(sums, ["month", "currency_code"], "left").select("month", "currency_code", F.coalesce("movement_count", F.lit(0)).alias("movement_count"), F.coalesce("inflow_amount", zero).alias("inflow_amount"), F.coalesce("outflow_amount", zero).alias("outflow_amount"))


def roll_up(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of several companies as one, with the range of their due dates."""
    return summaries.groupBy(*keys).agg(F.count("*").alias("companies"), F.sum("amount").alias("amount"), F.min("due_on").alias("first_due"), F.max("due_on").alias("last_due"))


def missing_dates(m: DataFrame) -> DataFrame:
    """For each dataset the movements without an accounting date, and its distinct references."""
    return m.groupBy("dataset_version_id").agg(F.count_if(F.col("accounting_date").isNull()).alias("missing"), F.countDistinct("reference_normalised").alias("refs"))


def usage_to_date(meter: DataFrame, as_of: DataFrame) -> DataFrame:
    """What each company used of each metric (company, metric, quantity, used_at) since the first of the month of ``as_of``, a row with now."""
    month = as_of.select(F.date_trunc("month", "now").alias("first_"))
    return meter.join(F.broadcast(month), F.col("used_at") >= F.col("first_")).groupBy("company", "metric").agg(F.sum("quantity").alias("quantity"))


def platform_counters(jobs: DataFrame) -> DataFrame:
    """Jobs (state, identity): all, failed, and the identities behind them."""
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("state") == "failed").alias("failed"), F.countDistinct("identity").alias("identities"))


def account_usage(accounts: DataFrame, movements: DataFrame, key: str) -> DataFrame:
    """Accounts with the number of their movements and of those whose link is active, none counting as zero."""
    used = movements.groupBy(key).agg(F.count("*").alias("movements"), F.count_if("active").alias("active_links"))
    return accounts.join(used, key, "left").fillna(0)
