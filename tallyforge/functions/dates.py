"""Civil dates, zones, calendar steps and lateness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def civil_date(instant: Column, zone: Column) -> Column:
    """The date that people in ``zone`` have at a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def end_of_local_day(day: Column, zone: Column) -> Column:
    """The UTC instant of a civil day's last microsecond in ``zone``."""
    return F.to_utc_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59.999999")).cast("timestamp"), zone)


def next_start(start: Column, periodicity: Column, custom_days: Column | None = None) -> Column:
    custom = F.lit(1) if custom_days is None else F.coalesce(custom_days, F.lit(1))
    return (
        F.when(periodicity == "monthly", F.date_add(F.last_day(start), 1))
        .when(periodicity == "fortnightly", F.date_add(start, 15))
        .when(periodicity == "weekly", F.date_add(start, 7))
        .otherwise(F.date_add(start, custom))
    )


def days_late(late_after: Column, today: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(today, late_after))


def reminder_state(state: Column, due_on: Column, late_after: Column, today: Column, soon: int = 7) -> Column:
    """How an expected document stands today."""
    return (
        F.when(state.isin("satisfied", "waived"), state)
        .when((state == "late") | (today > late_after), "overdue")
        .when(today == due_on, "due_today")
        .when(today > due_on, "in_grace")
        .when(F.datediff(due_on, today) <= soon, "due_soon")
        .otherwise("upcoming")
    )
