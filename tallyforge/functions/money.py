"""Exact money: decimals of 38 digits, 12 after the point, never rounded and never from floating text.

Parsers return a struct of value and error, of which one is null, so that no row is dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

MONEY = "decimal(38,12)"
#: The currencies that a mapping may declare.
CURRENCIES = ("COP", "USD", "EUR")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it. Plain nesting would repeat the value's whole
    expression at each place, and again where the optimiser moves filters."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def outcome(error: Column, value: Column, kind: str) -> Column:
    """The value where there is no error, and the error."""
    return let(error, lambda e: F.struct(F.when(e.isNull(), value).cast(kind).alias("value"), e.alias("error")))


def parse_money(c: Column) -> Column:
    def parsed(text: Column) -> Column:
        whole = F.length(F.regexp_extract(text, r"\A[+-]?0*([0-9]*)", 1))
        after = F.length(F.regexp_extract(text, r"\.([0-9]+)\z", 1))
        error = (
            F.when(text.isNull() | ~F.regexp_like(text, F.lit(r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z")), "not_exact_decimal")
            .when(after > 12, "more_than_12_decimals")
            .when(whole > 26, "more_than_38_digits")
        )
        return outcome(error, text.try_cast(MONEY), MONEY)

    return let(stripped(c), parsed)


def money_text(c: Column) -> Column:
    """Twelve decimals, never scientific."""
    return c.cast(MONEY).cast("string")


def parse_currency(c: Column, allowed: tuple[str, ...] = CURRENCIES) -> Column:
    text = F.upper(stripped(c))
    error = F.when(text.isNull() | ~text.isin(*allowed), "currency_not_supported")
    return outcome(error, text, "string")


def times_ten(c: Column) -> Column:
    """Exactly ten times an amount of up to 28 digits: a wider product would lose decimals."""
    return c.cast("decimal(28,12)") * F.lit(10).cast("decimal(2,0)")


def combined(a: Column, a_currency: Column, b: Column, b_currency: Column, sign: int = 1) -> Column:
    """The exact sum or (``sign`` -1) difference of two amounts as (value, error). Amounts of different currencies, or of none, are never
    added up, and a result of over 38 digits is an error and not a rounded number."""
    out = F.try_add(a.cast(MONEY), (b * sign).cast(MONEY)).cast("decimal(38,12)")
    error = (
        F.when(a.isNull() | b.isNull(), "amount_missing")
        .when(~F.coalesce(a_currency == b_currency, F.lit(False)), "currency_mismatch")
        .when(out.isNull(), "more_than_38_digits")
    )
    return outcome(error, out, MONEY)
