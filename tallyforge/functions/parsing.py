"""What a cell says under a declared convention: dates, amounts, directions, kinds. Nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import let, outcome, parse_money
from .text import stripped

#: Words of direction in statements.
INFLOW = ("inflow", "credito", "crédito", "credit", "abono", "entrada", "haber")
OUTFLOW = ("outflow", "debito", "débito", "debit", "cargo", "salida", "debe")
#: Words of truth; digits are numbers first.
BOOLEANS = ("true", "false", "si", "no", "sí", "s", "n", "yes")


def parse_date(c: Column, convention: str) -> Column:
    """A date in the declared convention: iso, dmy or mdy. Two-digit years are refused, as are days that do not exist."""
    iso, slash = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z", r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\z"
    if convention == "iso":
        pattern, (y, m, d) = iso, (1, 2, 3)
    else:
        pattern, (y, m, d) = slash, (3, 2, 1) if convention == "dmy" else (3, 1, 2)

    def parsed(text: Column) -> Column:
        is_iso, is_slash = F.regexp_like(text, F.lit(iso)), F.regexp_like(text, F.lit(slash))
        year = F.length(F.regexp_extract(text, slash, 3))
        shape = (
            F.when(text == "", "date_missing")
            .when(is_iso & F.lit(convention != "iso"), "date_is_iso_but_not_declared")
            .when(~is_iso & ~is_slash, "date_not_recognised")
            .when(is_slash & (year == 2), "date_year_ambiguous")
            .when(is_slash & F.lit(convention == "iso"), "date_not_iso")
            .when(is_slash & (year == 3), "date_out_of_range")
        )
        part = lambda g, n: F.lpad(F.regexp_extract(text, pattern, g), n, "0")
        date = F.try_to_date(F.concat_ws("-", part(y, 4), part(m, 2), part(d, 2)), "yyyy-MM-dd")
        return let(date, lambda x: outcome(F.coalesce(shape, F.when(x.isNull() | ~F.year(x).between(1900, 2999), "date_out_of_range")), x, "date"))

    return let(F.coalesce(stripped(c), F.lit("")), parsed)


def normalised_amount(c: Column, decimals: str) -> Column:
    """The text of a number with a point for decimals. Marks of thousands go only where they group in threes."""
    mark, point = (",", ".") if decimals == "dot" else (".", ",")
    groups = rf"\A[+-]?[0-9]{{1,3}}(?:\{mark}[0-9]{{3}})+(?:\{point}[0-9]+)?\z"

    def parsed(text: Column) -> Column:
        plain = F.translate(F.translate(text, mark, ""), point, ".")
        error = (
            F.when(text == "", "amount_missing")
            .when(F.contains(text, F.lit(mark)) & ~F.regexp_like(text, F.lit(groups)), "amount_bad_thousands")
            .when(F.length(text) - F.length(F.translate(text, point, "")) > 1, "amount_two_decimal_marks")
            .when(~F.regexp_like(plain, F.lit(r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z")), "amount_not_a_number")
        )
        return outcome(error, plain, "string")

    return let(F.regexp_replace(F.coalesce(stripped(c), F.lit("")), "[ \u00a0]", ""), parsed)


def parse_direction(c: Column) -> Column:
    word = F.lower(stripped(c))
    found = F.when(word.isin(*INFLOW), "inflow").when(word.isin(*OUTFLOW), "outflow")
    return outcome(F.when(found.isNull(), "direction_not_recognised"), found, "string")


def classify(c: Column) -> Column:
    """The kind of a trimmed cell; the first that fits. What could be read two ways is called ambiguous."""
    like = lambda p: F.regexp_like(c, F.lit(p))
    slash = r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"
    a, b = (F.regexp_extract(c, slash, g).try_cast("int") for g in (1, 2))
    date = F.when((a > 12) & (b <= 12), "date_dmy").when((b > 12) & (a <= 12), "date_mdy").when((a <= 12) & (b <= 12), "ambiguous_date").otherwise("text")
    return (
        F.when(like(r"\A[+-]?[0-9]{1,3}[.,][0-9]{3}\z"), "ambiguous_numeric")
        .when(like(r"\A[+-]?[0-9]+\z"), "integer")
        .when(like(r"\A[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\.[0-9]+\z"), "decimal_dot")
        .when(like(r"\A[+-]?(?:[0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+),[0-9]+\z"), "decimal_comma")
        .when(like(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "date_iso")
        .when(like(slash), date)
        .when(F.lower(c).isin(*BOOLEANS), "boolean")
        .otherwise("text")
    )


def corrected_value(field: Column, value: Column) -> Column:
    """A typed correction: (type, canonical text, error) by the field that is corrected."""
    text = stripped(value)
    money, date = parse_money(text), parse_date(text, "iso")
    kind = (
        F.when(field == "amount", "money")
        .when(field == "currency_code", "currency")
        .when(field == "direction", "direction")
        .when(field.isin("occurred_on", "posted_on", "value_date", "accounting_date"), "date")
        .when(field.isin("description", "reference"), "text")
    )
    canonical = (
        F.when((kind == "money") & (money["value"] > 0), money["value"].cast("string"))
        .when((kind == "currency") & F.regexp_like(text, F.lit(r"\A[A-Za-z]{3}\z")), F.upper(text))
        .when((kind == "direction") & text.isin("inflow", "outflow"), text)
        .when(kind == "date", date["value"].cast("string"))
        .when((kind == "text") & (F.length(text) > 0), text)
    )
    error = F.when(kind.isNull(), "field_not_correctable").when(canonical.isNull(), "value_not_valid")
    return F.struct(kind.alias("type"), canonical.alias("canonical"), error.alias("error"))
