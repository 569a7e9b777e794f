"""Text expressions: trimming, references, spreadsheet safety, search, secrets in lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stripped(c: Column) -> Column:
    """Without white space of any script at either end; null stays null."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def normalised_reference(c: Column) -> Column:
    """White space collapsed, upper case, at most 200 characters; empty becomes null."""
    one = F.trim(F.upper(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.nullif(F.substring(one, 1, 200), F.lit(""))


def spreadsheet_safe(c: Column) -> Column:
    """An apostrophe before text that a spreadsheet would run as a formula."""
    first = F.regexp_extract(c, r"\A[ \t\r\n]*([=+@-])", 1)
    return F.when(first != "", F.concat(F.lit("'"), c)).otherwise(c)


def contains_ignoring_case(c: Column, wanted: str) -> Column:
    """A search in which % and _ stand for themselves."""
    return F.contains(F.lower(c), F.lit(wanted.lower()))


@F.pandas_udf(T.StringType())
def normalised_text(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed: there is no built-in for the first two."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def luhn(c: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", c), F.lit(False))


#: A card number's candidates, and forms of credentials that a line of an upload must not hold.
CARD = r"(?<![0-9])((?:[0-9][ -]?){12,18}[0-9])(?![0-9])"
CREDENTIALS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_access_key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Z0-9])",
    "bearer_token": r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{20,}",
    "password_assignment": r"(?i)\b(?:password|passwd|contrase(?:n|ñ)a|secret|api[_-]?key)\s*[:=]\s*\S{6,}",
    "connection_string": r"(?i)\b(?:postgres|postgresql|mysql|mongodb)://[^\s:]+:[^\s@]+@",
}


def line_findings(line: Column) -> Column:
    """The kinds of secret in a line, never their values: a payment card number that passes Luhn, or a credential."""
    cards = F.transform(F.regexp_extract_all(line, F.lit(CARD), F.lit(1)), lambda x: F.regexp_replace(x, "[ -]", ""))
    card = F.exists(cards, lambda x: F.call_function("luhn_check", x))
    kinds = [F.when(card, F.lit("payment_card_number"))] + [F.when(F.regexp_like(line, F.lit(p)), F.lit(k)) for k, p in CREDENTIALS.items()]
    return F.array_compact(F.array(*kinds))
