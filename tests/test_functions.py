"""Expressions on the cases that bite: money, dates, kinds, keys, secrets."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import digests, money, parsing, text
from tallyforge.session import ship


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_fingerprints_are_versioned_and_exact(spark):
    ship(spark)
    df = spark.createDataFrame([("b", 1, 0.5, None)], "currency string, n long, amount double, ref string")
    with pytest.raises(TypeError, match="amount"):
        digests.canonical_features(df, ["currency", "amount"])
    one, two = (df.select(digests.candidate_fingerprint(df, ["n", "currency", "ref"], b"k", v)).first()[0] for v in ("v1", "v2"))
    assert one.startswith("v1:") and two.startswith("v2:") and one[3:] != two[3:]
    text = df.select(digests.canonical_features(df, ["n", "currency", "ref"])).first()[0]
    assert one == "v1:" + hmac.new(b"k", f"v1|{text}".encode(), hashlib.sha256).hexdigest()


def test_money_is_exact_or_refused(spark):
    cases = ["1.5", " -2 ", "0", "1.1234567890123", "1e3", "NaN", "", None, "9" * 26, "9" * 27, "1.", "+3.000000000001"]
    got = column(spark, cases, money.parse_money)
    assert [str(r.value) if r.value is not None else r.error for r in got] == [
        "1.500000000000", "-2.000000000000", "0E-12", "more_than_12_decimals", "not_exact_decimal", "not_exact_decimal", "not_exact_decimal", "not_exact_decimal", "9" * 26 + ".000000000000", "more_than_38_digits", "not_exact_decimal", "3.000000000001",
    ]
    assert column(spark, ["0"], lambda c: money.money_text(c.cast("decimal(38,12)"))) == ["0.000000000000"]


@pytest.mark.parametrize(
    ("convention", "value", "want"),
    [
        ("iso", "2026-02-28", "2026-02-28"), ("iso", "2026-02-29", "date_out_of_range"), ("dmy", "29/02/2024", "2024-02-29"), ("dmy", "31-4-2026", "date_out_of_range"), ("mdy", "4/3/2026", "2026-04-03"), ("dmy", "2026-01-02", "date_is_iso_but_not_declared"),
        ("dmy", "1/2/26", "date_year_ambiguous"), ("dmy", "1/1/1899", "date_out_of_range"), ("dmy", "1/1/3000", "date_out_of_range"), ("iso", "1/2/2026", "date_not_iso"), ("dmy", "", "date_missing"), ("dmy", None, "date_missing"), ("dmy", "soon", "date_not_recognised"),
    ],
)
def test_dates(spark, convention, value, want):
    r = column(spark, [value], lambda c: parsing.parse_date(c, convention))[0]
    assert (str(r.value) if r.value else r.error) == want


@pytest.mark.parametrize(
    ("mark", "value", "want"),
    [("comma", "1.234", "1234"), ("dot", "1.234", "1.234"), ("dot", "1,23,45", "amount_bad_thousands"), ("comma", "1.234.567,89", "1234567.89"), ("dot", "1 234.5", "1234.5"), ("dot", "1.2.3", "amount_two_decimal_marks"), ("comma", "", "amount_missing"), ("comma", "(5)", "amount_not_a_number"), ("dot", "-12", "-12")],
)
def test_amounts(spark, mark, value, want):
    r = column(spark, [value], lambda c: parsing.normalised_amount(c, mark))[0]
    assert (r.value or r.error) == want


def test_references_and_cells(spark):
    assert column(spark, ["  ab\t c ", "   ", None], text.normalised_reference) == ["AB C", None, None]
    assert column(spark, ["=1", " -1", "a=1", "", None, "\t@x"], text.spreadsheet_safe) == ["'=1", "' -1", "a=1", "", None, "'\t@x"]


def test_secrets_in_lines_are_named_not_shown(spark):
    lines = ["4539 5787 6362 1486", "4539 5787 6362 1487", "-----BEGIN RSA PRIVATE KEY-----", "Bearer abcdefghijklmnopqrstuvwxyz", "contraseña: secreto1", "postgres://u:p@h", "nothing"]
    assert column(spark, lines, text.line_findings) == [["payment_card_number"], [], ["private_key"], ["bearer_token"], ["password_assignment"], ["connection_string"], []]


def test_keyed_digests_and_keys(spark):
    ship(spark)
    assert column(spark, ["a", None], digests.keyed_digest(b"k")) == [hmac.new(b"k", b"a", hashlib.sha256).hexdigest(), None]
    token = column(spark, ["12-34 56.78"], lambda c: digests.account_token(c, F.lit("c1"), "bank", b"k", 2))[0]
    assert token.last4 == "5678" and token.key_version == 2 and token.token == hmac.new(b"k", b"c1|bank|2|12345678", hashlib.sha256).hexdigest()
    assert column(spark, ["ﬁ  Straße\n", None], text.normalised_text) == ["fi strasse", None]
    full = dict.fromkeys(digests.REPRODUCTION_INPUTS, "x")
    assert digests.reproduction_key(full) == digests.reproduction_key(dict(reversed(full.items())))
    with pytest.raises(ValueError, match="missing"):
        digests.reproduction_key(full | {"mapping_sha256": ""})
    with pytest.raises(ValueError, match="floating"):
        digests.reproduction_key(full | {"engine_release_id": "engine-latest"})
    assert digests.decode_cursor(digests.encode_cursor("2026-01-02", "ab|c")) == ("2026-01-02", "ab|c")
