"""The driver's tables seen as the domain's: movements, balances, expectations, statement rows, lineage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import fingerprint
from ..functions.money import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Events as canonical movements; the coarse view has few accounts, amounts and references, so that rare rules find something."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    account = F.col("user_id") % 15 if coarse else F.col("user_id")
    amount = (F.floor(F.col("value") / 10) * 10 + 10).cast(MONEY) if coarse else F.col("value").cast(MONEY)
    ref = k % 10 if coarse else k
    day = F.to_date("ts")
    n = F.col("event_id")
    made = e.select(
        n.cast("string").alias("movement_id"),
        F.lit("c1").alias("company_id"),
        F.when(n % 2 == 0, "A").otherwise("B").alias("dataset_version_id"),
        account.cast("string").alias("financial_account_id"),
        F.when(F.col("event_type") == "purchase", "payment").otherwise("other").alias("kind"),
        amount.alias("amount"),
        F.element_at(F.array(F.lit("COP"), F.lit("USD"), F.lit("EUR")), (account % 3 + 1).cast("int")).alias("currency_code"),
        F.when(F.col("event_type").isin("purchase", "error"), "outflow").otherwise("inflow").alias("direction"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("description"),
        F.when(n % 11 != 0, F.concat(F.lit("REF-"), ref.cast("string"))).alias("reference_normalised"),
        day.alias("occurred_on"),
        F.when(n % 7 == 0, F.date_add(day, (n % 45).cast("int"))).alias("posted_on"),
        F.when(n % 3 == 0, F.date_add(day, 1)).alias("accounting_date"),
        F.when(n % 20 == 0, "voided").when(n % 20 == 1, "reversed").when(n % 20 == 2, "proposed").otherwise("confirmed").alias("state"),
        F.when(n % 97 == 0, "invalidated").otherwise("complete").alias("lineage_state"),
    )
    return made.withColumn("dedupe_fingerprint", fingerprint(*[F.col(c) for c in ("financial_account_id", "amount", "company_id", "currency_code", "direction", "occurred_on", "reference_normalised")]))


def movement_sql(coarse: bool) -> str:
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
    account = "user_id % 15" if coarse else "user_id"
    amount = "CAST(floor(value / 10) * 10 + 10 AS DECIMAL(38,12))" if coarse else "CAST(value AS DECIMAL(38,12))"
    ref = f"{k} % 10" if coarse else k
    return f"""SELECT *, sha256('{{"account":"' || financial_account_id || '","amount":"' || CAST(amount AS VARCHAR) || '","company":"' || company_id || '","currency":"' || currency_code || '","direction":"' || direction || '","occurred_on":"' || CAST(occurred_on AS VARCHAR) || '","reference":"' || coalesce(reference_normalised, '') || '"}}') AS dedupe_fingerprint FROM (
SELECT CAST(event_id AS VARCHAR) AS movement_id, 'c1' AS company_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS dataset_version_id, CAST({account} AS VARCHAR) AS financial_account_id,
CASE WHEN event_type = 'purchase' THEN 'payment' ELSE 'other' END AS kind, {amount} AS amount, CASE ({account}) % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency_code,
CASE WHEN event_type IN ('purchase', 'error') THEN 'outflow' ELSE 'inflow' END AS direction, event_type || ' ' || {k} AS description, CASE WHEN event_id % 11 <> 0 THEN 'REF-' || ({ref}) END AS reference_normalised,
CAST(ts AS DATE) AS occurred_on, CASE WHEN event_id % 7 = 0 THEN CAST(ts AS DATE) + CAST(event_id % 45 AS INTEGER) END AS posted_on, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 1 END AS accounting_date,
CASE event_id % 20 WHEN 0 THEN 'voided' WHEN 1 THEN 'reversed' WHEN 2 THEN 'proposed' ELSE 'confirmed' END AS state, CASE WHEN event_id % 97 = 0 THEN 'invalidated' ELSE 'complete' END AS lineage_state FROM events)"""


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dataset versions: one each, with the states that the rules look at."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        n.cast("string").alias("dataset_version_id"),
        (n % 25).cast("string").alias("company_id"),
        F.col("o_custkey").cast("string").alias("data_source_id"),
        F.when(n % 5 == 0, "validated").when(n % 5 == 1, "staging").when(n % 5 == 2, "rejected").otherwise("published").alias("state"),
        F.when(n % 7 == 0, "mismatch").when(n % 7 == 1, "unknown").when(n % 7 == 2, "accepted_exception").otherwise("verified").alias("completeness_state"),
        F.when(n % 13 == 0, "invalidated").otherwise("complete").alias("lineage_state"),
        F.when(n % 9 == 0, n % 4).otherwise(0).cast("int").alias("rejected_count"),
        F.to_date("o_orderdate").alias("prepared_on"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
    )


DATASET_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS dataset_version_id, CAST(o_orderkey % 25 AS VARCHAR) AS company_id, CAST(o_custkey AS VARCHAR) AS data_source_id,
CASE o_orderkey % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'staging' WHEN 2 THEN 'rejected' ELSE 'published' END AS state,
CASE o_orderkey % 7 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'unknown' WHEN 2 THEN 'accepted_exception' ELSE 'verified' END AS completeness_state,
CASE WHEN o_orderkey % 13 = 0 THEN 'invalidated' ELSE 'complete' END AS lineage_state, CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 4 ELSE 0 END AS INTEGER) AS rejected_count,
CAST(o_orderdate AS DATE) AS prepared_on, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,12)) AS total FROM orders"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts with a bank and a books balance; of two in three the books follow from confirmed items."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    bank = F.col("c_acctbal").cast(MONEY)
    return c.select(
        k.cast("string").alias("statement_id"),
        F.col("c_nationkey").cast("string").alias("company_id"),
        F.element_at(F.array(F.lit("COP"), F.lit("USD"), F.lit("EUR")), (k % 3 + 1).cast("int")).alias("currency_code"),
        bank.alias("bank_closing_balance"),
        F.when(k % 3 == 0, bank).when(k % 3 == 1, bank + F.lit(25).cast(MONEY)).otherwise(bank - F.lit("0.01").cast(MONEY)).cast(MONEY).alias("books_closing_balance"),
    )


BALANCE_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CAST(c_nationkey AS VARCHAR) AS company_id, CASE c_custkey % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency_code,
CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12)) AS bank_closing_balance, CAST(CASE c_custkey % 3 WHEN 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12)) WHEN 1 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12)) + 25 ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12)) - 0.01 END AS DECIMAL(38,12)) AS books_closing_balance FROM customer"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciling items of the balances: an addition and a deduction, with defects in some, in decision versions."""
    b = balances(spark, sf_dir)
    k = F.col("statement_id").cast("long")
    two = b.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return two.select(
        F.concat_ws("-", "statement_id", F.col("n").cast("string")).alias("item_id"),
        F.when(k % 41 == 0, F.lit("other")).otherwise(F.col("statement_id")).alias("statement_id"),
        "company_id",
        F.when(k % 37 == 0, "GBP").otherwise(F.col("currency_code")).alias("currency_code"),
        F.when(F.col("n") == 1, "add_to_bank").otherwise("deduct_from_bank").alias("adjustment_side"),
        F.when(F.col("n") == 1, F.lit(35)).when(k % 29 == 0, F.lit(-10)).otherwise(F.lit(10)).cast(MONEY).alias("amount"),
        F.when(k % 3 == 1, "confirmed").otherwise("proposed").alias("state"),
        F.lit("ana").alias("prepared_by"),
        F.when(k % 31 == 0, "ana").otherwise("luis").alias("approved_by"),
        (k % 2 + 1).cast("int").alias("decision_version"),
    )


ITEM_SQL = """SELECT statement_id || '-' || n AS item_id, CASE WHEN CAST(statement_id AS BIGINT) % 41 = 0 THEN 'other' ELSE statement_id END AS statement_id, company_id,
CASE WHEN CAST(statement_id AS BIGINT) % 37 = 0 THEN 'GBP' ELSE currency_code END AS currency_code, CASE WHEN n = 1 THEN 'add_to_bank' ELSE 'deduct_from_bank' END AS adjustment_side,
CAST(CASE WHEN n = 1 THEN 35 WHEN CAST(statement_id AS BIGINT) % 29 = 0 THEN -10 ELSE 10 END AS DECIMAL(38,12)) AS amount,
CASE WHEN CAST(statement_id AS BIGINT) % 3 = 1 THEN 'confirmed' ELSE 'proposed' END AS state, 'ana' AS prepared_by, CASE WHEN CAST(statement_id AS BIGINT) % 31 = 0 THEN 'ana' ELSE 'luis' END AS approved_by,
CAST(CAST(statement_id AS BIGINT) % 2 + 1 AS INTEGER) AS decision_version FROM balance, (SELECT unnest([1, 2]) AS n)"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the cells of a statement's rows: date dmy, description, reference, debit, credit, signed value, direction word."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    units, rest = F.floor(cents / 100).cast("long").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    comma = F.concat(units, F.lit(","), rest)
    day = F.when(n % 50 == 0, "31/02/2026").when(n % 51 == 0, "3/4/26").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    signed = F.concat(F.when(n % 2 == 0, "-").otherwise(""), comma)
    return o.select(
        n.alias("record_ordinal"),
        F.array(
            day,
            F.when(n % 53 == 0, "  ").otherwise(F.col("o_orderpriority")),
            F.concat(F.lit(" ref  "), n.cast("string")),
            F.when(n % 2 == 0, comma).otherwise(""),
            F.when(n % 2 == 1, comma).when(n % 59 == 0, "1,23,45").otherwise(""),
            F.when(n % 61 == 0, "0,00").otherwise(signed),
            F.when(n % 2 == 0, "Cargo").otherwise("Abono"),
        ).alias("raw_values"),
    )


RAW_SQL = """SELECT o_orderkey AS record_ordinal, CASE WHEN o_orderkey % 50 = 0 THEN '31/02/2026' WHEN o_orderkey % 51 = 0 THEN '3/4/26' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS fecha,
CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE o_orderpriority END AS descripcion, 'ref  ' || o_orderkey AS referencia, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,12)) AS valor, CASE WHEN o_orderkey % 2 = 0 THEN con_coma ELSE '' END AS cargo, CASE WHEN o_orderkey % 2 = 1 THEN con_coma WHEN o_orderkey % 59 = 0 THEN '1,23,45' ELSE '' END AS abono,
CASE WHEN o_orderkey % 61 = 0 THEN '0,00' WHEN o_orderkey % 2 = 0 THEN '-' || con_coma ELSE con_coma END AS firmado, CASE WHEN o_orderkey % 2 = 0 THEN 'Cargo' ELSE 'Abono' END AS sentido FROM (SELECT *, replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS con_coma FROM orders)"""

#: Views that oracles may use, in the order in which they need each other.
SQL_VIEWS = {"movement": movement_sql(False), "movement_coarse": movement_sql(True), "dataset": DATASET_SQL, "balance": BALANCE_SQL, "item": ITEM_SQL, "raw_row": RAW_SQL}
NEEDS = {"item": ["balance"]}


def with_views(sql: str) -> str:
    """``sql`` with those views before it that it names."""
    used = [v for v in SQL_VIEWS if re.search(rf"\b{v}\b", sql)]
    used = [v for v in SQL_VIEWS if v in used or any(v in NEEDS.get(u, []) for u in used)]
    if not used:
        return sql
    views = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in used)
    if m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{views},\n{sql[m.end():]}"
    return f"WITH {views}\n{sql}"
