"""Mapping of statement rows to movements: a declared mapping becomes expressions; every row ends up as a movement or a rejection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import CURRENCIES, MONEY, let, parse_money
from ..functions.parsing import normalised_amount, parse_date, parse_direction
from ..functions.text import normalised_reference, stripped
from .rounds import running

FIELDS = ("occurred_on", "description", "reference", "amount", "debit", "credit", "direction", "currency")
MODES = {"debit_credit_columns": ("debit", "credit"), "signed_amount": ("amount",), "explicit_direction": ("amount", "direction")}


@dataclass(frozen=True)
class ColumnMapping:
    """How a file is read: places of columns, conventions of dates and decimals, currency, and where direction stands."""

    columns: dict[str, int]
    date_format: str
    decimal_format: str
    currency: str
    direction_mode: str
    header_row: int = 1
    first_data_row: int = 2
    last_data_row: int | None = None
    ignored: tuple[int, ...] = field(default_factory=tuple)


def mapping_findings(m: ColumnMapping, profile: list[dict] | None = None, decisions: dict[int, str] | None = None) -> list[tuple[str, str]]:
    """(code, place) for all that keeps a mapping from use. ``profile`` has index and inferred_type of each column; an ambiguous column
    stays a finding until ``decisions`` says the convention that the mapping declares."""
    out = [("unknown_field", f) for f in m.columns if f not in FIELDS]
    out += [("missing_field", f) for f in ("occurred_on", "description", *MODES.get(m.direction_mode, ())) if f not in m.columns]
    out += [("direction_mode", m.direction_mode)] * (m.direction_mode not in MODES)
    out += [("date_format", m.date_format)] * (m.date_format not in ("iso", "dmy", "mdy"))
    out += [("decimal_format", m.decimal_format)] * (m.decimal_format not in ("dot", "comma"))
    out += [("currency", m.currency)] * (m.currency.strip().upper() not in CURRENCIES)
    out += [("negative_column", f) for f, i in m.columns.items() if i < 0]
    places = list(m.columns.values())
    out += [("column_used_twice", f) for f, i in m.columns.items() if places.count(i) > 1]
    out += [("ignored_and_mapped", f) for f, i in m.columns.items() if i in m.ignored]
    out += [("header_row", str(m.header_row))] * (m.header_row < 1)
    out += [("first_data_row", str(m.first_data_row))] * (m.first_data_row <= m.header_row)
    out += [("last_data_row", str(m.last_data_row))] * (m.last_data_row is not None and m.last_data_row < m.first_data_row)
    for c in profile or ():
        wanted = {"ambiguous_date": m.date_format, "ambiguous_numeric": m.decimal_format}.get(c["inferred_type"])
        if wanted and c["index"] in places and (decisions or {}).get(c["index"]) != wanted:
            out.append(("undecided_column", str(c["index"])))
    if profile is not None:
        out += [("column_missing_in_file", f) for f, i in m.columns.items() if i >= len(profile)]
        out += [("column_unaccounted", str(c["index"])) for c in profile if c["index"] not in places and c["index"] not in m.ignored]
    return out


def cell(m: ColumnMapping, name: str, values: str = "raw_values") -> Column:
    """The text of a mapped column; short rows have nothing there."""
    if name not in m.columns:
        return F.lit("")
    return F.coalesce(F.get(F.col(values), F.lit(m.columns[name])), F.lit(""))


def amount_and_direction(m: ColumnMapping) -> Column:
    """A struct of amount, direction and error, as the mapping's mode has them."""
    answer = lambda amount, direction, error: F.struct(amount.cast(MONEY).alias("amount"), direction.alias("direction"), error.alias("error"))
    money = lambda raw, body: let(normalised_amount(raw, m.decimal_format), lambda t: let(parse_money(t["value"]), lambda v: body(v["value"], F.coalesce(t["error"], v["error"]))))
    if m.direction_mode == "debit_credit_columns":

        def sides(x: Column) -> Column:
            debit, credit = x["debit"], x["credit"]
            both = F.when((debit != "") & (credit != ""), "debit_and_credit").when((debit == "") & (credit == ""), "neither_debit_nor_credit")
            return money(F.when(debit != "", debit).otherwise(credit), lambda v, e: answer(v, F.when(debit != "", "outflow").otherwise("inflow"), F.coalesce(both, e, F.when(v < 0, "signed_debit_or_credit"))))

        return let(F.struct(stripped(cell(m, "debit")).alias("debit"), stripped(cell(m, "credit")).alias("credit")), sides)
    if m.direction_mode == "signed_amount":
        return money(cell(m, "amount"), lambda v, e: answer(F.abs(v), F.when(v < 0, "outflow").otherwise("inflow"), e))
    return let(parse_direction(cell(m, "direction")), lambda w: money(cell(m, "amount"), lambda v, e: answer(v, w["value"], F.coalesce(e, w["error"], F.when(v < 0, "sign_contradicts_direction")))))


def mapped(rows: DataFrame, m: ColumnMapping) -> DataFrame:
    """Rows (record_ordinal, raw_values) with their movement's columns and ``reject_reason``, the first thing that is wrong."""
    if found := mapping_findings(m):
        raise ValueError(f"the mapping cannot be used: {found}")
    inside = F.col("record_ordinal") >= m.first_data_row
    if m.last_data_row is not None:
        inside = inside & (F.col("record_ordinal") <= m.last_data_row)
    description = F.substring(stripped(cell(m, "description")), 1, 500)
    reference = F.nullif(F.substring(stripped(cell(m, "reference")), 1, 120), F.lit(""))

    def row(x: Column) -> Column:
        reason = F.coalesce(x["day"]["error"], F.when(x["description"] == "", "description_missing"), x["money"]["error"], F.when(x["money"]["amount"] == 0, "amount_zero"))
        return F.struct(
            x["day"]["value"].alias("occurred_on"), x["description"].alias("description"), x["reference"].alias("reference_original"), normalised_reference(x["reference"]).alias("reference_normalised"),
            F.when(x["money"]["error"].isNull(), x["money"]["amount"]).alias("amount"), F.lit(m.currency.strip().upper()).alias("currency_code"), x["money"]["direction"].alias("direction"), reason.alias("reject_reason"),
        )

    cells = F.struct(parse_date(cell(m, "occurred_on"), m.date_format).alias("day"), description.alias("description"), reference.alias("reference"), amount_and_direction(m).alias("money"))
    return rows.where(inside).select("record_ordinal", F.inline(F.array(let(cells, row))))


def accepted(out: DataFrame) -> DataFrame:
    return out.where("reject_reason IS NULL").drop("reject_reason")


def rejected(out: DataFrame) -> DataFrame:
    return out.where("reject_reason IS NOT NULL").select("record_ordinal", "reject_reason")


def preview(rows: DataFrame, m: ColumnMapping, limit: int = 25) -> DataFrame:
    """The first rows as they would be mapped; nothing is written."""
    return mapped(rows.where(F.col("record_ordinal") >= m.first_data_row).orderBy("record_ordinal").limit(limit), m)


def violations(m: DataFrame) -> DataFrame:
    """Movements that break a rule of the table, with the rules broken."""
    broken = F.array_compact(F.array(
        F.when(F.coalesce(F.col("amount") <= 0, F.lit(True)), "amount_not_positive"),
        F.when(F.col("posted_on") < F.col("occurred_on"), "posted_before_occurred"),
        F.when(~F.col("direction").isin("inflow", "outflow"), "direction"),
        F.when(~F.length("description").between(1, 500), "description_length"),
    ))
    return m.select("movement_id", broken.alias("broken")).where(F.size("broken") > 0)


def versions_in_force(versions: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, template_id, version`` of each file (file_id, schema_digest, uploaded_on): the version of its schema that was the last to be validated by then.

    ``versions`` has template_id, version, schema_digest, validated_on, state (draft, validated or frozen), ambiguities and decisions. A draft maps nothing, nor does a version with
    an ambiguity that nobody decided; a frozen version is its template's last. Files and versions of a schema are put in one order, and
    the last version carried on, so that no file meets all versions."""
    frozen = versions.where("state = 'frozen'").groupBy("template_id").agg(F.min("version").alias("last"))
    live = versions.join(frozen, "template_id", "left").where("state IN ('validated', 'frozen') AND decisions >= ambiguities AND (last IS NULL OR version <= last) AND schema_digest IS NOT NULL")
    known = live.select("schema_digest", F.col("validated_on").alias("at"), F.lit(0).alias("kind"), F.struct("validated_on", "template_id", "version").alias("valid"))
    asks = files.where("schema_digest IS NOT NULL").select("schema_digest", F.col("uploaded_on").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(known.schema["valid"].dataType).alias("valid"), "file_id")
    both = known.withColumn("file_id", F.lit(None).cast(asks.schema["file_id"].dataType)).unionByName(asks)
    met = running(both, "schema_digest", [F.col("at"), F.col("kind")], F.max, "valid", lambda a, b: F.when(a >= b, a).otherwise(b))
    return met.where("kind = 1 AND valid_before IS NOT NULL").select("file_id", "valid_before.template_id", "valid_before.version")
