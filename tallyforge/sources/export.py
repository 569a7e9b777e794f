"""Exports: movements and reports as CSV of one form, and frames in a store that is partitioned by company."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_text
from ..functions.text import spreadsheet_safe

#: The columns of the canonical export, in order, and where the names of movements differ.
COLUMNS = ("record_ordinal", "movement_id", "occurred_on", "posted_on", "value_date", "accounting_date", "amount", "currency", "direction", "kind", "description", "reference", "state", "canonical_schema_version", "engine_release", "lineage_state")
NAMES = {"currency": "currency_code", "reference": "reference_normalised"}
#: Columns whose cells people wrote, and which a spreadsheet might run.
WRITTEN = ("description", "reference")
MOST_ROWS = 200_000


def export_rows(m: DataFrame) -> DataFrame:
    """Movements as the texts of the canonical form; a spreadsheet runs none of them."""

    def cell(c):
        name = c if c in m.columns else NAMES.get(c, c)
        if name not in m.columns:
            return F.lit("")
        text = money_text(F.col(name)) if c == "amount" else F.col(name).cast("string")
        return F.coalesce(spreadsheet_safe(text) if c in WRITTEN else text, F.lit(""))

    return m.select(*[cell(c).alias(c) for c in COLUMNS])


def preflight(datasets: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``dataset_version_id, row_count, refusal``: whether each dataset may be exported. It must be published, verified, complete in lineage and
    reproducible, without rejected rows, every record a movement, and of at most ``most`` rows."""
    whole = (
        (F.col("state") == "published") & (F.col("completeness_state") == "verified") & (F.col("lineage_state") == "complete") & F.coalesce("reproducible", F.lit(False))
        & (F.coalesce("rejected_count", F.lit(0)) == 0) & (F.coalesce("movement_count", F.lit(0)) == F.coalesce("record_count", F.lit(0)))
    )
    why = F.when(~F.coalesce(whole, F.lit(False)), "dataset-export-unavailable").when(F.col("movement_count") > most, "dataset-export-too-large")
    return datasets.select("dataset_version_id", F.col("movement_count").alias("row_count"), why.alias("refusal"))


def csv_line(columns: list[str]):
    """A row as a line of CSV, without its end: cells with a comma, a quote or a line's end in quotes."""
    quoted = lambda c: F.when(F.col(c).rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    return F.concat_ws(",", *[quoted(c) for c in columns])


def write_csv(df: DataFrame, order: list, path: str) -> int:
    """A file's parts, in order by name: the mark of UTF-8 and the header, then the rows by ``order``, with CRLF. Executors sort and write them; the
    parts one after the other are the file. Gives the number of rows, counted again from what was written."""
    spark = df.sparkSession
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    spark.createDataFrame([("\ufeff" + ",".join(df.columns) + "\r",)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    text.orderBy(*order).select(F.concat(csv_line(df.columns), F.lit("\r")).alias("line")).write.mode("overwrite").text(f"{path}/1-rows")
    return spark.read.csv(f"{path}/1-rows", multiLine=True, quote='"', escape='"').count()


def csv_bytes(path: str, size: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of the parts under a mounted ``path``, in order, a piece at a time."""
    for part in sorted(Path(path).glob("*/part-*")):
        with part.open("rb") as f:
            while piece := f.read(size):
                yield piece


def write_movements(m: DataFrame, path: str) -> None:
    """Movements by company and dataset; writing a dataset again replaces it and nothing else."""
    m.write.partitionBy("company_id", "dataset_version_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
