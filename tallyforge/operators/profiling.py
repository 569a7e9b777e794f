"""Profiles of files' columns: counts, lengths, kinds; never the values themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import classify
from ..functions.text import stripped

NUMERIC = ("integer", "decimal_dot", "decimal_comma", "ambiguous_numeric")
DATES = ("date_iso", "date_dmy", "date_mdy", "ambiguous_date")
MOST_ROWS = 200_000


def kinds(rows: DataFrame, values: str = "raw_values", keys: tuple[str, ...] = ()) -> DataFrame:
    """``index, kind`` and length of each cell; an empty cell's kind is empty."""
    cells = rows.select(*keys, F.posexplode(values).alias("index", "cell")).withColumn("cell", stripped(F.coalesce("cell", F.lit(""))))
    return cells.select(*keys, "index", F.when(F.col("cell") == "", "empty").otherwise(classify(F.col("cell"))).alias("kind"), F.length("cell").alias("length"))


def columns(rows: DataFrame, values: str = "raw_values", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each column: how many cells are filled, their lengths, the kinds seen, the kind it has and how surely.

    Cells are counted by kind first; kinds are few, so the second step's groups are small.
    """
    by = [*keys, "index"]
    counted = kinds(rows, values, keys).groupBy(*by, "kind").agg(F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("most"))
    some = F.col("kind") != "empty"
    has = lambda k: F.bool_or(F.col("kind") == k)
    only = lambda ks: F.bool_and(~some | F.col("kind").isin(*ks))
    one = lambda a, b: F.when(has(a) & ~has(b), a).when(has(b) & ~has(a), b)
    largest = F.max_by(F.when(some, F.col("kind")), F.when(some, F.struct("n", "kind")))
    inferred = (
        F.when(~F.bool_or(some), "empty")
        .when(only(NUMERIC) & has("ambiguous_numeric"), F.coalesce(one("decimal_dot", "decimal_comma"), F.lit("ambiguous_numeric")))
        .when(only(DATES) & has("ambiguous_date"), F.coalesce(one("date_dmy", "date_mdy"), F.lit("ambiguous_date")))
        .otherwise(largest)
    )
    filled = F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0))
    out = counted.groupBy(*by).agg(
        filled.alias("non_empty"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("empty"), F.coalesce(F.min(F.when(some, F.col("least"))), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.when(some, F.col("most"))), F.lit(0)).alias("max_length"), inferred.alias("inferred_type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("observed"),
    )
    share = F.when(F.col("non_empty") == 0, F.lit(0.0)).otherwise(F.round(F.coalesce(F.try_element_at("observed", F.col("inferred_type")), F.lit(0)) / F.col("non_empty"), 4))
    return out.withColumn("type_confidence", share).withColumn("ambiguous", F.col("inferred_type").isin("ambiguous_numeric", "ambiguous_date"))


def table_profile(rows: DataFrame, values: str = "raw_values") -> DataFrame:
    """Rows, columns, ragged rows and whether the file goes on beyond what a profile reads. Wide rows make columns."""
    width = F.size(values)
    widest = rows.agg(F.max(width).alias("column_count"))
    sizes = rows.groupBy(width.alias("width")).agg(F.count("*").alias("n"))
    ragged = F.coalesce(F.sum(F.when(F.col("width") != F.col("column_count"), F.col("n"))), F.lit(0))
    return sizes.crossJoin(F.broadcast(widest)).agg(F.least(F.sum("n"), F.lit(MOST_ROWS)).alias("row_count"), F.max("column_count").alias("column_count"), ragged.alias("ragged_rows"), (F.sum("n") > MOST_ROWS).alias("truncated"))


def looks_like_header(row: Column) -> Column:
    """Filled, different texts: a row with numbers or dates is data."""
    names = F.transform(row, lambda c: F.lower(stripped(c)))
    return (F.size(row) > 0) & F.forall(names, lambda c: (c != "") & (classify(c) == "text")) & (F.size(F.array_distinct(names)) == F.size(row))


def clean_header(c: Column, index: Column) -> Column:
    bare = F.substring(stripped(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")), 1, 120)
    return F.when(bare == "", F.concat(F.lit("columna_"), (index + 1).cast("string"))).otherwise(bare)


def delimiter(lines: Column) -> Column:
    """Of the candidates the one that most lines have as often as the first; U+001F where none is in the first line."""
    some = F.slice(F.filter(lines, lambda x: stripped(x) != ""), 1, 20)

    def score(n: int, mark: str) -> Column:
        count = lambda x: F.length(x) - F.length(F.translate(x, mark, ""))
        first = count(F.get(some, F.lit(0)))
        same = F.size(F.filter(some, lambda x: count(x) == first))
        return F.when(first > 0, F.struct(same.alias("same"), first.alias("first"), F.lit(-n).alias("order"), F.lit(mark).alias("mark")))

    scores = [score(n, mark) for n, mark in enumerate((",", ";", "\t", "|"))]
    return F.coalesce(F.array_max(F.array_compact(F.array(*scores)))["mark"], F.lit("\x1f"))
