"""Latest row per key, pages and keysets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``. Give a total order: ties would be settled by chance."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """One page of a stable order; limits are clamped to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def with_one_more(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows and a column that tells whether there are more."""
    rows = df.orderBy(*order).limit(limit + 1)
    numbered = rows.withColumn("place_", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("truncated", F.max("place_").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("place_") <= limit).drop("place_")


def after(df: DataFrame, columns: list[str], values: list, limit: int, backwards: bool = False) -> DataFrame:
    """The rows after a cursor in the descending order of ``columns`` (before it, if ``backwards``), nearest first."""
    here, cursor = F.struct(*[F.col(c) for c in columns]), F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, values, strict=True)])
    if backwards:
        return df.where(here > cursor).orderBy(*[F.col(c).asc() for c in columns]).limit(limit)
    return df.where(here < cursor).orderBy(*[F.col(c).desc() for c in columns]).limit(limit)


def next_version(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))
