"""Membership and order in arrays, without holding an array of unbounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members_of(rows: DataFrame, id_: str, owners: DataFrame, array: str) -> DataFrame:
    """Rows whose id is an element of any owner's array."""
    return rows.join(owners.select(F.explode(array).alias(id_)).distinct(), id_, "left_semi")


def sequence_checks(rows: DataFrame, keys: list[str], order: str, value: Column, allowed: list[int]) -> DataFrame:
    """For each key whether its values, in ``order``, are all distinct, ascending, and among those allowed."""
    v = rows.select(*keys, F.col(order).alias("order_"), value.alias("v_"))
    v = v.withColumn("before_", F.lag("v_").over(Window.partitionBy(*keys).orderBy("order_")))
    return v.groupBy(*keys).agg(
        (F.count("*") == F.countDistinct("v_")).alias("all_distinct"),
        F.bool_and(F.coalesce(F.col("before_") <= F.col("v_"), F.lit(True))).alias("ordered"),
        F.bool_and(F.col("v_").isin(allowed)).alias("subset"),
    )


def present(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key others have."""
    return rows.join(others.select(key).distinct(), key, "left_semi")


def absent(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other has; a null key is nobody's."""
    return rows.join(others.select(key), key, "left_anti")


def two_way_difference(rows: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Keys that only the ledger's rows or only the store's objects have, each once."""
    a, b = rows.select(key).distinct(), objects.select(key).distinct()
    return absent(a, b, key).withColumn("side", F.lit("row_only")).unionByName(absent(b, a, key).withColumn("side", F.lit("object_only")))
