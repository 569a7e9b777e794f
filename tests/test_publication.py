"""A dataset is there whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import publication
from tallyforge.session import ship

SCHEMA = "record_ordinal long, description string, reject_reason string"


def rows(spark, n=4500):
    return spark.range(n).select(F.col("id").alias("record_ordinal"), F.concat(F.lit("row "), F.col("id")).alias("description"), F.when(F.col("id") % 9 == 0, "no_date").alias("reject_reason"))


def test_only_what_is_conserved_is_written(spark, tmp_path):
    ship(spark)
    folder, df = str(tmp_path), rows(spark)
    with pytest.raises(publication.Refused, match="not_conserved"):
        publication.prepare(df.where("record_ordinal <> 17"), 4500, folder, "d")
    assert [*tmp_path.iterdir()] == []
    first = publication.prepare(df, 4500, folder, "d").first()
    assert (first.state, first.movements, first.rejected, first.chunks) == ("validated", 4000, 500, 3)
    # the order of rows and their parts is no part of the digest, what they hold is
    again = publication.prepare(df.repartition(5), 4500, folder, "d").first()
    assert (again.state, again.digest) == ("replayed", first.digest)
    with pytest.raises(publication.Refused, match="divergent"):
        publication.prepare(df.withColumn("description", F.when(F.col("record_ordinal") == 4000, "x").otherwise(F.col("description"))), 4500, folder, "d")
    assert publication.published_rows(spark, folder, "d").count() == 4500 and [p.name for p in tmp_path.iterdir()] == ["d"]
    assert publication.manifest(spark, folder, "other") is None


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    ship(spark)

    def dies(batches):
        for n, batch in enumerate(batches):
            yield batch
        raise RuntimeError("lost")

    df = rows(spark).repartition(4)
    broken = df.where("record_ordinal % 2 = 0").unionByName(df.where("record_ordinal % 2 = 1").mapInArrow(dies, SCHEMA))
    with pytest.raises(Exception, match="lost"):
        publication.prepare(broken, 4500, str(tmp_path), "d")
    assert [*tmp_path.iterdir()] == []
    assert publication.prepare(df, 4500, str(tmp_path), "d").first().state == "validated"


def test_empty_datasets(spark, tmp_path):
    ship(spark)
    with pytest.raises(publication.Refused):
        publication.prepare(rows(spark, 0), 3, str(tmp_path), "d")
    assert [*tmp_path.iterdir()] == []
