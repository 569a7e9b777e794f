"""A session with the settings that the library's results rest on, and the way of this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "tallyforge", **settings: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive plans; anything else is the cluster's own configuration."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that workers can import it wherever they start."""
    # a union of two sides that are one partition each passes for one partition in Spark 4.1, and a repartition after it may be left out
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package.name}", "zip", package.parent, package.name)
    sc.addPyFile(made)
    sc._tallyforge_shipped = True
