"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["STEP_CHARS", "by_step", "cut", "held_out", "read", "running", "shared_folder", "ship", "steps", "written"]

#: Characters of text that one numpy step holds at a time.
STEP_CHARS = 6_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where it names none, a temporary one does on a single machine only."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        folder = sc._jsc.sc().getCheckpointDir()
    return folder.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, and of known size to the planner. The tables go when
    the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its scratch folder with it
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def running(df: DataFrame, key: str, order: list, agg: Callable, cols: list[str], combine: Callable) -> DataFrame:
    """``df`` with ``<col>_before``: ``agg`` of ``col`` over the rows of the same key that stand before, for keys of any number of rows.

    Rows are dealt by ranges, of which a key may fill many; each range adds up its own rows, and what all ranges before hold of the key is one row a range."""
    names = [f"order_{k}_" for k in range(len(order))]
    dealt = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names, strict=True)], F.monotonically_increasing_id().alias("tie_"))
    dealt = written(dealt.repartitionByRange(key, *names, "tie_").withColumn("part_", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy(key, "part_").orderBy(*names, "tie_").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "part_").agg(*[agg(c).alias(f"{c}_all") for c in cols])
    sums = sums.select(key, "part_", *[F.coalesce(agg(f"{c}_all").over(earlier), F.lit(0)).alias(f"{c}_far") for c in cols])
    out = dealt.select("*", *[F.coalesce(agg(c).over(local), F.lit(0)).alias(f"{c}_near") for c in cols]).join(sums, [key, "part_"])
    return out.select(*df.columns, *[combine(F.col(f"{c}_far"), F.col(f"{c}_near")).alias(f"{c}_before") for c in cols])


def steps(lengths: list[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about ``most`` characters together."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 64
    if start < len(lengths):
        yield start, len(lengths)


def by_step(texts: str, work: Callable[[list[str], pa.RecordBatch], dict[str, list]]) -> Callable:
    """A mapInArrow function: null texts count as empty; ``work`` sees bounded steps of each batch."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(texts))
            lengths = pc.binary_length(column).fill_null(0).to_pylist()
            for a, b in steps(lengths):
                part = batch.slice(a, b - a)
                made = work([t or "" for t in column.slice(a, b - a).to_pylist()], part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()], names=list(made))

    return run
