"""From mapped rows to published datasets: conservation, ordered digests, eligibility, blockers, idempotent writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import settled


def candidate_eligible() -> Column:
    return F.col("state").isin("validated", "published") & F.col("completeness_state").isin("verified", "accepted_exception") & (F.col("lineage_state") == "complete")


def report_eligible() -> Column:
    return (F.col("state") == "published") & (F.col("completeness_state") == "verified") & (F.col("lineage_state") == "complete")


def close_eligible() -> Column:
    return report_eligible() & (F.col("rejected_count") == 0)


def conservation(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every row of a dataset became a movement or a rejection."""
    sums = chunks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("expected", "movements", "rejected")])
    return sums.withColumn("conserved", F.col("movements") + F.col("rejected") == F.col("expected"))


#: Records of a block of an ordered digest, as bits of the ordinal, and levels of blocks below the dataset.
BLOCK_BITS, LEVELS = 12, 2


def ordered_digest(df: DataFrame, keys: list[str], ordinal: str, record: str) -> DataFrame:
    """The digest of a dataset's records in their order, and their number.

    The form is a tree: sha256 of the records of 4,096 ordinals, one after the other; of the digests of 4,096 such blocks; and of all of those. So no
    row holds more than a block, however large the dataset; repeated ordinals stand in the order of their records.
    """
    rows = df.select(*keys, F.col(ordinal).cast("long").alias("at_"), F.col(record).alias("text_"), F.lit(1).cast("long").alias("n_"))
    for _ in range(LEVELS):
        gathered = F.array_sort(F.collect_list(F.struct("at_", "text_")))
        text = F.array_join(F.transform(gathered, lambda x: x["text_"]), "")
        rows = rows.groupBy(*keys, F.shiftright("at_", BLOCK_BITS).alias("at_")).agg(F.sha2(text, 256).alias("text_"), F.sum("n_").alias("n_"))
    gathered = F.array_sort(F.collect_list(F.struct("at_", "text_")))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(gathered, lambda x: x["text_"]), ""), 256).alias("digest"), F.sum("n_").alias("records"))


def digest_levels(df: DataFrame, ordinal: str, record: str) -> list[DataFrame]:
    """``at, digest, records`` of blocks of 4,096 ordinals, of 4,096 such blocks, and so on up to one: the tree of ``ordered_digest`` for one dataset, kept by level."""
    rows = df.select(F.col(ordinal).cast("long").alias("at"), F.col(record).alias("digest"), F.lit(1).cast("long").alias("records"))
    out, most = [], None
    while most is None or most > 0:
        gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        rows = settled(rows.groupBy(F.shiftright("at", BLOCK_BITS).alias("at")).agg(F.sha2(gathered, 256).alias("digest"), F.sum("records").alias("records")))
        out.append(rows)
        most = rows.agg(F.max("at")).first()[0] or 0
    return out


def first_difference(a: DataFrame, b: DataFrame, a_levels: list[DataFrame], b_levels: list[DataFrame], ordinal: str, record: str) -> int | None:
    """The first ordinal at which two versions of a dataset differ, or one of them ends; None if they are the same.

    From the top down the first unequal block is found by the digests of a level, 4,096 at most below the one above; of the records themselves only those
    of one block are read, by a range of ordinals that the scan can push down."""
    low, high = 0, None

    def unequal(x, y, key, value):
        inside = lambda d: d.where(F.col(key) >= low) if high is None else d.where(F.col(key).between(low, high))
        one, two = inside(x).select(F.col(key).alias("k"), F.col(value).alias("v")), inside(y).select(F.col(key).alias("k"), F.col(value).alias("w"))
        return one.join(two, "k", "full_outer").where("NOT v <=> w").agg(F.min("k")).first()[0]

    deep = min(len(a_levels), len(b_levels))
    for level in reversed(range(deep)):
        at = unequal(a_levels[level], b_levels[level], "at", "digest")
        if at is None:
            return None
        low, high = at << BLOCK_BITS, ((at + 1) << BLOCK_BITS) - 1
    return unequal(a, b, ordinal, record)


def blockers(datasets: DataFrame) -> DataFrame:
    """``dataset_version_id, blocker``: why a dataset may not be published yet."""
    why = F.array_compact(F.array(
        F.when(F.col("state") != "validated", "not_validated"),
        F.when(F.col("completeness_state").isin("mismatch", "unknown"), "completeness_not_verified"),
        F.when(F.col("lineage_state") != "complete", "lineage_not_complete"),
        F.when(F.col("rejected_count") > 0, "rejected_rows"),
    ))
    return datasets.select("dataset_version_id", F.explode(why).alias("blocker"))


def fresh_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the store has not yet: what an idempotent write adds."""
    return incoming.dropDuplicates(keys).join(stored, keys, "left_anti")


def divergent(incoming: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose stored values are others than those that come in again: a write with any of these must stop."""
    old = stored.select(*keys, *[F.col(v).alias(f"stored_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"stored_{v}"))
    return incoming.join(old, keys).where(differs).select(*keys)


#: Records of a chunk, and what a publication may come to.
CHUNK = 2000
MANIFEST = "dataset string, state string, expected long, movements long, rejected long, chunks long, digest string"


class Refused(ValueError):
    """Why a dataset was not written; nothing of it stays."""


def paths(spark: SparkSession, *names: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    places = [jvm.Path(n) for n in names]
    return places[0].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), places


def manifest(spark: SparkSession, folder: str, dataset: str) -> DataFrame | None:
    fs, (place,) = paths(spark, f"{folder}/{dataset}/manifest")
    return spark.read.schema(MANIFEST).json(place.toString()) if fs.exists(place) else None


def prepare(mapped: DataFrame, expected: int, folder: str, dataset: str, ordinal: str = "record_ordinal", reason: str = "reject_reason") -> DataFrame:
    """Write a dataset's mapped rows under ``folder`` in two phases, and give its manifest.

    Tasks write their rows to a place that nobody reads, each committed by Spark once, whatever tasks are lost or tried again. Then what was written, and not what was meant to be, is
    read back: chunks of ``CHUNK`` records with their numbers and digests, and a digest of all. If movements and rejections are as many as the
    rows that came in, one rename makes it the dataset, in state validated; otherwise, and after any error, the place is cleared and nothing is left.
    A dataset that is there already stays as it is: the same digest is a replay, another is refused."""
    spark = mapped.sparkSession
    staging, final = f"{folder}/_staging-{uuid.uuid4().hex}", f"{folder}/{dataset}"
    fs, (from_, to) = paths(spark, staging, final)
    try:
        mapped.write.parquet(f"{staging}/rows")
        rows = spark.read.schema(mapped.schema).parquet(f"{staging}/rows")
        text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)]))
        kept = rows.select(F.lit(dataset).alias("dataset"), F.col(ordinal).alias("at"), F.sha2(text, 256).alias("record"), F.col(reason).isNull().alias("moves"))
        chunk = F.floor(F.col("at") / CHUNK)
        chunks = kept.groupBy("dataset", chunk.alias("chunk")).agg(F.count_if("moves").alias("movements"), F.count_if(~F.col("moves")).alias("rejected"), F.sha2(F.array_join(F.array_sort(F.collect_list("record")), ""), 256).alias("digest"))
        chunks.write.parquet(f"{staging}/chunks")
        chunks = spark.read.parquet(f"{staging}/chunks")
        digest = ordered_digest(chunks, ["dataset"], "chunk", "digest").select("dataset", "digest")
        sums = chunks.groupBy("dataset").agg(F.sum("movements").alias("movements"), F.sum("rejected").alias("rejected"), F.count("*").alias("chunks"))
        told = settled(sums.join(digest, "dataset").select("dataset", F.lit("validated").alias("state"), F.lit(expected).cast("long").alias("expected"), "movements", "rejected", "chunks", "digest"))
        row = told.first()
        if (row.movements + row.rejected if row else 0) != expected:
            raise Refused("not_conserved")
        old = manifest(spark, folder, dataset)
        if old is not None:
            if old.first().digest != row.digest:
                raise Refused("divergent")
            return old.withColumn("state", F.lit("replayed"))
        told.coalesce(1).write.json(f"{staging}/manifest")
        if not fs.rename(from_, to):
            raise Refused("taken")
        return manifest(spark, folder, dataset)
    finally:
        # after the rename there is nothing at that place
        fs.delete(from_, True)


def published_rows(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{dataset}/rows")
