"""A corpus made ready for training, in five stages that each read what the one before wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame: documents with their columns, and at last the pieces of packed sequences.

toxicity      documents whose noisy-or score reaches the threshold go; learned from ``labels``
near_copies   of each group of near-copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest id
              stays; repeated rows count as copies
secrets       spans that hold a secret, encoded ones too, are replaced by a mark; n_chars follows
mixture       an over-represented source gives up documents until the target weights are met, in one epoch
packing       documents become pieces of sequences of 2048 tokens

Nulls in any column, empty texts and empty tables pass every stage; further columns of documents are kept by the first four.
"""

from __future__ import annotations

import atexit
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import copies, mixing, packing, secrets, toxicity
from tallyforge.llm.common import cut, read, removed, shared_folder, ship
from tallyforge.llm.queries import tokenizer

#: The mixture's weights, and the share of all tokens that it keeps.
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
SHARE, SEED = 0.9, 11


def stage(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def reject_toxic(spark, docs, sf_dir):
    weights = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    names = [f"{c}_" if c in ("score", "predicted") else c for c in docs.columns]
    return toxicity.scored(docs.toDF(*names), weights).where("predicted = 0").select(*names).toDF(*docs.columns)


@stage
def one_of_near_copies(spark, docs, sf_dir):
    # an id may have several texts, and a text of an id several rows, equal or not in other columns: the first of these stays
    row = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), copies.key()), 256).alias("row_key")
    first = docs.select(row, F.struct(*docs.columns).alias("row")).groupBy("row_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    stay = cut(copies.near_copies(docs.select("doc_id", "text"))).select(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "key"), 256).alias("row_key"))
    return first.join(stay, "row_key", "left_semi").select("row.*")


@stage
def without_secrets(spark, docs, sf_dir):
    clash = {"n_assign", "n_access", "n_hex", "base_spans", "spans"}
    names = [f"{c}_" if c in clash else c for c in docs.columns]
    clean = secrets.scan_secrets(docs.toDF(*names), redact=True).select(*names).toDF(*docs.columns)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def mixed(spark, docs, sf_dir):
    return mixing.mix_rows(docs, WEIGHTS, SHARE, SEED, mixing.domain_of_source())


@stage
def packed(spark, docs, sf_dir):
    return packing.pack(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", one_of_near_copies),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("packing", packed),
]

#: Training, decoding and packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    # the result is read from the last stage's folder; all of them go when the driver ends
    atexit.register(removed, spark, folder)
    return docs
