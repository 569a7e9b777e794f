"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is logistic in its hashed words and word beginnings; a document's is the noisy-or of its sentences',
1 - prod(1 - p). Only document labels are known, so the noisy-or's likelihood is what training maximises; afterwards the sentence
scores show where a document offends.

Training takes a bounded sample of labelled texts: copies of a text under one label are one, and at most ``sample`` of these of each label are
expected, chosen by a hash of the text. Their hashed features, four bytes each, are what the driver fits the weights from; all weights together are of a fixed size.

Null and empty texts have no sentence and score the prior of such texts, 0. Repeated rows score alike. Labels without a document, null
labels and further labels of one id are left out (of several, the largest counts). Columns of the result's names are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, cut, held_out, read

SAMPLE = 2000
BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
#: Buckets, of all that a sample holds, that may at most be expected to become features by chance.
BY_CHANCE = 0.05
THRESHOLD = 0.7
REMEMBERED = 300_000
#: Words, and the marks that end a sentence.
TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]+")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """The buckets of a word and of its beginnings; 0 is kept for the sentence's own term."""
    return [1 + zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) for x in (f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n))]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, sentences without words left out."""
    out: list[list[str]] = [[]]
    for t in TOKENS.findall(text.lower()):
        if t[0] in ENDS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def telling(bad: np.ndarray, all_: np.ndarray, share: float) -> np.ndarray:
    """Whether a bucket in ``all_`` documents stands in more toxic ones (``bad``) than chance would have it. Chernoff's bound of that chance
    holds for samples of any size."""
    n = np.maximum(all_, 1)
    part = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(bad > 0, part * np.log(part / share), 0.0) + np.where(bad < all_, (1 - part) * np.log((1 - part) / (1 - share)), 0.0)
    return (part > share) & (all_ * gap > np.log(max(np.count_nonzero(all_), 1) / BY_CHANCE))


def fit(samples: list[tuple[int, list[np.ndarray]]], rounds: int = 120, rate: float = 0.3, decay: float = 2e-5) -> np.ndarray:
    """Weights that maximise the noisy-or likelihood, by AdaGrad over the whole sample."""
    weights = np.zeros(BUCKETS)
    weights[0] = -4.0
    if not samples or len({y for y, _ in samples}) < 2:
        weights[0] = 0.0 if samples and samples[0][0] else -20.0
        return weights
    y = np.array([y for y, _ in samples], float)
    # only buckets that toxic documents hold more often than chance would have it can carry weight
    bad, all_ = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for toxic, doc in samples:
        held = np.unique(np.concatenate(doc))
        all_[held] += 1
        bad[held] += toxic
    usable = telling(bad, all_, y.mean())
    sets = [s[usable[s]] for _, doc in samples for s in doc]
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    doc_of = np.repeat(np.arange(len(samples)), [len(d) for _, d in samples])
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    memory = np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        z = np.clip(weights[0] + np.bincount(of, weights[flat], len(sets)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        quiet = -np.bincount(doc_of, np.logaddexp(0, z), len(samples))  # log of prod(1 - p)
        none = np.exp(quiet)
        # d log-likelihood / dz of a sentence: -p in clean documents, p * none / (1 - none) in toxic ones
        g = share[doc_of] * p * np.where(y[doc_of] > 0, none[doc_of] / np.maximum(1 - none[doc_of], 1e-12), -1.0)
        grad = np.bincount(flat, g[of], BUCKETS) / len(samples)
        grad[0] = g.sum() / len(samples)
        grad -= decay * weights
        memory += grad * grad
        weights += rate * grad / np.sqrt(memory)
    return weights


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id_")).agg(F.max(label).cast("int").alias("y"))
    named = docs.select(F.col(doc_id).alias("id_"), F.xxhash64(text).alias("hash_"))
    # a text under a label is one, however many rows and ids hold it
    texts = cut(named.join(known, "id_").groupBy("hash_", "y").agg(F.min("id_").alias("id_")))
    rates = {r.y: min(1.0, sample / r.n) for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return fit([])
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(r)) for y, r in rates.items()])
    chosen = texts.where(F.shiftrightunsigned(F.xxhash64("hash_"), 11) / F.lit(float(1 << 53)) < rate)
    # the sample's size is bounded, whatever the tables' sizes
    held = docs.select(F.col(doc_id).alias("id_"), F.xxhash64(text).alias("hash_"), F.col(text).alias("text_"))
    picked = held.join(F.broadcast(chosen), ["id_", "hash_"]).groupBy("hash_", "y").agg(F.min("text_").alias("text_")).select("y", "text_")

    def extract(batches):
        for batch in batches:
            y, bags = [], []
            for label_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y.append(label_)
                parts = [np.unique(np.array([b for w in s for b in features(w)], "<i4")) for s in sentences(t or "")]
                bags.append([p.tobytes() for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(bags, pa.list_(pa.binary()))], names=["y", "bags"])

    rows = picked.mapInArrow(extract, "y int, bags array<binary>").collect()
    rows = sorted(((r.y, [bytes(b) for b in r.bags]) for r in rows), key=lambda r: (r[0], len(r[1]), r[1][:1]))
    return fit([(y, [np.frombuffer(b, "<i4") for b in bags]) for y, bags in rows if bags])


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD, locate: bool = False) -> DataFrame:
    """``docs`` with score and predicted and, where asked for, offending: number (from 0) and score of each sentence at or over
    the threshold, sentences without words not counted; the text stays."""
    new = {"score": "double", "predicted": "int"} | ({"offending": "array<struct<sentence:int,score:double>>"} if locate else {})
    keep = [c for c in docs.columns if c not in new]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in new.items()])
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        weights = shared.value
        memory: dict[str, float] = {}

        def work(texts, part):
            found = [TOKENS.findall(t.lower()) for t in texts]
            unmet = {w for ws in found for w in ws}
            if len(memory) + len(unmet) > REMEMBERED:
                memory.clear()
            for w in unmet:
                if w not in memory:
                    memory[w] = np.nan if w[0] in ENDS else float(weights[features(w)].sum())
            sizes = np.array([len(ws) + 1 for ws in found], np.int64)
            value = np.fromiter((x for ws in found for x in (*map(memory.__getitem__, ws), np.nan)), float, int(sizes.sum()))
            end = np.isnan(value)
            number = np.cumsum(end) - end
            many = np.bincount(number, ~end)
            z = np.bincount(number, np.where(end, 0.0, value)) + float(weights[0])
            doc_of = np.repeat(np.arange(len(texts)), sizes)[end]
            real = many > 0
            z, doc_of = z[real], doc_of[real]
            score = -np.expm1(-np.bincount(doc_of, np.logaddexp(0, z), len(texts)))
            score = np.clip(score, 0.0, 1.0)
            out = {c: part.column(part.schema.get_field_index(c)) for c in keep}
            out["score"], out["predicted"] = score, (score >= threshold).astype(np.int32)
            if locate:
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                starts = np.searchsorted(doc_of, np.arange(len(texts) + 1))
                out["offending"] = pa.array([[{"sentence": int(i), "score": float(p[a + i])} for i in np.flatnonzero(p[a:b] >= threshold)] for a, b in zip(starts[:-1], starts[1:])], pa.list_(pa.struct({"sentence": pa.int32(), "score": pa.float64()})))
            return out

        yield from by_step(text, work)(batches)

    return docs.select(keep).mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 3, 1))
    weights = learn(docs.where(~F.col("held_out")), read(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    return scored(docs, weights).drop("text")
