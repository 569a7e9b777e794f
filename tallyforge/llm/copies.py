"""SimHash near-duplicates at a Jaccard similarity of word shingles, each link checked exactly.

Two texts are near-copies if the sets of their shingles of ``WIDTH`` words have a Jaccard similarity of 0.8 or more. At that
similarity SimHash fingerprints of 64 bits differ in some ten bits, too many for shards that agree in whole blocks of bits. So
shards are MinHash buckets: texts share one of ``BANDS`` buckets of ``ROWS`` minima each, which a pair at just 0.8
does with probability 1 - (1 - 0.8 ** 2) ** 8 = 0.9997. In a shard the fingerprints make a BK-tree, whose root is the text nearest to
the majority of all; searches follow the edges within ``RADIUS`` bits, which a pair at 0.8 exceeds with probability 0.0002, and what
they find is held to the exact similarity of the sets.

Texts of equal sets are one class. The root asks first and joins up most of a group of near-copies; then those ask that are
not joined to it, lightly edited ones first, and pairs already joined are not checked. Shards of many texts or shingles
are dealt to several tasks: each joins up its own block, the roots of all blocks ask in all others, and then
those that are still apart from the shard's largest group. So no shard is cut short, and none is held in one task.

Null texts count as empty; texts without words are one class. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, cut, written
from .shards import Shard, joined_classes, sharded
from .simhash import BITS, LOWER, WORDS, Forest

WIDTH = 5
BANDS, ROWS = 8, 2
#: Bits within which fingerprints are searched for.
RADIUS = 20
#: Members and shingles of a shard that one task holds.
MEMBERS, SHINGLES = 8192, 4_000_000


def key():
    """The hash that stands for a text."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def shingles(text: str, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = WORDS.findall(text.encode("utf-8", "replace").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def majority(found: np.ndarray) -> int:
    """The fingerprint of a set: each bit as most of its hashes have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << BITS[2 * ones > len(found)]).sum(dtype=np.uint64))


def name(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.astype("<u8").tobytes())


class MinHash:
    def __init__(self, seed: int = 45):
        rng = np.random.default_rng(seed)
        self.mask = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def buckets(self, found: np.ndarray) -> list[int]:
        if not len(found):
            return []
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(found), 1 << 16):
            some = (found[None, i : i + (1 << 16)] ^ self.mask[:, None]) * self.odd[:, None]
            least = np.minimum(least, some.min(axis=1))
        rows = least.reshape(BANDS, ROWS).astype("<u8")
        return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def classed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, class, size, fp, buckets`` of each row: its text's hash, its class, the size and fingerprint of its set and its shards."""

    def run(batches):
        hashes = MinHash()

        def work(texts, part):
            sets = [shingles(t) for t in texts]
            out = {c: part.column(part.schema.get_field_index(c)) for c in ("doc_id", "key")}
            out |= {"class": [name(s) for s in sets], "size": pa.array([len(s) for s in sets], pa.int32())}
            out["fp"] = np.array([majority(s) for s in sets], np.uint64).astype(np.int64)
            return out | {"buckets": pa.array([hashes.buckets(s) for s in sets], pa.list_(pa.int64()))}

        yield from by_step("text", work)(batches)

    type_ = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", key().alias("key"), "text").mapInArrow(run, f"doc_id {type_}, key string, class string, size int, fp long, buckets array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """``class, found``: the sets of these texts, as bytes."""

    def work(texts, part):
        sets = [shingles(t) for t in texts]
        return {"class": [name(s) for s in sets], "found": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())}

    return texts.select("text").mapInArrow(by_step("text", work), "class string, found binary").dropDuplicates(["class"])


class Sets(Shard):
    """Members by the fingerprints and sets of their texts; candidates come from a BK-tree whose root is the shard's."""

    def __init__(self, fps: np.ndarray, found: list[bytes], comp: list[str]):
        bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(axis=0)
        super().__init__(np.bitwise_count(fps ^ (np.uint64(1) << BITS[bits > 0.5]).sum(dtype=np.uint64)), comp)
        self.order = np.append(self.root, np.delete(np.arange(len(fps)), self.root))
        self.place = np.argsort(self.order)
        self.tree = Forest(np.zeros(len(fps), np.int64), fps[self.order])
        self.sets = [np.frombuffer(x, "<u8") for x in found]
        self.sizes = np.array([*map(len, self.sets)], np.int64)

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = [(self.order[q], self.order[node]) for q, node in self.tree.search(self.place[asked], RADIUS)]
        q, node = (np.concatenate(x) for x in zip(*met, strict=True))
        sized = 5 * np.minimum(self.sizes[q], self.sizes[node]) >= 4 * np.maximum(self.sizes[q], self.sizes[node])
        return q[sized], node[sized]

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        own, flat = self.sets[x], np.concatenate([self.sets[k] for k in others])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        sizes = self.sizes[others]
        common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        return 5 * common >= 4 * (sizes + len(own) - common)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose ``doc_id, key`` are among those of ``b``."""
    b = b.select(F.col("doc_id").alias("copy_id"), F.col("key").alias("copy_key"))
    return a.join(b, F.col("key").eqNullSafe(F.col("copy_key")) & F.col("doc_id").eqNullSafe(F.col("copy_id")), "left_semi")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, key``: for each group of near-copies the smallest id and, of its texts there, the smallest ``key()``."""
    marked = cut(classed(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    classes = cut(marked.groupBy("class").agg(first, F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("buckets").alias("buckets")))
    placed = classes.select("class", "size", "fp", F.explode("buckets").alias("bucket"))
    members = sharded(placed, MEMBERS, SHINGLES)
    needed = classes.join(members.select("class").distinct(), "class", "left_semi").select("least.doc_id", "least.key")
    sets = written(sets_of(same_rows(docs.select("doc_id", "text", key().alias("key")), needed)))
    comps = joined_classes(members, sets, Sets)
    joined = classes.select("class", "least").join(comps, "class", "left").select("class", "least", F.coalesce("comp", "class").alias("comp"))
    return joined.groupBy("comp").agg(F.min("least").alias("least")).select("least.doc_id", "least.key")
