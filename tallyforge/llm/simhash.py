"""SimHash near-duplicates through sharded BK-trees.

A text's fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word shingles. Cut into k blocks, fingerprints
within ``radius`` bits agree wholly in some ``k - radius`` of them, so the distinct fingerprints that share the values of such a
choice of blocks make a shard, and every pair in reach meets in a shard. k is ``radius + 1`` for as long as shards are small and
grows with the number of fingerprints: more choices, but of more bits each. A shard that is crowded all the same is cut by the same rule
over the bits that its members need not share yet, and so on; as each cut leaves fewer free bits, every shard ends small, and no link is lost.
A shard is indexed as a BK-tree: each child hangs on its parent by the integer Hamming
distance between them, and a search at distance d from a node follows only the edges from d - radius to d + radius. Each task returns
only the links that its trees' components need, at most one less than their members; Spark joins these up.

The trees travel with the shuffle that brings a shard together, not as one broadcast of all trees: those grow with the corpus.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and ids link by their fingerprint. Columns of
the result's names are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, cut, read
from .components import components

RADIUS = 3
#: Members over which a shard is cut into finer ones.
CROWDED = 1024
#: Blocks over ``radius`` that fingerprints are cut into at most; 3 over a radius of 3 are 20 choices of 32 bits.
MOST_OVER = 3
#: (search, node) pairs that one numpy step holds.
FRONTIER = 1_000_000
#: The words of a text, once its A-Z are lower case.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    words = WORDS.findall(text.encode("utf-8", "replace").translate(LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << BITS[2 * ones > len(hashes)]).astype(np.uint64).sum()) if (2 * ones > len(hashes)).any() else 0


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long ``fp``."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["fp long"])

    def work(texts, part):
        fp = np.array([fingerprint(t, width) for t in texts], np.uint64).astype(np.int64)
        return {c: part.column(part.schema.get_field_index(c)) for c in keep} | {"fp": pa.array(fp)}

    return docs.select(*keep, text).mapInArrow(by_step(text, work), schema)


class Forest:
    """The BK-trees of several shards, as arrays: nodes 0 to n-1, each the child of a node at a distance, or a shard's root."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        n = len(fps)
        self.fps, self.root_of = fps, np.zeros(n, np.int64)
        edge = np.full(n, -1, np.int64)
        order = np.argsort(shard, kind="stable")
        _, group = np.unique(shard[order], return_inverse=True)
        first = True
        while len(order):
            head = np.append(True, group[1:] != group[:-1])
            node = order[np.flatnonzero(head)[np.cumsum(head) - 1]]  # the group's first is its node
            if first:
                self.root_of[order], first = node, False
            rest = ~head
            order, node = order[rest], node[rest]
            d = np.bitwise_count(fps[order] ^ fps[node]).astype(np.int64)
            edge[order] = group = node * 128 + d
            by = np.argsort(group, kind="stable")
            order, group = order[by], group[by]
        self.child = np.argsort(edge, kind="stable")
        self.child = self.child[edge[self.child] >= 0]
        self.edge = edge[self.child]

    def search(self, asked: np.ndarray, radius: int):
        """Pairs of a member of ``asked`` and a node of its own shard's tree within ``radius``."""
        q, node = asked, self.root_of[asked]
        stack = [(q, node)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[FRONTIER:], node[FRONTIER:])]
                q, node = q[:FRONTIER], node[:FRONTIER]
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.edge, node * 128 + np.maximum(d - radius, 1))
            hi = np.searchsorted(self.edge, node * 128 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            if total := int(many.sum()):
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(total)
                stack.append((np.repeat(q, many), self.child[at]))


class Union:
    """Components of numbered members; the smallest member names its component."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            other = a != b
            a, b = np.minimum(a, b)[other], np.maximum(a, b)[other]
            if len(a):
                np.minimum.at(self.up, b, a)
                while (self.up[self.up] != self.up).any():
                    self.up = self.up[self.up]


def shard_links(shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up the members ``fps`` of whole shards."""
    forest, union = Forest(shard, fps), Union(len(fps))
    for i in range(0, len(fps), FRONTIER):
        for q, node in forest.search(np.arange(i, min(i + FRONTIER, len(fps))), radius):
            other = q != node
            union.add(q[other], node[other])
    tied = np.flatnonzero(union.up != np.arange(len(fps)))
    return fps[tied], fps[union.up[tied]]


def choices(over: int, radius: int) -> list[int]:
    """Masks of every ``over`` blocks out of ``over + radius``, the blocks of 64 bits as even as can be."""
    cuts = [64 * k // (over + radius) for k in range(over + radius + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(blocks, over)]


def blocks_over(fingerprints: int, radius: int) -> int:
    """The fewest blocks over ``radius`` for which a shard is expected to be no crowd."""
    return next((k for k in range(1, MOST_OVER) if fingerprints >> (64 * k // (k + radius)) < CROWDED), MOST_OVER)


def finer(mask: int, radius: int) -> list[int]:
    """Masks that add a part of the free bits to ``mask`` each: of those that agree in ``mask`` and within ``radius``, any two agree in one."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def recut(members: DataFrame, radius: int) -> DataFrame:
    """``fp, mask, value`` of crowded shards' members, in finer shards."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, mask = (batch.column(k).to_numpy() for k in range(2))
            kinds, which = np.unique(mask, return_inverse=True)
            new = np.array([[signed(m) for m in finer(int(k) % (1 << 64), radius)] for k in kinds.tolist()], np.int64)[which]
            fp = np.repeat(fp, radius + 1)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(new.ravel()), pa.array(fp & new.ravel())], names=["fp", "mask", "value"])

    # different cuts may end in the same mask
    return members.select("fp", "mask").mapInArrow(run, "fp long, mask long, value long").distinct()


def link_table(distinct: DataFrame, radius: int = RADIUS, over: int | None = None) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` of one column, enough for their components."""
    masks = choices(over or blocks_over(distinct.count(), radius), radius)
    blocks = F.array(*[F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for m in masks])
    members = distinct.select("fp", F.explode(blocks).alias("at")).select("fp", "at.mask", "at.value")
    dealt = None
    while True:
        sizes = cut(members.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"))
        # what is left when all bits are shared is one fingerprint
        crowd = F.col("n") > CROWDED
        small = members.join(sizes.where(~crowd).drop("n"), ["mask", "value"])
        dealt = small if dealt is None else dealt.unionByName(small)
        if sizes.where(crowd).isEmpty():
            break
        members = cut(recut(members.join(sizes.where(crowd).drop("n"), ["mask", "value"]), radius))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(F.xxhash64("mask", "value").alias("shard"), "fp").repartition(parts, "shard").sortWithinPartitions("shard", "fp")

    def run(batches):
        def flush(kept):
            if not kept:
                return
            shard, fps = (np.concatenate(x) for x in zip(*kept, strict=True))
            a, b = shard_links(shard, fps.view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            kept.append(new)
            # whole shards go; the last one may continue in the next batch
            last = new[0][-1]
            if new[0][0] != last:
                k = int(np.searchsorted(new[0], last))
                kept[-1] = tuple(c[:k] for c in new)
                yield from flush(kept)
                kept = [tuple(c[k:] for c in new)]
        yield from flush(kept)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` without its text, with fp and component_id, the smallest id that links of at most ``radius`` bits reach."""
    marked = cut(fingerprints(docs.drop("component_id"), text, width))
    distinct = cut(marked.groupBy("fp").agg(F.min(doc_id).alias("least")))
    comp = components(link_table(distinct.select("fp"), radius))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp")


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
