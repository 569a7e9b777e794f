"""Components of near members within shards, where large shards are dealt to several tasks and pairs already joined are not compared.

Members of a shard have a root, the one most like all others. The root asks first and joins up most of a group of near members;
then those ask that are not joined to it. Shards of many members are cut into blocks: each block is joined up by itself, the roots of all blocks
ask in all others, and then those that are still apart from the shard's largest group. So every pair of different groups is compared, no
shard is cut short, and none is held in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .components import components
from .simhash import Union

#: Members that ask at once.
ASKED = 64


class Shard:
    """Members by their distance ``far`` from the middle of all; ``comp`` tells which are joined already. Subclasses say which are candidates and
    which of these are alike."""

    def __init__(self, far: np.ndarray, comp: list[str]):
        self.far, self.root, self.union = far, int(far.argmin()), Union(len(far))
        if len({*comp}) < len(comp):
            _, first, of = np.unique(np.array(comp), return_index=True, return_inverse=True)
            self.union.add(np.arange(len(far)), first[of])

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one of ``asked`` and another member that may be alike."""
        raise NotImplementedError

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are alike to ``x``."""
        raise NotImplementedError

    def links(self, asked: np.ndarray, may: np.ndarray):
        """Pairs of one of ``asked`` and one of those that ``may`` be found, near-copies and not joined before."""
        for i in range(0, len(asked), ASKED):
            q, node = self.candidates(asked[i : i + ASKED])
            by = np.argsort(q, kind="stable")
            q, node = q[by], node[by]
            for x in asked[i : i + ASKED].tolist():
                others = node[np.searchsorted(q, x) : np.searchsorted(q, x, "right")]
                others = others[may[others] & (self.union.up[others] != self.union.up[x])]
                if len(others):
                    near = others[self.alike(x, others)]
                    # one link to each of the groups that are joined
                    near = near[np.unique(self.union.up[near], return_index=True)[1]]
                    self.union.add(np.full(len(near), x), near)
                    yield from ((x, int(y)) for y in near)

    def joined(self, foreign: np.ndarray):
        """Links that join up the members, or those that connect ``foreign`` members to the others."""
        if foreign.any():
            yield from self.links(np.flatnonzero(foreign), ~foreign)
            return
        all_ = np.ones(len(self.far), bool)
        yield from self.links(np.array([self.root]), all_)
        if len(all_) == 2:
            return
        # those near it first: who is joined to the root by then need not ask
        order = np.argsort(self.far, kind="stable")
        for i in range(0, len(order), ASKED):
            some = order[i : i + ASKED]
            yield from self.links(some[self.union.up[some] != self.union.up[self.root]], all_)


def linked(dealt: DataFrame, make) -> DataFrame:
    """``a, b`` of links between classes, and of each place its root as ``a`` and the place's shard as ``bucket``.

    ``dealt`` has place, foreign, class, comp, fp, bucket and found."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("place", "foreign", "class", "comp", "fp", "bucket", "found").repartition(parts, "place").sortWithinPartitions("place", "foreign", "class")

    def flush(held):
        foreign = np.concatenate([h[1].to_numpy(zero_copy_only=False) for h in held])
        names, comp = ([x for h in held for x in h[k].to_pylist()] for k in (2, 3))
        fps = np.concatenate([h[4].to_numpy() for h in held]).view(np.uint64)
        shard = make(fps, [x for h in held for x in h[6].to_pylist()], comp)
        found = [*shard.joined(foreign)]
        root = [] if foreign.any() else [names[shard.root]]
        a = [names[x] for x, _ in found] + root
        b = [names[y] for _, y in found] + [None] * len(root)
        bucket = [None] * len(found) + [held[0][5][0].as_py()] * len(root)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(bucket, pa.int64())], names=["a", "b", "bucket"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy()
            border = np.append(0, np.append(np.flatnonzero(np.diff(place)) + 1, len(place)))
            for a, b in zip(border[:-1], border[1:], strict=True):
                part = batch.slice(int(a), int(b - a)).columns
                if held and held[-1][0][-1].as_py() != part[0][0].as_py():
                    yield flush(held)
                    held = []
                held.append(part)
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "a string, b string, bucket long")


def sharded(placed: DataFrame, members: int, weight: int) -> DataFrame:
    """``class, fp, bucket, blocks, block`` of the rows ``class, size, fp, bucket`` whose bucket others share; a block has about so many members,
    and their sizes come to about ``weight``."""
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / members, F.col("total") / weight)).cast("int")
    found = placed.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    return cut(found.select("class", "fp", "bucket", "blocks", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block")))


def joined_classes(members: DataFrame, payload: DataFrame, make) -> DataFrame:
    """``class, comp`` of those that are joined to others; ``payload`` has class and found, what ``make(fps, found, comp)`` makes a Shard of."""
    place, no = F.xxhash64("bucket", "block").alias("place"), F.lit(False).alias("foreign")
    found = written(linked(members.select("*", place, no, F.col("class").alias("comp")).join(payload, "class"), make))
    links = found.where("b IS NOT NULL").select("a", "b")
    comps = named(links)
    crowded = members.where("blocks > 1")
    if crowded.isEmpty():
        return comps
    roots = found.where("b IS NULL").select(F.col("a").alias("class"), "bucket")
    for asks in ("roots", "apart"):
        of = written(crowded.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")))
        if asks == "roots":
            asking = of.join(roots.withColumn("asks", F.lit(True)), ["class", "bucket"], "left")
        else:
            # all but the shard's largest group
            groups = of.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
            largest = groups.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
            asking = of.join(largest, "bucket").withColumn("asks", F.col("comp") != F.col("largest"))
        # a member stands in its own block and, if it asks, in all others
        at = asking.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("asks OR to = block")
        at = at.withColumn("foreign", F.col("to") != F.col("block")).withColumn("place", F.xxhash64("bucket", "to"))
        # blocks that nobody asks have nothing to do
        dealt = at.join(at.where("foreign").select("place").distinct(), "place", "left_semi")
        links = written(links.unionByName(linked(dealt.join(payload, "class"), make).where("b IS NOT NULL").select("a", "b")))
        comps = named(links)
    return comps


def named(links: DataFrame) -> DataFrame:
    """``class, comp`` of those that links join; its plan ends here, so that the driver holds no more of them."""
    return written(components(links).select(F.col("node").alias("class"), F.col("component").alias("comp")))
