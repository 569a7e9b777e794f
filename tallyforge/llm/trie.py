r"""A prefix trie of conversations, built as a Patricia trie.

Conversations are sequences of turns. They are sorted; from the common prefixes of sorted neighbours come the branch points, and with the points
where conversations end and the leaves these are all that is created, joined by compressed edges. Sums over subtrees are
worked out on this compressed tree, and unary nodes are expanded at last, each with the sum over its edge's suffix.

A turn is held as two hashes of 64 bits of its role, text and depth, and a node as the exclusive or of its turns' hashes (128 bits). Sequences
are cut into blocks of ``BLOCK`` turns, so that no row grows with a conversation: a block belongs to the node that it
starts from, blocks are sorted by that node and their turns, and a block's end is a point, too. Equal blocks are counted before
they are sorted. Sorted blocks lie in ranges, which one key of many blocks may fill in part; each range makes its own points and, besides, all
nodes of its first and its last block, which alone it can share with other ranges. Partial points of one node are then added up.
Subtree sums double the distance in each round, so that rounds grow with the logarithm of the compressed depth.

The ids of conversations that end at a node are hashed in ascending order by a stream over sorted rows, in bounded memory; SHA-256 takes them one after the other, so
that one task reads those of one node.

Rows without a conv_id take no part. Turns are ordered by ``turn``, null first; equal turns by the hashes of role and text, so that the result does not
depend on the order of rows; repeated rows are turns each. Null role and text are empty. Further columns are not used. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, running, written

#: Turns of a block.
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, a, b, words``: the turns in order, from 1, as hashes; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    placed = running(known, "conv_id", ["turn", "a", "b"], F.sum, ["one"], lambda x, y: x + y)
    return placed.select("conv_id", (F.col("one_before") + 1).alias("place"), "a", "b", "words")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share their beginnings: ``conv_id, depth, total, a, b, words`` of their turns, and ``conv_id, total`` of all, the
    turnless among them. The first h turns of conversation c - c % 20 stand for the first h of c, with h = crc32(c) % 4."""
    each = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    each = cut(each.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 4).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20))
    bases = each.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    each = each.join(bases, "base", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    each = cut(each.select("conv_id", "base", "h", "got", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    heads = placed.where("place <= 3").withColumnRenamed("conv_id", "base")
    taken = each.join(heads, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "total", "a", "b", "words")
    kept = placed.join(each, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("got")).alias("depth"), "total", "a", "b", "words")
    return taken.unionByName(kept), each.select("conv_id", "total")


def blocks(sequences: DataFrame) -> DataFrame:
    """``conv_id, j, p1, p2, z1, z2, words, last``: blocks of turns, each with the node that it starts from; ``last`` says whether the conversation ends in it."""
    turn = F.struct("depth", F.xxhash64("depth", "a", "b").alias("z1"), F.xxhash64("b", "depth", "a", F.lit(7)).alias("z2"), "words")
    cutted = sequences.select("conv_id", "total", F.floor((F.col("depth") - 1) / BLOCK).alias("j"), turn.alias("t"))
    held = cutted.groupBy("conv_id", "j").agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("total").alias("total"))
    xor = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, z: s.bitwiseXOR(z))
    held = held.select("conv_id", "j", *[F.col(f"t.{c}").alias(c) for c in ("z1", "z2", "words")], (F.col("total") <= (F.col("j") + 1) * BLOCK).alias("last"))
    held = held.withColumn("x1", xor("z1")).withColumn("x2", xor("z2"))
    out = running(held, "conv_id", ["j"], F.bit_xor, ["x1", "x2"], lambda x, y: x.bitwiseXOR(y))
    return out.withColumnRenamed("x1_before", "p1").withColumnRenamed("x2_before", "p2")


POINT = "depth long, k1 long, k2 long, up_depth long, up1 long, up2 long, n long, least long, ends long, words array<long>"


def points(batches, block: int):
    """Partial points of one range of sorted blocks, by a stack of the points above the block at hand."""
    names = [x.split()[0] for x in POINT.split(", ")]
    made: dict[str, list] = {c: [] for c in names}
    types = [pa.int64()] * 9 + [pa.list_(pa.int64())]

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in zip(names, types, strict=True)], names=names)
        for x in made.values():
            x.clear()
        return out

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("j", "p1", "p2", "z1", "z2", "words", "n", "least", "ends")), strict=True)

    def close(stack, to):
        """Points deeper than ``to`` are complete; the turns are those of the block before."""
        while stack[-1][0] > to:
            depth, n, least, ends = stack.pop()
            if stack[-1][0] < to:
                stack.append([to, 0, None, 0])
            above = stack[-1]
            above[1] += n
            above[2] = least if above[2] is None else min(above[2], least)
            up = above[0]
            for c, x in zip(names, (base + depth, k1[depth], k2[depth], base + up, k1[up], k2[up], n, least, ends, words[up:depth]), strict=True):
                made[c].append(x)

    group, stack, base, k1, k2, words, turns_ = None, [[0, 0, None, 0]], 0, [0], [0], [], []
    source = rows()
    row, first = next(source, None), True
    while row is not None:
        after = next(source, None)
        j, p1, p2, z1, z2, w, n, least, ends = row
        same = group == (j, p1, p2)
        z, common = [*zip(z1, z2, strict=True)], 0
        if same:
            for x, y in zip(z, turns_, strict=False):
                if x != y:
                    break
                common += 1
        close(stack, common)
        if not same:
            group, base, k1, k2, stack = (j, p1, p2), j * block, [p1], [p2], [[0, 0, None, 0]]
        turns_, words = z, w
        k1, k2 = k1[: common + 1], k2[: common + 1]
        for x, y in z[common:]:
            k1.append(k1[-1] ^ x)
            k2.append(k2[-1] ^ y)
        size = len(z)
        met = {p[0]: p for p in stack}
        # the first and the last block of a range make all their nodes
        stack = [met.get(d) or [d, 0, None, 0] for d in range(size + 1) if d in met or d == size or first or after is None]
        top = stack[-1]
        top[1] += n
        top[2] = least if top[2] is None else min(top[2], least)
        top[3] += ends
        if len(made["depth"]) > 10_000:
            yield flush()
        row, first = after, False
    close(stack, 0)
    yield flush()


def compressed(placed: DataFrame) -> DataFrame:
    """The points below the root, with their edges: ``POINT``."""
    equal = placed.groupBy("j", "p1", "p2", "z1", "z2").agg(F.min("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum(F.col("last").cast("long")).alias("ends"))
    order = ["j", "p1", "p2", "z1", "z2"]
    pieces = cut(equal).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(points, block=BLOCK), POINT)
    whole = pieces.groupBy("depth", "k1", "k2").agg(F.min("up_depth").alias("up_depth"), F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("ends").alias("ends"), F.min("words").alias("words"))
    return cut(whole)


def node(*names: str) -> Column:
    return F.struct(*[F.col(n).alias(c) for n, c in zip(names, ("depth", "k1", "k2"), strict=True)])


def zeros() -> list[Column]:
    return [F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")]


def summed(tree: DataFrame, cols: list[str]) -> DataFrame:
    """``id`` and the sums of ``cols`` over its subtree; ``tree`` has id, up (null for the root) and the columns."""
    at = tree
    while not at.where("up IS NOT NULL").isEmpty():
        lifted = at.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"{c}_more") for c in cols])
        after = at.where("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("then"))
        at = at.join(lifted, "id", "left").join(after, "up", "left")
        at = cut(at.select("id", F.col("then").alias("up"), *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in cols]))
    return at.drop("up")


def end_hashes(ends: DataFrame) -> DataFrame:
    """``id, sha``: of the conversations that end at a node, the hash of their ids."""

    def run(batches):
        place, digest = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for depth, k1, k2, conv in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if place != (depth, k1, k2):
                    if place:
                        out[0].append(place)
                        out[1].append(digest.hexdigest())
                    place, digest = (depth, k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield of(out)
        if place:
            yield of(([place], [digest.hexdigest()]))

    def of(out):
        keys = [*zip(*out[0], strict=True)] or [(), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(out[1], pa.string())], names=["depth", "k1", "k2", "sha"])

    keys = ["depth", "k1", "k2"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select(*keys, "conv_id").repartition(parts, *keys).sortWithinPartitions(*keys, "conv_id")
    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, sha string").select(node(*keys).alias("id"), "sha")


def prefix_trie(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """All nodes: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``sequences`` has conv_id, depth (from 1), total, a, b and words of all turns, ``members`` conv_id and total of all conversations, also those
    without turns. ``saved_tokens`` sums over the subtree each node's members but one times the words of its last turn."""
    placed = cut(blocks(sequences))
    below = compressed(placed).select(node("depth", "k1", "k2").alias("id"), node("up_depth", "up1", "up2").alias("up"), "n", "least", "words", F.col("up_depth").alias("top"))
    root = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    root = root.select(F.struct(*zeros()).alias("id"), F.lit(None).cast(below.schema["up"].dataType).alias("up"), "n", "least", F.lit(None).cast("array<long>").alias("words"), F.lit(-1).cast("long").alias("top"))
    kids = below.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"))
    edge = (F.col("n") - 1) * F.aggregate(F.coalesce("words", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda s, w: s + w)
    tree = below.unionByName(root).join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long"))).withColumn("edge", edge)
    tree = cut(tree)
    sums = summed(tree.select("id", "up", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("edge").alias("saved")), ["leaves", "saved"])
    ended = placed.where("last").select("conv_id", (F.col("j") * BLOCK + F.size("z1")).alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("k2"))
    none = members.where("total = 0").select("conv_id", *zeros())
    hashes = end_hashes(ended.unionByName(none))
    parents = tree.select(F.col("id").alias("up"), F.col("least").alias("up_least"))
    full = tree.join(sums, "id").join(hashes, "id", "left").join(parents, "up", "left")
    # the words of an edge from each of its nodes to its lower end; the root has no edge
    suffix = F.when(F.col("words").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr("transform(words, (w, i) -> aggregate(slice(words, i + 1, size(words)), 0L, (s, x) -> s + x))"))
    nodes = full.select("*", F.posexplode(suffix).alias("i", "left"))
    at = F.col("top") + 1 + F.col("i")
    lowest = at == F.col("id.depth")
    return nodes.select(
        F.col("least").alias("conv_id"), at.alias("depth"), F.when(F.col("i") == 0, F.col("up_least")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(lowest, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("edge") + (F.col("n") - 1) * F.col("left")).alias("saved_tokens"),
        F.when(lowest, F.coalesce("sha", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    placed = turns(read(spark, sf_dir, "conversations"))
    sequences, members = rebuilt(written(placed))
    return prefix_trie(sequences, members)


def oracle() -> str:
    """Every prefix as the list of its turns; sums over subtrees by each conversation's own nodes."""
    bit = "xor(s >> 1, 3988292384 * (s & 1))"
    byte = f"list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, b: {byte}), 4294967295)"
    return f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
each AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc} % 4 AS h, max(place) AS own FROM own GROUP BY conv_id),
got AS (SELECT e.conv_id, e.base, e.h, least(e.h, coalesce(b.own, 0)) AS got FROM each e LEFT JOIN each b ON e.base = b.conv_id),
t AS (SELECT g.conv_id, o.place AS depth, role, text FROM got g JOIN own o ON g.base = o.conv_id AND o.place <= g.h
  UNION ALL SELECT g.conv_id, o.place - g.h + g.got, role, text FROM got g JOIN own o ON g.conv_id = o.conv_id AND o.place > g.h),
p AS (SELECT conv_id, depth, md5(CAST(list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS VARCHAR)) AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t
  UNION ALL SELECT conv_id, 0, '', 0 FROM each),
c AS (SELECT *, lead(key) OVER w AS below, lag(key) OVER w AS above FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT below) AS n_children, min(words) AS words, min(above) AS above,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE below IS NULL), '')) AS ends_sha256 FROM c GROUP BY depth, key),
s AS (SELECT c.depth, c.key, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens FROM c JOIN n ON n.conv_id = c.conv_id AND n.depth >= c.depth GROUP BY c.depth, c.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON n.depth = s.depth AND n.key = s.key LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.above"""
