r"""Set similarity join of word n-grams by vertical partitioning.

Two documents link if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Documents of equal sets are one class, and only classes
are compared. Shingles have one global order: by the power of two that their number of classes reaches, then by hash. The order is cut into
fragments; a class has a segment of its set in each. Overlaps of a pair of classes are counted fragment by fragment and summed for the pair.

1. The number of classes of each shingle is counted in tasks that hold a range of hashes each. A class of which under 0.8 of the
   shingles stand in another class as well can have no partner and ends here; most documents do.
2. The others get their segments. Shingles of no other class come first in the order, so that two similar classes share one of the first
   shared - ceil(0.8 size) + 1 of the shingles that they share with any: the prefix.
3. In each prefix shingle's list, the member with most shared shingles (of copies with edits mostly the original) is the hub, and all others meet it. Then those
   that are not joined to it take a hub of their own, ``ROUNDS`` times, so that groups of near-copies are joined by as many pairs as they have members. What members
   of a list are in different components after that meet in pairs, each pair once; sizes and places in the order rule most of them out. So no link between
   components is lost, and no list is cut. Where many texts share rare passages and are unlike otherwise, these last pairs grow with the square of such a list.

Shingles that stand in many documents of a bounded sample (``SAMPLE`` documents) are last in the order and do not go through the count, so that no task meets a list of
nearly all classes there; any order gives the same result. Hashes keep 48 bits beside those of their range, 53 at least: a pair's overlap is wrong only where two of its own shingles collide.

Words are runs of other characters than space and \x09 to \x0D, A-Z in lower case. Under five words are one shingle; texts without words, null among
them, have none and link with nothing. Rows of one id are documents each; null ids are never a component's id unless all its members have none. Columns of the
result's names are replaced, others are left out. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, cut, read, steps, written
from .components import components
from .simhash import LOWER

#: Shingles of a fragment that one task counts, and fragments at least.
FRAGMENT, LEAST = 2_000_000, 32
#: Documents of the sample that tells frequent shingles, and the share of them that makes a shingle frequent.
SAMPLE, FREQUENT = 4096, 1 / 64
#: Rounds in which lists choose hubs.
ROUNDS = 2
#: The level of frequent shingles in the order, after all others; parts of each level that are fragments of their own.
LAST, PARTS = 63, 4


#: Odd multipliers: of a word's place in a shingle, and of the mixing at the end.
PLACE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingles(text: str, known: Words, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: its words' hashes, each multiplied by its place's power."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if len(known) > 1_000_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    # fewer words than a shingle are one, told from longer ones by their number
    n = min(width, len(h))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = out * PLACE + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.astype("<u8").tobytes())


def classed(docs: DataFrame) -> DataFrame:
    """``doc_id, class, n``: the class of a document's set, and the set's size."""

    def work(texts, part):
        known = Words()
        sets = [shingles(t, known) for t in texts]
        return {"doc_id": part.column(0), "class": pa.array([class_of(s) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64())}

    return docs.select("doc_id", "text").mapInArrow(by_step("text", work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, class binary, n long")


def frequent(docs: DataFrame, total: int) -> np.ndarray:
    """Hashes of the shingles that many of the sampled documents have, sorted; their number has a bound that the sample sets."""
    some = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE / max(total, 1)) * (1 << 20)))).select("text")

    def run(batches):
        known = Words()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or "", known).astype(np.int64))], names=["x"])

    counted = some.mapInArrow(run, "x long").groupBy("x").count().where(F.col("count") >= max(8, int(FREQUENT * min(total, SAMPLE))))
    return np.sort(np.array([r.x for r in counted.select("x").collect()], np.int64).astype(np.uint64))


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``values`` as bytes."""
    ends = np.append(0, np.cumsum(sizes * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def lists(values: np.ndarray, sizes: np.ndarray, kind=None) -> pa.Array:
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(values, kind) if isinstance(values, np.ndarray) else values)


def ranges(docs: DataFrame, bits: int, often: np.ndarray) -> DataFrame:
    """``range, classes, sizes, counts, low, high``: the sets cut by ranges of hashes, those of many documents in one row, with 32 and 16 further bits of each hash. Frequent
    shingles go by class."""
    many = 1 << bits

    def cutted(sets, names):
        ids = np.frombuffer(b"".join(names), "<u8").reshape(-1, 2)
        sizes = np.array([*map(len, sets)], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        to = (flat >> np.uint64(64 - bits)).astype(np.int64)
        if len(often):
            is_often = often[np.minimum(np.searchsorted(often, flat), len(often) - 1)] == flat
            to = np.where(is_often, many + (ids[owner, 0] % np.uint64(many)).astype(np.int64), to)
        order = np.argsort(to.astype(np.uint16 if bits < 15 else np.int64), kind="stable")
        flat, owner, to = flat[order], owner[order], to[order]
        # classes of each range, in order
        first = np.flatnonzero(np.append(True, (np.diff(to) != 0) | (np.diff(owner) != 0)))
        counts = np.diff(np.append(first, len(flat)))
        at, heads = to[first], np.flatnonzero(np.append(True, np.diff(to[first]) != 0))
        per = np.diff(np.append(heads, len(first)))
        cls = ids[owner[first]]
        hashes = np.add.reduceat(counts, heads)
        columns = [pa.array(at[heads].astype(np.int32)), binaries(cls.reshape(-1), 2 * per), binaries(sizes[owner[first]].astype("<u4"), per), binaries(counts.astype("<u4"), per), binaries(flat.astype("<u4"), hashes), binaries((flat >> np.uint64(32)).astype("<u2"), hashes)]
        return pa.RecordBatch.from_arrays(columns, names=["range", "classes", "sizes", "counts", "low", "high"])

    def run(batches):
        met: set[bytes] = set()
        known = Words()
        for batch in batches:
            lengths = pc.binary_length(batch.column(0)).fill_null(0).to_pylist()
            for a, b in steps(lengths):
                sets, names = [], []
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    # sets of under four shingles are similar to none but their equals
                    if len(s := shingles(t or "", known)) >= 4 and (c := class_of(s)) not in met:
                        met.add(c)
                        sets.append(s)
                        names.append(c)
                if sets:
                    yield cutted(sets, names)
                if len(met) > 500_000:
                    met.clear()

    return docs.select("text").mapInArrow(run, "range int, classes binary, sizes binary, counts binary, low binary, high binary")


def counted(cuts: DataFrame, bits: int) -> DataFrame:
    """``class, n, levels, hashes``: of each class and range the shingles that other classes have as well, with their level in the order."""
    many = 1 << bits

    def flush(held):
        raw = np.concatenate([np.frombuffer(x, "<u8") for _, x, *_ in held]).reshape(-1, 2)
        n, counts, low, high = (np.concatenate([np.frombuffer(h[k], kind) for h in held]) for k, kind in ((2, "<u4"), (3, "<u4"), (4, "<u4"), (5, "<u2")))
        flat = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) | np.uint64(min(held[0][0], many) << 48)
        # a class may come from several tasks
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        new = np.append(True, (np.diff(raw[order], axis=0) != 0).any(axis=1))
        one = np.zeros(len(raw), bool)
        one[order[new]] = True
        owner = np.repeat(np.arange(len(raw)), counts)
        keep = one[owner]
        owner, flat = owner[keep], flat[keep]
        if held[0][0] >= many:
            level = np.full(len(flat), LAST, np.uint8)
        else:
            by = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(flat[by]) != 0))
            size = np.diff(np.append(first, len(flat)))
            level = np.zeros(len(flat), np.uint8)
            level[by] = np.repeat(np.floor(np.log2(size)).astype(np.uint8), size)
        shared = level > 0
        owner, flat, level = owner[shared], flat[shared], level[shared]
        first = np.flatnonzero(np.append(True, np.diff(owner) != 0)) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(owner)))
        at = owner[first]
        return pa.RecordBatch.from_arrays([binaries(raw[at].reshape(-1), np.full(len(at), 2)), pa.array(n[at].astype(np.int64)), binaries(level, size), binaries(flat, size)], names=["class", "n", "levels", "hashes"])

    def run(batches):
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    parts = int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cuts.repartition(max(parts, many), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "class binary, n long, levels binary, hashes binary")


def segmented(shared: DataFrame, bits: int) -> DataFrame:
    """``class, n, shared, prefix, segments`` of the classes that may have partners: their shared shingles in the global order, cut into fragments."""

    def flush(held):
        names = [h[0] for h in held]
        new = np.array([True, *(a != b for a, b in zip(names[:-1], names[1:], strict=True))])
        of = np.repeat(np.cumsum(new) - 1, [len(h[2]) for h in held])
        level = np.frombuffer(b"".join([h[2] for h in held]), np.uint8)
        flat = np.frombuffer(b"".join([h[3] for h in held]), "<u8")
        n = np.array([h[1] for h in held], np.int64)[new]
        total = np.bincount(of, minlength=len(n))
        keep = 5 * total >= 4 * n
        kept = keep[of]
        order = np.flatnonzero(kept)
        order = order[np.lexsort((flat[kept], level[kept], of[kept]))]
        of, level, flat = of[order], level[order].astype(np.int64), flat[order]
        n, total, which = n[keep], total[keep], np.array(names, object)[new][keep]
        begin = np.cumsum(total) - total
        prefix = total - (4 * n + 4) // 5 + 1
        place = np.arange(len(flat)) - np.repeat(begin, total)
        values = flat.astype(np.int64)
        # the range's uppermost bits
        fragment = level * PARTS + np.minimum((flat >> np.uint64(48 + bits - 2)).astype(np.int64), PARTS - 1)
        first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(fragment) != 0))) if len(flat) else np.zeros(0, np.int64)
        struct = pa.StructArray.from_arrays([pa.array(fragment[first].astype(np.int32)), lists(values, np.diff(np.append(first, len(flat))))], names=["f", "seg"])
        number = np.cumsum(keep) - 1
        segments = lists(struct, np.bincount(number[of[first]], minlength=len(n)) if len(flat) else np.zeros(len(n), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(which.tolist(), pa.binary()), pa.array(n), pa.array(total), lists(values[place < np.repeat(prefix, total)], prefix), segments], names=["class", "n", "shared", "prefix", "segments"])

    def run(batches):
        held: list = []
        weight = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if weight > 2_000_000 and row[0] != held[-1][0]:
                    yield flush(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[2]) + 32
        if held:
            yield flush(held)

    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.repartition(parts, "class").sortWithinPartitions("class")
    return dealt.mapInArrow(run, "class binary, n long, shared long, prefix array<long>, segments array<struct<f int, seg array<long>>>")


def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Those of ``a, b, na, nb, la, lb`` that are similar: overlaps counted in each fragment and summed for the pair."""
    own = segments.select(F.col("class").alias("a"), "f", F.col("seg").alias("seg_a"))
    other = segments.select(F.col("class").alias("b"), "f", F.col("seg").alias("seg_b"))
    keys = ["a", "b", "na", "nb", "la", "lb"]
    partial = pairs.join(own, "a").join(other, ["b", "f"]).select(*keys, F.size(F.array_intersect("seg_a", "seg_b")).alias("common"))
    return partial.groupBy(*keys).agg(F.sum("common").alias("common")).where("9 * common >= 4 * (na + nb)").drop("common", "na", "nb")


#: What holds of two similar members of a list at the first shingle that they share: sizes, and what can still follow in both.
MAY = "5 * least(na, nb) >= 4 * greatest(na, nb) AND 9 * (1 + least(ra, rb)) >= 4 * (na + nb)"


def raised(links: DataFrame) -> DataFrame:
    """``label, to``: where links lead from a label, upwards, followed three times; enough for most groups, and none is lost where it is not."""
    up = links.where("la != lb").select(F.when(F.col("la") < F.col("lb"), F.col("la")).otherwise(F.col("lb")).alias("label"), F.when(F.col("la") < F.col("lb"), F.col("lb")).otherwise(F.col("la")).alias("to"))
    up = cut(up.groupBy("label").agg(F.max("to").alias("to")))
    for _ in range(2):
        then = up.select(F.col("label").alias("to"), F.col("to").alias("then"))
        up = up.join(then, "to", "left").select("label", F.coalesce("then", "to").alias("to"))
    return up


def similar(docs: DataFrame, total: int, shingles_: int) -> DataFrame:
    """``class, comp`` of the classes that links join.

    Between the rounds members carry labels, the best hub that they are joined to; labels that differ may be of one component, which costs pairs but no link."""
    bits = max(LEAST, -(-shingles_ // FRAGMENT) - 1).bit_length()
    sets = written(segmented(counted(ranges(docs, bits, frequent(docs, total)), bits), bits))
    segments = sets.select("class", F.explode("segments").alias("s")).select("class", "s.f", "s.seg")
    label = F.struct((F.col("shared") / F.col("n")).alias("rank"), "class").alias("label")
    listed = sets.select("class", "n", "shared", "prefix", label).select("class", "n", "shared", "label", F.posexplode("prefix").alias("pos", "x"))
    listed = listed.select("x", "class", "n", (F.col("shared") - F.col("pos") - 1).alias("rest"), F.col("label.rank").alias("rank"), "label")
    open_ = cut(listed.join(listed.groupBy("x").count().where("count > 1").select("x"), "x"))
    tested, links = None, []

    def meet(pairs):
        """Links of new pairs; all pairs that have met are known."""
        nonlocal tested
        first = F.col("a") < F.col("b")
        swap = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"), ("la", "lb"), ("lb", "la"))]
        pairs = pairs.where(MAY).select(*swap).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        links.append(cut(linked(pairs, segments)))
        return links[-1]

    pair = [F.col("class").alias("a"), F.col("hub.class").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"), F.col("rest").alias("ra"), F.col("hub.rest").alias("rb"), F.col("label").alias("la"), F.col("hub.label").alias("lb")]
    best = F.max(F.struct("rank", "class", "label", "n", "rest"))
    for turn in range(ROUNDS):
        if turn == 0:
            hubs = open_.groupBy("x").agg(best.alias("hub"))
        else:
            # the best of those outside the list's largest group
            groups = open_.groupBy("x", "label").agg(F.count("*").alias("size"), best.alias("hub"))
            large = groups.groupBy("x").agg(F.max(F.struct("size", "label")).alias("large"))
            hubs = groups.join(large, "x").where("label != large.label").groupBy("x").agg(F.max("hub").alias("hub"))
        found = meet(open_.join(hubs, "x").where("label != hub.label").select(*pair))
        now = open_.join(raised(found), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        apart = now.groupBy("x").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("x")
        open_ = cut(now.join(apart, "x", "left_semi").select("x", "class", "n", "rest", "rank", "label"))
    one = open_.select("x", F.col("class").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("label").alias("la"))
    two = open_.select("x", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("label").alias("lb"))
    meet(one.join(two, "x").where("a < b AND la != lb"))
    all_ = links[0]
    for more in links[1:]:
        all_ = all_.unionByName(more)
    return cut(components(all_, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("comp")))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row for each document."""
    marked = written(classed(docs))
    total, shingles_ = marked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    comps = similar(docs, total, shingles_)
    classes = marked.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    joined = cut(classes.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")))
    ids = joined.groupBy("comp").agg(F.min("least").alias("component"))
    named = joined.join(ids, "comp").select("class", "component")
    found = marked.join(named, "class", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op11(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    return """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON w.doc_id = r.a GROUP BY ALL"""
