"""Document fingerprints by randomised edit embedding.

A walk goes over a text's characters: at each time it stands on one character, emits it, and a random bit, shared by all texts and
chosen by time and character, says whether it moves on. Two texts with few edits between them emit strings of few differing places,
so Hamming distance stands in for edit distance. A fingerprint keeps the emitted characters at fixed random times, equally
many from each doubling of time: the times are the same for texts of all lengths, and ``likeness`` weighs each doubling by its
length. Near-duplicates are found by banding bit-sampled fingerprint places and verified by likeness or by edit distance: all classes of
a band, not only neighbours. A text that ends soon after its last doubling began also stands in the bands of the one before, where those of just shorter
texts are.

The walk needs one table look-up a character, as the time that a character holds the walk depends on the character and the time
of arrival alone. Texts of a step are walked side by side; the last long ones one by one.

Null texts count as empty; an empty text's fingerprint is the empty string, and two empty fingerprints have likeness 1. Ids that are null come
last, equal ids stand in an order by their text's hash or compressed text, the same in each run; the rows of an id that many have, or of none, are dealt to several parts. Columns of the
result's names are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_CHARS, by_step, cut, read, written
from .shards import Shard, joined_classes

#: Kinds of character, by a hash of the code point; each has random bits of its own.
KINDS = 16
#: Times that the bits repeat after.
PERIOD = 1 << 16
#: Places kept of each doubling of time, from the first.
PLACES = 24
#: Fewer texts than this are walked one by one.
ALONE = 48
#: Likeness from which two documents of a shared band are near.
NEAR = 0.8
BANDS, ROWS = 9, 6
#: Places of its last doubling up to which a text may be near one that ends in the doubling before: about a quarter of them, and what chance adds.
OVER = 10
#: Members of a band that one task holds.
MEMBERS = 8192
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Texts' hashes are whole numbers below this one, which doubles hold exactly; and what stands for no id: the last of all.
HASHES, NO_ID = float(1 << 53), -(1 << 63)


def holds(seed: int = 42) -> np.ndarray:
    """How long a character of each kind that is reached at each time (modulo PERIOD) holds the walk: until its bit is 1."""
    bits = np.random.default_rng(seed).integers(0, 2, (KINDS, PERIOD), dtype=np.int8)
    bits[:, -1] = 1
    ones = np.where(bits == 1, np.arange(PERIOD), PERIOD)
    return (np.minimum.accumulate(ones[:, ::-1], axis=1)[:, ::-1] - np.arange(PERIOD) + 1).astype(np.uint8)


def times(seed: int = 43, doublings: int = 34) -> np.ndarray:
    """The kept times, in order: the first PLACES, then as many of each doubling."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.arange(PLACES), *[np.sort(rng.integers(PLACES << k, PLACES << k + 1, PLACES)) for k in range(doublings)]])


def kinds(text: str) -> np.ndarray:
    """The kind of each code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return (((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.uint8)


def walk(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, start: np.ndarray, table: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The arrival time of each character of the texts codes[begin : begin + length], into ``out``; gives the times after the last.

    ``start`` has the times of arrival at the first characters."""
    order = np.argsort(-length, kind="stable")
    begin, size, now = begin[order], length[order], start[order].astype(np.int64)
    flat, mask = table.ravel(), PERIOD - 1
    most = int(size[0]) if len(size) else 0
    # side by side as long as enough texts go on
    together = int(size[ALONE - 1]) if len(size) >= ALONE else 0
    active = np.searchsorted(-size, -np.arange(together), "left").tolist()
    for t in range(together):
        m = active[t]
        at, n = begin[:m] + t, now[:m]
        out[at] = n
        n += flat[(codes[at].astype(np.int64) << 16) + (n & mask)]
    if most > together:
        rows = [row.tobytes() for row in table]
        for k in range(int(np.searchsorted(-size, -together, "left"))):
            a, b, n, seen = int(begin[k]) + together, int(begin[k] + size[k]), int(now[k]), []
            add = seen.append
            for c in codes[a:b].tobytes():
                add(n)
                n += rows[c][n & mask]
            out[a:b] = seen
            now[k] = n
    back = np.empty_like(now)
    back[order] = now
    return back


def shown(codes: np.ndarray, arrivals: np.ndarray, end: int, kept: np.ndarray) -> str:
    """The fingerprint of one text: a hexadecimal digit for each kept time before ``end``, the walk's end."""
    n = int(np.searchsorted(kept, end))
    return HEX[codes[np.searchsorted(arrivals, kept[:n], "right") - 1]].tobytes().decode() if n else ""


def likeness(a: str, b: str) -> float:
    """The share of time at which two walks emit alike, by their fingerprints; time after a walk's end is unlike."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    m = min(len(a), len(b))
    same = np.zeros(n)
    same[:m] = np.frombuffer(a[:m].encode(), np.uint8) == np.frombuffer(b[:m].encode(), np.uint8)
    weight = weights(n)
    return float((same * weight).sum() / weight.sum())


class Walker:
    def __init__(self):
        self.table, self.kept = holds(), times()

    def fingerprints(self, texts: list[str], heads: list[tuple[int, str]] | None = None) -> tuple[list[str], list[str]]:
        """The texts' fingerprints, and those of (first characters kept, new rest) of each, where given."""
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = kinds("".join(texts))
        begin = np.cumsum(lengths) - lengths
        arrivals = np.zeros(len(codes), np.int64)
        ends = walk(codes, begin, lengths, np.zeros(len(texts), np.int64), self.table, arrivals)
        whole = [shown(codes[a : a + n], arrivals[a : a + n], e, self.kept) for a, n, e in zip(begin.tolist(), lengths.tolist(), ends.tolist(), strict=True)]
        if heads is None:
            return whole, []
        # the walk over an edited text starts where the kept characters end
        kept = np.array([h for h, _ in heads], np.int64)
        start = np.where(kept == lengths, ends, arrivals[np.minimum(begin + kept, max(len(codes) - 1, 0))]) if len(codes) else ends
        rest = [r for _, r in heads]
        sizes = np.array([len(r) for r in rest], np.int64)
        more = kinds("".join(rest))
        at = np.cumsum(sizes) - sizes
        times_ = np.zeros(len(more), np.int64)
        after = walk(more, at, sizes, start, self.table, times_)
        edited = []
        for k, (a, h, b, n) in enumerate(zip(begin.tolist(), kept.tolist(), at.tolist(), sizes.tolist(), strict=True)):
            edited.append(shown(np.append(codes[a : a + h], more[b : b + n]), np.append(arrivals[a : a + h], times_[b : b + n]), int(after[k]), self.kept))
        return whole, edited


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["fingerprint string"])

    def run(batches):
        walker = Walker()

        def work(texts, part):
            return {c: part.column(part.schema.get_field_index(c)) for c in keep} | {"fingerprint": pa.array(walker.fingerprints(texts)[0], pa.string())}

        yield from by_step(text, work)(batches)

    return docs.select(keep).mapInArrow(run, schema)


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits lead from a to b (furthest-reaching diagonals, time in edits squared)."""
    if abs(len(a) - len(b)) > most:
        return False
    reach = {0: 0}
    for edits in range(most + 1):
        new = {}
        for k in range(-edits, edits + 1):
            # an exchange, a character less in b, one more in b
            i = min(max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2)), len(a), len(b) + k) if edits else 0
            j = i - k
            if i < 0 or j < 0:
                continue
            while i < len(a) and j < len(b):
                step = 256
                while step and a[i : i + step] != b[j : j + step]:
                    step //= 2
                if not step:
                    break
                done = min(step, len(a) - i, len(b) - j)
                i, j = i + done, j + done
            if i >= len(a) and j >= len(b):
                return True
            new[k] = i
        reach = new
    return False


def weights(n: int) -> np.ndarray:
    """The length of the doubling that each of the first ``n`` places stands for."""
    return np.exp2(np.maximum(np.arange(n) // PLACES - 1, 0))


class Prints(Shard):
    """Members by their fingerprints (and texts, where edits count); all of a band are candidates of each other."""

    def __init__(self, near: float, edits: int | None, fps: np.ndarray, found: list[bytes], comp: list[str]):
        parts = [x.split(b"\0", 1) for x in found]
        self.near, self.edits, self.texts = near, edits, [p[1].decode("utf-8", "surrogatepass") for p in parts]
        self.lengths = np.array([len(p[0]) for p in parts], np.int64)
        self.places = np.zeros((len(parts), max(1, int(self.lengths.max()))), np.uint8)
        for row, (p, _) in zip(self.places, parts, strict=True):
            row[: len(p)] = np.frombuffer(p, np.uint8)
        self.weight = weights(self.places.shape[1])
        self.upto = np.append(0, np.cumsum(self.weight))
        if len(parts) == 2:  # most bands; either is as good a root
            super().__init__(np.zeros(2), comp)
            return
        most = np.stack([(self.places == c).sum(axis=0) for c in HEX]).argmax(axis=0)
        super().__init__(-((self.places == HEX[most]) @ self.weight), comp)

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(asked, len(self.lengths)), np.tile(np.arange(len(self.lengths)), len(asked))

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        if self.edits is not None:
            return np.array([within(self.texts[x], self.texts[k], self.edits) for k in others], bool)
        same = (self.places[others] == self.places[x]) & (self.places[x] > 0)
        return same @ self.weight >= self.near * self.upto[np.maximum(self.lengths[others], self.lengths[x])]


def banded(classes: DataFrame) -> DataFrame:
    """``id, bucket``: each class, by a hash of its name, in the bands of its last doubling and, soon after that began, of the one before."""
    rng = np.random.default_rng(44)
    chosen = [sorted(rng.choice(PLACES * 3, ROWS, replace=False).tolist()) for _ in range(BANDS)]

    def run(batches):
        for batch in batches:
            keys = []
            for print_ in batch.column(1).to_pylist():
                last, own = (len(print_) - 1) // PLACES, []
                for level in {last, last - 1 if len(print_) - last * PLACES <= OVER else last} - {-1, -2}:
                    begin = max(0, level - 2) * PLACES
                    for i, places in enumerate(chosen):
                        sampled = "".join([print_[begin + p : begin + p + 1] or "." for p in places])
                        own.append(xxhash.xxh64_intdigest(f"{i}:{level}:{sampled}") - (1 << 63))
                keys.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "buckets"])

    bands = classes.select(F.xxhash64("class").alias("id"), "fingerprint").mapInArrow(run, "id long, buckets array<long>")
    return bands.select("id", F.explode("buckets").alias("bucket"))


def band_members(classes: DataFrame) -> DataFrame:
    """Those classes that share a band with others, as ``joined_classes`` takes them. Names join only then: most bands hold one class."""
    bands = banded(classes)
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = bands.join(sizes.select("bucket", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")), "bucket")
    named = shared.join(classes.select(F.xxhash64("class").alias("id"), "class"), "id")
    return cut(named.select("class", F.lit(0).cast("long").alias("fp"), "bucket", "blocks", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block")))


def print_key(text: bool):
    return F.sha2("text" if text else "fingerprint", 256)


def components_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", near: float = NEAR, edits: int | None = None) -> DataFrame:
    """``class, component_id``: of each class of equal fingerprints (with ``edits``, of equal texts) the smallest id that links reach; classes of one document
    that none reach are left out."""
    marked = fingerprints(docs.select(F.col(doc_id).alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return components_of_prints(marked.withColumn("class", print_key(edits is not None)), near, edits)


def components_of_prints(marked: DataFrame, near: float = NEAR, edits: int | None = None) -> DataFrame:
    """``components_of`` for rows ``id_, class, fingerprint`` (with ``edits``, and text)."""
    one = F.min("text") if edits is not None else F.lit("")
    classes = written(marked.groupBy("class").agg(F.count("*").alias("n"), F.min("id_").alias("least"), F.min("fingerprint").alias("fingerprint"), one.alias("text")))
    members = band_members(classes)
    needed = classes.join(members.select("class").distinct(), "class", "left_semi")
    found = F.concat(F.col("fingerprint").cast("binary"), F.unhex(F.lit("00")), F.col("text").cast("binary"))
    comps = joined_classes(members, needed.select("class", found.alias("found")), partial(Prints, near, edits))
    named = classes.select("class", "least", "n").join(comps, "class", "left").where("n > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "class"))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    # a table whose size the planner knows, so that a small one travels to the documents
    return written(named.join(ids, "comp").select("class", "component_id"))


def with_components(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` (with class) and component_id: a document that nothing reaches is its own component."""
    out = docs.join(found, "class", "left")
    return out.withColumn("component_id", F.coalesce("component_id", doc_id)).drop("class")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", near: float = NEAR, edits: int | None = None) -> DataFrame:
    """``doc_id, component_id``: the smallest id that links reach, which go between documents of a shared band with a likeness of ``near`` or,
    with ``edits``, at most so many edits. Documents of equal fingerprint (or text) are one class."""
    marked = fingerprints(docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")))
    marked = marked.withColumn("class", print_key(edits is not None)).select(doc_id, "class")
    return with_components(marked, components_of(docs, text, doc_id, near, edits), doc_id)


class Parts:
    """Parts that follow the descending order of ids. They border at ids of even ranks; an id that is several of these borders in a row has a part for
    each, by equal ranges of its texts' hashes, and one more for the ids below it."""

    def __init__(self, borders: list[int]):
        ids, times_ = np.unique(np.array(borders, np.int64), return_counts=True)
        self.ids, self.hot = ids, np.where(times_ > 1, times_, 0)
        # from the highest ids down: those above the last border, then each border's own and those below it, down to the next
        sizes = np.append(self.hot + 1, 1)[::-1]
        self.first = (np.cumsum(sizes) - sizes)[::-1]

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids, "left")
        part = self.first[at]
        inside = np.flatnonzero(at < len(self.ids))
        cuts = self.hot[at[inside]]
        own = self.ids[at[inside]] == ids[inside]
        by_hash = (hashes[inside] * cuts.astype(float) / HASHES).astype(np.int64)
        part[inside] += np.where(own, np.minimum(by_hash, np.maximum(cuts - 1, 0)), cuts)
        return part


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part_rows: int = 2000, most_parts: int = 20_000) -> DataFrame:
    """``part, guest, id, hash, text``, the text compressed: the rows dealt into parts that follow the descending order of ids, sorted within; the row after a
    part's last is a guest, the first row of the next part (after the last part: of the first). There are ``2 * most_parts`` parts at most; of an
    id's rows only those that are equal in text too must share one."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("rank", F.coalesce("id", F.lit(NO_ID)))
    rows = docs.count()
    parts = int(min(max(1, rows // part_rows), most_parts))
    borders = docs.agg(F.percentile_approx("rank", [k / parts for k in range(1, parts)], 50_000)).first()[0] if parts > 1 else None
    dealing = Parts(borders or [])
    # texts are read and hashed for those ids alone that have several parts
    hot = dealing.ids[dealing.hot > 0].tolist()
    docs = docs.withColumn("hash", F.when(F.col("rank").isin(hot), F.shiftrightunsigned(F.xxhash64("text"), 11)).otherwise(F.lit(0)) if hot else F.lit(0).cast("long"))

    def first_rows(batches):
        for batch in batches:
            rank, hash_ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            part = dealing.of(rank, hash_)
            order = np.lexsort((hash_, ~rank, part))
            head = order[np.flatnonzero(np.append(True, np.diff(part[order]) > 0))] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array(rank[head]), pa.array(hash_[head])], names=["part", "rank", "hash"])

    heads = docs.select("rank", "hash").mapInArrow(first_rows, "part long, rank long, hash long")
    # one row for each part that has any
    found = sorted(heads.groupBy("part").agg(F.max(F.struct("rank", (-F.col("hash")).alias("hash"))).alias("head")).collect(), key=lambda r: r.part)
    number_of = np.array([r.part for r in found], np.int64)
    head_rank, head_hash = np.array([r.head.rank for r in found], np.int64), np.array([-r.head.hash for r in found], np.int64)

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            rank, hash_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            part = np.searchsorted(number_of, dealing.of(rank, hash_))
            head = np.flatnonzero((head_rank[part] == rank) & (head_hash[part] == hash_))
            row = np.append(np.arange(len(rank)), head)
            to = np.append(part, (part[head] - 1) % len(number_of))
            # half of what the shuffle's own compression makes of a text
            packed = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            texts = pa.array(packed, pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), pa.array(np.arange(len(row)) >= len(rank)), batch.column(0).take(pa.array(row)), pa.array(hash_[row]), texts], names=["part", "guest", "id", "hash", "text"]
            )

    dealt = docs.select("id", "text", "rank", "hash").mapInArrow(deal, "part int, guest boolean, id long, hash long, text binary")
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(number, "part").sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "hash", "text").drop("hash")


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document: its fingerprint beside
    those of the text whose second half is the next document's beginning, and of the next document."""
    schema = f"`{doc_id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        walker = Walker()

        def flush(rows):
            own = [k for k in range(len(rows) - 1) if not rows[k][1]]
            if not own:
                return
            texts = [r[3] for r in rows]
            heads = [(len(t) - len(t) // 2, texts[k + 1][: len(t) // 2]) if k + 1 < len(rows) and not rows[k][1] else (0, "") for k, t in enumerate(texts)]
            prints, edited = walker.fingerprints(texts, heads)
            new = [hashlib.sha256((texts[k][: heads[k][0]] + heads[k][1]).encode("utf-8", "surrogatepass")).hexdigest() for k in own]
            out = [[rows[k][2] for k in own], [len(texts[k]) for k in own], new, [prints[k] for k in own], [edited[k] for k in own]]
            out += [[likeness(prints[k], edited[k]) for k in own], [likeness(prints[k], prints[k + 1]) for k in own]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        rows: list[tuple] = []
        total, unsqueeze = 0, zstandard.ZstdDecompressor()
        for batch in batches:
            for *row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((*row, unsqueeze.decompress(text).decode("utf-8", "surrogatepass")))
                row = rows[-1]
                total += len(row[3])
                if total > STEP_CHARS:
                    yield from flush(rows)
                    rows, total = rows[-1:], len(row[3])
        yield from flush(rows)

    return with_next(docs, text, doc_id).mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # texts are walked once; what follows reads their fingerprints
    out = written(edited_likeness(docs).withColumn("class", print_key(False)), "zstd")
    return with_components(out, components_of_prints(out.select(F.col("doc_id").alias("id_"), "class", "fingerprint")), "doc_id")
