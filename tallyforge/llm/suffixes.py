"""Repeated passages through a sparse suffix array.

Of all suffixes of a text, word by word, only those are retained that start at content-selected minimiser positions: the 16-word
group with the smallest hash of each 50-word window. Every passage of 50 words or more that two documents share thus has a suffix in both that starts
with the same group. The retained suffixes are sorted by that beginning, over range partitions, and compared with
their neighbours; those that share it with another document's go on. From each such group the match is extended left and right:
of the 50-word windows around it those stay that stand in another document too, and what stays is joined up to maximal passages: windows that overlap or adjoin are one
passage, so that every word of it is covered by a window that stands in another document, while a window across the seam of two of them may stand in none.
So a passage is found whole and to the word, whatever stands around it, and each step is a sort, a
join or an aggregation with partial results: no group of equal suffixes is held together in one task.

Words are runs of characters between white space, compared in lower case by 64-bit hashes. Documents of wholly equal text count as repeated in
full if they have 50 words; one of them stands for all when windows are compared. Null and short texts have no passages. Rows
with equal ids are versions of one document, whose passages are taken together. Rows without an id, or whose id is no whole number, are left out:
their passages could not be named. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, cut, read, written

LEAST = 50
GROUP = 16
#: At most so many windows are frequent, and broadcast: those that make up a greater part than one in as many of all rows.
FREQUENT = 2000
WORD = re.compile(r"\S+")
#: Odd multipliers of the rolling hash and of the order of groups.
ROLL, ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of several texts in one array: hash and place of each, and the texts' borders in it."""

    def __init__(self, texts: list[str]):
        memory: dict[str, int] = {}
        hashes, starts, ends, sizes = [], [], [], []
        for t in texts:
            spans = [m.span() for m in WORD.finditer(t)]
            words = t.lower().split()
            if len(words) != len(spans):
                words = [t[a:b].lower() for a, b in spans]
            for w in {*words}:
                if w not in memory:
                    memory[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
            hashes.extend(map(memory.__getitem__, words))
            starts.extend(a for a, _ in spans)
            ends.extend(b for _, b in spans)
            sizes.append(len(spans))
        self.hash = np.array(hashes, np.uint64)
        self.start, self.end = np.array(starts, np.int64), np.array(ends, np.int64)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.sizes = np.array(sizes, np.int64)

    def rolled(self, length: int) -> np.ndarray:
        """The hash of the ``length`` words from each place on, as far as the array reaches."""
        total, power, out, at = self.hash, ROLL, None, 0
        need, done = length, 1
        while need:
            if need & 1:
                m = len(self.hash) - (at + done) + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = total[:m] if out is None else out[:m] * power + total[at : at + m]
                at += done
            need >>= 1
            if need:
                m = len(total) - done
                if m <= 0:
                    return np.zeros(0, np.uint64)
                total = total[:m] * power + total[done : done + m]
                power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
                done *= 2
        return out

    def whole(self, count: int, length: int) -> np.ndarray:
        """For each of ``count`` places whether ``length`` words from it on are of one text."""
        return self.text[:count] == self.text[length - 1 : length - 1 + count]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbouring values."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def groups(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The order of each group of GROUP words, and the smallest in each window of LEAST words."""
    order = words.rolled(GROUP) * ORDER
    order ^= order >> np.uint64(29)
    if len(order) < LEAST - GROUP + 1:
        return order, np.zeros(0, np.uint64)
    return order, sliding(order, LEAST - GROUP + 1, np.minimum)


def anchors(docs: DataFrame) -> DataFrame:
    """``grp, id``: the minimiser groups of each document."""

    def work(texts, part):
        words = Words(texts)
        _, least = groups(words)
        inside = np.flatnonzero(words.whole(len(least), LEAST))
        # a text's groups, each once
        grp, text = least[inside].astype(np.int64), words.text[inside]
        first = np.append(True, (grp[1:] != grp[:-1]) | (text[1:] != text[:-1]))[: len(grp)]
        return {"grp": pa.array(grp[first]), "id": part.column(0).take(pa.array(text[first]))}

    return docs.mapInArrow(by_step("text", work), "grp long, id long")


def shared_groups(retained: DataFrame) -> DataFrame:
    """``grp, id``: the retained suffixes whose beginning another document has too, found among sorted neighbours."""
    ordered = retained.repartitionByRange("grp", "id").sortWithinPartitions("grp", "id")

    def neighbours(batches):
        # a run of equal beginnings is decided with its second document; the first and last of a partition may go on in others
        first, now, ids = None, None, np.zeros(0, np.int64)

        def out(grp, id_, edge):
            return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(id_, pa.int64()), pa.array(np.full(len(grp), edge))], names=["grp", "id", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            grp, id_ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            first = grp[0] if first is None else first
            # what stands for the run so far: its one document's row, or two that are decided already
            stand = np.append(np.ones(len(ids), bool), np.zeros(len(grp), bool))
            done = stand & (len(ids) > 1)
            grp, id_ = np.append(np.full(len(ids), now if now is not None else 0), grp), np.append(ids, id_)
            head = np.append(True, grp[1:] != grp[:-1])
            run = np.cumsum(head) - 1
            several = np.logical_or.reduceat(np.append(False, (id_[1:] != id_[:-1]) & ~head[1:]), np.flatnonzero(head))[run]
            yield out(grp[several & ~done & (grp != first)], id_[several & ~done & (grp != first)], False)
            yield out(grp[(grp == first) & ~stand], id_[(grp == first) & ~stand], True)
            now = grp[-1]
            ids = np.unique(id_[run == run[-1]])[:2] if now != first else np.zeros(0, np.int64)
        yield out(np.full(len(ids), now if now is not None else 0), ids, True)

    met = cut(ordered.mapInArrow(neighbours, "grp long, id long, edge boolean"))
    edges = met.where("edge").select("grp", "id")
    shared = edges.groupBy("grp").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("grp")
    return met.where("not edge").select("grp", "id").unionByName(edges.join(shared, "grp"))


def windows(docs: DataFrame) -> DataFrame:
    """``win, id, word, start, end``: the windows of LEAST words around a document's shared groups ``grps``; start and end in code points."""

    def work(texts, part):
        words = Words(texts)
        _, least = groups(words)
        shared = part.column(part.schema.get_field_index("grps")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(words.whole(len(least), LEAST) & np.isin(least.astype(np.int64), np.unique(shared)))
        win = words.rolled(LEAST)[at] if len(at) else np.zeros(0, np.uint64)
        win = win ^ (win * ORDER >> np.uint64(31))
        begin = np.cumsum(words.sizes) - words.sizes
        text = words.text[at]
        return {
            "win": pa.array(win.astype(np.int64)), "id": part.column(0).take(pa.array(text)), "word": pa.array((at - begin[text]).astype(np.int32)),
            "start": pa.array(words.start[at].astype(np.int32)), "end": pa.array(words.end[at + LEAST - 1].astype(np.int32)) if len(at) else pa.array([], pa.int32()),
        }

    return docs.mapInArrow(by_step("text", work), "win long, id long, word int, start int, end int")


def joined(kept: DataFrame, parts: int) -> DataFrame:
    """``id, start, end, n_words, first_id``: overlapping and adjoining windows of a document as one passage."""
    ordered = kept.repartition(parts, "id").sortWithinPartitions("id", "word")

    def run(batches):
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_, word, start, end, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.append(True, (id_[1:] != id_[:-1]) | (word[1:] > word[:-1] + LEAST))
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(id_)) - 1
            found = [*zip(id_[a].tolist(), word[a].tolist(), word[b].tolist(), start[a].tolist(), end[b].tolist(), np.minimum.reduceat(first, a).tolist(), strict=True)]
            if now is not None and now[0] == found[0][0] and found[0][1] <= now[2] + LEAST:
                found[0] = (*now[:2], found[0][2], now[3], found[0][4], min(now[5], found[0][5]))
            elif now is not None:
                found.insert(0, now)
            now = found.pop()
            yield out(found)
        if now is not None:
            yield out([now])

    def out(found):
        columns = [[f[0] for f in found], [f[3] for f in found], [f[4] for f in found], [f[2] - f[1] + LEAST for f in found], [f[5] for f in found]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "end", "n_words", "first_id"])

    return ordered.mapInArrow(run, "id long, start int, end int, n_words int, first_id long")


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, end, n_words, first_id``: each document's maximal passages whose words are all covered by windows of LEAST words that stand in
    another document too, overlapping or adjoining ones as one; start and end in code points, first_id the smallest id of a document that has a part of it."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal texts: the smallest id stands for them
    hashed = cut(docs.mapInArrow(by_step("text", extents), "id long, same string, start int, end int, n_words int"))
    classes = hashed.groupBy("same").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("same", "least")
    copies = cut(hashed.join(classes, "same").drop("same").distinct())
    retained = written(anchors(docs))
    of_doc = shared_groups(retained).groupBy("id").agg(F.collect_set("grp").alias("grps"))
    extra = copies.where("id <> least").select("id")
    around = written(windows(docs.join(of_doc.join(extra, "id", "left_anti"), "id")))
    ends = cut(around.groupBy("win").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low <> high").select("win", F.col("low").alias("first_id"), "n"))
    # copies are repeated in full, if they are long enough; the windows of those that stand for them have done their work
    open_ = around.join(copies.select("id").distinct(), "id", "left_anti")
    # windows that make up a part of all rows can be few, whatever the corpus: they meet their rows where these are
    many = F.col("n") > (ends.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    frequent = ends.where(many).drop("n")
    rest = open_.join(F.broadcast(frequent), "win").unionByName(open_.join(F.broadcast(frequent.select("win")), "win", "left_anti").join(ends.where(~many).drop("n"), "win"))
    rest = rest.select("id", "word", "start", "end", "first_id")
    full = copies.where(F.col("n_words") >= LEAST).select("id", "start", "end", "n_words", F.col("least").alias("first_id"))
    return joined(rest, parts).unionByName(full).withColumnRenamed("id", doc_id)


def extents(texts, part):
    """A digest of each text, where its words begin and end, and their number."""
    same = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
    start = [len(t) - len(t.lstrip()) for t in texts]
    place = {"start": start, "end": [max(a, len(t.rstrip())) for a, t in zip(start, texts, strict=True)], "n_words": [len(t.split()) for t in texts]}
    return {"id": part.column(0), "same": pa.array(same, pa.string())} | {c: pa.array(v, pa.int32()) for c, v in place.items()}


def op9(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
