r"""Ranked lexical search over an index that recursive graph bisection has put in order.

``index`` reorders the documents so that those of like terms stand together, and cuts the order into clusters of about ``LEAF`` documents, each with its inverted
lists and, for each term, the number of its documents and the largest part that the term can give to a score. The bisection halves the documents again and again;
between two halves documents are exchanged as long as this lowers the logarithms of the gaps in the inverted lists. Its upper levels are fitted on
``SAMPLE`` documents, whose halves then tell for every document on which side its terms cost less. The rest of the recursion takes all documents of a cell, ``BLOCK`` at a time; cells of any size,
copies of one text among them, are cut into as many blocks as they need. Every document is in one cluster.

``search`` takes items in blocks of ``ITEMS``. The bound of a cluster for an item is the sum of its terms' largest parts there. Each item first visits the ``FIRST`` clusters of the
highest bounds; the score of its k-th document there is a threshold. Then all tasks visit, highest bounds first, the clusters whose bound
reaches the threshold, which rises as they find better ones, and stop where no bound reaches it. A bound equal to the threshold is visited, too, since equal
scores go by ascending doc_id; so the result is that of scoring every document.

Terms are the maximal runs of letters and digits of ASCII, A-Z in lower case, and of all other characters beyond ASCII. N counts the documents with a term, L all their terms, n a
document's terms, df the documents that hold a term, tf its occurrences in one. A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles, m is
50 + (50 n N) div L, and the score the sum of w ((1000000000 tf) div (1000 tf + 20 m)) over an item's different terms, all in 64-bit integers.

Terms are held as hashes of 64 bits. Null and empty texts have no term; they rank nowhere and as items have no rows. Repeated rows are documents, or items, each; a document without an id stands
after its equals. Further columns are not used. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_step, read, written

#: Documents of the sample for the upper levels, of a block, and of a cluster; passes over one level.
SAMPLE, BLOCK, LEAF, PASSES = 4096, 16_384, 128, 6
#: Postings of a block at most.
POSTINGS = 4_000_000
#: Items searched for at once, clusters that each visits first, and different terms of all items for which an index may hold these alone.
ITEMS, FIRST, VOCABULARY = 256, 4, 1_000_000
#: Bytes that are in terms are kept, A-Z in lower case; all others part terms.
TERMS = bytes((c | 0x20 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERMS).split()


def hashed(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``values`` as bytes."""
    ends = np.append(0, np.cumsum(sizes * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


# the order


def split(side: np.ndarray, node: np.ndarray, doc: np.ndarray, term: np.ndarray, nodes: int, terms: int, passes: int = PASSES) -> np.ndarray:
    """Exchange documents between the two halves of each node as long as this makes lists' gaps smaller. ``doc, term`` are the postings."""
    at = node[doc] * terms + term
    used, at = np.unique(at, return_inverse=True)
    of = used // terms
    by_doc = np.bincount(doc, minlength=len(node))
    for _ in range(passes):
        size = np.bincount(node * 2 + side, minlength=2 * nodes).reshape(nodes, 2)[of].astype(float)
        deg = np.bincount(at * 2 + side[doc], minlength=2 * len(used)).reshape(-1, 2).astype(float)

        def cost(d, size=size):
            return (np.maximum(d, 0) * np.log2(np.maximum(size, 1) / (np.maximum(d, 0) + 1))).sum(axis=1)

        now = cost(deg)
        gains = np.stack([now - cost(deg + (-1, 1)), now - cost(deg + (1, -1))], axis=1)
        gain = np.bincount(doc, gains[at, side[doc]], len(node))
        gain[by_doc == 0] = 0
        order = np.lexsort((-gain, side, node))
        key = node[order] * 2 + side[order]
        rank = np.arange(len(order)) - starts(np.bincount(key, minlength=2 * nodes))[key]
        # the i-th of one half with the i-th of the other
        place = node[order] * (len(order) + 1) + rank
        left, right = (np.flatnonzero(side[order] == s) for s in (0, 1))
        _, i, j = np.intersect1d(place[left], place[right], assume_unique=True, return_indices=True)
        a, b = order[left[i]], order[right[j]]
        better = gain[a] + gain[b] > 1e-9
        if not better.any():
            break
        side[a[better]], side[b[better]] = 1, 0
    return side


def bisected(docs: int, doc: np.ndarray, term: np.ndarray, levels: int, seen=None) -> np.ndarray:
    """The leaf, of 2 ** levels in order, of each document. ``seen`` gets node, side and level after each split."""
    terms = int(term.max()) + 1 if len(term) else 1
    node = np.zeros(docs, np.int64)
    for level in range(levels):
        nodes = 1 << level
        order = np.argsort(node, kind="stable")
        sizes = np.bincount(node, minlength=nodes)
        rank = np.empty(docs, np.int64)
        rank[order] = np.arange(docs) - starts(sizes)[node[order]]
        side = (rank >= (sizes[node] + 1) // 2).astype(np.int64)
        side = split(side, node, doc, term, nodes, terms)
        if seen:
            seen(node, side, level)
        node = node * 2 + side
    return node


class Router:
    """The upper levels: at each node what a term adds for going right, learned from the halves of a sample."""

    def __init__(self, rows: list[tuple[bytes]], levels: int):
        self.levels = levels
        flat = [np.frombuffer(r[0], "<u8") for r in rows]
        doc = np.repeat(np.arange(len(flat)), [*map(len, flat)])
        terms, number = np.unique(np.concatenate([*flat, np.zeros(0, np.uint64)]), return_inverse=True)
        often = np.bincount(number, minlength=len(terms)) >= 4
        keep = often[number]
        self.terms = terms[often]
        doc, number = doc[keep], (np.cumsum(often) - 1)[number[keep]]
        self.weights = np.zeros((max(1, (1 << levels) - 1), len(self.terms)), np.float32)
        self.base = np.zeros(len(self.weights), np.float32)

        def seen(node, side, level):
            many = 1 << level
            deg = np.bincount((node[doc] * 2 + side[doc]) * len(self.terms) + number, minlength=2 * many * len(self.terms)).reshape(many, 2, -1)
            size = np.bincount(node * 2 + side, minlength=2 * many).reshape(many, 2)
            self.weights[many - 1 : 2 * many - 1] = np.log2((deg[:, 1] + 1) / (deg[:, 0] + 1)) - np.log2((size[:, 1] + 1) / (size[:, 0] + 1))[:, None]

        if len(self.terms):
            bisected(len(flat), doc, number, levels, seen)

    def cells(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(sizes), np.int64)
        if not len(self.terms):
            return node
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        known = self.terms[at] == flat
        doc, at = doc[known], at[known]
        for level in range(self.levels):
            first = (1 << level) - 1
            node = node * 2 + (np.bincount(doc, self.weights[first + node[doc], at], len(sizes)) > 0)
        return node


# the index


def forward(docs: DataFrame, vocabulary: dict[bytes, int] | None) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the documents that have terms: all terms' number, and the different ones of the vocabulary."""

    def run(batches):
        known: dict[bytes, int] = {}

        def work(texts, part):
            n, sizes, flat, tfs = [], [], [], []
            for t in texts:
                words = terms_of(t)
                counts = Counter(words)
                n.append(len(words))
                if vocabulary is not None:
                    met = [(vocabulary[w], c) for w, c in counts.items() if w in vocabulary]
                else:
                    if len(known) > 1_000_000:
                        known.clear()
                    met = [(known.get(w) or known.setdefault(w, hashed(w)), c) for w, c in counts.items()]
                sizes.append(len(met))
                flat += [h for h, _ in met]
                tfs += [c for _, c in met]
            sizes = np.array(sizes, np.int64)
            return {"doc_id": part.column(0).cast(pa.int64()), "n": pa.array(n, pa.int64()), "terms": binaries(np.array(flat, np.uint64), sizes), "tfs": binaries(np.array(tfs, np.uint32), sizes)}

        yield from by_step("text", work)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms binary, tfs binary").where("n > 0")


def clusters(rows: list[tuple], total: int, length: int, first: int, size_: int) -> pa.RecordBatch:
    """The clusters of one block: documents in their new order, and the lists of each cluster with their bounds."""
    ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)
    n = np.array([r[1] for r in rows], np.int64)
    flat = [np.frombuffer(r[2], "<u8") for r in rows]
    term, tf = np.concatenate(flat), np.concatenate([np.frombuffer(r[3], "<u4") for r in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [*map(len, flat)])
    m = 50 + (50 * n * total) // length
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    names, number = np.unique(term, return_inverse=True)
    leaf = bisected(len(rows), doc, number, max(0, -(-len(rows) // size_) - 1).bit_length())
    _, leaf = np.unique(leaf, return_inverse=True)
    order = np.argsort(leaf, kind="stable")
    size = np.bincount(leaf)
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows)) - starts(size)[leaf[order]]
    by = np.lexsort((place[doc], number, leaf[doc]))
    doc, number, impact = doc[by], number[by], impact[by]
    head = np.flatnonzero(np.append(True, (np.diff(number) != 0) | (np.diff(leaf[doc]) != 0)))
    per = np.bincount(leaf[doc[head]], minlength=len(size))
    counts = np.diff(np.append(head, len(doc)))
    many = np.bincount(leaf[doc], minlength=len(size))
    columns = [
        pa.array(first + np.arange(len(size))), binaries(ids[order], size), binaries(names[number[head]], per), binaries(counts.astype("<u4"), per),
        binaries(np.maximum.reduceat(impact, head).astype("<u4"), per), binaries(place[doc].astype("<u4"), many), binaries(impact.astype("<u4"), many),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cluster", "docs", "terms", "counts", "bounds", "places", "impacts"])


class Index:
    """Clusters as a table, with N and L of all documents."""

    def __init__(self, table: DataFrame, total: int, length: int):
        self.table, self.total, self.length = table, total, length


def index(docs: DataFrame, vocabulary: dict[bytes, int] | None = None) -> Index:
    """An index of all documents, for all terms or those of ``vocabulary`` (term to hash) alone."""
    lists = written(forward(docs, vocabulary))
    total, length, held, postings = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.octet_length("terms") > 0), F.coalesce(F.sum(F.octet_length("tfs")), F.lit(0))).first()
    some = lists.where("octet_length(terms) > 0")
    most, leaf = BLOCK, LEAF  # as they are at the driver
    blocks = max(-(-held // BLOCK), -(-postings // (4 * POSTINGS)), 1)
    levels = min(blocks - 1, SAMPLE // 64 - 1).bit_length()
    # about SAMPLE rows, whatever their ids and the number of partitions
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(held, 1)) * (1 << 40))
    router = Router(some.withColumn("drawn", drawn).where("drawn").select("terms").collect(), levels) if levels else None

    def route(batches):
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.cells(flat, sizes).astype(np.int32))], names=[*batch.schema.names, "cell"])

    def build(batches):
        first, held, weight = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[4] != held[0][4] or len(held) >= most or weight >= POSTINGS):
                    yield (made := clusters(held, total, length, first, leaf))
                    first, held, weight = first + made.num_rows, [], 0
                held.append(row)
                weight += len(row[3]) // 4
        if held:
            yield clusters(held, total, length, first, leaf)

    placed = some.mapInArrow(route, "doc_id long, n long, terms binary, tfs binary, cell int") if router else some.withColumn("cell", F.lit(0))
    # ranges of cells of equal size, in which cells of many documents fill several
    dealt = placed.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(blocks, "cell", "deal").sortWithinPartitions("cell", "deal").drop("deal")
    return Index(written(dealt.mapInArrow(build, "cluster long, docs binary, terms binary, counts binary, bounds binary, places binary, impacts binary")), total, length)


# the search


class Items:
    """Items as positions in the sorted vocabulary of all of them."""

    def __init__(self, terms: list[list[int]]):
        self.sizes = np.array([*map(len, terms)], np.int64)
        flat = np.array([h for x in terms for h in x], np.uint64)
        self.vocabulary, self.term = np.unique(flat, return_inverse=True)
        self.item = np.repeat(np.arange(len(terms)), self.sizes)

    def met(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the vocabulary a cluster has, and where among its terms."""
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.vocabulary)
        return own, at[own]

    def bounds(self, own: np.ndarray, part: np.ndarray) -> np.ndarray:
        """For each item the sum of ``part`` over its terms."""
        values = np.zeros(len(self.vocabulary), np.int64)
        values[own] = part
        upto = np.append(0, np.cumsum(values[self.term]))
        ends = np.append(0, np.cumsum(self.sizes))
        return upto[ends[1:]] - upto[ends[:-1]]


def document_counts(table: DataFrame, items: Items) -> np.ndarray:
    """df of each of the items' terms, over all clusters."""

    def run(batches):
        df = np.zeros(len(items.vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, at = items.met(np.frombuffer(terms, "<u8"))
                df[own] += np.frombuffer(counts, "<u4")[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["t", "df"])

    out = np.zeros(len(items.vocabulary), np.int64)
    for row in table.select("terms", "counts").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[row.t] = row.df
    return out


def highest(table: DataFrame, items: Items, weights: np.ndarray) -> DataFrame:
    """``item, cluster``: of each item the clusters of the highest bounds."""
    first = FIRST

    def run(batches):
        found: list[np.ndarray] = []
        for batch in batches:
            for cluster, terms, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, at = items.met(np.frombuffer(terms, "<u8"))
                bound = items.bounds(own, weights[own] * np.frombuffer(bounds, "<u4")[at])
                found.append(np.stack([np.arange(len(bound)), bound, np.full(len(bound), cluster)]))
            if found:
                item, bound, cluster = np.concatenate(found, axis=1)
                order = np.lexsort((cluster, -bound, item))
                rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
                found = [np.stack([item, bound, cluster])[:, order[(rank < first) & (bound[order] > 0)]]]
        for item, bound, cluster in found:
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(bound), pa.array(cluster)], names=["item", "bound", "cluster"])

    best = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    made = table.select("cluster", "terms", "bounds").mapInArrow(run, "item long, bound long, cluster long")
    return made.withColumn("r", F.row_number().over(best)).where(F.col("r") <= first).select("item", "cluster")


def pruned(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of ``item, score, doc_id`` the first k of each item."""
    item, score, doc = all_ = np.concatenate(found, axis=1)
    order = np.lexsort((doc, -score, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    return all_[:, order[rank < k]]


def visited(batches, items: Items, weights: np.ndarray, least: np.ndarray, k: int, chosen: dict[int, list[int]] | None = None):
    """The best k documents of each item in one task's clusters whose bound reaches ``least``, or in those ``chosen`` for it."""
    threshold = np.maximum(least, 1)
    found, size = [np.zeros((3, 0), np.int64)], 0
    exact = float(items.sizes.max(initial=0)) * max(1, int(weights.max(initial=0))) * 1e6 < 2**53
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chosen is not None and row[0] not in chosen:
                continue
            terms = np.frombuffer(row[2], "<u8")
            own, at = items.met(terms)
            rows.append((items.bounds(own, weights[own] * np.frombuffer(row[4], "<u4")[at]), own, at, row))
        for bound, own, at, row in sorted(rows, key=lambda r: -int(r[0].max(initial=0))):
            go = bound >= threshold
            if chosen is not None:
                asked = np.zeros(len(bound), bool)
                asked[chosen[row[0]]] = True
                go &= asked
            who = np.flatnonzero(go)
            if not len(who):
                continue
            docs, counts = np.frombuffer(row[1], "<i8"), np.frombuffer(row[3], "<u4").astype(np.int64)
            places, impacts, begin = np.frombuffer(row[5], "<u4"), np.frombuffer(row[6], "<u4"), starts(counts)
            each = counts[at]
            here = np.repeat(begin[at] - starts(each), each) + np.arange(each.sum())
            # sums stay under 2 ** 53 and doubles hold them exactly, or whole numbers are used
            kind = np.float64 if exact else np.int64
            parts = np.zeros((len(own), len(docs)), kind)
            parts[np.repeat(np.arange(len(own)), each), places[here]] = (np.repeat(weights[own], each) * impacts[here]).astype(kind)
            column = np.full(len(items.vocabulary), -1)
            column[own] = np.arange(len(own))
            line = np.full(len(bound), -1)
            line[who] = np.arange(len(who))
            use = (line[items.item] >= 0) & (column[items.term] >= 0)
            has = np.zeros((len(who), len(own)), kind)
            has[line[items.item[use]], column[items.term[use]]] = 1
            scores = (has @ parts).astype(np.int64)
            i, d = np.nonzero(scores >= threshold[who][:, None])
            found.append(np.stack([who[i], scores[i, d], docs[d]]))
            size += len(i)
            if size > 100_000:
                found, size = [best := pruned(found, k)], 0
                full = np.bincount(best[0], minlength=len(threshold)) == k
                last = np.full(len(threshold), np.iinfo(np.int64).max)
                np.minimum.at(last, best[0], best[1])
                threshold[full] = np.maximum(threshold[full], last[full])
    item, score, doc = pruned(found, k)
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=doc == NO_ID)], names=["item", "score", "doc_id"])


def search_block(found: Index, terms: list[list[int]], k: int) -> DataFrame:
    items = Items(terms)
    table, shape = found.table, "item long, score long, doc_id long"
    weights = np.floor(1000 * np.log((2 * found.total + 2) / (2 * document_counts(table, items) + 1))).astype(np.int64)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    chosen: dict[int, list[int]] = {}
    # a few clusters for each item of the block
    for row in highest(table, items, weights).collect():
        chosen.setdefault(row.cluster, []).append(row.item)
    first = table.mapInArrow(partial(visited, items=items, weights=weights, least=np.zeros(len(terms), np.int64), k=k, chosen=chosen), shape)
    least = np.zeros(len(terms), np.int64)
    for row in first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).collect():
        least[row.item] = row.score
    out = table.mapInArrow(partial(visited, items=items, weights=weights, least=least, k=k), shape)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(found: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` its k best documents."""
    spark = items.sparkSession
    shape = "item_id long, rank int, doc_id long, score long"
    out, held = spark.createDataFrame([], shape), []

    def done(out):
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], "item long, item_id long")
        part = search_block(found, [t for _, t in held], k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        return out.unionByName(written(part))

    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if terms := sorted({hashed(w) for w in terms_of(row.text or "")}):
            held.append((row.item_id, terms))
        if len(held) == ITEMS:
            out, held = done(out), []
    return done(out) if held and found.total else out


def vocabulary_of(items: DataFrame) -> dict[bytes, int] | None:
    """The terms of all items, if they are few enough to be sent to every task."""

    def run(batches):
        for batch in batches:
            words = {w for t in batch.column(0).to_pylist() for w in terms_of(t or "")}
            yield pa.RecordBatch.from_arrays([pa.array([*words], pa.binary())], names=["w"])

    some = items.select("text").mapInArrow(run, "w binary").distinct().limit(VOCABULARY + 1).collect()
    return {bytes(r.w): hashed(bytes(r.w)) for r in some} if len(some) <= VOCABULARY else None


def op13(spark, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    return search(index(read(spark, sf_dir, "documents"), vocabulary_of(items)), items)


def oracle() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH w AS (SELECT doc_id, {words} AS w FROM documents), d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM w WHERE len(w) > 0),
a AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM d),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * (SELECT total FROM a) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({words}) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t), a GROUP BY ALL)
SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50"""
