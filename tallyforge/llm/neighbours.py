"""Approximate nearest neighbours by cosine: p-stable hashing with several probes a table.

Unit vectors are hashed by ``tables`` groups of ``hashes`` Gaussian projections cut into steps of one width. A query visits its own
bucket in each table and then the buckets that differ by one step in some projections, in the order of their estimated
success: the sum of squared distances from the query's projections to the borders that are crossed. Candidates of all tables are
merged and reranked by the exact cosine.

Equal vectors are one class, which keeps its smallest ids only; a bucket with many classes is cut into blocks that the
queries visit in turn; so neither a vector nor a bucket that holds a third of all rows lands in one task. The number of
projections, tables and probes is fitted on a bounded sample of rows: the cheapest setting for a table of this many rows that finds the
sample's true neighbours, which lie farther than those among all rows, with at least ``recall``. The more rows, the more
projections and tables pay, so that a query's part of them shrinks. All rows are indexed. A query that finds too few neighbours searches all
rows, in blocks.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Rows of equal id count
once each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

NEAREST = 5
SAMPLE = 3000
RECALL = 0.975
#: Classes of one block of a bucket.
BLOCK = 8192
#: Settings to choose from: tables, projections a table, the width of their steps for unit vectors, and probes a table.
TABLES = (4, 8, 16)
HASHES = (1, 2, 3, 4, 5, 6, 8, 10, 12)
WIDTHS = (0.6, 1.0, 1.6, 2.4)
PROBES = (1, 2, 4, 8, 16, 32, 64, 128)
#: Projections in which a probe may leave the query's own step.
MOVED = 3
#: What it costs to move a row to a bucket, in products of two vectors.
MOVE = 40
#: Room for rounding when candidates are cut before their exact cosine is taken.
MARGIN = 1e-9


class Scheme:
    def __init__(self, dim: int, hashes: int, width: float, probes: int, tables: int = TABLES[0], seed: int = 42):
        rng = np.random.default_rng(seed)
        self.hashes, self.width, self.probes, self.tables = hashes, width, probes, tables
        # tables draw in turn, so that the first tables of a larger scheme are those of a smaller one
        drawn = [(rng.standard_normal((dim, hashes)), rng.uniform(0, width, hashes)) for _ in range(tables)]
        self.lines = np.concatenate([lines for lines, _ in drawn], axis=1)
        self.shifts = np.concatenate([shifts for _, shifts in drawn])
        moves = [dict(zip(at, way, strict=True)) for n in range(min(MOVED, hashes) + 1) for at in combinations(range(hashes), n) for way in product((-1, 1), repeat=n)]
        self.steps = np.array([[move.get(k, 0) for k in range(hashes)] for move in moves], np.int64).reshape(-1, hashes)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step numbers, by row, table and projection, and places within the steps, from 0 to 1."""
        at = (unit @ self.lines + self.shifts) / self.width
        cell = np.floor(at)
        shape = (len(unit), self.tables, self.hashes)
        return cell.astype(np.int64).reshape(shape), (at - cell).reshape(shape)

    def keys(self, cell: np.ndarray) -> np.ndarray:
        """One number for each table's bucket; tables never share one."""
        key = np.zeros(cell.shape[:2], np.int64)
        for k in range(self.hashes):
            key = key * 1009 + np.clip(cell[:, :, k], -504, 504) + 504
        return key * self.tables + np.arange(self.tables)

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """The buckets that each row visits, by row, table and turn."""
        cell, place = self.cells(unit)
        # the squared distance to the border below or above, for those projections that a probe moves
        below, above = (self.steps == -1).astype(float), (self.steps == 1).astype(float)
        score = place**2 @ below.T + (1 - place) ** 2 @ above.T
        few = min(self.probes, len(self.steps))
        turn = np.argpartition(score, few - 1, axis=2)[:, :, :few]
        turn = np.take_along_axis(turn, np.argsort(np.take_along_axis(score, turn, axis=2), axis=2, kind="stable"), axis=2)
        seen = [self.keys(cell + self.steps[turn[:, :, i]]) for i in range(turn.shape[2])]
        return np.stack(seen, axis=2)


def fit(sample: np.ndarray, rows: int, every: int, recall: float = RECALL, seed: int = 42) -> Scheme:
    """The setting that finds the sample's own nearest at ``recall`` and costs least for ``rows`` rows, one in ``every`` of which asks."""
    dim = sample.shape[1] if sample.size else 1
    asked = sample[: max(1, min(100, len(sample) // 2))]
    if len(sample) < 2 * NEAREST:
        return Scheme(dim, 1, 2.4, 3)
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    # two near groups of vectors may lie together closely; copies are taken out by the caller
    true = np.argpartition(-near, NEAREST, axis=1)[:, :NEAREST]
    best = None
    for hashes in HASHES:
        for width in WIDTHS:
            # the turn in which a query first meets each row
            met = np.full((len(asked), len(sample)), PROBES[-1] + 1)
            done = 0
            for tables in TABLES:
                # more tables cost more than they can save
                if best and MOVE * tables * every > best[0]:
                    break
                scheme = Scheme(dim, hashes, width, PROBES[-1], tables, seed)
                keys, visits = scheme.keys(scheme.cells(sample)[0]), scheme.visits(asked)
                for t in range(done, tables):
                    bucket, of = np.unique(keys[:, t], return_inverse=True)
                    at = np.minimum(np.searchsorted(bucket, visits[:, t]), len(bucket) - 1)
                    q, turn = np.nonzero(bucket[at] == visits[:, t])
                    first = np.full((len(asked), len(bucket)), PROBES[-1] + 1)
                    np.minimum.at(first, (q, at[q, turn]), turn)
                    met = np.minimum(met, first[:, of])
                done = tables
                for probes in PROBES:
                    got = (np.take_along_axis(met, true, axis=1) < probes).mean()
                    if got >= recall:
                        # a product for each row met; a move for each row of the index and each probe
                        cost = rows * (met < probes).mean() + MOVE * tables * (min(probes, len(scheme.steps)) + every)
                        if best is None or cost < best[0]:
                            best = (cost, hashes, width, probes, tables)
                        break
    _, hashes, width, probes, tables = best or (0, 1, WIDTHS[-1], 3, TABLES[0])
    return Scheme(dim, hashes, width, probes, tables, seed)


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), v.alias("v")).where(~bad & F.exists("v", lambda x: x != 0))


def classes(rows: DataFrame, dim: int, every: int, keep: int) -> DataFrame:
    """``key, raw, ids, asked``: one row for each distinct vector, its bytes, its smallest ids, and whether it asks."""

    def local(batches):
        for batch in batches:
            values = batch.column(1)
            lengths = np.diff(values.offsets.to_numpy())
            data = values.flatten().to_numpy()
            good = np.flatnonzero(lengths == dim)
            if not len(good):
                continue
            matrix = data.reshape(-1, dim) if len(good) == len(lengths) else np.array([values[int(i)].as_py() for i in good])
            ids = batch.column(0).to_numpy()[good]
            order = np.argsort(ids, kind="stable")
            met: dict[bytes, list] = {}
            # -0.0 and 0.0 are one number
            for raw, i in zip(map(bytes, (matrix[order] + 0.0).astype("<f8")), ids[order].tolist(), strict=True):
                of = met.setdefault(raw, [[], False])
                of[1] |= i % every == 0
                if len(of[0]) < keep and i not in of[0][-1:]:
                    of[0].append(i)
            # one row for each id, and one that says that the vector asks
            found = [(raw, i, False) for raw, (kept, _) in met.items() for i in kept] + [(raw, 0, True) for raw, (_, asks) in met.items() if asks]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["raw", "id", "asks"])

    # the rank is cut before and after the shuffle, so that no row ever holds more ids of a vector than are kept
    place = F.dense_rank().over(Window.partitionBy("raw").orderBy(F.desc("asks"), "id"))
    first = rows.mapInArrow(local, "raw binary, id long, asks boolean").withColumn("place", place).where(F.col("place") <= keep + 1)
    merged = first.groupBy("raw").agg(F.slice(F.sort_array(F.collect_set(F.when(~F.col("asks"), F.col("id")))), 1, keep).alias("ids"), F.bool_or("asks").alias("asked"))
    return merged.select(F.sha2("raw", 256).alias("key"), "raw", "ids", "asked")


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow of squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row whose id ``every`` divides."""
    rows = usable(df, id_, vector)
    out = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return df.sparkSession.createDataFrame([], out)
    dim = dims.n
    asking = rows.where((F.size("v") == dim) & (F.pmod("id", F.lit(every)) == 0)).select("id", F.col("v"))
    # a query's own row is one of its class: one more id than wanted is kept
    found = cut(classes(rows, dim, every, k + 1))
    total = found.count()
    rate = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    sample = found.where(rate < min(1.0, SAMPLE / max(total, 1))).select("key", "raw").limit(2 * SAMPLE).collect()
    scheme = fit(unit_rows(np.array([np.frombuffer(bytes(r.raw), "<f8") for r in sorted(sample, key=lambda r: r.key)])) if sample else np.zeros((0, dim)), total, every, recall)
    blocks = found.sparkSession.sparkContext.broadcast(scheme)  # a few projections
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(batches):
        scheme = blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(matrix_of(batch.column(1), dim))
            keys = scheme.keys(scheme.cells(unit)[0])
            row = np.repeat(np.arange(len(unit)), keys.shape[1])
            asked = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            visits = scheme.visits(unit[asked])
            visits = visits.reshape(len(asked), visits.shape[1] * visits.shape[2])
            row = np.append(row, np.repeat(asked, visits.shape[1]))
            bucket = np.append(keys.ravel(), visits.ravel())
            asks = np.arange(len(row)) >= keys.size
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(asks), *taken.columns[:3]], names=["bucket", "asks", "key", "raw", "ids"])

    index = found.mapInArrow(placed, "bucket long, asks boolean, key string, raw binary, ids array<long>")
    top = cut(merged(searched(index, dim, k, number), k))
    # too few found: all rows, in blocks
    # a query's own id is among the best, so that k others need one more; ids are kept up to as many
    want = min(k + 1, found.agg(F.sum(F.size("ids"))).first()[0] or 0)
    lacking = found.where("asked").join(top.where(F.size("best") >= want).select("key"), "key", "left_anti")
    lacking = cut(lacking.select("key", "raw", "ids"))
    if total > 1 and not lacking.isEmpty():
        parts = math.ceil(total / BLOCK)
        all_rows = found.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("bucket"), F.lit(False).alias("asks"), "key", "raw", "ids")
        asks = lacking.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).cast("long").alias("bucket"), F.lit(True).alias("asks"), "key", "raw", "ids")
        more = merged(searched(all_rows.unionByName(asks), dim, k, number), k)
        top = top.join(lacking.select("key"), "key", "left_anti").unionByName(more)
    # back from classes to the rows that ask
    own = asking.select("id", F.sha2(packed(), 256).alias("key"))
    listed = own.join(top, "key").select("id", F.filter("best", lambda x: x["id"] != F.col("id")).alias("best"))
    ranked = listed.select(F.col("id").alias("query_id"), F.posexplode(F.slice("best", 1, k)).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def packed():
    """The bytes of a vector, as ``classes`` has them."""

    @F.pandas_udf("binary")
    def raw(v):
        return v.map(lambda x: (np.asarray(x, dtype="<f8") + 0.0).tobytes())

    return raw("v")


def searched(index: DataFrame, dim: int, k: int, number: int) -> DataFrame:
    """``key, best``: for each query and block it visits, the best rows there, nearest first, as (far, id)."""
    counts = index.where("not asks").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts"))
    joined = index.join(counts, "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    block = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int")))
    dealt = joined.withColumn("block", F.explode(block)).select(F.xxhash64("bucket", "block").alias("place"), "asks", "key", "raw", "ids")
    dealt = dealt.repartition(number, "place").sortWithinPartitions("place", "asks", "key")

    def run(batches):
        def flush(held):
            asks = np.concatenate([np.asarray(h[1].to_numpy(zero_copy_only=False)) for h in held])
            have = np.flatnonzero(~asks)
            if not asks.any() or not len(have):
                return
            raw = np.concatenate([matrix_of(h[3], dim) for h in held])
            ids = [i for h in held for i in h[4].to_pylist()]
            keys = [x for h in held for x in h[2].to_pylist()]
            unit, asked = unit_rows(raw), np.flatnonzero(asks)
            rows, best = [], []
            for i in range(0, len(asked), 256):
                some = asked[i : i + 256]
                near = unit[some] @ unit[have].T
                m = min(k + 1, len(have))
                least = -np.partition(-near, m - 1, axis=1)[:, m - 1]
                for q, line, low in zip(some.tolist(), near, least.tolist(), strict=True):
                    at = have[line >= low - MARGIN]
                    score = exact(raw[q], raw[at])
                    kept = sorted((-s, i) for s, a in zip(score.tolist(), at.tolist(), strict=True) for i in ids[a])[: k + 1]
                    rows.append(keys[q])
                    best.append([{"far": f, "id": i} for f, i in kept])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(best, pa.list_(pa.struct({"far": pa.float64(), "id": pa.int64()})))], names=["key", "best"])

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy()
            border = np.append(0, np.append(np.flatnonzero(np.diff(place)) + 1, len(place)))
            for a, b in zip(border[:-1], border[1:], strict=True):
                part = batch.slice(int(a), int(b - a)).columns
                if held and held[-1][0][-1].as_py() != part[0][0].as_py():
                    yield from flush(held)
                    held = []
                held.append(part)
        if held:
            yield from flush(held)

    return dealt.mapInArrow(run, "key string, best array<struct<far:double,id:long>>")


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of a vector and others, in double precision, the same for a pair wherever it is met."""
    return np.array([float(np.dot(q, r)) for r in rows]) / (np.sqrt(np.dot(q, q)) * np.sqrt(np.array([float(np.dot(r, r)) for r in rows])))


def merged(best: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of all blocks; a query has as many lists as it visits blocks."""
    return best.groupBy("key").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best"))


def op2(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
