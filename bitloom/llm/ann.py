"""Nearest neighbours by collision counting: sorted single projections, query-centred windows, virtual rehashing.

Every vector is indexed, in shards of about SHARD_NUMBERS components and SHARD_ROWS vectors at most. A shard keeps a sorted
array for each of PROJECTIONS Gaussian projections. Around a query's own projections a window of HALF_WIDTH times the
radius opens in each array, as if the hash had buckets of that width, and each window that holds a vector is a collision;
whether it does follows from the vector's rank in the array, for a block of queries at a time. A vector with ``needed``
collisions or more is verified by its true distance. The first radius is what a few of the shard's own vectors need for
k neighbours. Where fewer than k verified vectors lie within the radius, it grows, to the k-th best distance so far at
most: the windows at that distance hold a vector nearer than it with the probability of CONFIDENCE standard deviations.
Each shard gives its k best, and the k best of those are the answer, so that shards cost no recall.

Shards and queries meet by cogroups: a shard is sent and indexed once for QUERY_NUMBERS components of queries.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null
id; vectors of other lengths are searched among themselves; ties go to the smaller id; equal vectors are neighbours at
distance 0; a query's own rows are left out; repeated rows are candidates each, a query that is repeated asks once, and
two vectors that ask under one id share its k answers. With fewer than k candidates all are returned; an empty table gives
no rows; vectors of any length are searched. Ids are whole numbers. Further columns don't pass, so their names are free.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm.common import ship, table, written

#: Numbers in a shard (8,192 vectors of 64) and in the queries that meet it at once (65,536 of 64).
SHARD_NUMBERS, SHARD_ROWS, QUERY_NUMBERS = 1 << 19, 1 << 14, 1 << 22
PROJECTIONS, HALF_WIDTH, CONFIDENCE, GROWTH, SEED = 240, 1.6, 1.5, 1.25, 5
#: Queries whose collisions are counted together; rows of a shard that set the first radius, and which part of them it serves.
TOGETHER, SAMPLE, SERVED = 8, 32, 0.25


def needed(m: int = PROJECTIONS) -> int:
    """Collisions that make a candidate; two vectors at the distance of the radius collide with probability P(|Z| <= HALF_WIDTH)."""
    p = erf(HALF_WIDTH / sqrt(2))
    return int(m * p - CONFIDENCE * sqrt(m * p * (1 - p)))


class Shard:
    """verified counts the true distances that were computed, of asked times the number of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS):
        self.ids, self.x, self.m, n = ids, vectors.astype(np.float64), m, len(ids)
        self.axes = np.random.Generator(np.random.PCG64(SEED)).standard_normal((self.x.shape[1], m))
        p = np.ascontiguousarray((self.x @ self.axes).T)
        order = p.argsort(axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, axis=1)
        kind = np.uint16 if n < 1 << 16 else np.uint32
        self.ranks = np.empty((m, n), kind)
        np.put_along_axis(self.ranks, order, np.broadcast_to(np.arange(n, dtype=kind), (m, n)), axis=1)
        self.verified = self.asked = 0

    def _first_radius(self, k: int) -> float:
        n = len(self.x)
        kth = [np.partition(np.sqrt(((self.x - v) ** 2).sum(axis=1)), min(k, n - 1))[min(k, n - 1)] for v in self.x[:: -(-n // SAMPLE)]]
        return float(np.quantile(kth, SERVED))

    def _collisions(self, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """How many of each query's windows hold each vector: (queries, rows)."""
        q, n = len(centres), len(self.ids)
        reach = HALF_WIDTH * radius * (1 + 1e-12) + 1e-9
        counts, held = np.zeros((q, n), np.uint8 if self.m < 256 else np.uint16), np.empty((q, n), bool)
        beyond, one = np.empty((q, n), self.ranks.dtype), held.view(np.uint8)
        for j in range(self.m):
            low = self.sorted[j].searchsorted(centres[:, j] - reach).astype(self.ranks.dtype)
            size = (self.sorted[j].searchsorted(centres[:, j] + reach, "right") - low).astype(self.ranks.dtype)
            np.subtract(self.ranks[j], low[:, None], out=beyond)  # ranks below the window wrap round to large ones
            np.less(beyond, size[:, None], out=held)
            np.add(counts, one, out=counts)
        return counts

    def search(self, owns: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
        """For each query the k nearest rows whose id is not its own, as (id, distance)."""
        out: list[list[tuple[int, float]]] = []
        first = self._first_radius(k)
        for i in range(0, len(queries), TOGETHER):
            out += self._search(owns[i : i + TOGETHER], queries[i : i + TOGETHER], k, first)
        return out

    def _search(self, owns: np.ndarray, queries: np.ndarray, k: int, first: float) -> list[list[tuple[int, float]]]:
        least, centres, n = needed(self.m), queries @ self.axes, len(self.ids)
        distance, own = np.full((len(queries), n), np.inf), self.ids[None, :] == owns[:, None]
        seen, radius, open_ = own.copy(), np.full(len(queries), first), np.arange(len(queries))
        self.asked += len(queries)
        while len(open_):
            counts, left = self._collisions(centres[open_], radius[open_]), []
            for i, count in zip(open_, counts):
                fresh = np.flatnonzero((count >= least) & ~seen[i])
                missing = k - int((seen[i] & ~own[i]).sum()) - len(fresh)
                if missing > 0:  # then those with the most collisions, so that there is a k-th best distance
                    rest = np.flatnonzero((count < least) & ~seen[i])
                    fresh = np.concatenate([fresh, rest[np.argsort(-count[rest].astype(np.int64), kind="stable")[:missing]]])
                distance[i, fresh] = np.sqrt(((self.x[fresh] - queries[i]) ** 2).sum(axis=1))
                seen[i, fresh] = True
                self.verified += len(fresh)
                known = distance[i][seen[i] & ~own[i]]
                if len(known) < k:  # all rows have been verified
                    continue
                last = float(np.partition(known, k - 1)[k - 1])
                if last > radius[i]:
                    radius[i] = min(last, max(radius[i] * GROWTH, last * 0.7))
                    left.append(i)
            open_ = np.array(left, np.int64)
        best = []
        for i in range(len(queries)):
            found = np.flatnonzero(seen[i] & ~own[i])
            found = found[np.lexsort((self.ids[found], distance[i, found]))[:k]]
            best.append([(int(self.ids[j]), float(distance[i, j])) for j in found])
        return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    vectors = column.combine_chunks()
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def _searcher(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(rows) and len(asked):
            ids = np.asarray(asked.column("id"))
            hits = Shard(np.asarray(rows.column("id")), _matrix(rows.column("v"))).search(ids, _matrix(asked.column("v")), k)
            found = [(int(q), *hit) for q, own in zip(ids, hits) for hit in own]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    x, infinite = F.col(vector), F.lit(float("inf"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)) & F.exists(x, lambda c: c != 0)
    return vectors.filter(F.col(id).isNotNull() & x.isNotNull() & sound).select(F.col(id).cast("long").alias("id"), x.alias("v"), F.size(x).alias("dim"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows of vectors."""
    ship(vectors.sparkSession)
    rows, asked = usable(vectors, id, vector), usable(queries, id, vector).dropDuplicates(["id", "v"])
    n, wide = F.count("*"), F.greatest("dim", F.lit(1))
    shards = written(rows.groupBy("dim").agg(F.greatest(F.ceil(n * wide / SHARD_NUMBERS), F.ceil(n / SHARD_ROWS)).alias("shards")), "shards")
    groups = asked.groupBy("dim").agg(F.ceil(n * wide / QUERY_NUMBERS).alias("groups"))
    sizes = written(shards.join(groups, "dim"), "sizes")  # of the lengths that are asked for
    all_of = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    left = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("id", "v"), "shards")).withColumn("group", all_of("groups"))
    right = asked.join(sizes, "dim").withColumn("group", F.pmod(F.xxhash64("id", "v", F.lit(1)), "groups")).withColumn("shard", all_of("shards"))
    keys = ("dim", "shard", "group")
    both = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys))
    found = both.applyInArrow(_searcher(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = written(found, "found").withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
