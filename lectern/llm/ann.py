"""Approximate nearest neighbours by collision counting over single projections.

Every vector is projected on M random lines. A shard of vectors keeps each line's values as a sorted array. A query puts a
window around its own value on each line and widens all windows step by step (virtual rehashing: a radius R means windows of
width w R); a vector collides once for each line on which it lies in the window. Vectors with enough collisions are verified:
their true distance is computed. A query ends when its k nearest verified lie within R, or when all is verified.

Shards hold a bounded number of vectors, and queries meet them in blocks; each query's nearest of each shard are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines; approximation ratio that sets window width and collision threshold; growth of the radius; a query ends when its
#: k-th distance is at most SLACK times the radius.
LINES, RATIO, STEP, SLACK = 64, 1.3, 1.15, 1.05
#: Vectors of a shard and queries of a block at most; shards at least.
SHARD, BLOCK, LEAST_SHARDS = 32_768, 16_384, 12
WIDTH = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1))
_NEAR = math.erf(WIDTH / 2 / math.sqrt(2))
_FAR = math.erf(WIDTH / 2 / RATIO / math.sqrt(2))
THRESHOLD = (_NEAR + _FAR) / 2


class Shard:
    """Vectors with each line's projections as a sorted array; the arrays lie behind one another in one, each shifted beyond the
    one before, so that one binary search finds places on all lines."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 42):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], lines))
        h = (self.x @ self.lines).T
        order = np.argsort(h, axis=1, kind="stable")
        self.order = order.astype(np.int32).ravel()
        self.ends = h.min(), h.max()
        self.shift = np.arange(lines) * (2 * (self.ends[1] - self.ends[0]) + 4)
        self.sorted = (np.take_along_axis(h, order, 1) + self.shift[:, None]).ravel()
        self.touched = self.verified = 0
        # The first radius: half of what a few vectors have as distance to their nearest other one.
        some = self.x[:: max(1, len(self.x) // 32)][:32]
        gaps = [d[d > 0].min(initial=np.inf) for d in (np.sqrt(((self.x - v) ** 2).sum(1)) for v in some)]
        finite = [g for g in gaps if np.isfinite(g)]
        self.radius = float(np.median(finite)) / 2 if finite else 1.0

    def _places(self, values: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.sorted, np.clip(values, self.ends[0] - 1, self.ends[1] + 1) + self.shift, side)

    def nearest(self, q_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, but for rows of the query's own id. While windows are small, a step costs
        what enters them."""
        n, at, need = len(self.x), q @ self.lines, THRESHOLD * self.lines.shape[1]
        low = self._places(at, "left")
        high = low.copy()
        count, seen = np.zeros(n, np.int64), self.ids == q_id
        left, radius = n - int(seen.sum()), self.radius
        rows, dist = np.empty(0, np.int64), np.empty(0)
        while left and (len(rows) < k or np.partition(dist, k - 1)[k - 1] > SLACK * radius / STEP):
            below = np.minimum(self._places(at - WIDTH * radius / 2, "left"), low)
            above = np.maximum(self._places(at + WIDTH * radius / 2, "right"), high)
            spans = [*zip(below.tolist(), low.tolist()), *zip(high.tolist(), above.tolist())]
            entered = np.concatenate([self.order[a:b] for a, b in spans])
            low, high, radius = below, above, radius * STEP
            if 4 * len(entered) < n:
                np.add.at(count, entered, 1)
                fresh = np.unique(entered[(count[entered] >= need) & ~seen[entered]])
            else:
                count += np.bincount(entered, minlength=n)
                fresh = np.flatnonzero((count >= need) & ~seen)
            seen[fresh] = True
            left -= len(fresh)
            self.touched += len(entered)
            self.verified += len(fresh)
            rows, dist = np.concatenate([rows, fresh]), np.concatenate([dist, np.sqrt(((self.x[fresh] - q) ** 2).sum(1))])
        best = np.lexsort((self.ids[rows], dist))[:k]
        return self.ids[rows[best]], dist[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): rows with an id and a vector that is not empty or zero and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For each row of queries its k nearest among vectors, all but rows of its own id: query_id, rank (from 1), vec_id and
    score, the Euclidean distance in double precision; ties go to the smaller vec_id. Both tables have id_col and vector_col.

    Rows take no part, as query or as candidate, if the id or the vector is null, or the vector is empty, zero, or holds a
    null or non-finite component. Only vectors of one length meet. With fewer candidates than k all are returned; repeated
    rows are candidates each on their own. Queries of one id and one vector are one query; of one id and several vectors, each
    has ranks of its own. Other columns are not looked at; empty tables give an empty result."""
    own, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["id", "v"])
    sizes = own.agg(F.count("*").alias("n")).first()["n"], asked.agg(F.count("*").alias("n")).first()["n"]
    shards, blocks = max(LEAST_SHARDS, math.ceil(sizes[0] / shard)), max(1, math.ceil(sizes[1] / block))
    # Every shard meets every block of queries, in a task of its own.
    dealt = own.select(F.lit(0).alias("kind"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = asked.select(F.lit(1).alias("kind"), "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def run(group: pa.Table) -> pa.Table:
        kind, ids = group["kind"].to_numpy(), group["id"].to_numpy()
        flat = group["v"].combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        found = Shard(ids[kind == 0], x[kind == 0]) if (kind == 0).any() else None
        asks = [*zip(ids[kind == 1].tolist(), group["twin"].to_numpy()[kind == 1].tolist(), x[kind == 1])]
        parts = [(q, t, *found.nearest(q, v, k)) for q, t, v in asks] if found else []
        n = [len(p[2]) for p in parts]
        cols = [*(np.repeat(np.array([p[j] for p in parts], np.int64), n) for j in (0, 1)), *(np.concatenate([p[j] for p in parts]) for j in (2, 3))] if sum(n) else [*np.empty((3, 0), np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0]), "twin": pa.array(cols[1]), "vec_id": pa.array(cols[2]), "score": pa.array(cols[3])})

    both = dealt.union(asking).withColumns({"dims": F.size("v"), "twin": F.when(F.col("kind") == 1, F.xxhash64("v")).otherwise(0)})
    found = both.groupBy("shard", "block", "dims").applyInArrow(run, "query_id long, twin long, vec_id long, score double")
    order = Window.partitionBy("query_id", "twin").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
