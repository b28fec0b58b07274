"""Nearest neighbours with vantage-point trees, one a shard.

Vectors are dealt to shards of bounded size by a hash of vec_id; each shard builds
one tree and answers a block of queries at a time; the nearest of all shards are
merged. A subtree is skipped when the triangle inequality's lower bound, times
``factor``, is beyond the query's current k-th distance: factor 1 is exact, larger
ones skip more. Production uses factor 1.

Equal vectors of a shard are one point with its smallest ids, as no query needs
more than k + 1 of them, so a very common vector costs no more than another.

Edge cases: vectors that are null, zero or hold a null or non-finite component
take no part; vectors of different lengths are never near one another; rows with
one vec_id are one candidate each time they differ, never their own query's; ties
go to the smaller vec_id; with fewer candidates than k all are returned; a null
vec_id takes no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pick, table

K, QUERY_STEP, FACTOR = 10, 100, 1.0
LEAF, SHARD_ROWS, QUERY_BLOCK = 128, 16_384, 4_096
FOUND = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b; squares are added component by component, so
    that a pair's distance is the same number wherever it is worked out."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        x = a[:, j, None] - b[None, :, j]
        total += x * x
    return np.sqrt(total)


class Tree:
    def __init__(self, points: np.ndarray, seed: int = 7) -> None:
        self.points, self.rng = points, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> tuple:
        if len(ids) <= LEAF:
            return (ids,)
        v = ids[self.rng.integers(len(ids))]
        d = distances(self.points[ids], self.points[v : v + 1])[:, 0]
        by = np.argsort(d, kind="stable")
        ids, d, mid = ids[by], d[by], len(ids) // 2
        return (v, (d[0], d[mid - 1]), self._build(ids[:mid]), (d[mid], d[-1]), self._build(ids[mid:]))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and distances of the k nearest points of each query (-1: fewer than k points)."""
        n = len(queries)
        best, dist = np.full((n, k), -1), np.full((n, k), np.inf)

        def visit(node: tuple, q: np.ndarray) -> None:
            if len(node) == 1:
                ids = node[0]
                for lo in range(0, len(q), 256):  # blocks, so that memory is bounded
                    own = q[lo : lo + 256]
                    d = distances(queries[own], self.points[ids])
                    d = np.hstack([dist[own], d])
                    i = np.hstack([best[own], np.broadcast_to(ids, (len(own), len(ids)))])
                    by = np.lexsort((i, d), axis=1)[:, :k]
                    dist[own], best[own] = np.take_along_axis(d, by, 1), np.take_along_axis(i, by, 1)
                return
            v, (a, b), inner, (c, e), outer = node
            d = distances(queries[q], self.points[v : v + 1])[:, 0]
            bounds = np.maximum(np.maximum(d - b, a - d), 0), np.maximum(np.maximum(d - e, c - d), 0)
            first = bounds[0] <= bounds[1]
            for side in (first, ~first):
                for go_inner in (True, False) if side is first else (False, True):
                    near = factor * bounds[0 if go_inner else 1][side] <= dist[q[side], -1] * (1 + 1e-12)
                    if near.any():
                        visit(inner if go_inner else outer, q[side][near])

        if len(self.points) and n:
            visit(self.root, np.arange(n))
        return best, dist


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _search(k: int, factor: float):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(points) and len(queries):
            p = np.stack(points["v"].to_numpy()).astype(np.float64)
            ids = points["vec_id"].to_numpy()
            # Points by vector, then id; each point keeps its k + 1 smallest ids.
            p, inverse = np.unique(p, axis=0, return_inverse=True)
            by = np.lexsort((ids, inverse.ravel()))
            own = [np.unique(x)[: k + 1] for x in np.split(ids[by], np.cumsum(np.bincount(inverse.ravel()))[:-1])]
            q, qid = np.stack(queries["v"].to_numpy()).astype(np.float64), queries["vec_id"].to_numpy()
            # The query's own point may be among the nearest with no other id to give: one point more.
            best, dist = Tree(p).search(q, k + 1, factor)
            for i, query in enumerate(qid):
                for j, d in zip(best[i], dist[i], strict=True):
                    if j >= 0:
                        near = own[j][own[j] != query]
                        out["query_id"] += [query] * len(near)
                        out["vec_id"] += near.tolist()
                        out["score"] += [d] * len(near)
        got = pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return got.sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)

    return run


def nearest(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = K, factor: float = FACTOR, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each row whose vec_id is divisible by ``query_step``."""
    v = pick(vectors, "vec_id", column).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    v = cut(v.where("vec_id IS NOT NULL").where(_usable(F.col("v"))).withColumn("dim", F.size("v")))
    q = v.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id", "v"])
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((v, SHARD_ROWS), (q, QUERY_BLOCK)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    p = v.withColumn("shard", part(shards)).withColumn("block", spread(blocks))
    q = q.withColumn("block", part(blocks)).withColumn("shard", spread(shards))
    keys = ("dim", "shard", "block")
    found = p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(_search(k, factor), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


SQL = {"op10_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""}
