"""Nearest neighbours by vantage-point trees per shard.

Rows are dealt into shards by hash, each row once. A partition holds one shard: its data rows come first and become a tree (vantage point, median distance, inner and
outer half), then the queries stream past it in Arrow batches. A batch walks the tree together, nearer half first; a subtree is pruned for a query when the triangle inequality's
lower bound, the largest over all vantage points above it, times `factor` exceeds the query's k-th best distance. Factor 1 is exact, larger factors prune more and may miss
neighbours. The best k of each shard are merged by rank.

In a leaf, distances from one matrix product choose which pairs are measured exactly (all that could be among the k, by a margin far above its rounding), so scores and ties
are those of differences squared and summed in double precision.

Every row is a candidate of every query but itself: rows that repeat an id are rows of their own, as queries too. Equal vectors of a shard hang on one point of the tree, by the k + 1
smallest of their ids; more can't be among the k nearest of any query.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do null ids; vectors are compared with those of the same length only; ties go to the smaller
id; a query with fewer candidates than k gets them all; an empty table gives an empty result; only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import shards, staged

K, LEAF, FACTOR = 10, 256, 1.0
#: A shard has n / `SHARDS` rows, but no fewer and no more than these.
SHARDS, SMALLEST, LARGEST = 64, 4_096, 131_072
#: Queries that walk a tree together.
BATCH = 1024


class Tree:
    """A vantage-point tree over distinct points; each point carries its rows (id, key) in order, `k + 1` at most."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int = K, leaf: int = LEAF):
        x = np.ascontiguousarray(x + 0.0)  # no negative zero
        _, point = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((keys, ids, point))
        first = np.flatnonzero(np.r_[True, np.diff(point[order]) != 0])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        order = order[place <= k]
        self.first = np.flatnonzero(np.r_[True, np.diff(point[order]) != 0])
        self.many = np.diff(np.r_[self.first, len(order)])
        self.ids, self.keys, self.k, self.leaf = ids[order], keys[order], k, leaf
        self.x = x[order[self.first]]
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.order = np.arange(len(self.x))
        self.computed = 0
        self.nodes: dict[tuple[int, int], tuple[int, float, float, float, float]] = {}
        todo = [(0, len(self.x))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf:
                continue
            own = self.order[lo:hi]
            pick = int(np.argmax(distances(self.x[own[0]], self.x[own])))  # a far point spreads the distances
            own[0], own[pick] = own[pick], own[0]
            d = distances(self.x[own[0]], self.x[own[1:]])
            by = np.argsort(d, kind="stable")
            own[1:] = own[1:][by]
            d = d[by]
            half = len(d) // 2
            self.nodes[lo, hi] = (lo + 1 + half, d[0], d[half - 1], d[half], d[-1])
            todo += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]

    def search(self, q: np.ndarray, q_keys: np.ndarray, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the ids of its k best rows, whether there is such a row, and their distances; the row with the query's own key is left out."""
        k, big = self.k, np.iinfo(np.int64).max
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), big)
        squares = np.einsum("ij,ij->i", q, q)

        def offer(at: np.ndarray, points: np.ndarray) -> None:
            self.computed += len(at) * len(points)
            near = squares[at][:, None] + self.squares[points] - 2 * q[at] @ self.x[points].T
            margin = 1e-9 * (squares[at] + self.squares[points].max())  # far above the rounding of the product
            limit = best_d[at, -1] ** 2
            if len(points) > k + 1:
                limit = np.minimum(limit, np.partition(near, k, axis=1)[:, k] + margin)  # k + 1 points: one may be the query's own
            a, p = np.nonzero(near <= (limit + margin)[:, None])
            if not len(a):
                return
            a, p = at[a], points[p]
            d = distances(q[a], self.x[p])
            rows = _ranges(self.first[p], self.many[p])
            a, d = np.repeat(a, self.many[p]), np.repeat(d, self.many[p])
            other = self.keys[rows] != q_keys[a]
            a, d, i = a[other], d[other], self.ids[rows[other]]
            some = np.unique(a)
            a, d, i = np.r_[np.repeat(some, k), a], np.r_[best_d[some].ravel(), d], np.r_[best_i[some].ravel(), i]
            by = np.lexsort((i, d, a))
            start = np.searchsorted(a[by], some)
            keep = by[(start[:, None] + np.arange(k)).ravel()]
            best_d[some], best_i[some] = d[keep].reshape(-1, k), i[keep].reshape(-1, k)

        def visit(lo: int, hi: int, at: np.ndarray, bound: np.ndarray) -> None:
            live = bound * factor <= best_d[at, -1] * (1 + 1e-12)  # rounding must not prune a tie
            at, bound = at[live], bound[live]
            if not len(at) or lo == hi:
                return
            if (lo, hi) not in self.nodes:
                offer(at, self.order[lo:hi])
                return
            mid, in_lo, in_hi, out_lo, out_hi = self.nodes[lo, hi]
            offer(at, self.order[lo : lo + 1])
            d = distances(q[at], self.x[self.order[lo]])
            inner = np.maximum(bound, np.maximum(d - in_hi, in_lo - d))
            outer = np.maximum(bound, np.maximum(d - out_hi, out_lo - d))
            near = inner <= outer
            visit(lo + 1, mid, at[near], inner[near])
            visit(mid, hi, at[~near], outer[~near])
            visit(mid, hi, at[near], outer[near])
            visit(lo + 1, mid, at[~near], inner[~near])

        visit(0, len(self.x), np.arange(len(q)), np.zeros(len(q)))
        return best_i, np.isfinite(best_d), best_d


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows (or of one row to many), differences summed from the first component to the last in double precision."""
    total = np.zeros(max(len(np.atleast_2d(a)), len(np.atleast_2d(b))))
    for j in range(a.shape[-1]):
        diff = a[..., j] - b[..., j]
        total += diff * diff
    return np.sqrt(total)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key, v (array<double>) of the rows that take part; to be written, as the key numbers rows of one reading."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return rows.where(finite).select("id", F.monotonically_increasing_id().alias("key"), "v")


def nearest(vectors: DataFrame, is_query: Column | str, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, shares: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance) of the k nearest found of every query row. `is_query`: condition on column `id`.

    `shares` gives, instead, a row for each batch of queries and shard: pairs (of query and distinct point) and computed (those whose distance was computed).
    """
    if factor < 1:
        raise ValueError("factor is 1 or more")
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    n_shards = shards(n, shard_rows or min(LARGEST, max(SMALLEST, n // SHARDS)))
    kept = [F.size("v").alias("dim"), "id", "key", "v"]
    data = rows.select(*kept, F.expr(f"cast(pmod(xxhash64(key), {n_shards}) as int)").alias("shard"), F.lit(False).alias("q"))
    asked = rows.where(F.expr(is_query) if isinstance(is_query, str) else is_query).select(*kept, F.explode(F.expr(f"sequence(0, {n_shards - 1})")).alias("shard"), F.lit(True).alias("q"))
    dealt = data.unionByName(asked).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "dim", "q")
    if shares:
        schema = pa.schema([("pairs", pa.int64()), ("computed", pa.int64())])
    else:
        schema = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            shard, dim, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "q"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | np.diff(q)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if at != (shard[lo], dim[lo]):
                    at, held, tree = (shard[lo], dim[lo]), [], None
                part = batch.slice(lo, hi - lo)
                ids, keys = part.column("id").to_numpy(), part.column("key").to_numpy()
                x = part.column("v").flatten().to_numpy().reshape(hi - lo, -1)
                if not q[lo]:
                    held.append((x, ids, keys))
                    continue
                if tree is None and held:
                    tree, held = Tree(*map(np.concatenate, zip(*held, strict=True)), k), []
                for some in range(0, len(x) if tree else 0, BATCH):
                    mine = slice(some, some + BATCH)
                    before = tree.computed
                    found, hit, d = tree.search(x[mine], keys[mine], factor)
                    if shares:
                        yield pa.record_batch([[len(found) * len(tree.x)], [tree.computed - before]], schema=schema)
                    else:
                        yield pa.record_batch([np.repeat(keys[mine], hit.sum(1)), np.repeat(ids[mine], hit.sum(1)), found[hit], d[hit]], schema=schema)

    if shares:
        return dealt.mapInArrow(search, "pairs long, computed long")
    got = dealt.mapInArrow(search, "key long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
