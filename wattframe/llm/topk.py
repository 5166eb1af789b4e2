"""Exact top-k inner products by an impact-ordered index processed score at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.session import stage

K = 10
SCALE = 1024
#: Vectors of an index block and queries of a query block; a task holds one of each.
BLOCK = 8192
QUERY_BLOCK = 512
#: Posting segments (levels of quantised impact) for each dimension.
LEVELS = 12


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component as a double; null for a vector with a null or non-finite component."""
    raw = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    usable = F.forall(raw, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    # floor gives a long; beyond 2^53 a double is whole as it is.
    whole = F.transform(raw, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    return F.when(usable, whole)


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The inner products of integers held in doubles, exact; one beyond a long counts as the nearest long."""
    bound = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query))
    if bound < 1 << 53:
        return (vectors @ query).astype(np.int64)
    if bound < 1 << 62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    own = [int(x) for x in query]
    sums = (sum(int(a) * b for a, b in zip(v, own, strict=True)) for v in vectors)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


class ImpactIndex:
    """Postings of one block: for each dimension, ids in segments of like impact.

    A segment holds the ids whose component lies in one quantised range; its impact is the middle of the range
    and `slack` the most by which a component in it differs.
    """

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        self.segments: list[tuple[int, float, np.ndarray]] = []
        self.slack = np.zeros(vectors.shape[1])
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            lo, hi = column.min(), column.max()
            step = max(1.0, (hi - lo + 1) / levels)
            level = ((column - lo) / step).astype(np.int64)
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for ids in np.split(order, cuts):
                top, bottom = column[ids].max(), column[ids].min()
                middle = (top + bottom) / 2
                self.segments.append((d, float(middle), ids))
                self.slack[d] = max(self.slack[d], top - middle, middle - bottom)
        self.reach = np.array([max((abs(m) for e, m, _ in self.segments if e == d), default=0.0) for d in range(vectors.shape[1])])

    def search(self, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best of the block as (ids, scores), ties to the smaller id; `own` is left out.

        Segments go by descending impact, summed up for all queries of the block. What is left undone bounds each
        score from both sides; once, for every query, the vectors that could still be among its k best are few,
        the work stops, and those are scored exactly. Without that proof all segments are processed.
        """
        n, m = len(ids), len(queries)
        score = np.zeros((m, n))
        weight = np.abs(queries)
        strength = weight.max(0, initial=0)
        order = sorted(range(len(self.segments)), key=lambda s: -abs(self.segments[s][1]) * strength[self.segments[s][0]])
        same = own[:, None] == ids[None, :]
        # A dimension's undone share: its largest impact not yet processed (segments of it go by descending impact).
        undone = self.reach.copy()
        left: list[list[float]] = [[] for _ in self.reach]
        for s in reversed(order):
            left[self.segments[s][0]].append(abs(self.segments[s][1]))
        checks = {len(order) * c // 8 for c in range(4, 8)} | {len(order)}
        possible = ~same
        # Twice what rounding can add to a sum of doubles, of the largest one there may be.
        rounding = (weight @ np.abs(self.vectors).max(0, initial=0) * 1e-12)[:, None] + 1e-6
        for done, s in enumerate(order, 1):
            d, impact, members = self.segments[s]
            score[:, members] += queries[:, d, None] * impact
            left[d].pop()
            undone[d] = max(left[d], default=0.0)
            if done in checks:
                error = (weight @ (undone + self.slack))[:, None] + rounding
                # Scores beyond a long are all the nearest one.
                high, low = (np.clip(x, -float(1 << 63), float(1 << 63)) for x in (score + error, score - error))
                low = np.where(same, -np.inf, low)
                if n > k:
                    bar = np.partition(low, n - k, axis=1)[:, n - k, None]
                    possible = (high >= bar) & ~same
                else:
                    possible = ~same
                if possible.sum() <= max(4 * k * m, n * m // 50):
                    break
        out = []
        for q in range(m):
            members = np.flatnonzero(possible[q])
            exact = exact_products(self.vectors[members], queries[q])
            # ~x turns the order of all longs around, the least one's too.
            best = np.lexsort((ids[members], ~exact))[:k]
            out.append((ids[members][best], exact[best]))
        return out


def top_inner_products(
    rows: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K, scale: int = SCALE
) -> DataFrame:
    """Each query's k highest integer inner products with every other row: (query_id, rank, vec_id, score).

    Components become floor(scale * x). Ties go to the smaller id. Rows with a null id, a null vector, or a null
    or non-finite component take no part. Vectors of different lengths never meet; empty ones meet with score 0. Scores are
    exact at any size, and one beyond a long counts as the nearest long. Rows that repeat an id count
    once, the one with the least vector; fewer rows than k give fewer results, an empty table none.

    Blocks of vectors meet blocks of queries: every row is shuffled once for each block of queries and every
    query once for each block of vectors, a task holds one block of each, and hands on k rows for a query.
    """
    vectors = rows.select(F.col(id_column).cast("long").alias("id"), scaled(F.col(vector_column), scale).alias("v"), is_query.alias("q"))
    vectors = stage(
        vectors.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    )
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("m"))
    most = sizes.agg(F.max("n"), F.max("m")).first()
    blocks, query_blocks = (max(1, math.ceil((x or 0) / size)) for x, size in zip(most, (BLOCK, QUERY_BLOCK), strict=True))
    left = vectors.select(
        F.size("v").alias("d"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("c"),
        "id",
        "v",
    )
    right = vectors.where("q").select(
        F.size("v").alias("d"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"),
        F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_blocks)).cast("int").alias("c"),
        "id",
        "v",
    )

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.sort_by("id").combine_chunks()
        flat = t.column("v").combine_chunks().flatten().to_numpy().astype(float)
        return t.column("id").to_numpy(), flat.reshape(t.num_rows, -1)

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if own.num_rows == 0 or asked.num_rows == 0:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        (ids, data), (queries, wanted) = matrix(own), matrix(asked)
        found = ImpactIndex(data).search(ids, wanted, queries, k)
        return pa.table(
            [
                pa.array(np.repeat(queries, [len(f[0]) for f in found])),
                pa.array(np.concatenate([f[0] for f in found])),
                pa.array(np.concatenate([f[1] for f in found])),
            ],
            names,
        )

    keys = ["d", "b", "c"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
