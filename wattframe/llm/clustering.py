"""Exact integer k-means over dictionary-encoded vectors: distances are worked out by distinct subvector and summed by code."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import written

CLUSTERS, ROUNDS, SEED = 8, 10, 3
DIMENSIONS, SCALE = 64, 1024
#: Vectors encoded together, and the widest dimension block tried.
CHUNK, WIDEST = 8192, 8
#: Components up to this size keep every distance of 64 of them within a long; beyond it Python's integers count.
SMALL = 1 << 27
LONG = 1 << 63

_ENCODED = "ids array<long>, blocks array<struct<first:int,width:int,codes:binary,words:binary>>"


def whole_vector(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as doubles (exact integers); null for a vector that takes no part."""
    made = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    raw = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    usable = F.forall(raw, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float(LONG)), F.lit(False)))
    return F.when((F.size(vector) == dimensions) & usable, made)


def dictionary_blocks(data: np.ndarray, widest: int = WIDEST) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first dimension, width, codes, words): for each block of dimensions the distinct subvectors and each row's code.

    A block is halved as long as more than a quarter of its subvectors are distinct, so copies share wide words
    and other vectors narrow ones. Nothing is lost: words[codes] is the block.
    """
    out = []

    def encode(first: int, width: int) -> None:
        part = np.ascontiguousarray(data[:, first : first + width])
        if width == 1:
            words, codes = np.unique(part[:, 0], return_inverse=True)
        else:
            _, at, codes = np.unique(part.view(f"V{8 * width}")[:, 0], return_index=True, return_inverse=True)
            words = part[at]
            if len(at) * 4 > len(part):
                half = width // 2
                encode(first, half)
                encode(first + half, width - half)
                return
        out.append((first, width, codes.astype(np.uint32), words.reshape(-1, width)))

    for first in range(0, data.shape[1], widest):
        encode(first, min(widest, data.shape[1] - first))
    return out


def _whole(words: np.ndarray, small: bool) -> np.ndarray:
    return words.astype(np.int64) if small else np.array([[int(x) for x in row] for row in words], object)


def block_distances(words: np.ndarray, centroids: list[list[int]], small: bool) -> np.ndarray:
    """The exact squared distance of each word to the matching part of each centroid."""
    parts = np.array(centroids, np.int64 if small else object)
    return np.stack([((words - c) ** 2).sum(1) for c in parts], 1)


class Chunk:
    """An encoded chunk, ready for distances and sums. `small` says that longs are wide enough."""

    def __init__(self, blocks: list[dict], centroids: list[list[int]]):
        self.blocks, largest = [], max((abs(x) for c in centroids for x in c), default=0)
        for b in blocks:
            words = np.frombuffer(b["words"]).reshape(-1, b["width"])
            largest = max(largest, np.abs(words).max(initial=0))
            self.blocks.append((b["first"], b["width"], np.frombuffer(b["codes"], np.uint32), words))
        self.small = largest <= SMALL
        self.centroids = centroids
        self.blocks = [(first, width, codes, _whole(words, self.small)) for first, width, codes, words in self.blocks]

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector, ties to the smaller number, and its distance."""
        whole = 0
        for first, width, codes, words in self.blocks:
            whole = whole + block_distances(words, [c[first : first + width] for c in self.centroids], self.small)[codes]
        cluster = np.argmin(whole, 1)
        return cluster, whole[np.arange(len(cluster)), cluster]

    def sums(self, cluster: np.ndarray) -> list[list[int]]:
        """For each cluster the sum of its vectors: how often each word occurs there, times the word."""
        k, out = len(self.centroids), [[] for _ in self.centroids]
        for _, _, codes, words in sorted(self.blocks, key=lambda b: b[0]):
            often = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
            total = (often if self.small else often.astype(object)) @ words
            for c in range(k):
                out[c].extend(int(x) for x in total[c])
        return out


def encoded(vectors: DataFrame) -> DataFrame:
    """(ids, blocks): the vectors `v` in chunks, each encoded by dictionaries of its own, where they lie."""

    def chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        flat = pa.compute.list_flatten(whole.column("v")).to_numpy() + 0.0  # no negative zero
        blocks = [
            {"first": first, "width": width, "codes": codes.tobytes(), "words": words.tobytes()}
            for first, width, codes, words in dictionary_blocks(flat.reshape(whole.num_rows, -1))
        ]
        kinds = pa.struct([("first", pa.int32()), ("width", pa.int32()), ("codes", pa.binary()), ("words", pa.binary())])
        ids = pa.array([whole.column("id").to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([blocks], pa.list_(kinds))], ["ids", "blocks"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CHUNK - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == CHUNK:
                    yield chunk(held)
                    held = []
        if held:
            yield chunk(held)

    return vectors.select("id", "v").mapInArrow(made, _ENCODED)


def _chunks(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.Array, Chunk]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column("ids")[row].values, Chunk(batch.column("blocks")[row].as_py(), centroids)


def next_centroids(chunks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each cluster's vectors; a cluster without one keeps its centroid.

    A task hands on one row a cluster and dimension, and the driver gets as many.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(centroids)
        totals = [[0] * len(c) for c in centroids]
        for _, chunk in _chunks(batches, centroids):
            cluster, _ = chunk.nearest()
            for c, (often, added) in enumerate(zip(np.bincount(cluster, minlength=len(n)), chunk.sums(cluster), strict=True)):
                n[c] += int(often)
                totals[c] = [a + b for a, b in zip(totals[c], added, strict=True)]
        rows = [(c, d, n[c], str(x)) for c, total in enumerate(totals) if n[c] for d, x in enumerate(total)]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("cluster", "d", "n", "total"), r, strict=True)) for r in rows],
            pa.schema([("cluster", pa.int32()), ("d", pa.int32()), ("n", pa.int64()), ("total", pa.string())]),
        )

    rows = chunks.mapInArrow(summed, "cluster int, d int, n long, total string")
    sums = rows.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for r in sums.collect():
        out[r["cluster"]][r["d"]] = int(r["total"]) // r["n"]
    return out


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """The nearest centroid of each vector after `rounds` rounds: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x), and all that follows is exact in integers. Centroids start as the vectors with
    the least sha256 of seed:id. A round assigns every vector (ties to the smaller number), then moves each
    centroid to the floor of its vectors' mean; rounds that would change nothing more are skipped.

    Vectors are written once, in chunks whose dimension blocks are encoded by dictionaries; a round reads the chunks
    where they lie, works out distances once for each distinct subvector of a chunk and sends on one row a cluster
    and dimension. No vector is shuffled, so many equal ones make no task larger.

    Vectors that are null, have another length, hold null or non-finite components or one whose scaled size reaches 2^63
    take no part. A null id is hashed as an empty one; repeated rows count each. A distance or inertia beyond a
    long is null. Fewer vectors than clusters give fewer centroids, an empty table no rows. Other columns are not read.
    """
    vectors = rows.select(F.col(id_column).cast("long").alias("id"), whole_vector(F.col(vector_column), dimensions, scale).alias("v"))
    vectors = vectors.where("v IS NOT NULL")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    centroids = [[int(x) for x in r["v"]] for r in starts]
    shape = "vec_id long, cluster int, distance long"
    if not centroids:
        nothing = vectors.sparkSession.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid_sha256 string")
        return nothing
    chunks = written(encoded(vectors), "chunks")
    for _ in range(rounds):
        moved = next_centroids(chunks, centroids)
        if moved == centroids:
            break
        centroids = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches, centroids):
            number, distance = chunk.nearest()
            fits = pa.array([int(x) if x < LONG else None for x in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), fits], ["vec_id", "cluster", "distance"])

    placed = written(chunks.mapInArrow(assigned, shape), "clusters")
    # A sum of distances of which one is beyond a long is beyond it too.
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = dict(placed.groupBy("cluster").agg(total.alias("inertia")).collect())
    whole = None if None in by.values() else int(sum(by.values()))

    def long(value) -> Column:
        return F.lit(None if value is None or value >= LONG else int(value)).cast("long")

    own = F.array(*[long(by.get(c, 0)) for c in range(len(centroids))])
    digests = F.array(*[F.lit(centroid_sha256(c)) for c in centroids])
    return placed.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(own, F.col("cluster")).alias("cluster_inertia"),
        long(whole).alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
