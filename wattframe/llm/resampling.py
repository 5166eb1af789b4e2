"""Importance resampling towards a target corpus: bucket gains, Gumbel noise, exact ranks by regular sampling."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.llm.common import slices
from wattframe.session import stage

GRAMS = (1, 1)
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Rows aimed at in a run, and the most runs. Runs send as many samples each as there are runs: MOST_RUNS^2 in all.
RUN_ROWS = 1 << 18
MOST_RUNS = 512
#: Bytes of a text worked on at a time.
BLOCK = 1 << 20
#: Words whose bucket a task remembers.
REMEMBERED = 1 << 18

#: In lower-cased UTF-8: digits, a-z and every byte of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


class Buckets(dict):
    """Bucket by feature, worked out when first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = found
        return found


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, block by block; a block ends at a gap between words."""
    at = 0
    while at < len(text):
        end = at + block
        # The gap at or after the block's end; a word longer than a block is looked through block by block.
        while end < len(text):
            gap = _GAP.search(text, end, end + block)
            if gap:
                end = gap.start()
                break
            end += block
        yield _WORD.findall(text[at:end].lower())
        at = end


def feature_buckets(text: bytes, known: Buckets, grams: tuple[int, int] = GRAMS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of each block of a text: runs of grams[0] to grams[1] words, across blocks too."""
    least, most = grams
    carried: list[bytes] = []
    for words in word_blocks(text):
        run = carried + words
        found = []
        for n in range(least, most + 1):
            # Runs that end in this block.
            first = max(0, len(carried) - n + 1)
            features = run[first:] if n == 1 else [b" ".join(run[i : i + n]) for i in range(first, len(run) - n + 1)]
            found.append(np.fromiter(map(known.__getitem__, features), np.int64, len(features)))
        carried = run[len(run) - most + 1 :] if most > 1 else []
        yield len(words), np.concatenate(found)


def bucket_counts(texts: DataFrame, column: str = "text", grams=GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task hands on one row a bucket, the driver gets `buckets` rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", BLOCK):
            for text in batch.column("text").cast(pa.large_binary()).fill_null(b""):
                for _, found in feature_buckets(text.as_py(), known, grams):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    rows = texts.select(F.col(column).alias("text")).mapInArrow(counted, "bucket long, n long")
    whole = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        whole[bucket] = n
    return whole


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a feature of a bucket is in the target than here, one added to each count."""
    buckets = len(own)
    there, here = float(target.sum() + buckets), float(own.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * here / ((float(s) + 1) * there))) for s, t in zip(own, target, strict=True)],
        np.int64,
    )


def noise(doc_id: object, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id. A null id is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, grams=GRAMS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of doc_id and text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gains))
        for batch in slices(batches, "text", BLOCK):
            ids = batch.column("doc_id").to_pylist()
            made = np.zeros((4, len(ids)), np.int64)
            for row, text in enumerate(batch.column("text").cast(pa.large_binary()).fill_null(b"")):
                for n, found in feature_buckets(text.as_py(), known, grams):
                    made[:3, row] += n, len(found), gains[found].sum()
                made[3, row] = made[2, row] + noise(ids[row], seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, made)], ["doc_id", "n_words", "n_features", "weight", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_features long, weight long, score long"
    return docs.select("doc_id", "text").mapInArrow(score, shape)


def _segments(rows: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each row how many splitters are at or before it; keys are columns, the first counts most."""
    n = len(rows[0])
    both = [np.concatenate(c) for c in zip(rows, splitters, strict=True)]
    is_row = np.arange(len(both[0])) < n
    order = np.lexsort((is_row, *reversed(both)))
    before = np.cumsum(~is_row[order])
    out = np.zeros(len(order), np.int64)
    out[order] = before
    return out[:n]


def first_ranks(rows: DataFrame, keys: list[str], first: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """`rows` with the column rank: 1, 2, 3 ... for the `first` rows in ascending order of the long columns `keys`, else null.

    Parallel sorting by regular sampling. Rows are sorted in p local runs and each run sends every so many rows as a
    sample, p for a run of average length; p - 1 regular splitters of the sorted samples cut the runs in segments. The
    segments of one part meet in one task, which merges and numbers them, and the sizes of the parts before it make the
    number exact. Parts behind the last rank wanted don't move at all. Rows equal in all keys are told apart by
    their place, so no part grows with copies: it holds at most about twice its share. Keys must not be null, and no
    column may be called _place, _part or rank.
    """
    n = rows.count()
    if n == 0 or first <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    p = max(1, min(MOST_RUNS, math.ceil(n / run_rows)))
    full = [*keys, "_place"]
    runs = stage(rows.coalesce(p).withColumn("_place", F.monotonically_increasing_id()).sortWithinPartitions(*full))
    step = max(1, n // (p * p))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(batch.num_rows)
            yield batch.take(pa.array(at[(at + seen + 1) % step == 0]))
            seen += batch.num_rows

    samples = runs.select(*full).mapInArrow(sampled, ", ".join(f"`{c}` long" for c in full)).collect() if p > 1 else []
    samples.sort()
    splitters = [samples[len(samples) * i // p] for i in range(1, p)] if samples else []
    columns = [np.array([s[c] for s in splitters], np.int64) for c in full]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _segments([batch.column(c).to_numpy() for c in full], columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "_part"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    dealt = stage(runs.mapInArrow(cut, f"{shape}, _part long"))
    sizes = dict(dealt.groupBy("_part").count().collect())
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(p)])])
    starts = F.element_at(F.array(*[F.lit(int(b)) for b in before[:p]]), (F.col("_part") + 1).cast("int")).cast("long")
    needed = int(np.searchsorted(before[:p], first, "left"))
    inside = Window.partitionBy("_part").orderBy(*full)
    rank = starts + F.row_number().over(inside)
    ranked = dealt.where(F.col("_part") < needed).withColumn("rank", F.when(rank <= first, rank))
    rest = dealt.where(F.col("_part") >= needed).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_place", "_part")


def resample(
    docs: DataFrame,
    target: DataFrame,
    grams: tuple[int, int] = GRAMS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Every document with its weight towards the texts of `target`, and the rank of those drawn.

    Columns: doc_id, n_features, weight, score, rank. Features are runs of words (a-z, digits and all beyond ASCII,
    A-Z lower-cased) hashed in buckets; a document weighs the sum of its features' gains, and noise from its id makes
    taking the highest scores a draw without putting back. Of the N documents with `least_words` words or more
    floor(percent * N / 100) are drawn, ties to the smaller doc_id.

    Null and empty texts have no features and weight 0. A null doc_id comes last in a tie. Repeated rows count, weigh
    and may be drawn each. An empty target or corpus leaves only the added ones. Other columns of both are not read.
    """
    gains = bucket_gains(bucket_counts(docs, "text", grams, buckets), bucket_counts(target, "text", grams, buckets))
    rows = stage(scored(docs, gains, grams, seed))
    able = rows.where(F.col("n_words") >= least_words)
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keyed = able.withColumns({"_down": -F.col("score"), "_id": last})
    ranked = first_ranks(keyed, ["_down", "_id"], percent * able.count() // 100, run_rows)
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
