"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import held_out, slices, utf8

#: log2 of the number of weights.
BITS = 18
#: About so many labelled documents are learned from, chosen by hash of the id, in so many passes.
TRAIN_DOCS = 20_000
PASSES = 4
#: Step size, its smoothing, and the penalties on the sum and on the squares of the weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
THRESHOLD = 0.3

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes by kind: lower and other letters, capitals, digits, stops, other signs.
_SHAPE = np.full(256, 5, np.uint64)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[[ord(c) for c in ".,;:'\"-"]] = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLY
    return x ^ (x >> np.uint64(32))


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, repeats included, and how many each text has.

    A word is hashed by a polynomial in its bytes. Features are words, pairs of words, pairs of words that are
    equal (as one feature), and the outline of a word (runs of capitals, digits, stops and signs collapsed),
    alone and with the next word's. A text without a word has none.
    """
    n, shift = len(data), np.uint64(64 - bits)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    ink = ~_SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    edge = at[:-1][at[:-1] < n]
    begins[edge] = ink[edge]
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    word = np.cumsum(begins)[ink] - 1
    place = np.arange(n)[ink] - start[word]
    powers = np.cumprod(np.full(min(int(place.max()) + 1, 64), _BASE, np.uint64))
    weight = powers[place & 63] ^ (place >> 6).astype(np.uint64)
    bytes_ = data[ink]
    letters = np.bincount(word)
    first = np.concatenate([[0], np.cumsum(letters)[:-1]])
    text = np.add.reduceat(_mixed(bytes_.astype(np.uint64) + np.uint64(1)) * weight, first)
    kind = _SHAPE[bytes_]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[first] = True
    nth = np.cumsum(turn) - 1
    nth = nth - nth[first][word]
    outline = np.add.reduceat(np.where(turn, _mixed(kind + np.uint64(7)) * powers[np.minimum(nth, len(powers) - 1)], np.uint64(0)), first)
    row = np.searchsorted(at, start, "right") - 1
    follows = np.flatnonzero(row[1:] == row[:-1])
    equal = text[follows] == text[follows + 1]
    parts = [
        (_mixed(text), row),
        (_mixed(outline + np.uint64(11)), row),
        (_mixed(text[follows] * _BASE + text[follows + 1]), row[follows]),
        (_mixed(outline[follows] * _BASE + outline[follows + 1] + np.uint64(13)), row[follows]),
        (_mixed(equal.astype(np.uint64) + np.uint64(17)), row[follows]),
    ]
    hashed = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] for p in parts])
    by = np.argsort(owner, kind="stable")
    return (hashed[by] >> shift).astype(np.int64), np.bincount(owner, minlength=len(at) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, passes: int = PASSES) -> Model:
    """One update for each document and pass. A document's features have length one; the bias is a feature of its own."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    packed = []
    for r in rows:
        index, count = np.unique(r, return_counts=True)
        value = count / max(1e-9, np.sqrt((count.astype(float) ** 2).sum()))
        packed.append((np.append(index, 1 << bits), np.append(value, 0.2)))
    for _ in range(passes):
        for (index, value), y in zip(packed, labels, strict=True):
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (_logistic(w @ value) - y) * value
            z[index] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1].astype(np.float32), float(w[-1]) * 0.2)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        index, n = features(*utf8(batch.column("text")))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(index.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), lists], ["key", "y", "f"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model learned from all rows, in their order."""
    rows, labels = [], []
    for batch in batches:
        lists = batch.column("f")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        rows += [flat[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]
        labels.append(batch.column("y").to_numpy())
    if rows:
        model = ftrl(rows, np.concatenate(labels).astype(float))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias])], ["weights", "bias"]
        )


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn `quality` from labelled documents that aren't held out.

    Features are made in Spark from whole texts; one task makes the updates over the bounded sample, in the order
    of a hash, and the driver gets the weights. Ids with labels that disagree, and null labels, are left out.
    """
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("_y"))
        .where("y = _y")
        .select("doc_id", F.xxhash64("doc_id", F.lit("quality")).alias("key"), (F.col("y") == 1).cast("int").alias("y"))
    )
    many = known.count()
    chance = F.pmod("key", F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(chance * max(many, 1) < train_docs)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    made = picked.select("key", "y", "text").mapInArrow(_featurise, "key long, y int, f array<int>")
    got = made.repartition(1).sortWithinPartitions("key", "y").mapInArrow(_learn, "weights binary, bias double").first()
    if got is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(got["weights"]), "<f4"), got["bias"])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1, higher: better) and predicted (1 from `threshold` on) added or replaced.

    A text's score is a sparse dot product with its feature counts. Null or empty text gets the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    schema = kept.selectExpr("*", "0D AS score", "0 AS predicted").schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text", 1 << 20):
            index, n = features(*utf8(batch.column("text")))
            row = np.repeat(np.arange(len(n)), n)
            order = np.argsort(row * np.int64(1 << BITS) + index, kind="stable")
            key = (row * np.int64(1 << BITS) + index)[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(key))).astype(float)
            owner = key[first] >> BITS
            dot = np.bincount(owner, count * own.weights[key[first] & ((1 << BITS) - 1)], len(n))
            length = np.sqrt(np.bincount(owner, count * count, len(n)))
            p = _logistic(dot / np.maximum(length, 1e-9) + own.bias)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    return kept.mapInArrow(score, schema)
