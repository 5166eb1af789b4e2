"""Language identification by partial matching: byte context trees with escapes, frozen after training."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import held_out, slices, utf8

#: Longest context in bytes; contexts seen less often than MIN_SEEN in all languages together are cut off.
ORDER = 3
MIN_SEEN = 8
#: About so many bytes of each language are learned from (whole texts, chosen by hash of the id).
TRAIN_BYTES = 1_000_000
#: Most bytes of the table of code lengths; the rarest contexts go first where it would be larger.
TABLE_BYTES = 64_000_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """The merged context trees of all languages.

    A state is a context (its order and its bytes, the latest lowest). `cost[state, symbol, language]` is the
    code length in nats, escapes included; `symbol` maps bytes to columns, 0 for bytes never seen.
    """

    langs: list[str]
    order: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    cost: np.ndarray


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each byte as one number, zero before the start of a text."""
    context = np.zeros(len(data), np.uint32)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[:-back]
        before[place < back] = 0
        context |= before << np.uint32(8 * (back - 1))
    return context


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 22):
        data, at = utf8(batch.column("text"))
        whole = (_grams(data, at).astype(np.uint64) << np.uint64(8)) | data
        length = np.diff(at)
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            gram, n = np.unique(whole[np.repeat(langs == lang, length)], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from text and non-null lang of documents that aren't held out.

    Counting is a Spark aggregate over the bounded sample; what reaches the driver is the counts of distinct
    byte strings of ORDER + 1 bytes in it.
    """
    own = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    # One row for each language; the model holds as many. A join would bring all texts of a language to one task.
    key = F.xxhash64("doc_id", F.lit("lang"))
    sizes = own.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(key).alias("least")).collect()
    if not sizes:
        return fit([], *(np.zeros(0, t) for t in (int, np.uint64, float)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_bytes / r["bytes"]))])
    # The document of the least key is always taken, so a language of a few long texts is learned too.
    least = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["least"])])
    chance = F.pmod(key, F.lit(1 << 20)) / float(1 << 20)
    chosen = (chance < F.element_at(share, F.col("lang"))) | (key == F.element_at(least, F.col("lang")))
    sample = own.where(chosen).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = np.array(got.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    lang = np.searchsorted(langs, names) if langs else np.zeros(0, int)
    return fit(langs, lang, got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy().astype(float))


def fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Context trees from counts of byte strings; escapes by the number of distinct symbols in a context (method C)."""
    byte, context = (gram & np.uint64(255)).astype(np.int64), (gram >> np.uint64(8)).astype(np.int64)
    seen = np.unique(byte)
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    room = max(1, TABLE_BYTES // (4 * width * max(1, len(langs))))
    orders, contexts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for o in range(1, ORDER + 1):
        value, back = np.unique(context & ((1 << (8 * o)) - 1), return_inverse=True)
        total = np.bincount(back, n)
        often = np.argsort(-total, kind="stable")
        often = np.sort(often[total[often] >= MIN_SEEN][: max(0, room - sum(map(len, orders)))])
        orders.append(np.full(len(often), o))
        contexts.append(value[often])
    order, states = np.concatenate(orders), np.concatenate(contexts)
    # Order minus one: every byte alike.
    cost = np.full((len(states), width, max(1, len(langs))), math.log(256.0), np.float32)
    for o in range(ORDER + 1):
        first, many = sum(map(len, orders[:o])), len(orders[o])
        if not many:
            continue
        own = contexts[o]
        if o:
            # The next shorter context still in the tree; rarer ones were cut, so look further back.
            for i, c in enumerate(own):
                cost[first + i] = cost[_state(order, states, int(c), o - 1)]
        key = context & ((1 << (8 * o)) - 1)
        at = np.searchsorted(own, key)
        hit = (at < many) & (own[np.minimum(at, many - 1)] == key)
        counts = np.zeros((many, width, max(1, len(langs))))
        np.add.at(counts, (at[hit], symbol[byte[hit]], lang[hit]), n[hit])
        distinct, total = (counts > 0).sum(1, keepdims=True), counts.sum(1, keepdims=True)
        used = total > 0
        escape = np.where(used, -np.log(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
        with np.errstate(divide="ignore"):
            hit_cost = -np.log(counts / np.maximum(total + distinct, 1))
        block = cost[first : first + many]
        cost[first : first + many] = np.where(counts > 0, hit_cost, block + escape)
    return Model(langs, order, states, symbol, cost)


def _state(order: np.ndarray, states: np.ndarray, context: int, longest: int) -> int:
    for o in range(longest, 0, -1):
        lo, hi = np.searchsorted(order, [o, o + 1])
        want = context & ((1 << (8 * o)) - 1)
        i = lo + int(np.searchsorted(states[lo:hi], want))
        if i < hi and states[i] == want:
            return i
    return 0


def transitions(model: Model) -> np.ndarray:
    """For each possible run of ORDER bytes the state of its longest context in the tree."""
    table = np.zeros(1, np.int32)
    for o in range(1, ORDER + 1):
        table = np.tile(table, 256)
        mine = model.order == o
        table[model.context[mine]] = np.flatnonzero(mine)
    return table


def code_lengths(model: Model, table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Nats each language needs for each text."""
    total = np.zeros((len(at) - 1, model.cost.shape[2]))
    flat = model.cost.reshape(-1, model.cost.shape[2])
    step, width = 1 << 18, model.cost.shape[1]
    context, column = _grams(data, at), model.symbol[data]
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        cost = flat[table[context[lo:hi]].astype(np.int64) * width + column[lo:hi]]
        first, last = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        rows = np.arange(first, last)
        rows = rows[at[rows + 1] > np.maximum(at[rows], lo)]
        total[rows] += np.add.reduceat(cost, np.maximum(at[rows], lo) - lo, axis=0, dtype=np.float64)
    return total


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language with the shortest code, and its posterior.

    Languages are equally likely beforehand. Null text, text without a letter, and any text where nothing
    was learned is `und` with score 0. Ties go to the language first in code-point order. Repeated rows each keep a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        "doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = transitions(own)
        for batch in slices(batches, "text", 1 << 22):
            ok = batch.column("letter").to_numpy(zero_copy_only=False).copy()
            if own.langs:
                lengths = code_lengths(own, table, *utf8(batch.column("text")))
                best = lengths.argmin(1)
                sure = 1 / np.exp(np.maximum(lengths.min(1, keepdims=True) - lengths, -700)).sum(1)
            else:
                best, sure, ok[:] = np.zeros(len(ok), int), np.zeros(len(ok)), False
            names = np.array([*own.langs, UNKNOWN], object)[np.where(ok, best, len(own.langs))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(ok, sure, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
