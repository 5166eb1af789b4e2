"""Exact substring dedup: repeated strings of SPAN bytes found by external induced suffix sorting, shard by shard.

Suffixes that can agree on SPAN bytes must meet in one shard. Each window of SPAN bytes is therefore told by its
anchor, the least hash among its inner strings of INNER bytes, which depends on the window's bytes alone. Windows
whose anchor occurs once in the corpus repeat nowhere; what stands around the other anchors is sent, each
distinct content once, to shards by anchor, and sorted there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import slices, utf8, written
from wattframe.llm.induced import sorted_suffixes

SPAN = 200
INNER = 80
#: Window starts worked on at a time, the longest run of windows kept as one, and bytes aimed at in a shard.
CHUNK = 1_000_000
LONGEST = 512
SHARD_BYTES = 2 << 20
#: An anchor with more distinct contents than this is not sorted in one shard; its windows are counted by hash.
HOT = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.int64((1 << 20) - 1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a number for each byte."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    ones = np.ones(n, np.uint64)
    return (
        np.cumprod(np.append(ones[:1], np.full(n, _BASE))),
        np.cumprod(np.append(ones[:1], np.full(n, inverse))),
        _scramble(np.arange(1, 257, dtype=np.uint64)),
    )


class Hashes:
    """Hashes of any substring of some bytes in constant time."""

    def __init__(self, data: np.ndarray):
        power, self.inverse, value = _tables(CHUNK + SPAN)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scramble((self.sums[end] - self.sums[start]) * self.inverse[start] + _scramble((end - start).astype(np.uint64)))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.append(x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, at: np.ndarray, span: int = SPAN, inner: int = INNER):
    """Runs of neighbouring windows with one anchor: (row, start in the text, number, anchor, content hash, alone).

    `alone` is false where a run might hold two equal windows, which needs the anchor twice in one
    window, or more windows than one anchor can serve.
    """
    width = span - inner + 1
    out = []
    for lo in range(0, max(0, len(data) - span + 1), CHUNK):
        part = data[lo : lo + CHUNK + span - 1]
        n = len(part) - span + 1
        hashes = Hashes(part)
        first = np.arange(len(part) - inner + 1)
        h = hashes.of(first, first + inner)
        top = (h >> np.uint64(1)).astype(np.int64) & ~_LOW
        left = _sliding_least(top | first, width) & _LOW
        right = _LOW - (_sliding_least(top | (_LOW - first), width) & _LOW)
        anchor = h[left]
        row = np.searchsorted(at, np.arange(lo, lo + n), "right") - 1
        fits = np.arange(lo, lo + n) + span <= at[row + 1]
        begins = np.ones(n, bool)
        begins[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, n))
        # Long runs (of repetitive text) are cut so that their parts have equal contents.
        many = -(-length // LONGEST)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, length = np.repeat(start, many) + nth * LONGEST, np.minimum(LONGEST, np.repeat(length, many) - nth * LONGEST)
        twice = np.logical_or.reduceat(left != right, start) | (length > width) if len(start) else np.zeros(0, bool)
        ok = fits[start]
        start, length, twice = start[ok], length[ok], twice[ok]
        out.append((row[start], start + lo - at[row[start]], length, anchor[start], hashes.of(start, start + length + span - 1), ~twice))
    if not out:
        out = [tuple(np.zeros(0, t) for t in (int, int, int, np.uint64, np.uint64, bool))]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(contents: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each content a mask of its windows that also start elsewhere in any of them, by induced suffix sorting."""
    sizes = np.array([len(c) for c in contents])
    text = np.ones(int(sizes.sum()) + len(contents) + 1, np.int16)
    where = np.cumsum(sizes + 1) - sizes - 1
    for c, a in zip(contents, where, strict=True):
        text[a : a + len(c)] = np.frombuffer(c, np.uint8).astype(np.int16) + 2
    text[-1] = 0
    order, common = sorted_suffixes(text, span)
    same = common >= span
    repeated = np.zeros(len(text), bool)
    repeated[order[same | np.append(same[1:], False)]] = True
    return [repeated[a : a + n - span + 1] for a, n in zip(where, sizes, strict=True)]


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


_FOUND = "anchor long, content long, lo int, hi int"


def _sort_shard(table: pa.Table, span: int) -> pa.Table:
    masks = repeated_windows([c.as_py() for c in table.column("bytes")], span)
    ranges = [_ranges(m) for m in masks]
    many = [len(r[0]) for r in ranges]
    take = pa.array(np.repeat(np.arange(len(masks)), many))
    lo, hi = (np.concatenate([r[i] for r in ranges]).astype(np.int32) for i in (0, 1))
    return pa.table([table.column("anchor").take(take), table.column("content").take(take), pa.array(lo), pa.array(hi)], ["anchor", "content", "lo", "hi"])


def _runs_of(docs: DataFrame, span: int, inner: int) -> DataFrame:
    """Every run of windows of the keyed documents, without the texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            row, start, n, anchor, content, alone = window_runs(*utf8(batch.column("text")), span, inner)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("doc").take(take),
                    pa.array(anchor.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(alone),
                ],
                ["doc_id", "doc", "anchor", "content", "start", "n", "alone"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, doc long, anchor long, content long, start int, n int, alone boolean")


def _contents(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of the wanted runs, cut from the texts that hold them: (anchor, content, rivals, bytes)."""
    by_doc = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).agg(
        F.collect_list(F.struct("anchor", "content", "rivals", "start", "n")).alias("runs")
    )
    # A document may be there in several equal rows; any of them will do.
    found = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc"))).select("text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            data, at = utf8(batch.column("text"))
            runs = batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            start = at[row] + flat.field("start").to_numpy()
            end = start + flat.field("n").to_numpy() + span - 1
            whole = data.tobytes()
            for lo in range(0, len(row), 10_000):
                part = slice(lo, lo + 10_000)
                texts = [whole[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                kept = flat.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.field(c) for c in ("anchor", "content", "rivals")), pa.array(texts, pa.binary())],
                    ["anchor", "content", "rivals", "bytes"],
                )

    return found.mapInArrow(cut, "anchor long, content long, rivals long, bytes binary").dropDuplicates(["anchor", "content"])


def _hashed_windows(contents: DataFrame, span: int) -> DataFrame:
    """Repeated windows of anchors with very many contents, by hash counts instead of a sort in one shard."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[i].as_buffer(), np.uint8)
                at = np.arange(len(data) - span + 1)
                window = Hashes(data).of(at, at + span).view(np.int64)
                one = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("anchor").take(one), batch.column("content").take(one), pa.array(at.astype(np.int32)), pa.array(window)],
                    ["anchor", "content", "lo", "window"],
                )

    windows = contents.mapInArrow(spread, "anchor long, content long, lo int, window long")
    again = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    return windows.join(again, ["anchor", "window"], "left_semi").select("anchor", "content", "lo", (F.col("lo") + 1).alias("hi"))


def repeated_runs(docs: DataFrame, span: int = SPAN, inner: int = INNER, hot: int = HOT) -> DataFrame:
    """Where windows that also start elsewhere lie: (doc_id, doc, starts), starts an array of (lo, hi) of window starts.

    `docs` has doc_id, doc (a hash of the text) and text.
    """
    # Found once and written, for finding them costs more than reading them back.
    runs = written(_runs_of(docs, span, inner), "windows")
    seen = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("alone").alias("alone"))
    shared = written(runs.join(seen.where("n > 1 OR NOT alone").select("anchor"), "anchor", "left_semi"), "runs")
    distinct = shared.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min("alone").alias("alone"), F.min(F.struct("doc_id", "doc", "start", "n")).alias("at")
    )
    rivals = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("rivals"), F.min("alone").alias("single"))
    wanted = distinct.join(rivals.where("rivals > 1 OR NOT single").drop("single"), "anchor").select(
        "anchor", "content", "rivals", "at.*"
    )
    contents = written(_contents(docs, wanted, span), "contents")
    size = contents.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    few = contents.where(F.col("rivals") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sorted_ = few.groupBy("shard").applyInArrow(lambda t: _sort_shard(t, span), _FOUND)
    found = sorted_.unionByName(_hashed_windows(contents.where(F.col("rivals") > hot), span))
    copied = distinct.where("copies > 1").select("anchor", "content", F.lit(0).alias("lo"), F.col("at.n").alias("hi"))
    spans = found.unionByName(copied).groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    placed = shared.join(spans, ["anchor", "content"]).select(
        "doc_id", "doc", F.transform("spans", lambda s: F.struct((F.col("start") + s["lo"]).alias("lo"), (F.col("start") + s["hi"]).alias("hi"))).alias("s")
    )
    return placed.groupBy("doc_id", "doc").agg(F.flatten(F.collect_list("s")).alias("starts"))


def without_repeats(docs: DataFrame, span: int = SPAN, inner: int = INNER, hot: int = HOT) -> DataFrame:
    """Each document without the bytes that a string of `span` bytes, which also starts elsewhere, covers.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256. Strings are judged on the input, also
    inside one document, and never cross documents. Null text is empty; texts shorter than `span` keep everything.
    Repeated rows are elsewhere to each other and lose everything that is long enough.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated_runs(keyed, span, inner, hot).withColumnsRenamed({"doc_id": "_id", "doc": "_doc"})
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")), "left").select(
        "doc_id", "text", F.coalesce("starts", F.array().cast("array<struct<lo:int,hi:int>>")).alias("starts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * CHUNK):
            data, at = utf8(batch.column("text"))
            starts = batch.column("starts")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
            flat = starts.flatten()
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, at[owner] + flat.field("lo").to_numpy(), 1)
            np.add.at(change, at[owner] + flat.field("hi").to_numpy() + span - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept, removed, spans = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                mask = gone[a:b]
                kept.append(data[a:b][~mask].tobytes())
                removed.append(int(mask.sum()))
                spans.append(len(_ranges(mask)[0]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
