"""Packing documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.llm.common import slices, written

LENGTH = 1024
END = 0
#: Encoded stretches a task remembers before it starts afresh, and bytes of text it works on at a time.
REMEMBERED = 1_000_000
SLICE = 1 << 22
#: One character of white space, or one that might be taken for it.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Rows aimed at in a bucket of one piece length when pieces are ranked.
BUCKET_ROWS = 4096


class Encoder:
    """Token ids of many texts at once, by the tokenizer file given.

    Byte-level BPE never joins a character that isn't white space with white space after it, so a text falls into
    stretches: what stands before its first space, and each space with the word after it. Each distinct stretch is
    encoded once and remembered. Texts with white space before a space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A byte-level token is written with one character for each of its bytes.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _learn(self, words: pa.Array) -> None:
        """Remember the ids of a space and each of these words."""
        odd = pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, WHITE + "$"))
        alone, most = words.filter(odd), words.filter(pc.invert(odd))
        ids, sizes = [], []
        for lo in range(0, len(most), 20_000):
            part = most.slice(lo, 20_000)
            got = self._plain([" " + " ".join(part.to_pylist())])[0]
            ends = np.cumsum(pc.binary_length(part).to_numpy() + 1)
            cut = np.searchsorted(np.cumsum(self.sizes[got]), ends) + 1
            ids.append(got)
            sizes.append(np.diff(cut, prepend=0))
        for got in self._plain([" " + w for w in alone.to_pylist()]):
            ids.append(got)
            sizes.append(np.array([len(got)]))
        self.words = pa.concat_arrays([self.words, most, alone])
        self.ids = np.concatenate([self.ids, *ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, END after each, and where each begins and the last ends."""
        if len(self.words) > REMEMBERED:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, WHITE + " ")
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], parts.flatten().cast(pa.large_string())
        first, last = offsets[:-1], offsets[1:] - 1
        encoded = words.dictionary_encode()
        missing = encoded.dictionary.filter(pc.is_null(pc.index_in(encoded.dictionary, self.words)))
        if len(missing):
            self._learn(missing)
        known = pc.index_in(encoded.dictionary, self.words).to_numpy()
        refs = known[encoded.indices.to_numpy()].astype(np.int64)
        # The first stretch of a text has no space before it; it and END are put in as entries of their own.
        heads = self._plain(pc.if_else(whole, texts, words.take(pa.array(first))).to_pylist())
        n = len(self.words)
        refs[first] = n + 1 + np.arange(len(heads))
        refs = np.insert(refs, last + 1, n)
        size = np.concatenate([np.diff(self.at), [1], [len(h) for h in heads]]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        pool = np.concatenate([self.ids, np.array([END], np.uint32), *heads])
        took = size[refs]
        ends = np.cumsum(took)
        ids = pool[np.repeat(begin[refs] - ends + took, took) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends[last + 1 + np.arange(len(last))]])


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Documents encoded, ended by END, and cut every `length` ids: (doc_id, start, length, ids_crc32, doc_tokens).

    Only the last piece of a document is shorter than `length`. Null or empty text is a document of one id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in slices(batches, "text", SLICE):
            ids, at = encoder.encode(batch.column("text"))
            tokens = np.diff(at)
            many = -(-tokens // length)
            row = np.repeat(np.arange(len(tokens)), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * length
            size, begin = np.minimum(length, tokens[row] - start), at[row] + start
            data = ids.astype("<u4").view(np.uint8)
            crc = [zlib.crc32(data[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size, np.array(crc, np.int64), tokens[row]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths in them, number of such packs), from how many pieces there are of each length.

    Lengths go longest first, each into the packs that are shortest so far if it fits there and into new ones
    otherwise. Packs are handled by pattern, so the work depends on the number of lengths and patterns,
    not on that of pieces.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted(histogram, reverse=True):
        left, made = histogram[size], []
        for used in sorted(open_packs):
            if left == 0 or used + size > length:
                break
            patterns = open_packs[used]
            for pattern in list(patterns):
                take = min(left, patterns[pattern])
                made.append((used + size, (*pattern, size), take))
                patterns[pattern] -= take
                left -= take
                if not patterns[pattern]:
                    del patterns[pattern]
                if left == 0:
                    break
            if not patterns:
                del open_packs[used]
        if left:
            many = length // size if size * 2 <= length else 1
            # What is left opens new packs; these are at once the shortest ones that take more of the same.
            full, rest = divmod(left, many)
            if full:
                made.append((size * many, (size,) * many, full))
            if rest:
                made.append((size * rest, (size,) * rest, 1))
        for used, pattern, n in made:
            open_packs[used][pattern] += n
    return [(pattern, n) for used in sorted(open_packs) for pattern, n in sorted(open_packs[used].items())]


def places(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, pd.DataFrame]:
    """For each length the ranges of ranks that go to one place of one pattern: (lo, sequence, offset).

    The piece of rank r in the range from lo goes to sequence + (r - lo) at offset.
    """
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in packs:
        offset = 0
        for size in pattern:
            rows[size].append((ranks[size], first, offset))
            ranks[size] += n
            offset += size
        first += n
    return {size: pd.DataFrame(r, columns=["lo", "sequence", "offset"]) for size, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most `length` tokens and have no gap from offset 0. Full pieces are sequences by themselves;
    the others are packed by the histogram of their lengths (at most `length` numbers on the driver) and found
    again by their rank among the pieces of their length, in the order of doc_id, start and ids_crc32. Ranks are
    taken inside buckets of the hash of the id, of which the earlier ones are counted beforehand, so that no
    length, however common, is ranked in one task. Repeated rows are packed each; null ids are one more id.
    """
    cut = written(pieces(docs, tokenizer, length), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = histogram.pop(length, 0)
    packs = ([((length,), full)] if full else []) + shortest_pack_first(histogram, length)
    where = docs.sparkSession.sparkContext.broadcast(places(packs))
    most = max([full, *histogram.values()], default=0)
    buckets = 1 << max(0, math.ceil(math.log2(max(most, 1) / BUCKET_ROWS)) + 4)
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("length", "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        cut.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_first"))
        .drop("_bucket", "_first")
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for own in np.unique(size):
                mine, table = size == own, where.value[int(own)]
                lo = table["lo"].to_numpy()
                at = np.searchsorted(lo, rank[mine], "right") - 1
                sequence[mine] = table["sequence"].to_numpy()[at] + rank[mine] - lo[at]
                offset[mine] = table["offset"].to_numpy()[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*columns, "_rank").mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
