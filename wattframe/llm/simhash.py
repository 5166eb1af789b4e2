"""SimHash near-dedup with Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import slices
from wattframe.llm.graph import components
from wattframe.session import stage

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer; the keys below are made for three.
BITS_APART = 3
#: Fingerprints of one key compared at a time, and the most that stay together before a key is split in blocks.
COMPARED = 1024
HOT = 8192

# The binary Golay code of length 23: generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH = 23


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `shingle` words, of the whole text if it has fewer; none without a word."""
    words = text.lower().split()
    if not words:
        return []
    line, n = b" ".join(words), len(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if set in over half of the shingles' XXH64; zero without a word."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_ = total * 2 > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with a long column `fp`, the 64 bits as a signed number. Null text is empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            fp = np.array([simhash(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, "fp"])

    kept = docs.drop("fp")
    return kept.mapInArrow(made, kept.selectExpr("*", "0L AS fp").schema)


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and for each syndrome the error of at most three bits that causes it."""
    single = np.zeros(LENGTH, np.int64)
    for i in range(LENGTH):
        x = 1 << i
        for j in range(LENGTH - 1, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        single[i] = x
    error = np.zeros(1 << 11, np.int64)
    for i in range(LENGTH):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, error


_SINGLE, _ERROR = _syndromes()


def codebook() -> np.ndarray:
    """All codewords by their 12 leading bits: 4096 x 23, 1 for a set bit and -1 for any other."""
    leading = np.arange(1 << 12)
    word = leading << 11
    for i in range(12):
        word ^= np.where(leading >> i & 1, _SINGLE[11 + i], 0)
    return ((word[:, None] >> np.arange(LENGTH) & 1) * 2 - 1).astype(np.float32)


def codewords(segment: np.ndarray) -> np.ndarray:
    """The codewords (their 12 leading bits) nearest to each segment and to it with one bit turned: n x 6, -1 for none.

    Every segment lies within three bits of one codeword. Segments up to two bits apart share one of these: some
    word lies within one bit of both and is decoded for both. There are one or six of them.
    """
    syndrome = np.zeros(len(segment), np.int64)
    for i in range(LENGTH):
        syndrome ^= np.where(segment >> i & 1, _SINGLE[i], 0)
    found = np.empty((len(segment), LENGTH + 1), np.int64)
    found[:, 0] = (segment ^ _ERROR[syndrome]) >> 11
    for i in range(LENGTH):
        found[:, i + 1] = (segment ^ 1 << i ^ _ERROR[syndrome ^ _SINGLE[i]]) >> 11
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found.sort(axis=1)
    return found[:, -6:]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys such that fingerprints at most three bits apart share one: (position in fp, key).

    The bits fall into segments of 23, 23 and 18. By how three errors can fall on them, one of these agrees: the
    first and a codeword of the second; a codeword of the first and the second; codewords of both and a half of the
    third; the third and the first; the third and the second.
    """
    x = fp.view(np.uint64)
    s1, s2 = (x & np.uint64((1 << 23) - 1)).astype(np.int64), (x >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    s3 = (x >> np.uint64(46)).astype(np.int64)
    c1, c2 = codewords(s1), codewords(s2)
    tag = lambda kind, value: np.where(value < 0, -1, kind << 56 | value)
    out = [
        tag(1, np.where(c2 < 0, -1, s1[:, None] << 12 | c2)),
        tag(2, np.where(c1 < 0, -1, s2[:, None] << 12 | c1)),
        tag(3, s3 << 23 | s1)[:, None],
        tag(4, s3 << 23 | s2)[:, None],
    ]
    pair = np.where((c1[:, :, None] < 0) | (c2[:, None, :] < 0), -1, c1[:, :, None] << 12 | c2[:, None, :]).reshape(len(x), 36)
    for kind, half in ((5, s3 & 511), (6, s3 >> 9)):
        out.append(tag(kind, np.where(pair < 0, -1, pair << 9 | half[:, None])))
    whole = np.concatenate(out, axis=1)
    row, column = np.nonzero(whole >= 0)
    return row, whole[row, column]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << 14):
            fp = batch.column("fp").slice(lo, 1 << 14).to_numpy().copy()
            row, key = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def _near(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= most)
    return i, j


def spanning_links(left: np.ndarray, right: np.ndarray, most: int = BITS_APART) -> list[tuple[int, int]]:
    """Links that keep connected what the links within `most` bits between two lists connect: one less than nodes at most.

    Compared in blocks, so memory doesn't grow with the square; only links that join two trees are kept.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a in range(0, len(left), COMPARED):
        for b in range(0, len(right), COMPARED):
            i, j = _near(left[a : a + COMPARED], right[b : b + COMPARED], most)
            x, y = left[a + i], right[b + j]
            ok = x < y if left is right else x != y
            for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[rp] = rq
                    out.append((p, q))
    return out


def _links(key: tuple, table: pa.Table) -> pa.Table:
    """Links among the fingerprints of a key, or between the two sides of a pair of blocks."""
    fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy()
    left = np.unique(fp[side == 0])
    right = np.unique(fp[side == 1]) if (side == 1).any() else left
    found = np.array(spanning_links(left, right), np.int64).reshape(-1, 2)
    return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each key's sorted list of fingerprints; most lists hold a pair or two."""
    for batch in batches:
        at = batch.column("fps").offsets.to_numpy()
        flat = batch.column("fps").values.to_numpy()
        size = np.diff(at)
        two = np.flatnonzero(size == 2)
        a, b = flat[at[two]], flat[at[two] + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= BITS_APART
        more = []
        for k in np.flatnonzero(size > 2):
            own = flat[at[k] : at[k + 1]]
            more += spanning_links(own, own)
        rest = np.array(more, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a[near], rest[:, 0]])), pa.array(np.concatenate([b[near], rest[:, 1]]))], ["a", "b"]
        )


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect what pairs of distinct fingerprints at most three bits apart connect.

    `distinct` has a long column fp. Each key's fingerprints are compared by a task; a key with over `hot` of
    them is dealt into blocks, and every pair of blocks is a task of its own, so no comparison is left out.
    """
    keyed = stage(distinct.select("fp").mapInArrow(_keyed, "key long, fp long"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = stage(counts)
    shared = keyed.join(counts, "key")
    small = shared.where(F.col("n") <= hot).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    links = small.select("fps").mapInArrow(_bucket_links, "a long, b long")
    if counts.where(F.col("n") > hot).isEmpty():
        return links.distinct()
    blocks = F.ceil(F.col("n") / hot).cast("int")
    dealt = shared.where(F.col("n") > hot).select("key", "fp", blocks.alias("m"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("mine"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
        "key",
        "fp",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    large = paired.groupBy("key", "i", "j").applyInArrow(_links, "a long, b long")
    return links.unionByName(large).distinct()


def _groups(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of `marked` (doc_id, fp); the root names a group also without ids."""
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = placed.where(F.col("root").isNotNull())
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(least, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: groups of documents linked at three bits or fewer.

    component_id is the smallest doc_id of the group. Equal fingerprints are one node, so copies of a text cost
    one row for a task. Texts without a word have fingerprint zero and link like any others. A null doc_id takes
    part but is no one's component_id, which is null only in a group without ids. Repeated rows each keep a row.
    """
    marked = stage(fingerprints(docs.select("doc_id", "text"), shingle).drop("text"))
    return marked.join(_groups(marked), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Documents of which each group keeps one: the smallest doc_id, null ids last, then the least hash of the text.

    Of rows equal in doc_id and text one stays. Every group keeps a document, also one without ids and one whose
    id another group uses too.
    """
    marked = stage(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp", F.xxhash64("text").alias("_hash")))
    return keep_first(docs, marked.join(_groups(marked).select("fp", "root"), "fp"))


def keep_first(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The documents `keep_one` keeps, by the group (root) of each row: `placed` has doc_id, _hash (of the text), root."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_hash"))
    chosen = placed.groupBy("root").agg(first.alias("_first"))
    chosen = chosen.select(F.col("_first.doc_id").alias("_id"), F.col("_first._hash").alias("_of")).distinct()
    # The documents travel as one column, so their own columns may have any names.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["_doc", "_hash"]).select("_row.*")
