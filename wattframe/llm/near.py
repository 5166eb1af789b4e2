"""Near copies by word shingles: Golay codewords of SimHash bits find candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.llm.common import slices, written
from wattframe.llm.graph import components
from wattframe.llm.simhash import LENGTH, codebook, keep_first, shingle_hashes
from wattframe.session import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Each of so many segments of SimHash bits goes to its NEAREST Golay codewords; a key is such a codeword with the set's
#: word of least hash under a function of the segment. Two sets with a similarity of 0.8 have a codeword of a segment in
#: common with a chance of 0.55 and the word with one of 0.8, so no key at all with one of 1 in 10 000.
SEGMENTS, NEAREST = 16, 2
#: A set compared with many is sent to so many tasks at most.
DEALT = 64
#: Sets of one key, and words in them, that a task compares; more are dealt into blocks, of which all pairs meet.
BLOCK, BLOCK_WORDS = 2048, 1 << 22

_WORDS = -(-SEGMENTS * LENGTH // 64)
_TURN = np.random.default_rng(42).integers(0, 1 << 63, (2, _WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.random.default_rng(43).integers(0, 1 << 63, SEGMENTS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The codewords as signs, and a preference among those equally near.
_CODE = np.concatenate([codebook().T, np.arange(1 << 12, dtype=np.float32)[None] / (1 << 13)])


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's runs of words, sorted. A shorter text is one run, one without a word none."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def node(own: np.ndarray) -> int:
    """The name of a set as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def totals(own: np.ndarray) -> np.ndarray:
    """For each SimHash bit how many of a set's words have it set, less those that don't."""
    count = np.zeros(_WORDS * 64, np.int64)
    for lo in range(0, len(own), 4096):
        # A hash for each 64 bits: multiplied, folded and multiplied again.
        mixed = own[lo : lo + 4096, None] * _TURN[0]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _TURN[1]
        bits = np.unpackbits((mixed ^ mixed >> np.uint64(29)).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.uint16)
    return (2 * count - len(own))[: SEGMENTS * LENGTH].reshape(SEGMENTS, LENGTH)


def nearest_codewords(own: np.ndarray) -> np.ndarray:
    """The Golay codewords nearest to each segment of a set's SimHash, by their 12 leading bits.

    A bit counts by its total: those that a similar set may turn hardly count.
    """
    near = np.concatenate([totals(own), np.ones((SEGMENTS, 1), np.int64)], axis=1).astype(np.float32) @ _CODE
    words = np.empty((SEGMENTS, NEAREST), np.int64)
    for k in range(NEAREST):
        words[:, k] = near.argmax(1)
        near[np.arange(SEGMENTS), words[:, k]] = -np.inf
    return words


def golay_keys(own: np.ndarray) -> np.ndarray:
    """Keys of a set that similar sets share: each codeword of a segment with the segment's least word. An empty set has none."""
    if len(own) == 0:
        return np.zeros(0, np.int64)
    least = np.full(SEGMENTS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 4096):
        np.minimum(least, (own[lo : lo + 4096, None] * _ORDER).min(0), out=least)
    words = nearest_codewords(own) + (np.arange(SEGMENTS)[:, None] << 12)
    return ((least[:, None] ^ least[:, None] >> np.uint64(32)) * _TURN[0, 0] + words.astype(np.uint64) * _TURN[1, 0]).view(np.int64).ravel()


def marked_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _hash, node, size, keys) for each row: the hash of its text, its set's name, size and keys."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text").cast(pa.large_binary()).fill_null(b"")]
            names = [node(s) for s in sets]
            keys = {n: golay_keys(s) for n, s in dict(zip(names, sets, strict=True)).items()}
            columns = [
                batch.column("doc_id"),
                batch.column("_hash"),
                pa.array(names, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([keys[n] for n in names], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_hash", "node", "size", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    return rows.mapInArrow(made, f"doc_id {kind}, _hash long, node long, size long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the nodes in `wanted` (node, _hash), made anew from one text of each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    texts = docs.select(F.xxhash64("text").alias("_hash"), "text").join(wanted, "_hash").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(made, "node long, set binary")


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of at least `least`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= least


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar. Each a comes first in its part and is compared with the b behind it."""
    part = F.pmod(F.xxhash64("b"), F.lit(DEALT)).alias("part")
    dealt = pairs.select(F.col("b").alias("node"), "a", part, F.lit(1).alias("side"))
    dealt = dealt.unionByName(pairs.select(F.col("a").alias("node"), "a", part, F.lit(0).alias("side")).distinct())
    rows = dealt.join(sets, "node").repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            nodes, a, side = (batch.column(c).to_numpy() for c in ("node", "a", "side"))
            ok = np.zeros(len(nodes), bool)
            for i, value in enumerate(batch.column("set")):
                other = np.frombuffer(value.as_py(), np.uint64)
                if side[i] == 0:
                    own = other
                else:
                    ok[i] = similar(own, other, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(nodes[ok])], ["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")


def _sizes_fit(one: Column, other: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(one, other) / F.greatest(one, other) >= similarity


def links_among(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of similar sets that join different groups, enough to join all that are linked; with `side`, of two sides only.

    Each set in turn marks its words, and one pass over the words of the larger sets counts what they share with it.
    Sets of the same group, also of one joined meanwhile, aren't compared.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    group = np.unique(group[order], return_inverse=True)[1]
    side = None if side is None else side[order]
    sizes = np.array([len(sets[i]) for i in order])
    words, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    marked, out = np.zeros(len(words), bool), []
    for i in range(len(order) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right"))
        meets = group[i + 1 : stop] != group[i]
        if side is not None:
            meets &= side[i + 1 : stop] != side[i]
        if not meets.any():
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        marked[own] = True
        # What is shared with each larger set: running totals read at the sets' ends.
        total = np.concatenate([[0], np.cumsum(marked[codes[ends[i] : ends[stop - 1]]])])
        both = np.diff(total[np.concatenate([[0], ends[i + 1 : stop] - ends[i]])])
        marked[own] = False
        for j in i + 1 + np.flatnonzero(meets & (both / (sizes[i] + sizes[i + 1 : stop] - both) >= similarity)):
            if group[j] != group[i]:
                out.append((int(order[i]), int(order[j])))
                group[group == group[j]] = group[i]
    return out


def _compared(similarity: float):
    def compare(rows: pa.Table) -> pa.Table:
        nodes, roots, side = (rows.column(c).to_numpy() for c in ("node", "root", "side"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in rows.column("set")]
        two = side if side.min() != side.max() else None
        found = links_among(sets, roots, two, similarity)
        return pa.table([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return compare


def _links_in_keys(open_keys: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join what is similar among the sets of each key; `open_keys` has key, node, root, blocks."""
    of = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    small = open_keys.where("blocks = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "root")
    large = stage(open_keys.where("blocks > 1").withColumn("own", of))
    roots = large.groupBy("key", "own").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    other = roots.select("key", F.col("own").alias("other"), "least", "most")
    # Blocks whose sets are all in one group needn't meet.
    met = large.join(other, "key").join(roots.withColumnsRenamed({"least": "_least", "most": "_most"}), ["key", "own"])
    met = met.where(F.least("least", "_least") < F.greatest("most", "_most"))
    dealt = met.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root",
    )
    rows = small.unionByName(dealt).join(sets, "node")
    return rows.groupBy("key", "i", "j").applyInArrow(_compared(similarity), "a long, b long")


def similar_links(
    nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(node, root) for the sets that links of similar pairs connect: `nodes` has node, _hash, size, keys.

    Sets that share a key may be similar, and every link is checked on whole sets. Keys with the same sets count once.
    First each key's sets are compared with one of them, the one with most neighbours, as an original has among its
    copies; so a group of copies costs about one comparison for each, whatever its size. The keys whose sets aren't all
    connected by then go to a task each, which compares what is still apart; a large key goes in blocks, of
    which every two meet that aren't in one group already. A set travels once for each key and block, never once a pair.
    """
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    met = stage(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"))
    same = [F.sum("size").alias("words"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    keys = met.groupBy("key", "n").agg(*same).groupBy("n", "words", "x", "y").agg(F.min("key").alias("key"))
    shared = stage(met.join(keys.select("key", "words"), "key").select("key", "node", "size", "n", "words"))
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "_hash")
    sets = stage(_sets(docs, wanted, shingle))
    neighbours = shared.withColumn("met", F.sum("n").over(Window.partitionBy("node")))
    most = F.max(F.struct("met", F.xxhash64("node").alias("_"), F.col("node").alias("a"), F.col("size").alias("_size")))
    centre = neighbours.groupBy("key").agg(most.alias("c")).select("key", "c.a", "c._size")
    pairs = shared.join(centre, "key").where((F.col("node") != F.col("a")) & _sizes_fit(F.col("size"), F.col("_size"), similarity))
    links = stage(_verified(pairs.select("a", F.col("node").alias("b")).distinct(), sets, similarity))
    roots = stage(components(links))
    placed = shared.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("words") / block_words))
    still = placed.join(apart.select("key"), "key", "left_semi").select("key", "node", "root", blocks.alias("blocks"))
    more = stage(_links_in_keys(stage(still), sets, similarity))
    if more.isEmpty():
        return roots
    # The stars around the roots stand for all the links they came from.
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stage(components(stars.unionByName(more)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Documents of which each group of similar ones keeps one, chosen as in `simhash.keep_first`.

    Documents with equal sets are one node; texts without a word, null ones among them, are one group.
    """
    marked = written(marked_sets(docs.select("doc_id", "text"), shingle), "near-marked")
    nodes = written(marked.dropDuplicates(["node"]).select("node", "_hash", "size", "keys"), "near-nodes")
    roots = similar_links(nodes, docs.select("text"), shingle, similarity)
    placed = marked.select("doc_id", "_hash", "node").join(roots, "node", "left")
    return keep_first(docs, placed.select("doc_id", "_hash", F.coalesce("root", "node").alias("root")))
