"""Document fingerprints from closed syncmers, and neighbours in id order. Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a k-mer and of the inner substring that must be least at one of its edges.
K, S = 16, 10
#: Bytes of a piece of a text without an anchor (such a text has fewer than about 2 K bytes).
SHORT = 4
#: Hashes a fingerprint keeps: the smallest, eight hexadecimal digits each.
KEPT = 64
#: Positions worked on at a time, so that a very long text never has one long array of hashes.
BLOCK = 8192


def let(value: Column, body) -> Column:
    """`body` of a value worked out once. A lambda variable is also read without the copy a binary column costs."""
    return F.get(F.transform(F.array(value), body), 0)


def syncmers(data: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a binary column: array of (pos from 1, hash).

    A k-mer counts if the least of the hashes of its s-mers is that of its first or last one. Whether it does
    depends on its own bytes alone, so equal passages give equal anchors wherever they stand.
    """
    inner = k - s + 1

    def nth(h: Column, j: Column, q: int) -> Column:
        return F.get(h, j + q if q else j)

    def least(h: Column, j: Column, edge: int) -> Column:
        others = [q for q in range(inner) if q != edge]
        return reduce(lambda x, y: x & y, [nth(h, j, edge) <= nth(h, j, q) for q in others])

    def whole(d: Column) -> Column:
        last = F.octet_length(d) - (k - 1)

        def block(b: Column) -> Column:
            first = b * BLOCK
            hashes = F.transform(
                F.sequence(first + 1, F.least(first + BLOCK, last) + (inner - 1)),
                lambda i: F.xxhash64(F.substring(d, i, F.lit(s))),
            )

            def pick(h: Column) -> Column:
                at = F.filter(F.sequence(F.lit(0), F.size(h) - inner), lambda j: least(h, j, 0) | least(h, j, inner - 1))
                return F.transform(
                    at,
                    lambda j: F.struct(
                        (first + j + 1).alias("pos"), F.xxhash64(F.substring(d, first + j + 1, F.lit(k))).alias("hash")
                    ),
                )

            return let(hashes, pick)

        found = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((last - 1) / BLOCK).cast("int")), block))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return let(data, whole)


def smallest(hashes: Column, kept: int = KEPT) -> Column:
    """The `kept` smallest of some hashes, each once, by their upper half."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 32)))), 1, kept)


def merged(*sketches: Column, kept: int = KEPT) -> Column:
    """The smallest hashes of several sketches together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(*sketches))), 1, kept)


def or_pieces(sketch: Column, data: Column, kept: int = KEPT) -> Column:
    """A sketch; of a text too short for an anchor that of all its short pieces, of an empty one nothing."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(data) - (SHORT - 1), F.lit(1)))
    pieces = F.transform(starts, lambda i: F.xxhash64(F.substring(data, i, F.lit(SHORT))))
    return F.when((F.size(sketch) > 0) | (F.octet_length(data) == 0), sketch).otherwise(smallest(pieces, kept))


def hashes_of(anchors: Column) -> Column:
    return F.transform(anchors, lambda x: x["hash"])


def printed(hashes: Column) -> Column:
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Share of the smallest hashes of both that are in each: an estimate of the Jaccard index. Two empty ones are alike."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, kept)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared.cast("double") / F.size(both))


def fingerprint(text: Column, kept: int = KEPT) -> Column:
    """The printed fingerprint of a text column; null counts as empty."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    return printed(let(smallest(hashes_of(syncmers(data)), kept), lambda x: or_pieces(x, data, kept)))


def _at_most(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most the value, by way of every sixteenth."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + 16] for i in range(0, len(bounds), 16)]
    tops = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(tops, lambda b: b <= value))
    inside = F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * 16 + F.size(F.filter(inside, lambda b: b <= value)))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Documents in ranges of ascending doc_id, ready for `lead`: columns _range and _guest added.

    Bounds are ids found by approximate quantiles (a fixed number, kept by the driver). The first document of a
    range is also sent, as a guest, to the range before, and the very first to the last range, so that each row
    finds its successor in its own range. Null ids come first; rows of one id go by text.
    """
    spark = docs.sparkSession
    n = ranges or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, 4096))
    found = docs.agg(
        F.percentile_approx("doc_id", [i / n for i in range(n)], 50 * n).alias("cuts"),
        F.max(F.col("doc_id").isNull()).alias("null"),
        F.min("doc_id").alias("first"),
    ).first()
    first = None if found["null"] else found["first"]
    cuts = sorted({c for c in found["cuts"] or [] if found["null"] or c > found["first"]})
    home = F.when(F.col("doc_id").isNull(), 0).otherwise(_at_most(cuts, F.col("doc_id")))
    opens = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    seats = F.array(
        F.struct(F.col("_home").alias("range"), F.lit(0).alias("guest")),
        F.when(F.coalesce(opens, F.lit(False)), F.struct((F.col("_home") - 1).alias("range"), F.lit(1).alias("guest"))),
        F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("long")), F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("guest"))),
    )
    return (
        docs.withColumn("_home", home)
        .withColumn("_seat", F.explode(F.filter(seats, lambda x: x.isNotNull())))
        .select(*docs.columns, F.col("_seat.range").alias("_range"), F.col("_seat.guest").alias("_guest"))
    )


def fingerprints(docs: DataFrame, k: int = K, s: int = S, kept: int = KEPT) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they are.

    The edited text is the text with its last quarter (floor(n_chars / 4) code points) replaced by as many from
    the start of the next document in ascending doc_id, or all it has; after the last comes the first. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors.

    Texts are shuffled once, by range of id; everything else happens inside that range. An anchor depends on its own
    bytes only, so those of the edited text are those of the kept head, those of the start of the next document, which
    that document's row hands over as a sketch, and the few across the seam. Null text counts as empty, and two empty
    texts are alike. Repeated rows follow one another and each keep a row.
    """
    w = Window.partitionBy("_range").orderBy("_guest", "doc_id", "text")
    seated = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    seen = seated.select(
        "*",
        F.coalesce(F.lead("text").over(w), F.lit("")).alias("_next"),
        F.coalesce(F.lag(cut).over(w), F.lit(0)).alias("_lent"),
        F.row_number().over(w).alias("_nth"),
    ).select(
        "*",
        n.cast("long").alias("n_chars"),
        F.col("text").cast("binary").alias("_data"),
        F.left("text", n - cut).alias("_head"),
        F.left("_next", cut).alias("_tail"),
        F.octet_length(F.left("text", "_lent")).alias("_lent_bytes"),
    ).drop("_next", "_lent")
    head_bytes = F.octet_length("_head")
    seen = seen.select(
        "*",
        F.concat("_head", "_tail").alias("_edited"),
        head_bytes.alias("_kept"),
        F.concat(
            F.substring(F.col("_head").cast("binary"), F.greatest(head_bytes - (k - 2), F.lit(1)), F.lit(k - 1)),
            F.substring(F.col("_tail").cast("binary"), F.lit(1), F.lit(k - 1)),
        ).alias("_seam"),
        syncmers(F.col("_data"), k, s).alias("_own"),
    ).drop("_head", "_tail", "text")

    def inside(n_bytes: str) -> Column:
        """Anchors that end within the first bytes; they are in order of place."""
        return F.filter("_own", lambda x: x["pos"] <= F.col(n_bytes) - (k - 1))

    made = seen.select(
        "*",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        let(smallest(hashes_of(F.col("_own")), kept), lambda x: or_pieces(x, F.col("_data"), kept)).alias("_a"),
        smallest(hashes_of(inside("_kept")), kept).alias("_stays"),
        smallest(hashes_of(inside("_lent_bytes")), kept).alias("_lends"),
        smallest(hashes_of(syncmers(F.col("_seam"), k, s)), kept).alias("_across"),
        F.size("_own").cast("long").alias("n_anchors"),
        # Of any 2 k - s bytes some k-mer counts, so only a shorter text can do without anchors.
        F.when(F.octet_length("_edited") < 2 * k, F.col("_edited")).cast("binary").alias("_short"),
    ).drop("_own", "_seam", "_data", "_edited")
    after = Window.partitionBy("_range").orderBy("_nth")
    borrowed = F.coalesce(F.lead("_lends").over(after), F.array().cast("array<bigint>"))
    paired = made.select("*", F.lead("_a").over(after).alias("_c"), merged("_stays", "_across", borrowed, kept=kept).alias("_found"))
    found = F.when(F.col("_short").isNull(), F.col("_found")).otherwise(or_pieces(F.col("_found"), F.col("_short"), kept))
    paired = paired.where(F.col("_guest") == 0).withColumn("_b", found)
    return paired.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("_a")).alias("fingerprint"),
        printed(F.col("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b"), kept).alias("near_edited"),
        likeness(F.col("_a"), F.col("_c"), kept).alias("near_next"),
        "n_anchors",
    )
