"""Line dedup by a deletion-neighbourhood join. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.llm.common import written

#: Shorter lines are left alone.
MIN_CHARS = 20
#: Code points of a line above which its variants are made in one pass over it.
LONG = 1024


def _document(text: Column) -> Column:
    return F.xxhash64(text)


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves: lines within one edit share the first or last floor(m / 2) code points, m the shorter length.

    The partner may be shorter by one, so a line gives the keys for its own length and for one less.
    """
    keys = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), m, F.left(line, half)), F.xxhash64(F.lit("last"), m, F.right(line, half))]
    return F.array(*keys)


def _occurrences(docs: DataFrame, min_chars: int, halves: bool) -> DataFrame:
    lines = docs.select(
        "doc_id", _document(F.col("text")).alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).where(F.char_length("line") >= min_chars)
    return lines.select(
        F.struct("doc_id", "doc", "pos").alias("at"),
        F.xxhash64("line").alias("h"),
        F.xxhash64(F.lit(1), "line").alias("g"),
        *([_half_keys(F.col("line"), F.char_length("line")).alias("halves")] if halves else []),
    )


def _long_variants(lines: DataFrame) -> DataFrame:
    """(me, key, place) of the variants of long lines, in time that grows with a line and not with its square.

    The key of a string is the exclusive or of a hash of each code point and its place. That of a variant is the part
    before the deletion together with the part behind it, moved by one place, so one pass over a line's code
    points gives all its variants.
    """
    points = lines.select("me", "start", "stop", F.posexplode(F.split("line", "")).alias("i", "c"))
    line = Window.partitionBy("me")
    so_far = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.xxhash64(F.col("i") - 1, "c")
    sums = points.select(
        "me", "start", "stop", "i",
        F.coalesce(F.bit_xor(F.xxhash64("i", "c")).over(so_far), F.lit(0)).alias("before"),
        F.coalesce(F.bit_xor(moved).over(so_far), F.lit(0)).bitwiseXOR(moved).alias("moved"),
        F.bit_xor(moved).over(line).alias("all"),
    )
    place = F.col("i") + 1
    key = F.col("before").bitwiseXOR(F.col("all")).bitwiseXOR(F.col("moved"))
    variants = sums.where(place.between(F.col("start"), F.col("stop"))).select("me", key.alias("key"), place.alias("place"))
    whole = points.groupBy("me").agg(F.bit_xor(F.xxhash64("i", "c")).alias("key"), F.lit(0).alias("place"))
    return variants.unionByName(whole)


def _neighbours(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """For each distinct line the earliest earlier line within one edit: (h, g, near)."""
    # Lines that share a half with another line; no other line can have a partner.
    keyed = distinct.select("h", "g", "first", F.posexplode("halves").alias("kind", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    candidates = (
        keyed.join(shared, "key", "left_semi")
        .groupBy("h", "g")
        .agg(
            F.min("first").alias("first"),
            F.max((F.col("kind") % 2 == 0).cast("int")).alias("front"),
            F.max((F.col("kind") % 2 == 1).cast("int")).alias("back"),
        )
    )
    wanted = candidates.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.doc").alias("_doc")).agg(
        F.collect_list(F.struct("first", "h", "g", "front", "back")).alias("_lines")
    )
    # A document that is there in several equal rows gives its lines several times.
    texts = docs.select("doc_id", "text").withColumn("doc", _document(F.col("text")))
    found = (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")))
        .select(F.split("text", "\n").alias("all"), F.explode("_lines").alias("c"))
        .select("c.*", F.get("all", F.col("c.first.pos")).alias("line"))
    )
    found = written(found.dropDuplicates(["h", "g"]), "candidates")
    n = F.char_length("line")
    half = F.floor((n - 1) / 2).cast("int")
    start = F.when(F.col("back") == 1, 1).otherwise(half + 1)
    stop = F.when(F.col("front") == 1, n).otherwise(n - half)
    deleted = F.transform(
        F.sequence(start, stop),
        lambda i: F.struct(F.xxhash64(F.overlay("line", F.lit(""), i, F.lit(1))).alias("key"), i.alias("place")),
    )
    whole = F.array(F.struct(F.col("h").alias("key"), F.lit(0).alias("place")))
    me = F.struct("first", "h", "g").alias("me")
    short = found.where(n <= LONG + 1).select(me, F.explode(F.concat(deleted, whole)).alias("v")).select("me", "v.key", "v.place")
    long = found.where(n > LONG).select(me, "line", start.alias("start"), stop.alias("stop"))
    variants = short.unionByName(_long_variants(long))
    # Lines that agree but for the code point at one place are one replacement apart; a line equal to another's
    # variant is one deletion away. Either way the earliest of a bucket answers for all, so no pairs are made.
    by_key, by_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    here = F.struct("me", "place")
    met = variants.select(
        "me",
        "place",
        F.min(here).over(by_place).alias("replaced"),
        F.min(F.when(F.col("place") == 0, F.col("me"))).over(by_key).alias("shorter"),
        F.min(F.when(F.col("place") > 0, here)).over(by_key).alias("longer"),
    )
    shorter = F.when(F.col("shorter").isNotNull(), F.struct(F.col("shorter").alias("me"), "place"))
    near = F.when(F.col("place") == 0, F.col("longer")).otherwise(F.least("replaced", shorter))
    best = met.select("me", near.alias("near")).where("near.me.first < me.first")
    best = best.groupBy("me").agg(F.min("near").alias("near"))
    text = found.select("h", "g", "line")
    pairs = (
        best.select("me.h", "me.g", F.col("near.me.h").alias("h2"), F.col("near.me.g").alias("g2"), F.col("near.me.first").alias("near"), "near.place")
        .join(text, ["h", "g"])
        .join(text.withColumnsRenamed({"h": "h2", "g": "g2", "line": "line2"}), ["h2", "g2"])
    )
    # The place is where the longer line, or each of two as long, has the code point that the edit is about.
    without = lambda c: F.overlay(c, F.lit(""), F.col("place"), F.lit(1))
    more = F.char_length("line") - F.char_length("line2")
    one_edit = (
        F.when(more == 0, without("line") == without("line2")).when(more == 1, without("line") == F.col("line2")).when(more == -1, F.col("line") == without("line2"))
    )
    return pairs.where(one_edit).select("h", "g", "near")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines that go, by document: (doc_id, doc, gone), gone holding (pos, near).

    A line of at least `min_chars` code points goes if an equal line, or one within one edit, stands earlier
    anywhere, by (doc_id, hash of the text, position); null ids are earliest. What is earlier decides even if that
    line goes as well, so the outcome does not depend on the order of work. Rows equal in doc_id and text
    are the same document.
    """
    distinct = _occurrences(docs, min_chars, True).groupBy("h", "g").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.first("halves").alias("halves")
    )
    distinct = written(distinct, "lines")
    near = written(_neighbours(docs, distinct), "near")
    verdicts = (
        distinct.select("h", "g", "first", (F.col("first") < F.col("last")).alias("again"))
        .join(near, ["h", "g"], "left")
        .where("again OR near IS NOT NULL")
        .select("h", "g", "first", F.col("near").isNotNull().alias("near"))
    )
    gone = (
        _occurrences(docs, min_chars, False)
        .join(verdicts, ["h", "g"])
        .where(F.col("near") | (F.col("at") != F.col("first")))
        .select("at.doc_id", "at.doc", F.struct("at.pos", (F.col("at") == F.col("first")).alias("near")).alias("line"))
    )
    return gone.groupBy("doc_id", "doc").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without the lines that stand earlier elsewhere; columns n_lines, n_equal and n_near added.

    n_equal counts lines dropped for an equal earlier line, n_near those dropped for one within one edit. A
    null text stays null with no lines; a document may be left with an empty text. Columns of `docs` keep
    their values except text (and n_chars, if there).
    """
    gone = repeated_lines(docs.select("doc_id", "text"), min_chars).select(
        F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), F.col("gone").alias("_gone")
    )
    # The documents travel as one column, so their own columns may have any names.
    rows = docs.select(F.struct("*").alias("_row"))
    own = F.col("_row.text")
    joined = rows.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (_document(own) == F.col("_doc")), "left")
    lines = F.split(own, "\n")
    places = F.transform("_gone", lambda x: x["pos"])
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(places, i)), "\n")
    text = F.when(F.col("_gone").isNull(), own).otherwise(left)
    count = lambda near: F.coalesce(F.size(F.filter("_gone", lambda x: x["near"] == near)), F.lit(0)).cast("long")
    made = {
        "text": text,
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_equal": count(False),
        "n_near": count(True),
    }
    out = joined.select("_row", F.struct(*[c.alias(n) for n, c in made.items()]).alias("_made"))
    columns = {c: F.col("_row").getField(c) for c in docs.columns if c not in made} | {n: F.col("_made").getField(n) for n in made}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(F.col("_made.text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])
