"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.llm.common import WORD, running_totals, written
from wattframe.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Rows aimed at in a bucket of one source, and the most hexadecimal digits of the key a bucket is told by.
BUCKET_ROWS = 256
MOST_DIGITS = 4


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The words each source gives: (source, source_size, rows, target).

    `sizes` holds (source, size) by document. Sources in code-point order, null last, weigh `weights` over and
    over; together they share `share` times all words. No target exceeds `epochs` times its source, and what is
    cut is shared out again by weight. The level at which weights stop is found from running sums in the order
    in which sources fill up.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1)})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select(
        "source",
        "source_size",
        "rows",
        F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * epochs).cast("double").alias("_cap"),
    ).withColumn("_fills", F.col("_cap") / F.col("_w"))
    filled = stage(
        running_totals(weighed, [F.col("_fills"), F.col("source").asc_nulls_last()], {"_caps": F.col("_cap"), "_ws": F.col("_w")})
    )
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    budget, weight = share * float(whole["size"] or 0), float(whole["w"] or 0)
    full = F.col("_caps") + F.col("_fills") * (F.lit(weight) - F.col("_ws")) <= F.lit(budget)
    rest = filled.agg(
        F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("caps"),
        F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w"),
    ).first()
    level = (budget - rest["caps"]) / rest["w"] if rest["w"] else 0.0
    return filled.select(
        "source",
        "source_size",
        "rows",
        F.when(full, F.col("_cap")).otherwise(F.least(F.col("_w") * F.lit(level), F.col("_cap"))).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken) and the columns `keep`.

    Within a source documents go by md5(seed:doc_id), then doc_id and size; the source's rounded target is cut
    from its words laid end to end in that order, as many whole times as it goes in and then exactly at the
    budget, so one document of a source may be taken in part. Every document keeps a row, also with nothing
    taken.

    A source is split into buckets by the first digits of the key, so that a source of any size is spread evenly;
    a bucket starts from the words of the buckets before it. Null or empty text has size 0. A null source is a
    source; a null doc_id is hashed as an empty one. Repeated rows each count and are interchangeable.
    """
    sized = stage(
        docs.select(
            *keep,
            "doc_id",
            "source",
            words(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
        )
    )
    targets = stage(source_targets(sized, weights, share, epochs))
    rows = targets.agg(F.sum("rows")).first()[0] or 0
    digits = min(MOST_DIGITS, max(0, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))))
    sized = sized.withColumn("_bucket", F.substring("_key", 1, digits))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sized.groupBy("source", "_bucket")
        .agg(F.sum("size").alias("_words"))
        .select("source", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
        .withColumnsRenamed({"source": "_source", "_bucket": "_of"})
    )
    t = targets.withColumnsRenamed({"source": "_source2"}).drop("rows")
    buckets = buckets.join(t, F.col("_source").eqNullSafe(F.col("_source2")))
    inside = (
        Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = sized.withColumn("_end", F.sum("size").over(inside)).join(
        buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of"))
    )
    size, budget = F.col("size"), F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - rounds * F.col("source_size")
    begins = F.col("_start") + F.col("_end") - size
    part = F.greatest(F.lit(0), F.least(size, left - begins))
    return placed.select(
        *keep, "doc_id", "source", "size", "source_size", "target", (rounds * size + part).cast("long").alias("taken")
    )


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), 1, n), "")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: a row each time one is taken, the last cut at the budget; same columns.

    Documents of which nothing is taken go; so do those without a word.
    """
    # Rows are numbered once and for all, so that repeated ones each get what the mix takes of them; they travel as one
    # column, so their own columns may have any names.
    rows = written(docs.select(F.monotonically_increasing_id().alias("_number"), F.struct("*").alias("_row")), "numbered")
    plan = mix(rows.select("_number", "_row.doc_id", "_row.source", "_row.text"), **parameters, keep=("_number",))
    plan = plan.where("taken > 0").select(F.col("_number").alias("_of"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    n = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    copies = rows.join(plan, F.col("_number") == F.col("_of")).withColumn("_copy", F.explode(F.sequence(F.lit(1), n)))
    here = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    own = F.col("_row.text")
    cut = F.when(here < F.col("_size"), leading_words(own, here)).otherwise(own)
    changed = {"text": cut}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length(cut).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
