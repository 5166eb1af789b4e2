"""Which row wins: versions, duplicates, keyed writes.

All of these are aggregates (`max_by` over a struct), which combine before the
shuffle, so a key with millions of copies costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*rest)
    choose = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(choose(row, F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _columns(order) -> list[Column]:
    items = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in items]


def dedupe_last(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """The last row of each key; `order` must tell rows of a key apart."""
    return _pick(df, keys, _columns(order), last=True)


def dedupe_first(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """The first row of each key."""
    return _pick(df, keys, _columns(order), last=False)


def latest_version(df: DataFrame, keys: Sequence[str], version: str = "version", tiebreak=()) -> DataFrame:
    """Of every key the row with the highest version."""
    return _pick(df, keys, [F.col(version), *_columns(tiebreak)], last=True)


def distinct_on(df: DataFrame, keys: Sequence[str], order_desc) -> DataFrame:
    """First row per key when sorted downwards by `order_desc`."""
    return _pick(df, keys, _columns(order_desc), last=True)


def latest_per_id(df: DataFrame, id_col: str, ts: str) -> DataFrame:
    """The newest row of each id."""
    return _pick(df, [id_col], [F.col(ts)], last=True)


def completeness_version(interval: str | Column, version: str | Column) -> Column:
    """Aggregate version under which a fuller bucket always beats a partial one."""
    return F.count_distinct(interval) * F.lit(1_000_000_000).cast("long") + F.max(version)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order=None,
    mode: str = "replace",
) -> DataFrame:
    """`target` with `updates` merged in by key.

    replace     named columns take the new value, other columns stay
    fill_nulls  named columns take the new value only where the old is NULL
    ignore      rows whose key exists are left alone

    Of several updates with one key the last by `order` counts.
    """
    if order is not None:
        updates = dedupe_last(updates, keys, order)
    if mode == "ignore":
        fresh = updates.join(target.select(*keys), list(keys), "left_anti")
        return target.unionByName(fresh.select(*[c for c in fresh.columns if c in target.columns]), allowMissingColumns=True)
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    # NULL keys never collide, as under a primary key.
    joined = target.join(new, list(keys), "full_outer")

    def merged(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        old, fresh = F.col(c), F.col(f"_new_{c}")
        if mode == "fill_nulls":
            return F.coalesce(old, fresh).alias(c)
        return F.when(F.col("_hit"), fresh).otherwise(old).alias(c)

    return joined.select(*[merged(c) for c in target.columns])


def merge_sparse(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], order=None) -> DataFrame:
    """Feeds that each fill their own columns of a shared row.

    Where a feed brings no value the stored one stays.
    """
    if order is not None:
        updates = dedupe_last(updates, keys, order)
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, list(keys), "full_outer")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    )
