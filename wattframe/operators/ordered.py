"""Ordered computations over long series without one task per series.

A window over (unit ORDER BY time) puts a whole series into one task, so one
busy unit can hold up a job. Everything here works in two levels instead: the
series is cut into calendar chunks, each chunk is summed up in one row (a
map-side combined aggregate), the short run of chunk rows is scanned per key,
and the carried state is joined back. The wide rows are shuffled once, by
(keys, chunk); the window inside a chunk reuses that partitioning.

`chunk=None` asks for the plain window, for series known to be short.
(keys, ts) must be unique, or `tiebreak` columns order the rows of one instant.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.timebucket import epoch_seconds, trunc

_SERIES, _CHUNK = "_series", "_chunk"


def with_chunk(df: DataFrame, keys: Sequence[str], ts: str, chunk: str | Column) -> DataFrame:
    """Tags rows with their series and chunk.

    The series is one never-NULL string, so the join that brings the carried
    state back is a plain equality on the same two columns the window is
    partitioned by, and both share one shuffle. The chunk is a calendar unit
    of `ts`, or any expression that never falls along a series, such as the
    offset of a file split.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys]
    series = F.concat_ws("\u0001", *parts) if parts else F.lit("")
    cut = chunk if isinstance(chunk, Column) else trunc(chunk, F.col(ts))
    return df.withColumn(_SERIES, series).withColumn(_CHUNK, cut)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join where NULL keys equal each other; the right keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def _carried(df: DataFrame, per_chunk: dict[str, Column], scan: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with what the chunks of its series before (or after) a row's own hand on.

    `scan` maps an output name to (summary column, "before" | "after" |
    "max_before" | "min_before" | "prev" | "next").
    """
    summary = df.groupBy(_SERIES, _CHUNK).agg(*[e.alias(n) for n, e in per_chunk.items()])
    order = Window.partitionBy(_SERIES).orderBy(_CHUNK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    outs = []
    for name, (source, kind) in scan.items():
        c = F.col(source)
        expr = {
            "before": lambda: F.last(c, ignorenulls=True).over(before),
            "after": lambda: F.first(c, ignorenulls=True).over(after),
            "max_before": lambda: F.max(c).over(before),
            "min_before": lambda: F.min(c).over(before),
            "prev": lambda: F.lag(c).over(order),
            "next": lambda: F.lead(c).over(order),
        }[kind]()
        outs.append(expr.alias(name))
    return df.join(summary.select(_SERIES, _CHUNK, *outs), [_SERIES, _CHUNK], "left")


def _at(ts: str, col: str) -> Column:
    """(time, value) of the rows where the value is present."""
    return F.when(F.col(col).isNotNull(), F.struct(F.col(ts).alias("ts"), F.col(col).alias("v")))


def lag_row(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    prefix: str = "prev_",
    chunk: str | None = "month",
) -> DataFrame:
    """Values of the previous row of the same series, NULL on the first."""
    row = F.struct(F.col(ts).alias("_t"), *[F.col(c) for c in cols])
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(ts)
        out = df.withColumn("_prev", F.lag(row).over(w))
    else:
        parts = with_chunk(df, keys, ts, chunk)
        w = Window.partitionBy(_SERIES, _CHUNK).orderBy(ts)
        out = _carried(parts, {"_end": F.max_by(row, F.col(ts))}, {"_before": ("_end", "prev")}).withColumn(
            "_prev", F.coalesce(F.lag(row).over(w), F.col("_before"))
        )
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in cols])


def lag_step(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    step: timedelta,
    prefix: str = "prev_",
    chunk: str = "month",
) -> DataFrame:
    """`lag_row` for series without holes, in one pass.

    The predecessor is known to be one step back, so the last row of a chunk
    is copied into the next one and dropped again after the window. Nothing
    is read twice and nothing is joined.
    """
    at = F.col(ts)
    here, following = trunc(chunk, at), trunc(chunk, at + F.lit(step))
    places = F.when(
        here == following, F.array(F.struct(here.alias("c"), F.lit(True).alias("own")))
    ).otherwise(
        F.array(
            F.struct(here.alias("c"), F.lit(True).alias("own")), F.struct(following.alias("c"), F.lit(False).alias("own"))
        )
    )
    spread = df.withColumn("_place", F.explode(places)).withColumn(_CHUNK, F.col("_place.c"))
    w = Window.partitionBy(*keys, _CHUNK).orderBy(ts)
    lagged = spread.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in cols})
    return lagged.filter("_place.own").select(*df.columns, *[f"{prefix}{c}" for c in cols])


def next_row(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], name: str = "_next", chunk: str | None = "month"
) -> DataFrame:
    """Adds a struct of (ts, cols) of the following row of the series."""
    row = F.struct(F.col(ts).alias("ts"), *[F.col(c) for c in cols])
    if chunk is None:
        return df.withColumn(name, F.lead(row).over(Window.partitionBy(*keys).orderBy(ts)))
    parts = with_chunk(df, keys, ts, chunk)
    w = Window.partitionBy(_SERIES, _CHUNK).orderBy(ts)
    carried = _carried(parts, {"_first": F.min_by(row, F.col(ts))}, {"_after": ("_first", "next")})
    return carried.withColumn(name, F.coalesce(F.lead(row).over(w), F.col("_after"))).select(*df.columns, name)


def _known(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    chunk: str | Column | None,
    following: bool,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Adds `_prev_<c>` (and `_next_<c>`) structs of the nearest present value."""
    rank = F.struct(ts, *tiebreak)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(ts, *tiebreak)
        out = df
        for c in cols:
            back = w.rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumn(f"_prev_{c}", F.last(_at(ts, c), ignorenulls=True).over(back))
            if following:
                ahead = w.rowsBetween(0, Window.unboundedFollowing)
                out = out.withColumn(f"_next_{c}", F.first(_at(ts, c), ignorenulls=True).over(ahead))
        return out
    parts = with_chunk(df, keys, ts, chunk)
    per_chunk, scan = {}, {}
    for c in cols:
        per_chunk[f"_hi_{c}"] = F.max_by(_at(ts, c), F.when(F.col(c).isNotNull(), rank))
        scan[f"_cp_{c}"] = (f"_hi_{c}", "before")
        if following:
            per_chunk[f"_lo_{c}"] = F.min_by(_at(ts, c), F.when(F.col(c).isNotNull(), rank))
            scan[f"_cn_{c}"] = (f"_lo_{c}", "after")
    out = _carried(parts, per_chunk, scan)
    w = Window.partitionBy(_SERIES, _CHUNK).orderBy(ts, *tiebreak)
    for c in cols:
        back = F.last(_at(ts, c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"_prev_{c}", F.coalesce(back, F.col(f"_cp_{c}")))
        if following:
            ahead = F.first(_at(ts, c), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
            out = out.withColumn(f"_next_{c}", F.coalesce(ahead, F.col(f"_cn_{c}")))
    return out.drop(_SERIES, _CHUNK, *[f"_cp_{c}" for c in cols], *[f"_cn_{c}" for c in cols])


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    chunk: str | Column | None = "month",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Each value or, where missing, the last one before it."""
    out = _known(df, keys, ts, cols, chunk, False, tiebreak)
    return out.select(
        *[F.col(f"_prev_{c}.v").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def linear_between(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], chunk: str | None = "month"
) -> DataFrame:
    """Missing values on the straight line between their present neighbours.

    Nothing is invented before the first or after the last present value.
    """
    out = _known(df, keys, ts, cols, chunk, True)
    now = epoch_seconds(ts)

    def line(c: str) -> Column:
        t0, t1 = epoch_seconds(F.col(f"_prev_{c}.ts")), epoch_seconds(F.col(f"_next_{c}.ts"))
        v0, v1 = F.col(f"_prev_{c}.v"), F.col(f"_next_{c}.v")
        return F.coalesce(F.col(c), v0 + (v1 - v0) * (now - t0) / F.nullif(t1 - t0, F.lit(0)))

    return out.select(*[line(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def running_extremes(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: dict[str, tuple[Column, str]],
    chunk: str | None = "year",
) -> DataFrame:
    """Running max or min up to each row, and up to the row before it.

    `values` maps a name to (value, "max" | "min"); the columns added are the
    name and `prev_<name>`. All of them share one scan. A struct value is
    compared field by field, so it can carry the time of the extreme along.
    """
    agg, pick = {"max": F.max, "min": F.min}, {"max": F.greatest, "min": F.least}
    part, marked = list(keys), df
    if chunk is not None:
        part = [_SERIES, _CHUNK]
        marked = with_chunk(df, keys, ts, chunk)
    marked = marked.withColumns({f"_v_{n}": v for n, (v, _) in values.items()})
    if chunk is not None:
        per_chunk = {f"_x_{n}": agg[k](f"_v_{n}") for n, (_, k) in values.items()}
        scan = {f"_b_{n}": (f"_x_{n}", f"{k}_before") for n, (_, k) in values.items()}
        marked = _carried(marked, per_chunk, scan)
    w = Window.partitionBy(*part).orderBy(ts)
    out = []
    for n, (_, k) in values.items():
        upto = agg[k](f"_v_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0))
        before = agg[k](f"_v_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1))
        if chunk is not None:
            upto, before = pick[k](upto, F.col(f"_b_{n}")), pick[k](before, F.col(f"_b_{n}"))
        out += [upto.alias(n), before.alias(f"prev_{n}")]
    return marked.select(*df.columns, *out)


def bounds(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    """Per-key minimum and maximum added to every row, by aggregate and join."""
    ends = df.groupBy(*keys).agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
    return null_safe_join(df, ends, keys)
