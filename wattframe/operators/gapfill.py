"""Regular time grids: create the missing steps, then fill or trim them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.timebucket import check_span, epoch_seconds, step_expr, step_lit, ts_lit
from wattframe.operators.ordered import _known, bounds, last_known, linear_between, next_row, null_safe_join

TAIL = timedelta(minutes=25)
LOOKBACK = timedelta(minutes=35)


def grid(df: DataFrame, keys: Sequence[str], ts: str, step: timedelta, start: datetime | str, end: datetime | str) -> DataFrame:
    """Every step in [start, end) for every key of `df`.

    Steps are numbered and laid out in years, days and steps, so no array is longer than about a year of days,
    and the days of a key are spread over tasks before their steps are made.
    """
    first, stop = (datetime.fromisoformat(t) if isinstance(t, str) else t for t in (start, end))
    steps = max(0, -((first - stop) // step))
    day = max(1, timedelta(days=1) // step)
    year = 366 * day

    def numbers(lo: Column, hi: Column, by: int) -> Column:
        return F.explode(F.sequence(lo, hi - 1, F.lit(by).cast("long")))

    def until(lo: str, many: int) -> Column:
        return F.least(F.col(lo) + many, F.lit(steps).cast("long"))

    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    if steps == 0:
        return base.select(*keys, ts_lit(first).alias(ts)).limit(0)
    years = base.withColumn("_year", numbers(F.lit(0).cast("long"), F.lit(steps).cast("long"), year))
    days = years.withColumn("_day", numbers(F.col("_year"), until("_year", year), day)).repartition(*keys, "_day")
    numbered = days.withColumn("_step", numbers(F.col("_day"), until("_day", day), 1))
    return numbered.select(*keys, (ts_lit(first) + step_lit(step) * F.col("_step")).alias(ts))


def gapfill(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: timedelta,
    start: datetime | str,
    end: datetime | str,
    present: str | None = None,
) -> DataFrame:
    """`df` (one row per key and step) on a complete grid.

    The grid is [start, end); rows of `df` outside it, such as one exactly at
    `end`, stay. `present` names a flag telling real rows from created ones.
    """
    flagged = df.withColumn("_real", F.lit(True))
    on = [*keys, ts]
    left = grid(df, keys, ts, step, start, end)
    condition = None
    for c in on:
        part = F.col(f"_g_{c}").eqNullSafe(F.col(c))
        condition = part if condition is None else condition & part
    renamed = left.select(*[F.col(c).alias(f"_g_{c}") for c in on])
    joined = renamed.join(flagged, condition, "full_outer")
    out = joined.select(
        *[F.coalesce(F.col(c), F.col(f"_g_{c}")).alias(c) if c in on else F.col(c) for c in df.columns],
        F.coalesce(F.col("_real"), F.lit(False)).alias("_real"),
    )
    return out.withColumnRenamed("_real", present) if present else out.drop("_real")


def locf(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    treat_null_as_missing: bool = True,
    present: str | None = None,
    chunk: str | None = "month",
) -> DataFrame:
    """Last observation carried forward.

    With `treat_null_as_missing` every NULL is filled; without it only rows
    the grid created (`present` is false) are, and a NULL that was really
    observed is itself carried.
    """
    if treat_null_as_missing:
        return last_known(df, keys, ts, cols, chunk)
    if present is None:
        raise ValueError("the plain form needs the flag of real rows")
    # A struct keeps an observed NULL apart from a missing row.
    boxed = df.select(
        *[F.when(F.col(present), F.struct(F.col(c).alias("x"))).alias(c) if c in cols else F.col(c) for c in df.columns]
    )
    filled = last_known(boxed, keys, ts, cols, chunk)
    return filled.select(*[F.col(f"{c}.x").alias(c) if c in cols else F.col(c) for c in df.columns])


def interpolate(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], chunk: str | None = "month"
) -> DataFrame:
    """Straight lines between real values; the edges stay empty."""
    return linear_between(df, keys, ts, cols, chunk)


def interpolate_with_tail(
    df: DataFrame, keys: Sequence[str], ts: str, col: str, tail: timedelta = TAIL, chunk: str | None = "month"
) -> DataFrame:
    """Interpolated interior, last value carried for `tail` past the last real one."""
    known = _known(df, keys, ts, [col], chunk, True)
    before, after = F.col(f"_prev_{col}"), F.col(f"_next_{col}")
    t0, t1 = epoch_seconds(before["ts"]), epoch_seconds(after["ts"])
    line = before["v"] + (after["v"] - before["v"]) * (epoch_seconds(ts) - t0) / F.nullif(t1 - t0, F.lit(0))
    held = F.when(after.isNull() & (F.col(ts) <= before["ts"] + step_lit(tail)), before["v"])
    return known.withColumn(col, F.coalesce(F.col(col), line, held)).select(*df.columns)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step,
    end=None,
    line: Sequence[str] = (),
    tail: timedelta | None = None,
    chunk: str | None = "month",
) -> DataFrame:
    """Each row with `_until`, the last grid step it stands for, and `_next`, the next row's time and `line` columns.

    The steps themselves are those of `spread`; whoever joins by row does it here, before rows are repeated.
    """
    step = step_lit(step) if isinstance(step, timedelta) else step
    known = next_row(df, keys, ts, line, chunk=chunk)
    at, after = F.col(ts), F.col("_next")
    last = at if end is None else ts_lit(end) - step
    if tail is not None:
        last = F.least(last, at + step_lit(tail)) if end is not None else at + step_lit(tail)
    stop = F.when(after.isNull(), last).otherwise(after["ts"] - step)
    if end is not None:
        stop = F.least(stop, ts_lit(end) - step)
    return known.withColumn("_until", F.greatest(stop, at))


def spread(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step,
    end=None,
    hold: Sequence[str] = (),
    line: Sequence[str] = (),
    tail: timedelta | None = None,
    chunk: str | None = "month",
) -> DataFrame:
    """Each row repeated on the grid steps up to the next row of its series.

    This fills a series straight from its sparse readings: no grid is built,
    joined or scanned. `hold` columns keep their value, `line` columns run
    straight to the next one, the others are NULL on created steps. After the
    last row `hold` goes on to the exclusive `end`, or for `tail` at most.
    Nothing is created before the first row.
    """
    step = step_lit(step) if isinstance(step, timedelta) else step
    at, after = F.col(ts), F.col("_next")
    known = runs(df, keys, ts, step, end, line, tail, chunk)
    steps = known.withColumn("_t", F.explode(F.sequence(at, F.col("_until"), step)))
    now, t0, t1 = epoch_seconds("_t"), epoch_seconds(ts), epoch_seconds(after["ts"])
    real = F.col("_t") == at

    def shown(c: str) -> Column:
        if c == ts:
            return F.col("_t").alias(ts)
        if c in keys or c in hold:
            return F.col(c)
        if c in line:
            v0, v1 = F.col(c), after[c]
            drawn = F.when(real, v0).otherwise(v0 + (v1 - v0) * (now - t0) / F.nullif(t1 - t0, F.lit(0)))
            return F.coalesce(drawn, F.when(after.isNull(), v0)).alias(c) if tail is not None else drawn.alias(c)
        return F.when(real, F.col(c)).alias(c)

    return steps.select(*[shown(c) for c in df.columns])


def locf_bounded(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    step: timedelta,
    start: datetime,
    end: datetime,
    lookback: timedelta = LOOKBACK,
    tail: timedelta = TAIL,
    chunk: str | None = "month",
) -> DataFrame:
    """Coarse readings carried over a finer grid, inside their own lifetime.

    The scan begins `lookback` early so the window start has a seed; nothing
    stands before the first or more than `tail` after the last reading.
    """
    seeded = df.filter((F.col(ts) >= ts_lit(start - lookback)) & (F.col(ts) <= ts_lit(end)))
    return spread(seeded, keys, ts, step, end, hold=cols, tail=tail, chunk=chunk)


def rescale_energy(energy: Column, interval_minutes: Column) -> Column:
    """Energy of a coarse interval spread over its five-minute parts."""
    return energy / (12 / (60 / interval_minutes))


def fill_interior(
    df: DataFrame, keys: Sequence[str], ts: str, interval: str, chunk: str | None = "year"
) -> DataFrame:
    """NULL points for missing buckets between each series' own ends."""
    return spread(df, keys, ts, step_expr(interval), chunk=chunk)


def dense_series(df: DataFrame, keys: Sequence[str], ts: str, value: str, interval: str) -> DataFrame:
    """One row per series: start, last and a positional array of values.

    Point i stands for start + i * interval. A series with any point off the
    grid keeps its own points instead. The array is as long as the series'
    span, so a span beyond what `check_span` allows for the interval is an error.
    """
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    ends = ends.withColumn("_hi", check_span(interval, F.col("_lo"), F.col("_hi")))
    steps = F.explode(F.sequence("_lo", "_hi", step_expr(interval))).alias(ts)
    spine = ends.select(*keys, steps).withColumn("_grid", F.lit(True))
    on = [*keys, ts]
    right = df.select(*on, F.col(value).alias("_value"), F.lit(True).alias("_real"))
    both = spine.join(right, on, "full_outer")
    off = F.max(F.col("_grid").isNull())
    points = F.struct(F.col(ts).alias("t"), F.col("_value").alias("v"), F.coalesce("_real", F.lit(False)).alias("r"))
    grouped = both.groupBy(*keys).agg(
        F.array_sort(F.collect_list(points)).alias("_points"), off.alias("_off"), F.min(ts).alias("start"), F.max(ts).alias("last")
    )
    kept = F.when(F.col("_off"), F.filter("_points", lambda p: p["r"])).otherwise(F.col("_points"))
    return grouped.select(
        *keys, "start", "last", F.lit(interval).alias("interval"), F.transform(kept, lambda p: p["v"]).alias("data")
    )


def drop_empty_series(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Without the series that hold nothing but NULL and 0."""
    alive = df.filter(F.col(col) != 0).select(*keys).distinct()
    return null_safe_join(df, alive, keys, "left_semi")


def cast_trailing_nulls(df: DataFrame, keys: Sequence[str], ts: str, col: str) -> DataFrame:
    """NULLs after the last value become 0."""
    real = F.when(F.col(col).isNotNull(), F.col(ts))
    marked = bounds(df, keys, real, real)
    after = F.col("_hi").isNull() | (F.col(ts) > F.col("_hi"))
    return marked.withColumn(col, F.when(after, F.lit(0.0)).otherwise(F.col(col))).select(*df.columns)


def trim_nulls(df: DataFrame, keys: Sequence[str], ts: str, col: str) -> DataFrame:
    """Without the NULL points before the first and after the last value."""
    real = F.when(F.col(col).isNotNull(), F.col(ts))
    marked = bounds(df, keys, real, real)
    return marked.filter((F.col(ts) >= F.col("_lo")) & (F.col(ts) <= F.col("_hi"))).select(*df.columns)


def missing_intervals(
    log: DataFrame, source: str, ts: str, step: timedelta, start: datetime, end: datetime
) -> DataFrame:
    """Steps of the expected grid a source never logged.

    Both ends are moved down to the step, so grid and log align; the last step
    belongs to the grid.
    """
    seconds = step.total_seconds()

    def floored(t: datetime) -> datetime:
        return t - timedelta(seconds=(t - datetime(1970, 1, 1)).total_seconds() % seconds)

    expected = grid(log, [source], ts, step, floored(start), floored(end) + step)
    return expected.join(log.select(source, ts), [source, ts], "left_anti")


def pad_combinations(
    df: DataFrame, dims: Sequence[str], pairs: Sequence[str], value: str, fill: float = 0.0
) -> DataFrame:
    """Every value of each free dimension for every *existing* key pair.

    The value sets are scalar subqueries of dimension size (months,
    technologies); the output is exactly the padded table asked for.
    """
    spine = df.select(*pairs).distinct()
    for d in dims:
        values = df.agg(F.array_sort(F.collect_set(d))).scalar()
        spine = spine.withColumn("_all", values).select(*spine.columns, F.explode("_all").alias(d))
    return spine.join(df, [*pairs, *dims], "left").fillna(fill, subset=[value])


def validate_length(
    df: DataFrame, keys: Sequence[str], ts: str, step: timedelta, start: datetime, end: datetime
) -> DataFrame:
    """Series whose point count differs from the steps in the closed window."""
    expected = int((end - start) / step) + 1
    inside = df.filter((F.col(ts) >= ts_lit(start)) & (F.col(ts) <= ts_lit(end)))
    counted = inside.groupBy(*keys).agg(F.count_distinct(ts).alias("points"))
    return counted.filter(F.col("points") != expected).withColumn("expected", F.lit(expected).cast("long"))


def cap_to_settled(df: DataFrame, ts: str, end: datetime, now: datetime, days: int = 7) -> DataFrame:
    """Rows before the newest interval of the last days, which is still settling.

    The edge is a scalar subquery over the recent rows only; without any the
    end stays as asked.
    """
    edge = df.filter(F.col(ts) > ts_lit(now - timedelta(days=days))).agg(F.max(ts)).scalar()
    return df.filter((F.col(ts) < ts_lit(end)) & (F.col(ts) < F.coalesce(edge, ts_lit(end))))
