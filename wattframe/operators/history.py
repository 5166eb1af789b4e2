"""Attributes that change over time, and what a unit has reached so far."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.timebucket import NTZ, ts_lit
from wattframe.operators.ordered import last_known

# Unit attributes whose changes are kept.
TRACKED = ("capacity_registered", "emissions_factor_co2", "emission_factor_source")


def value_at(
    df: DataFrame,
    history: DataFrame,
    id_col: str,
    ts: str,
    column: str,
    changed_at: str = "changed_at",
    tiebreak: str | None = None,
    chunk: str | None = "year",
) -> DataFrame:
    """Each row with the newest non-NULL value known at its time.

    An as-of join by union: changes and rows share one ordered scan, changes
    first at equal times. `tiebreak` orders changes of one instant.
    """
    order = F.col(tiebreak) if tiebreak else F.lit(0)
    row = F.struct(*[F.col(c) for c in df.columns if c != id_col])
    changes = history.filter(F.col(column).isNotNull()).select(
        F.col(id_col), F.col(changed_at).alias("_t"), F.lit(0).alias("_kind"), order.cast("long").alias("_n"), F.col(column).alias("_v")
    )
    probes = df.select(
        F.col(id_col),
        F.col(ts).alias("_t"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("_n"),
        row.alias("_row"),
    )
    both = probes.unionByName(changes, allowMissingColumns=True)
    filled = last_known(both, [id_col], "_t", ["_v"], chunk, ["_kind", "_n"])
    kept = filled.filter(F.col("_kind") == 1)
    return kept.select(
        *[F.col(c) if c == id_col else F.col(f"_row.{c}").alias(c) for c in df.columns], F.col("_v").alias(f"{column}_at")
    )


def capture_changes(
    current: DataFrame, incoming: DataFrame, at: datetime | Column, id_col: str = "unit_id", columns: Sequence[str] = TRACKED
) -> DataFrame:
    """History rows for units whose tracked values differ; unchanged ones stay NULL."""
    new = incoming.select(id_col, *[F.col(c).alias(f"_new_{c}") for c in columns])
    pairs = current.select(id_col, *columns).join(new, id_col)
    differs = {c: ~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns}
    any_change = F.lit(False)
    for d in differs.values():
        any_change = any_change | d
    return pairs.filter(any_change).select(
        id_col,
        ts_lit(at).alias("changed_at"),
        *[F.when(differs[c], F.col(f"_new_{c}")).alias(c) for c in columns],
    )


def current_values(history: DataFrame, id_col: str = "unit_id", columns: Sequence[str] = TRACKED, order: Sequence[str] = ("changed_at",)) -> DataFrame:
    """The newest non-NULL value of every tracked column."""
    rank = F.struct(*order)
    return history.groupBy(id_col).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )


def change_history(history: DataFrame, unit, id_col: str = "unit_id", column: str | None = None, limit: int | None = None, order: Sequence[str] = ("changed_at",)) -> DataFrame:
    """Changes of one unit, newest first."""
    rows = history.filter(F.col(id_col) == unit)
    if column:
        rows = rows.filter(F.col(column).isNotNull())
    rows = rows.orderBy(*[F.col(o).desc() for o in order])
    return rows.limit(limit) if limit else rows


def max_generation(telemetry: DataFrame, since: datetime | None = None) -> DataFrame:
    """Highest actual reading of each unit; of equal ones the latest."""
    rows = telemetry.filter(~F.col("is_forecast") & (F.col("generated") > 0))
    if since:
        rows = rows.filter(F.col("interval") >= ts_lit(since))
    best = F.max(F.struct("generated", "interval")).alias("_best")
    return rows.groupBy("unit_code").agg(best).select(
        "unit_code",
        F.round("_best.generated", 4).alias("max_generation"),
        F.col("_best.interval").alias("max_generation_interval"),
    )


def update_max(units: DataFrame, recent: DataFrame) -> DataFrame:
    """Units with their record raised where the recent one is higher."""
    new = recent.select(
        "unit_code", F.col("max_generation").alias("_g"), F.col("max_generation_interval").alias("_t")
    )
    higher = F.col("_g").isNotNull() & (F.col("max_generation").isNull() | (F.col("_g") > F.col("max_generation")))
    joined = units.join(new, "unit_code", "left").withColumn("_up", higher)
    return (
        joined.withColumn("max_generation", F.when(F.col("_up"), F.col("_g")).otherwise(F.col("max_generation")))
        .withColumn(
            "max_generation_interval",
            F.when(F.col("_up"), F.col("_t")).otherwise(F.col("max_generation_interval")),
        )
        .select(*units.columns)
    )


def live_months(units: DataFrame, start: datetime, end: datetime, now: datetime) -> DataFrame:
    """Each unit once per month of its life inside the window.

    The months come from the unit's own dates, so nothing is crossed with a
    calendar.
    """
    first = F.greatest(F.col("commencement_date"), ts_lit(start))
    last = F.least(F.coalesce("closure_date", ts_lit(now)), ts_lit(end))
    month = lambda c: F.date_trunc("month", c).cast(NTZ)
    lo, hi = month(first), month(last)
    spans = units.filter(F.col("commencement_date").isNotNull()).withColumn("_lo", lo).withColumn("_hi", hi)
    steps = F.sequence("_lo", "_hi", F.make_ym_interval(F.lit(0), F.lit(1)))
    return (
        spans.filter(F.col("_lo") <= F.col("_hi"))
        .withColumn("month_start", F.explode(steps))
        .drop("_lo", "_hi")
    )
