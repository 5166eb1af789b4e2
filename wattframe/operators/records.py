"""All-time highs and lows: detection, scoring, chaining, search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.lookups import NETWORKS, REGION_NAMES, Network, lookup
from wattframe.functions.timebucket import bucket, epoch_seconds, period_bounds, season_name, ts_lit
from wattframe.operators.ordered import lag_row, running_extremes
from wattframe.operators.versioning import latest_per_id, upsert
from wattframe.session import stage

PERIOD_BUCKET = {
    "day": "1d",
    "week": "7d",
    "7d": "7d",
    "month": "1M",
    "quarter": "3M",
    "season": "season",
    "year": "1y",
    "financial_year": "fy",
}

# Intervals a period needs before a low counts.
THRESHOLDS = {
    "interval": 1,
    "day": 288,
    "week": 2016,
    "7d": 2016,
    "month": 8000,
    "quarter": 24000,
    "season": 24000,
    "year": 98000,
    "financial_year": 98000,
}


def thresholds() -> dict[str, int]:
    """Intervals a period needs before a low counts."""
    return dict(THRESHOLDS)


@dataclass(frozen=True)
class RecordMetric:
    """One metric in which records are kept."""

    name: str
    periods: tuple[str, ...]
    groupings: tuple[str, ...]
    floor: float
    digits: int = 0
    allow_negative: bool = False
    since: str = "2000-01-01"


# Groupings as (by region, by technology group, by renewable).
GROUPINGS = {
    "network": (False, False, False),
    "region": (True, False, False),
    "fueltech": (False, True, False),
    "renewable": (False, False, True),
    "region_fueltech": (True, True, False),
    "region_renewable": (True, False, True),
}
_GENERATION = tuple(GROUPINGS)
_MARKET = ("network", "region")
_LONG = ("day", "month", "quarter", "year")

# The metrics, their periods, floors and first days.
REGISTRY = (
    RecordMetric("power", ("interval",), _GENERATION, 100),
    RecordMetric("energy", _LONG, _GENERATION, 1000),
    RecordMetric("emissions", _LONG, _GENERATION, 1000),
    RecordMetric("price", ("interval",), _MARKET, 100, allow_negative=True, since="2009-07-01"),
    RecordMetric("demand", ("interval", *_LONG), _MARKET, 100, since="2009-07-01"),
    RecordMetric("renewable_proportion", ("interval", *_LONG), _MARKET, 0, digits=2, since="2007-06-01"),
)


def record_registry() -> tuple[RecordMetric, ...]:
    """The metrics in which records are kept."""
    return REGISTRY


# Technologies whose early history does not count.
FUELTECH_SINCE = {"solar": "2015-10-26", "wind": "2009-07-01", "renewables": "2000-01-01"}
# Technologies that can hold a record.
RECORD_FUELTECHS = (
    "battery_charging",
    "battery_discharging",
    "bioenergy",
    "coal",
    "demand",
    "distillate",
    "gas",
    "hydro",
    "pumps",
    "solar",
    "wind",
    "renewables",
    "fossils",
)
UNITS = {"power": "MW", "energy": "MWh", "price": "AUD", "emissions": "tCO2e", "renewable_proportion": "%"}
DEBOUNCE_INTERVALS = 10


def bounded_proportion(part: Column, whole: Column) -> Column:
    """Percentage of sums; above 200 or without a whole it is -1, an artefact."""
    share = part / F.nullif(whole, F.lit(0.0)) * 100
    return F.round(F.when((whole > 0) & (share <= 200), share).otherwise(F.lit(-1.0)), 2)


def trim_incomplete(df: DataFrame, ts: str, period: str, end: datetime) -> DataFrame:
    """Rows before the period that `end` falls into."""
    edge = ts_lit(end) if period == "interval" else bucket(ts_lit(end), PERIOD_BUCKET[period])
    return df.filter(F.col(ts) < edge)


def apply_cutoffs(df: DataFrame, since: dict[str, str] = FUELTECH_SINCE) -> DataFrame:
    """Without records of technologies before their data became sound."""
    keep = F.lit(True)
    for name, first in since.items():
        keep = keep & ~(F.col("fueltech_id").eqNullSafe(F.lit(name)) & (F.col("interval") < ts_lit(first)))
    return df.filter(keep)


def pct_change(value: Column, previous: Column, relative_to_size: bool = False) -> Column:
    """Percentage change, kept only where it says something."""
    base = F.abs(previous) if relative_to_size else previous
    change = (value - previous) / F.nullif(base, F.lit(0.0)) * 100
    size = F.abs(change)
    return F.when((size < 9999) & (size > 0.01), F.round(change, 2))


_HIT = "struct<aggregate: string, value: double, previous: struct<v: double, n: bigint, t: timestamp_ntz>>"


def detect_records(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    count: str,
    floor: Column | float,
    threshold: Column | int,
    digits: Column | int = 0,
    allow_negative: Column | bool = False,
    chunk: str | None = "year",
) -> DataFrame:
    """Rows that beat everything before them in their series, highs and lows.

    A high has to exceed `floor` and is compared rounded; a low has to be
    positive (unless negatives are allowed) and complete. One ordered scan
    serves both directions and all series of the frame.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    raw = F.col(value)
    rounded = F.when(lit(digits) == 2, F.round(raw, 2)).otherwise(F.round(raw, 0))
    high = F.when(F.round(rounded, 0) > lit(floor), rounded)
    complete = F.col(count) >= lit(threshold)
    low = F.when(complete & (lit(allow_negative) | (raw > 0)), raw)
    # The earliest holder of the extreme travels along, so the record a new one
    # replaces is known without another scan.
    at = epoch_seconds(ts)
    marked = running_extremes(
        df,
        keys,
        ts,
        {
            "_max": (F.when(high.isNotNull(), F.struct(high.alias("v"), (-at).alias("n"), F.col(ts).alias("t"))), "max"),
            "_min": (F.when(low.isNotNull(), F.struct(low.alias("v"), at.alias("n"), F.col(ts).alias("t"))), "min"),
        },
        chunk,
    )

    def side(name: str, v: str, prev: str, beats: Column) -> Column:
        hit = F.col(v).isNotNull() & (F.col(prev).isNull() | beats)
        return F.when(
            hit, F.struct(F.lit(name).alias("aggregate"), F.col(v).alias("value"), F.col(prev).alias("previous"))
        )

    marked = marked.withColumn("_high", high).withColumn("_low", low)
    sides = F.array_compact(
        F.array(
            side("high", "_high", "prev__max", F.col("_high") > F.col("prev__max.v")).cast(_HIT),
            side("low", "_low", "prev__min", F.col("_low") < F.col("prev__min.v")).cast(_HIT),
        )
    )
    rest = [c for c in df.columns if c != value]
    hits = marked.select(*rest, F.explode(sides).alias("_r"))
    return hits.select(
        *rest,
        F.col("_r.aggregate").alias("aggregate"),
        F.col("_r.value").alias("value"),
        F.col("_r.previous.t").alias("previous_interval"),
        pct_change(F.col("_r.value"), F.col("_r.previous.v")).alias("pct_change"),
    )


# --- the base series ---------------------------------------------------------------------


def _grouped(df: DataFrame, groupings: Sequence[str], fueltech: Column | None) -> DataFrame:
    """Each row once per grouping, with the columns the grouping ignores NULL."""
    entries = []
    none = F.lit(None).cast("string")
    for name in groupings:
        by_region, by_group, by_green = GROUPINGS[name]
        entries.append(
            F.struct(
                F.lit(name).alias("grouping"),
                (F.col("network_region") if by_region else none).alias("region"),
                (fueltech if (by_group or by_green) and fueltech is not None else none).alias("tech"),
            )
        )
    out = df.withColumn("_g", F.explode(F.array(*entries)))
    return out.select(
        *[c for c in df.columns if c not in ("network_region", "fueltech_group_id", "renewable")],
        F.col("_g.grouping").alias("grouping"),
        F.col("_g.region").alias("network_region"),
        F.col("_g.tech").alias("fueltech_id"),
    )


_SERIES = ("grouping", "network_region", "fueltech_id")


def generation_base(fueltech: DataFrame, renewable: DataFrame, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Sums per interval for the six generation groupings."""
    codes = networks[network].codes
    measures = ("generated", "energy", "emissions")

    def part(df: DataFrame, groupings: Sequence[str], tech: Column | None) -> DataFrame:
        rows = df.filter(F.col("network_id").isin(*codes))
        grouped = _grouped(rows.select("interval", "network_region", *[c for c in ("fueltech_group_id", "renewable") if c in df.columns], *measures), groupings, tech)
        return grouped.groupBy("interval", *_SERIES).agg(*[F.sum(c).alias(c) for c in measures])

    green = F.when(F.col("renewable"), "renewables").otherwise("fossils")
    by_tech = part(fueltech, ("network", "region", "fueltech", "region_fueltech"), F.col("fueltech_group_id"))
    by_green = part(renewable, ("renewable", "region_renewable"), green)
    both = by_tech.unionByName(by_green)
    grouped_by_tech = F.col("grouping").isin("fueltech", "region_fueltech")
    return both.filter(~grouped_by_tech | F.col("fueltech_id").isin(*RECORD_FUELTECHS))


def market_base(summary: DataFrame, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Means and sums per interval for network and region."""
    codes = networks[network].codes
    rows = summary.filter(F.col("network_id").isin(*codes)).select(
        "interval", "network_region", "price", "demand", "demand_energy", "generation_renewable", "demand_gross"
    )
    return _grouped(rows, _MARKET, None).groupBy("interval", *_SERIES).agg(
        F.avg("price").alias("price"),
        F.avg("demand").alias("demand"),
        F.sum("demand_energy").alias("demand_energy"),
        F.sum("generation_renewable").alias("renewable"),
        F.sum("demand_gross").alias("gross"),
    )


def _long(df: DataFrame, values: dict[str, Column], period: str | Column, count: Column) -> DataFrame:
    """Measures as rows of (metric, value)."""
    entries = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
    out = df.select(
        "interval",
        *_SERIES,
        (period if isinstance(period, Column) else F.lit(period)).alias("period"),
        count.cast("long").alias("interval_count"),
        F.explode(F.array(*entries)).alias("_m"),
    )
    return out.select(
        "interval", *_SERIES, "period", "interval_count", F.col("_m.metric").alias("metric"), F.col("_m.value").alias("value")
    )


def _periods(df: DataFrame, sums: Sequence[str], periods: Sequence[str]) -> DataFrame:
    """Interval sums to days, and days to the longer periods, in two steps.

    Days are aggregated first, so the explode over periods multiplies day rows
    rather than interval rows.
    """
    days = df.groupBy(bucket("interval", "1d").alias("interval"), *_SERIES).agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n")
    )
    starts = F.array(
        *[F.struct(F.lit(p).alias("period"), bucket("interval", PERIOD_BUCKET[p]).alias("start")) for p in periods]
    )
    out = days.withColumn("_p", F.explode(starts))
    return out.groupBy(F.col("_p.start").alias("interval"), F.col("_p.period").alias("period"), *_SERIES).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("n").alias("n")
    )


def record_base(fueltech: DataFrame, renewable: DataFrame, summary: DataFrame, network: str = "NEM", periods: Sequence[str] = _LONG, networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Every (metric, period, grouping) series in one long frame.

    The sums by interval are written once to the shared folder: intervals and periods both start from them, and record
    detection reads the frame twice.
    """
    generation = stage(generation_base(fueltech, renewable, network, networks))
    market = stage(market_base(summary, network, networks))
    one = F.lit(1)
    col = F.col
    spans = _periods(generation, ("energy", "emissions"), periods)
    market_spans = _periods(market, ("demand_energy", "renewable", "gross"), periods)
    share = bounded_proportion(col("renewable"), col("gross"))
    parts = [
        _long(generation, {"power": col("generated")}, "interval", one),
        _long(spans, {"energy": col("energy"), "emissions": col("emissions")}, col("period"), col("n")),
        _long(market, {"price": col("price"), "demand": col("demand"), "renewable_proportion": share}, "interval", one),
        # A day or more of demand never counts as complete, a share always does.
        _long(market_spans, {"demand": col("demand_energy")}, col("period"), one),
        _long(market_spans, {"renewable_proportion": share}, col("period"), F.lit(10_000_000_000)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_metric(column: Column, pick: Callable[[RecordMetric], object], kind: str) -> Column:
    return lookup(column, {m.name: pick(m) for m in REGISTRY}).cast(kind)


def find_records(base: DataFrame, end: datetime, network: str = "NEM", chunk: str | None = "year", completeness: dict[str, int] = THRESHOLDS) -> DataFrame:
    """All records of a long base frame, with ids, chain, score and text.

    One scan over all series replaces a query per metric, period and grouping.
    """
    metric = F.col("metric")
    first = _of_metric(metric, lambda m: m.since, "timestamp_ntz")
    edge = ts_lit(end)
    complete = F.when(F.col("period") == "interval", F.col("interval") < edge)
    for p, width in PERIOD_BUCKET.items():
        complete = complete.when(F.col("period") == p, F.col("interval") < bucket(edge, width))
    complete = complete.otherwise(F.raise_error(F.concat(F.lit("unknown period: "), F.coalesce("period", F.lit("NULL")))))
    rows = base.filter(complete & (F.col("interval") >= first) & F.col("value").isNotNull())
    floors = _of_metric(metric, lambda m: float(m.floor), "double")
    hits = detect_records(
        rows,
        ["metric", "period", *_SERIES],
        "interval",
        "value",
        "interval_count",
        floors,
        lookup(F.col("period"), completeness),
        _of_metric(metric, lambda m: m.digits, "int"),
        _of_metric(metric, lambda m: m.allow_negative, "boolean"),
        chunk,
    )
    is_demand = metric == "demand"
    out_metric = F.when(is_demand & (F.col("period") == "interval"), "power").when(is_demand, "energy").otherwise(metric)
    named = hits.withColumn("fueltech_id", F.when(is_demand, "demand").otherwise(F.col("fueltech_id"))).withColumn(
        "metric", out_metric
    )
    named = with_ids(apply_cutoffs(named).withColumn("network_id", F.lit(network)), network)
    # A predecessor dropped by a cut-off is no predecessor.
    since = lookup(F.col("fueltech_id"), FUELTECH_SINCE).cast("timestamp_ntz")
    before = F.col("previous_interval")
    valid = before.isNotNull() & (since.isNull() | (before >= since))
    linked = named.withColumn("previous_instance_id", F.when(valid, instance_id(F.col("record_id"), before)))
    return describe_records(linked)


def with_ids(records: DataFrame, network: str = "NEM") -> DataFrame:
    """Adds record_id and a deterministic instance_id."""
    net = NETWORKS[network]
    rid = record_id(
        F.lit(net.country),
        F.lit(net.parent or net.code),
        F.col("network_region"),
        F.col("fueltech_id"),
        F.col("metric"),
        F.col("period"),
        F.col("aggregate"),
        F.col("interval"),
    )
    return records.withColumn("record_id", rid).withColumn("instance_id", instance_id(F.col("record_id"), F.col("interval")))


def record_id(country: Column, network: Column, region: Column, fueltech: Column, metric: Column, period: Column, aggregate: Column, interval: Column) -> Column:
    """Dotted name of a record series; absent parts are left out."""
    name = F.when(metric == "renewable_proportion", "renewables.proportion").otherwise(metric)
    span = F.when(period == "season", season_name(interval)).otherwise(period)
    return F.lower(F.concat_ws(".", country, network, region, fueltech, name, span, aggregate))


def instance_id(record: Column, interval: Column) -> Column:
    return F.sha2(F.concat_ws("|", record, F.date_format(interval, "yyyy-MM-dd HH:mm:ss")), 256)


def chain(records: DataFrame, chunk: str | None = "year") -> DataFrame:
    """Links each record to the one it replaced."""
    linked = lag_row(records, ["record_id"], "interval", ["instance_id"], "_previous_", chunk)
    return linked.withColumnRenamed("_previous_instance_id", "previous_instance_id")


# --- comparing with what is known ------------------------------------------------------------


def is_new(aggregate: Column, metric: Column, interval: Column, value: Column, previous_interval: Column, previous_value: Column) -> Column:
    """Whether a candidate is later than and, rounded, beats the record it faces."""
    now = F.when(metric == "renewable_proportion", F.bround(value, 2)).otherwise(F.bround(value, 0))
    before = F.when(metric == "renewable_proportion", F.bround(previous_value, 2)).otherwise(F.bround(previous_value, 0))
    beats = F.when(aggregate == "high", now > before).otherwise(now < before)
    return F.coalesce((interval > previous_interval) & (value != 0) & beats, F.lit(False))


def debounce(records: DataFrame, min_intervals: int = DEBOUNCE_INTERVALS, interval_minutes: int = 5, state: DataFrame | None = None) -> DataFrame:
    """Drops interval records that follow the last kept one too closely.

    The rule is a fold along each id, cut into days so that no task holds a
    whole series. A day is reached with the gate (last kept + window) at most
    one window into it, so only the few points up to there can be its first
    kept one; for each of them the gate the day ends with is worked out. The
    days of an id are then chained, one short row per day, and every day is
    folded once more from the gate it really has. `state` (record_id,
    interval) brings records kept earlier; they close the gate first.
    """
    window = min_intervals * interval_minutes * 60
    if window <= 0:
        return records
    fast = records.filter(F.col("period") == "interval")
    slow = records.filter(F.col("period") != "interval")
    day_start = epoch_seconds(F.date_trunc("day", "interval").cast("timestamp_ntz"))
    point = F.struct(epoch_seconds("interval").alias("s"), F.col("interval").alias("t"))
    days = fast.groupBy("record_id", day_start.alias("day")).agg(F.array_sort(F.collect_set(point)).alias("points"))

    seconds = F.transform("points", lambda p: p["s"])
    early = F.filter(seconds, lambda s: s < F.col("day") + window)
    free = F.slice(F.filter(seconds, lambda s: s >= F.col("day") + window), 1, 1)

    def gate_after(start: Column) -> Column:
        return F.aggregate(seconds, start, lambda gate, s: F.when(s >= gate, s + window).otherwise(gate))

    starts = F.concat(early, free)
    summary = days.select("record_id", "day", starts.alias("starts"), F.transform(starts, gate_after).alias("gates"))
    none = F.lit(None).cast("long")
    if state is None:
        seeded = summary.withColumn("seed", none)
    else:
        seed = state.groupBy("record_id").agg((F.max(epoch_seconds("interval")) + window).alias("seed"))
        seeded = summary.join(seed, "record_id", "left")
    gates = seeded.groupBy("record_id").applyInPandas(_chain_days, "record_id string, day long, gate long")

    entered = days.join(gates, ["record_id", "day"])
    empty = F.struct(F.col("gate").alias("gate"), F.array().cast("array<timestamp_ntz>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        passes = F.struct((p["s"] + window).alias("gate"), F.concat(acc["kept"], F.array(p["t"])).alias("kept"))
        return F.when(p["s"] >= acc["gate"], passes).otherwise(acc)

    kept = entered.select("record_id", F.explode(F.aggregate("points", empty, step)["kept"]).alias("interval"))
    return slow.unionByName(fast.join(kept, ["record_id", "interval"], "left_semi"))


def _chain_days(pdf: pd.DataFrame) -> pd.DataFrame:
    """The gate each day of one id is entered with; a few numbers per day."""
    pdf = pdf.sort_values("day")
    seed = pdf["seed"].iloc[0]
    gate = -(2**62) if pd.isna(seed) else int(seed)
    entered = []
    for starts, gates in zip(pdf["starts"], pdf["gates"], strict=True):
        entered.append(gate)
        # Past every point the gate stays as it is.
        gate = next((int(g) for s, g in zip(starts, gates, strict=True) if s >= gate), gate)
    return pd.DataFrame({"record_id": pdf["record_id"], "day": pdf["day"], "gate": entered})


def current_state(records: DataFrame) -> DataFrame:
    """The standing record of every id."""
    return latest_per_id(records, "record_id", "interval")


def completed_periods(now: datetime) -> dict[str, tuple[datetime, datetime]]:
    """The last finished interval, day, month, quarter and year at a clock.

    Quarters and years are aligned to the calendar, so a partial one is never
    taken for a whole.
    """
    spans = {p: period_bounds(now, p) for p in ("interval", "day", "month", "year")}
    month = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    end = month.replace(month=(month.month - 1) // 3 * 3 + 1)
    start = (end - timedelta(days=80)).replace(day=1)
    spans["quarter"] = (start, end)
    return spans


def check_period(base: DataFrame, state: DataFrame, now: datetime, network: str = "NEM", completeness: dict[str, int] = THRESHOLDS) -> DataFrame:
    """Candidates of the just completed periods that beat the standing records.

    `base` is the long frame of `record_base`; `state` the standing records.
    """
    inside = F.lit(False)
    for period, (start, end) in completed_periods(now).items():
        at = (F.col("interval") >= ts_lit(start)) & (F.col("interval") < ts_lit(end))
        inside = inside | ((F.col("period") == period) & at)
    rows = base.filter(inside & F.col("value").isNotNull())
    metric = F.col("metric")
    digits = _of_metric(metric, lambda m: m.digits, "int")
    value = F.when(digits == 2, F.bround("value", 2)).otherwise(F.bround("value", 0))
    # The price floor of the incremental check is zero.
    floor = F.when(metric == "price", 0.0).otherwise(_of_metric(metric, lambda m: float(m.floor), "double"))
    negative = _of_metric(metric, lambda m: m.allow_negative, "boolean")
    complete = F.col("interval_count") >= lookup(F.col("period"), completeness)
    sides = F.array_compact(
        F.array(
            F.when(value > floor, F.lit("high")),
            F.when(complete & (negative | (F.col("value") > 0)), F.lit("low")),
        )
    )
    is_demand = metric == "demand"
    shaped = (
        rows.withColumn("_rounded", value)
        .withColumn("aggregate", F.explode(sides))
        .withColumn("fueltech_id", F.when(is_demand, "demand").otherwise(F.col("fueltech_id")))
        .withColumn(
            "metric", F.when(is_demand & (F.col("period") == "interval"), "power").when(is_demand, "energy").otherwise(metric)
        )
    )
    shaped = with_ids(apply_cutoffs(shaped).withColumn("network_id", F.lit(network)), network)
    known = state.select(
        "record_id",
        F.col("interval").alias("_pi"),
        F.col("value").alias("_pv"),
        F.col("instance_id").alias("previous_instance_id"),
    )
    joined = shaped.join(known, "record_id", "left")
    far = (F.col("period") != "interval") | (
        epoch_seconds("interval") - epoch_seconds("_pi") >= DEBOUNCE_INTERVALS * 60 * NETWORKS[network].interval_minutes
    )
    better = is_new(F.col("aggregate"), F.col("metric"), F.col("interval"), F.col("_rounded"), F.col("_pi"), F.col("_pv"))
    new = joined.filter(F.col("_pi").isNull() | (better & far))
    return describe_records(
        new.withColumn("pct_change", pct_change(F.col("value"), F.col("_pv"), relative_to_size=True))
        .withColumn("value", F.col("_rounded"))
        .drop("_rounded", "_pi", "_pv")
    )


# --- score and text --------------------------------------------------------------------------

# Weights and scores of a record's significance.
WEIGHTS = {"period": 0.3, "metric": 0.25, "network": 0.1, "network_region": 0.15, "fueltech": 0.1, "aggregate": 0.1}
PERIOD_SCORES = {
    "interval": 1,
    "day": 9,
    "week": 2,
    "7d": 2,
    "month": 9,
    "quarter": 5,
    "season": 5,
    "year": 10,
    "financial_year": 4,
}
METRIC_SCORES = {"demand": 8, "price": 6, "power": 1, "energy": 9, "emissions": 9, "renewable_proportion": 10}
GREEN_FUELTECHS = ("solar", "wind", "hydro", "bioenergy", "pumps", "battery_charging", "battery_discharging")
DULL_LOWS = ("distillate", "solar", "battery_charging", "battery_discharging", "hydro", "pumps")


def significance(network: Column, region: Column, fueltech: Column, metric: Column, period: Column, aggregate: Column) -> Column:
    """Score from 0 to 10: named cases first, a weighted sum for the rest."""
    high, whole = aggregate == "high", region.isNull()
    ft = F.coalesce(fueltech, F.lit(""))
    by_scope = lambda a, b: F.when(whole, F.lit(a)).otherwise(F.lit(b))
    output = metric.isin("power", "energy") & period.isin("interval", "day", "quarter", "year")

    def scored(score: Column, part: str) -> Column:
        return score.cast("double") * WEIGHTS[part]

    tech = F.when(ft == "", 0).when(ft.isin(*GREEN_FUELTECHS), F.when(high, 10).otherwise(3)).otherwise(5)
    total = (
        scored(lookup(period, PERIOD_SCORES), "period")
        + scored(lookup(metric, METRIC_SCORES), "metric")
        + scored(F.when(network == "NEM", 10).otherwise(5), "network")
        + scored(by_scope(10, 5), "network_region")
        + scored(tech, "fueltech")
        + scored(F.when(high, 10).otherwise(5), "aggregate")
    )
    share = (metric == "renewable_proportion") & period.isin("interval", "day", "week", "7d")
    return (
        F.when(ft == "battery_charging", F.when(high, by_scope(8, 7)).otherwise(F.lit(1)))
        .when(output & high & ft.isin("solar", "wind", "renewables", "battery_discharging"), by_scope(10, 9))
        .when(output & ~high & ft.isin("fossils", "coal", "gas"), by_scope(10, 9))
        .when((ft == "demand") & period.isin("interval", "day") & high, by_scope(10, 9))
        .when(share, F.when(high, by_scope(10, 9)).otherwise(by_scope(5, 4)))
        .when((ft == "renewables") & (metric == "emissions"), F.lit(0))
        .when(~high & ft.isin(*DULL_LOWS), F.lit(1))
        .when(metric == "price", F.lit(1))
        # Noise below the last digit would tip halves either way.
        .otherwise(F.bround(F.round(total, 6), 0))
        .cast("int")
    )


# Spoken names.
PERIOD_WORDS = {
    "interval": "Interval",
    "day": "Daily",
    "week": "Weekly",
    "7d": "7d",
    "month": "Monthly",
    "quarter": "Quarterly",
    "year": "Annual",
    "financial_year": "Financial year",
}
METRIC_WORDS = {
    "demand": "Demand",
    "price": "Price",
    "power": "Generation",
    "energy": "Energy",
    "emissions": "Emissions",
    "market_value": "Market_value",
    "renewable_proportion": "Renewable_proportion",
}
FUELTECH_WORDS = {"battery_charging": "Battery (charging)", "battery_discharging": "Battery (discharging)"}


def describe(network: Column, region: Column, fueltech: Column, metric: Column, period: Column, aggregate: Column, interval: Column) -> Column:
    """A record in a sentence; parts without a value are left out."""
    span = F.when(period == "season", F.initcap(season_name(interval))).otherwise(lookup(period, PERIOD_WORDS))
    capital = F.concat(F.upper(F.substring(fueltech, 1, 1)), F.lower(F.substr(fueltech, F.lit(2))))
    return F.concat_ws(
        " ",
        span,
        F.coalesce(lookup(fueltech, FUELTECH_WORDS), capital),
        lookup(metric, METRIC_WORDS),
        aggregate,
        F.lit("record for"),
        network,
        F.concat(F.lit("in "), lookup(region, REGION_NAMES, region)),
    )


RECORD_COLUMNS = (
    "record_id",
    "interval",
    "instance_id",
    "aggregate",
    "metric",
    "period",
    "significance",
    "value",
    "pct_change",
    "value_unit",
    "network_id",
    "network_region",
    "fueltech_id",
    "description",
    "previous_instance_id",
)


def describe_records(records: DataFrame) -> DataFrame:
    """Adds score, unit and text, in the columns of the record table."""
    parts = [F.col(c) for c in ("network_id", "network_region", "fueltech_id", "metric", "period", "aggregate")]
    return (
        records.withColumn("significance", significance(*parts))
        .withColumn("description", describe(*parts, F.col("interval")))
        .withColumn("value_unit", lookup(F.col("metric"), UNITS))
        .withColumn("value", F.round("value", 4))
        .select(*RECORD_COLUMNS)
    )


# --- reading and maintaining ------------------------------------------------------------------


def search(
    records: DataFrame,
    start=None,
    end=None,
    significance_min: int | None = None,
    significance_max: int | None = None,
    fueltechs: Sequence[str] | None = None,
    aggregate: str | None = None,
    metrics: Sequence[str] | None = None,
    networks: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    periods: Sequence[str] | None = None,
    places: Sequence[str] | None = None,
    record: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Records by any mix of filters; network-wide ones unless a place is named.

    `places` match network or region, `pattern` matches ids with `*`.
    """
    col = F.col
    rows = records if record is None else records.filter(col("record_id") == record)
    if record is None:
        if start:
            rows = rows.filter(col("interval") >= ts_lit(start))
        if end:
            rows = rows.filter(col("interval") <= ts_lit(end) if end != start else col("interval") < ts_lit(end))
        if significance_min is not None:
            rows = rows.filter(col("significance") >= significance_min)
        if significance_max is not None:
            rows = rows.filter(col("significance") <= significance_max)
        for column, wanted in (("fueltech_id", fueltechs), ("metric", metrics), ("network_id", networks), ("period", periods)):
            if wanted:
                rows = rows.filter(col(column).isin(*wanted))
        if aggregate:
            rows = rows.filter(col("aggregate") == aggregate)
        if regions:
            rows = rows.filter(col("network_region").isin(*regions))
        elif not places:
            rows = rows.filter(col("network_region").isNull())
    for place in places or ():
        rows = rows.filter((col("network_id") == place) | col("network_region").eqNullSafe(F.lit(place)))
    if pattern:
        rows = rows.filter(col("record_id").ilike(pattern.replace("*", "%")))
    return rows


def page(df: DataFrame, order: Sequence[Column], limit: int, page_number: int = 1) -> DataFrame:
    """One page of an ordered listing, with the total number of rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    skip = (page_number - 1) * limit
    return df.orderBy(*order).offset(skip).limit(limit).withColumn("total", total)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, last: Sequence | None = None) -> DataFrame:
    """The `limit` rows that follow the row whose order columns hold `last`, or the first ones.

    `order` names columns, each with whether it ascends (nulls first) or descends (nulls last), and should end in a
    unique one. Rows up to the last key are filtered at the scan, so however deep the page, a task keeps `limit` rows.
    """
    rows = df
    if last is not None:
        after = F.lit(False)
        for (name, ascends), value in reversed(list(zip(order, last, strict=True))):
            c = F.col(name)
            if value is None:
                beyond = c.isNotNull() if ascends else F.lit(False)
            else:
                beyond = c > F.lit(value) if ascends else (c < F.lit(value)) | c.isNull()
            after = F.coalesce(beyond, F.lit(False)) | (c.eqNullSafe(F.lit(value)) & after)
        rows = df.filter(after)
    return rows.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in order]).limit(limit)


def history(records: DataFrame, record: str, before: datetime, n: int | None = None) -> DataFrame:
    """The records of one id before a time, newest first."""
    rows = records.filter((F.col("record_id") == record) & (F.col("interval") < ts_lit(before)))
    rows = rows.orderBy(F.col("interval").desc())
    return rows.limit(n) if n else rows


def reconcile(records: DataFrame, candidates: DataFrame, now: datetime, years: int = 2) -> DataFrame:
    """Stored records plus recomputed ones of the last years that are missing."""
    recent = candidates.filter(F.col("interval") >= ts_lit(now.replace(year=now.year - years)))
    return upsert(records, recent, ["record_id", "interval"], [], mode="ignore")


def gap_start(records: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """One row: the day to recompute from when records stopped over a day ago."""
    last = records.agg(F.max("interval").alias("last"))
    stale = epoch_seconds(ts_lit(now)) - epoch_seconds("last") > hours * 3600
    return last.select("last", F.when(stale, bucket("last", "1d")).alias("recompute_from"))


def highlights(records: DataFrame, start: datetime, end: datetime, network: str = "NEM", wanted: int = 3, limit: int | None = None) -> DataFrame:
    """The week's records worth telling: score 9 and up, or 8 when few.

    `limit` cuts the listing, if given; lows of demand are left out after that, as the count is of
    what remains.
    """
    rows = search(records, start, end, significance_min=8, places=[network])
    dull = (F.col("aggregate") == "low") & F.col("fueltech_id").eqNullSafe(F.lit("demand"))

    def listed(score: int) -> DataFrame:
        top = rows.filter(F.col("significance") >= score).orderBy(F.col("interval").desc(), "record_id")
        return (top.limit(limit) if limit else top).filter(~dull)

    best = listed(9)
    enough = best.agg(F.count(F.lit(1))).scalar() >= wanted
    return best.filter(enough).unionByName(listed(8).filter(~enough))


def repair(records: DataFrame, pattern: str, rebuilt: DataFrame) -> DataFrame:
    """Records with the series matching a LIKE pattern replaced by rebuilt ones."""
    kept = records.filter(~F.col("record_id").like(pattern))
    return upsert(kept, rebuilt.filter(F.col("record_id").like(pattern)), ["record_id", "interval"], [], mode="ignore")


def repair_report(records: DataFrame, repaired: DataFrame, rebuilt: DataFrame, pattern: str, unit: str) -> DataFrame:
    """One row of checks on a repair: counts, units, and whether it is sound."""
    def summary(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(F.col("record_id").like(pattern))
        return rows.agg(
            F.count(F.lit(1)).alias(name),
            F.count_if(~F.col("value_unit").eqNullSafe(F.lit(unit))).alias(f"{name}_odd_units"),
        ).withColumn("_k", F.lit(1))

    before, after, new = summary(records, "before"), summary(repaired, "stored"), summary(rebuilt, "attempted")
    joined = before.join(after, "_k").join(new, "_k").drop("_k")
    sound = (F.col("stored") > 0) & (F.col("stored") == F.col("attempted")) & (F.col("stored_odd_units") == 0)
    return joined.withColumn("sound", sound)
