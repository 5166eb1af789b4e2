"""Two-stage time-series aggregation driven by a registry of metrics.

Stage one sums over units per raw interval and group, stage two combines raw
intervals into buckets. Power has to be summed over units before it is
averaged over time, which is why one aggregation will not do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.lookups import NETWORKS, Network
from wattframe.functions.timebucket import bucket, check_range, default_range, ts_lit
from wattframe.operators.gapfill import cap_to_settled


@dataclass(frozen=True)
class MetricPlan:
    """Columns summed per raw interval, and how buckets combine them."""

    inner: dict[str, Column]
    outer: Callable[[], Column]


def _sum(column: str) -> dict[str, Column]:
    return {f"{column}_sum": F.sum(column)}


def _mean_of(column: str, scale: float = 1) -> MetricPlan:
    return MetricPlan(_sum(column), lambda: F.round(F.avg(F.col(f"{column}_sum") * scale), 6))


def _total_of(column: str) -> MetricPlan:
    return MetricPlan(_sum(column), lambda: F.round(F.sum(f"{column}_sum"), 6))


def _weighted(column: str, values: Column, present: Column) -> MetricPlan:
    total, count = f"{column}_total", f"{column}_count"
    return MetricPlan(
        {total: values, count: present},
        lambda: F.round(F.sum(total) / F.nullif(F.sum(count), F.lit(0)), 6),
    )


def _share(part: str, whole: str) -> MetricPlan:
    """Percentage of sums; unknown, not zero, where the whole is missing."""

    def outer() -> Column:
        below = F.sum(f"{whole}_sum")
        return F.when(below > 0, F.round(F.sum(f"{part}_sum") / below * 100, 2))

    return MetricPlan({**_sum(part), **_sum(whole)}, outer)


def data_metrics() -> dict[str, MetricPlan]:
    """Metrics of the unit fact."""
    stored = F.col("energy_storage")
    return {
        "power": _mean_of("generated"),
        "energy": _total_of("energy"),
        "emissions": _total_of("emissions"),
        "market_value": _total_of("market_value"),
        "storage_battery": _weighted(
            "energy_storage", F.sum(F.coalesce(stored, F.lit(0.0))), F.count_if(stored.isNotNull())
        ),
    }


def market_metrics() -> dict[str, MetricPlan]:
    """Metrics of the market fact."""
    price = F.col("price")
    return {
        "price": _weighted("price", F.sum(price), F.count_if(price.isNotNull())),
        "demand": _mean_of("demand"),
        "demand_energy": _total_of("demand_energy"),
        "demand_gross": _mean_of("demand_gross"),
        "demand_gross_energy": _total_of("demand_gross_energy"),
        "generation_renewable": _mean_of("generation_renewable"),
        "generation_renewable_energy": _total_of("generation_renewable_energy"),
        "generation_renewable_with_storage": _mean_of("generation_renewable_with_storage"),
        "generation_renewable_with_storage_energy": _total_of("generation_renewable_with_storage_energy"),
        "curtailment": _mean_of("curtailment_total"),
        "curtailment_energy": _total_of("curtailment_energy_total"),
        "curtailment_solar_utility": _mean_of("curtailment_solar_total"),
        "curtailment_wind": _mean_of("curtailment_wind_total"),
        "curtailment_solar_utility_energy": _total_of("curtailment_energy_solar_total"),
        "curtailment_wind_energy": _total_of("curtailment_energy_wind_total"),
        # Flows are stored as energy per five minutes.
        "flow_imports": _mean_of("energy_imports", 12),
        "flow_exports": _mean_of("energy_exports", 12),
        "flow_imports_energy": _total_of("energy_imports"),
        "flow_exports_energy": _total_of("energy_exports"),
        "renewable_proportion": _share("generation_renewable", "demand_gross"),
        "renewable_with_storage_proportion": _share("generation_renewable_with_storage", "demand_gross"),
    }


REGISTRIES = {"data": data_metrics, "facility": data_metrics, "market": market_metrics}

# Grouping names and the columns they stand for.
GROUPINGS = {
    "region": "network_region",
    "renewable": "renewable",
    "fueltech": "fueltech_id",
    "fueltech_group": "fueltech_group_id",
    "status": "status_id",
}
# Filter names and the columns they restrict.
FILTERS = {
    "facility_code": "facility_code",
    "unit_code": "unit_code",
    "network_region": "network_region",
    "fueltech": "fueltech_id",
    "fueltech_group": "fueltech_group_id",
}
# A filter on one of these shows up as a group of the answer.
_FORCES = {"network_region": "region", "fueltech": "fueltech", "fueltech_group": "fueltech_group"}


def timeseries(
    df: DataFrame,
    metrics: Sequence[str],
    interval: str,
    start: datetime,
    end: datetime,
    group: Sequence[str] = (),
    filters: dict[str, str | Sequence[str]] | None = None,
    network: str = "NEM",
    kind: str = "data",
    networks: dict[str, Network] = NETWORKS,
) -> DataFrame:
    """Metrics per bucket and group over [start, end).

    `kind` is "data" (unit fact), "facility" (unit fact, one series per unit)
    or "market" (market fact). A logical network covers all its feeds in `networks`.
    """
    plans = REGISTRIES[kind]()
    unknown = [m for m in metrics if m not in plans]
    if unknown:
        raise ValueError(f"no {kind} metric {unknown}, there are {sorted(plans)}")
    filters = dict(filters or {})
    names = [g for g in group if kind == "data" or g == "region"]
    for name, forced in _FORCES.items():
        if filters.get(name) and forced not in names and (kind == "data" or forced == "region"):
            names.append(forced)
    keys = [GROUPINGS[n] for n in names]
    if kind == "facility":
        keys = ["facility_code", "unit_code", *keys]

    rows = df.filter(
        F.col("network_id").isin(*networks[network].codes)
        & (F.col("interval") >= ts_lit(start))
        & (F.col("interval") < ts_lit(end))
    )
    for name, wanted in filters.items():
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        if values:
            rows = rows.filter(F.col(FILTERS[name]).isin(*values))

    inner: dict[str, Column] = {}
    for m in metrics:
        inner.update(plans[m].inner)
    per_interval = rows.groupBy("interval", *keys).agg(*[e.alias(n) for n, e in inner.items()])
    label = {"fueltech_id": "fueltech", "fueltech_group_id": "fueltech_group", "status_id": "status"}
    return (
        per_interval.groupBy(bucket("interval", interval).alias("interval"), *keys)
        .agg(*[plans[m].outer().alias(m) for m in metrics])
        .select(
            "interval",
            F.lit(network).alias("network"),
            *[F.col(k).alias(label.get(k, k)) for k in keys],
            *metrics,
        )
    )


def request(
    df: DataFrame,
    metrics: Sequence[str],
    interval: str,
    now: datetime,
    start: datetime | None = None,
    end: datetime | None = None,
    **options,
) -> DataFrame:
    """`timeseries` as it is asked for from outside: a checked range, without what is still settling.

    An end that is left out is the clock, a start half the allowed span before it; more than the allowed span
    is an error. `options` are those of `timeseries`.
    """
    half, _ = default_range(interval, end or now)
    start, end = start or half, end or now
    check_range(interval, start, end)
    return timeseries(cap_to_settled(df, "interval", end, now), metrics, interval, start, end, **options)
