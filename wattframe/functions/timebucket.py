"""Calendar buckets over naive timestamps.

`date_trunc` yields a zoned timestamp and `add_months` a date, so every bucket
is cast back to `timestamp_ntz`; the session runs in UTC.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe.functions.lookups import NETWORKS, lookup

# The bucket names a query may ask for.
INTERVALS = ("5m", "15m", "30m", "1h", "1d", "7d", "1M", "3M", "season", "1y", "fy")
# Width of the buckets that have a constant width.
FIXED_STEP = {
    "5m": timedelta(minutes=5),
    "15m": timedelta(minutes=15),
    "30m": timedelta(minutes=30),
    "1h": timedelta(hours=1),
    "1d": timedelta(days=1),
    "7d": timedelta(days=7),
}
# Months per calendar bucket.
CALENDAR_MONTHS = {"1M": 1, "3M": 3, "season": 3, "1y": 12, "fy": 12}
# Longest span a request may cover, by bucket, in days.
RANGE_LIMIT_DAYS = {"5m": 8, "1h": 32, "1d": 366, "7d": 366, "1M": 732, "3M": 1830, "season": 1830, "1y": 3700, "fy": 3700}
# Southern seasons by month.
SEASONS = {
    1: "summer",
    2: "summer",
    3: "autumn",
    4: "autumn",
    5: "autumn",
    6: "winter",
    7: "winter",
    8: "winter",
    9: "spring",
    10: "spring",
    11: "spring",
    12: "summer",
}

NTZ = "timestamp_ntz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: datetime | str | Column) -> Column:
    """A naive timestamp literal."""
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(text).cast(NTZ)


def step_lit(step: timedelta) -> Column:
    """A day-time interval literal."""
    return F.lit(step)


def trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast(NTZ)


def floor_minutes(ts: Column | str, minutes: int) -> Column:
    """Down to a multiple of `minutes` within the hour."""
    ts = col(ts)
    if minutes >= 60:
        return trunc("hour", ts)
    whole = F.floor(F.minute(ts) / minutes).cast("int") * minutes
    return trunc("hour", ts) + F.make_dt_interval(F.lit(0), F.lit(0), whole)


def week_start(ts: Column | str, first: str = "sunday") -> Column:
    """Start of the week; weeks begin on Sunday unless told otherwise."""
    ts = col(ts)
    if first == "monday":
        return trunc("week", ts)
    day = step_lit(timedelta(days=1))
    return trunc("week", ts + day) - day


def season_start(ts: Column | str, compat: bool = False) -> Column:
    """First day of the season (Dec, Mar, Jun, Sep).

    `compat` gives the quarter start of the season month within the *same*
    calendar year, the label older consumers still expect.
    """
    ts = col(ts)
    if not compat:
        shifted = F.date_trunc("quarter", F.add_months(ts, 1))
        return F.add_months(shifted, -1).cast(NTZ)
    month = F.month(ts)
    first = (
        F.when((month == 12) | (month <= 2), 10).when(month <= 5, 1).when(month <= 8, 4).otherwise(7)
    )
    return F.make_date(F.year(ts), first, F.lit(1)).cast(NTZ)


def fy_start(ts: Column | str) -> Column:
    """Label of the July-to-June year: 1 January of the year it ends in."""
    return trunc("year", F.add_months(col(ts), 6))


def season_name(ts: Column | str) -> Column:
    return lookup(F.month(col(ts)), SEASONS)


def bucket(ts: Column | str, interval: str, compat: bool = False) -> Column:
    """Start of the bucket `ts` falls into."""
    ts = col(ts)
    if interval in ("5m", "15m", "30m"):
        return floor_minutes(ts, int(interval[:-1]))
    if interval == "1h":
        return trunc("hour", ts)
    if interval == "1d":
        return trunc("day", ts)
    if interval == "7d":
        return week_start(ts)
    if interval == "1M":
        return trunc("month", ts)
    if interval == "3M":
        return trunc("quarter", ts)
    if interval == "season":
        return season_start(ts, compat)
    if interval == "1y":
        return trunc("year", ts)
    if interval == "fy":
        return fy_start(ts)
    raise ValueError(f"unknown bucket {interval!r}, use one of {INTERVALS}")


def step_expr(interval: str) -> Column:
    """Distance to the next bucket as an interval expression."""
    if interval in FIXED_STEP:
        return step_lit(FIXED_STEP[interval])
    return F.make_ym_interval(F.lit(0), F.lit(CALENDAR_MONTHS[interval]))


def date_series(start: Column | str, end: Column | str, interval: str) -> Column:
    """Every bucket start from `start` to `end` as an array."""
    return F.sequence(col(start), col(end), step_expr(interval))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a naive timestamp, whatever the session zone."""
    ts = col(ts)
    day = F.unix_date(F.to_date(ts)).cast("long") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def to_market_time(ts: Column | str, offset_minutes: int, market_offset_minutes: int = 600) -> Column:
    """Naive local time of a network moved into market time."""
    return col(ts) + step_lit(timedelta(minutes=market_offset_minutes - offset_minutes))


# --- driver-side date arithmetic on a given clock -------------------------------


def _floor_dt(dt: datetime, minutes: int) -> datetime:
    return dt.replace(minute=dt.minute - dt.minute % minutes, second=0, microsecond=0)


def _month_shift(dt: datetime, months: int) -> datetime:
    index = dt.year * 12 + dt.month - 1 + months
    return dt.replace(year=index // 12, month=index % 12 + 1, day=1)


def snap_window(start: datetime, end: datetime, minutes: int = 30) -> tuple[datetime, datetime]:
    """Both ends moved down onto the grid, so interpolation finds anchors."""
    return _floor_dt(start, minutes), _floor_dt(end, minutes)


def period_bounds(at: datetime, period: str, interval_minutes: int = 5) -> tuple[datetime, datetime]:
    """Start and end of the period a check at `at` looks at.

    Calendar periods look back at what just closed; an interval and a rolling
    week open at `at`.
    """
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    month = day.replace(day=1)
    if period == "interval":
        return at, at + timedelta(minutes=interval_minutes)
    if period == "7d":
        return at, at + timedelta(days=7)
    ends = {
        "day": day,
        "month": month,
        "quarter": month,
        "season": month,
        "year": month.replace(month=1),
        "financial_year": month.replace(month=7),
    }
    if period not in ends:
        raise ValueError(f"unknown period {period!r}")
    end = ends[period]
    if period == "day":
        return end - timedelta(days=1), end
    months = {"month": 1, "quarter": 3, "season": 3, "year": 12, "financial_year": 12}[period]
    return _month_shift(end, -months), end


# Months a calendar period may close at.
PERIOD_CLOSE_MONTHS = {
    "month": tuple(range(1, 13)),
    "quarter": (1, 4, 7, 10),
    "season": (3, 6, 9, 12),
    "year": (1,),
    "financial_year": (7,),
}


def is_period_end(at: datetime, period: str) -> bool:
    """Whether `at` is exactly where a period closes."""
    if period == "interval":
        return True
    midnight = (at.hour, at.minute, at.second) == (0, 0, 0)
    if period in ("day", "7d"):
        return midnight
    return midnight and at.day == 1 and at.month in PERIOD_CLOSE_MONTHS[period]


def last_complete(now_utc: datetime, network: str, unit: str = "interval") -> datetime:
    """Where the last finished interval or day of a network ends, in its own time."""
    net = NETWORKS[network]
    local = now_utc + timedelta(minutes=net.offset_minutes)
    if unit == "day":
        return local.replace(hour=0, minute=0, second=0, microsecond=0)
    return _floor_dt(local, net.interval_minutes)


# How far back a named period reaches.
PERIOD_DAYS = {"1d": 1, "3d": 3, "7d": 7, "14d": 14, "30d": 30, "1M": 30, "3M": 90, "1Y": 365}


SECOND = timedelta(seconds=1)


def _on_grid(at: datetime, interval: str) -> datetime:
    """A time without seconds, on the half hour for half-hourly series."""
    return _floor_dt(at.replace(second=0, microsecond=0), 30 if interval == "30m" else 1)


def _whole_range(first: datetime, last: datetime, interval: str) -> tuple[datetime, datetime]:
    """All of the data: from the day, or for monthly series the month, it begins with; monthly series end with a whole month."""
    if interval == "1M":
        return datetime(first.year, first.month, 1), datetime(last.year, last.month, 1) - SECOND
    return datetime(first.year, first.month, first.day), _on_grid(last, interval)


def _year_range(year: int, last: datetime, today: datetime) -> tuple[datetime, datetime]:
    """A calendar year; the current one ends with the last day before the newest data."""
    if year > last.year:
        raise ValueError("year lies after the data")
    after = datetime(year, last.month, last.day) if year == today.year else datetime(year + 1, 1, 1)
    return datetime(year, 1, 1), after - SECOND


def _month_range(month: datetime) -> tuple[datetime, datetime]:
    begin = datetime(month.year, month.month, 1)
    return begin, _month_shift(begin, 1) - SECOND


def resolve_range(
    first: datetime,
    last: datetime,
    interval: str,
    period: str | None = None,
    year: int | None = None,
    month: datetime | None = None,
    forecast: bool = False,
    now: datetime | None = None,
) -> tuple[datetime, datetime]:
    """Start and end of a series request on a given clock.

    `first` and `last` bound the data; a period reaches back from `last`,
    "all" starts at `first`, a year or month is a calendar window, and a
    forecast runs seven days on from `last`. A forecast goes before a month,
    a month before all, all before a year, and a year before any other period.
    """
    newest = _on_grid(last, interval)
    if forecast:
        return newest, newest + timedelta(days=7)
    if month is not None:
        return _month_range(month)
    if period == "all":
        return _whole_range(first, last, interval)
    if year is not None:
        return _year_range(year, last, now or last)
    if period is not None:
        return _on_grid(last - timedelta(days=PERIOD_DAYS[period]), interval), newest
    return _on_grid(first, interval), newest


def check_range(interval: str, start: datetime, end: datetime) -> None:
    """Refuse a request that spans more than its bucket size allows."""
    if start.tzinfo or end.tzinfo:
        raise ValueError("dates are naive, in network time")
    limit = RANGE_LIMIT_DAYS.get(interval)
    if limit is not None and (end - start).days > limit:
        raise ValueError(f"at most {limit} days for interval {interval}")


def check_span(interval: str, first: Column, last: Column) -> Column:
    """`last`, or an error for a series that spans more than its bucket size allows."""
    limit = RANGE_LIMIT_DAYS.get(interval)
    if limit is None:
        return last
    message = F.concat(F.lit(f"at most {limit} days for interval {interval}, asked for "), first.cast("string"), F.lit(" to "), last.cast("string"))
    return F.when(F.datediff(last, first) > limit, F.raise_error(message).cast(NTZ)).otherwise(last)


def default_range(interval: str, now: datetime) -> tuple[datetime, datetime]:
    """Half the allowed span, ending at the clock."""
    return now - timedelta(days=RANGE_LIMIT_DAYS[interval] / 2), now


def guard_intervals(start: datetime, end: datetime, step: timedelta, limit: int = 1000) -> None:
    """Refuse a window of more than `limit` steps."""
    if (end - start) / step > limit:
        raise ValueError(f"more than {limit} intervals requested")
