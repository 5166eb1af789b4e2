"""Pieces of SQL shared by the twins."""

from __future__ import annotations


def exact(expr: str, digits: int) -> str:
    """Round half up on the printed value, as Spark rounds doubles."""
    return f"round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 24)), {digits})::DOUBLE"


def r2(expr: str) -> str:
    return exact(expr, 2)


def r4(expr: str) -> str:
    return exact(expr, 4)


def r6(expr: str) -> str:
    return exact(expr, 6)


def line(col: str, keys: str, ts: str = "interval") -> str:
    """Straight line through present values within a window of keys by time."""
    part = f"PARTITION BY {keys} ORDER BY {ts}" if keys else f"ORDER BY {ts}"
    point = f"CASE WHEN {col} IS NOT NULL THEN {{'t': {ts}, 'v': {col}}} END"
    prev = f"last_value({point} IGNORE NULLS) OVER ({part})"
    nxt = f"first_value({point} IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (
        f"coalesce({col}, ({prev}).v + (({nxt}).v - ({prev}).v) * (epoch({ts}) - epoch(({prev}).t))"
        f" / nullif(epoch(({nxt}).t) - epoch(({prev}).t), 0))"
    )
