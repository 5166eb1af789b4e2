"""Electricity-market analytics as composable Spark DataFrame operators."""

from wattframe.session import build_session

__all__ = ["build_session"]
