"""Small frames and time shorthands for tests."""

from datetime import datetime, timedelta


def at(minutes, day=datetime(2024, 1, 1)):
    return day + timedelta(minutes=minutes)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if not order else sorted(out, key=lambda r: tuple(r[df.columns.index(o)] for o in order))
