"""Cleaning of codes, numbers, text and timestamps, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe.functions.timebucket import NTZ, col

# Layouts tried after ISO, in this order. `parse_ts` squeezes
# runs of blanks first.
TS_LAYOUTS = (
    "yyyy/MM/dd,HH:mm:ss",
    "yyyyMMdd",
    "d/M/yy H:mm",
    "yyyy/M/d H:mm:ss",
    "d/M/yyyy h:mm:ss a",
    "yyyyMMddHHmmss",
)
# ISO forms, dashes or slashes.
ISO_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
)
# Day-first layouts for anything left.
DAY_FIRST_LAYOUTS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy")


def squeeze(c: Column | str) -> Column:
    """Trim, and runs of blanks become one."""
    return F.regexp_replace(F.trim(col(c)), r"\s{2,}", " ")


def strip_blanks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", "")


def title(c: Column | str) -> Column:
    return F.initcap(F.trim(col(c)))


def camel(c: Column | str) -> Column:
    """snake_case to CamelCase."""
    parts = F.split(col(c), "_")
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))))


def clean_float(c: Column | str) -> Column:
    """Number from text; blank and unreadable become NULL."""
    return F.trim(col(c).cast("string")).try_cast("double")


def clean_code(c: Column | str) -> Column:
    """Unit code in its canonical form; blank is NULL, a lone dash is ''."""
    c = col(c)
    ascii_only = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    plain = F.upper(F.trim(F.regexp_replace(ascii_only, r"_[xX][0-9A-F]{4}_", "")))
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(plain == "-", F.lit("")).otherwise(plain)


def clean_capacity(c: Column | str, digits: int = 6) -> Column:
    """Capacity from spreadsheet text; of a range the last figure counts."""
    text = strip_blanks(col(c).cast("string"))
    # A leading sign is no range separator.
    split = F.when(F.instr(text, "-") > 1, F.element_at(F.split(text, "-"), -1)).otherwise(text)
    split = F.when(F.instr(split, "/") > 1, F.element_at(F.split(split, "/"), -1)).otherwise(split)
    return F.round(F.replace(split, F.lit(","), F.lit(".")).try_cast("double"), digits)


def bool_label(c: Column | str) -> Column:
    """Text that spells a boolean becomes one, other text is left out."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


def parse_ts(c: Column | str) -> Column:
    """Naive timestamp from the layouts seen in the feeds, day first."""
    text = squeeze(c)
    dashed = F.replace(text, F.lit("/"), F.lit("-"))
    tries = [F.try_to_timestamp(dashed, F.lit(f)) for f in ISO_LAYOUTS]
    # The twelve-hour marker is upper case in Java patterns.
    upper = F.upper(text)
    tries += [F.try_to_timestamp(upper, F.lit(f)) for f in (*TS_LAYOUTS, *DAY_FIRST_LAYOUTS)]
    return F.coalesce(*tries).cast(NTZ)


def sigfig(c: Column | str, digits: int = 4) -> Column:
    """Significant-figure compaction: large values lose their fraction."""
    c = col(c).cast("double")
    size = F.abs(c)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.nullif(size, F.lit(0.0)))))
    short = F.when(size >= 10**digits, F.floor(size).cast("double")).otherwise(F.bround(size * scale, 0) / scale)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * short)


# Powers of 1024 by letter.
SIZE_LETTERS = "BKMGTPEZY"


def parse_size(c: Column | str) -> Column:
    """'203K' or '1.5M' as a byte count; a bare number is itself."""
    text = F.trim(col(c))
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")
    letter = F.upper(F.regexp_extract(text, r"([A-Za-z])$", 1))
    factor = F.lit(None).cast("double")
    for power, name in enumerate(SIZE_LETTERS):
        factor = F.when(letter == name, F.lit(float(1024**power))).otherwise(factor)
    return F.floor(number * F.when(letter == "", F.lit(1.0)).otherwise(factor))


# Minutes per unit of a human interval.
INTERVAL_MINUTES = {"m": 1, "h": 60, "d": 1440, "w": 10080, "M": 43200, "q": 129600, "Y": 525600, "y": 525600}


def parse_interval(c: Column | str) -> Column:
    """'5m', '1h' or '7d' as minutes."""
    c = col(c)
    count = F.regexp_extract(c, r"^(\d+)", 1).try_cast("long")
    unit = F.regexp_extract(c, r"^\d+([A-Za-z])$", 1)
    factor = F.lit(None).cast("long")
    for name, minutes in INTERVAL_MINUTES.items():
        factor = F.when(unit == name, F.lit(minutes)).otherwise(factor)
    return count * factor


# Energy and power scales.
SCALES = {"kW": 1e3, "MW": 1e6, "GW": 1e9, "TW": 1e12, "kWh": 1e3, "MWh": 1e6, "GWh": 1e9, "TWh": 1e12}


def convert(c: Column | str, source: str, target: str, intervals_per_hour: float = 12) -> Column:
    """Between units; power and energy convert over one interval."""
    value = col(c) * (SCALES[source] / SCALES[target])
    if source.endswith("h") and not target.endswith("h"):
        return value * intervals_per_hour
    if target.endswith("h") and not source.endswith("h"):
        return value / intervals_per_hour
    return value


def series_key(labels: Sequence[Column | str]) -> Column:
    """Label parts joined by a pipe, absent ones skipped; 'total' for none."""
    if not labels:
        return F.lit("total")
    return F.concat_ws("|", *[col(c).cast("string") for c in labels])
