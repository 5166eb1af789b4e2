"""Market reports: many tables in one comma-separated file.

`C` rows are comments, an `I` row opens a table (namespace, name, version,
fields...) and the `D` rows below it are its records.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.clean import clean_code
from wattframe.functions.timebucket import NTZ, col
from wattframe.operators.ordered import last_known
from wattframe.session import saved

# Fields holding unit codes.
CODE_FIELDS = ("duid",)
# The two file-name schemes and the date layouts in them.
NAME_PATTERN = r"([a-zA-Z_]+)_(\d{6,14})_?(\d{8,16})?\.(zip|csv)"
ARCHIVE_PATTERN = r"([a-zA-Z0-9_#%]+?)(?:#|%23)(\d{8,14})(?:_(\d{8,16}))?\.(zip|csv)"
NAME_DATES = ("yyyyMMdd", "yyyyMMddHHmm", "yyyyMMddHHmmss")

LINE_SCHEMA = "file string, block long, row long, line string"
_MEMBER_SCHEMA = "file string, zipped boolean, method int, crc long, content binary"
_BLOCK_ROWS = 100_000
_STEP = 1 << 16
_SPLIT_BYTES = 1 << 24


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, offset of the split, row in it.

    A file larger than a split is read by several tasks; the offset keeps its
    parts in order.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the reports inside zip files, also of zips within zips."""
    return unzip_lines(spark.read.format("binaryFile").load(path))


def unzip_lines(files: DataFrame, levels: int = 2) -> DataFrame:
    """Lines of the reports in a frame of zip files (path, content).

    An archive's directory gives a row for each member, still compressed, and members are dealt to tasks, so one
    large archive is inflated by many; so are the members of archives inside it, down to `levels`. Deeper ones are
    opened by the task of the archive that holds them. A member is inflated in steps, never whole, and checked
    against its checksum. An archive itself is one binary value, which Spark limits to 2 GB. A null content is skipped.
    """
    members = files.filter(F.col("content").isNotNull()).select(
        F.col("path").alias("file"),
        F.lit(True).alias("zipped"),
        F.lit(zipfile.ZIP_STORED).alias("method"),
        F.lit(None).cast("long").alias("crc"),
        F.col("content"),
    )
    for _ in range(levels):
        members = members.mapInPandas(_split, _MEMBER_SCHEMA).repartition("file")
    return members.mapInPandas(_unzip, LINE_SCHEMA)


class _Inflated(io.RawIOBase):
    """The bytes of a stored or deflated member, inflated as they are read."""

    def __init__(self, content: bytes, method: int, crc: int | None):
        self._left, self._crc, self._seen = memoryview(content), crc, 0
        self._zip = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None

    def readable(self) -> bool:
        return True

    def _step(self, n: int) -> bytes:
        if self._zip is None:
            out, self._left = bytes(self._left[:n]), self._left[n:]
            return out
        while not self._zip.eof:
            # What a step did not use comes first in the next one.
            waiting = self._zip.unconsumed_tail
            if not waiting:
                waiting, self._left = bytes(self._left[:_STEP]), self._left[_STEP:]
                if not waiting:
                    raise zipfile.BadZipFile("a member ends before its data does")
            out = self._zip.decompress(waiting, n)
            if out:
                return out
        return b""

    def readinto(self, buffer) -> int:
        out = self._step(len(buffer))
        if out:
            self._seen = zlib.crc32(out, self._seen)
            buffer[: len(out)] = out
        elif self._crc is not None and self._seen != self._crc:
            raise zipfile.BadZipFile("a member differs from its checksum")
        return len(out)


def _members(name: str, content: bytes) -> Iterator[tuple[str, bool, int, int | None, bytes]]:
    """Members of an archive that are reports or archives, as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            zipped = info.filename.lower().endswith(".zip")
            if not zipped and not info.filename.lower().endswith(".csv"):
                continue
            inner, plain = f"{name}!{info.filename}", info.flag_bits & 1 == 0
            if plain and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                # The local header repeats the name and may have other extra fields than the directory.
                names, extra = struct.unpack_from("<HH", content, info.header_offset + 26)
                first = info.header_offset + 30 + names + extra
                yield inner, zipped, info.compress_type, info.CRC, content[first : first + info.compress_size]
            else:
                yield inner, zipped, zipfile.ZIP_STORED, None, archive.read(info)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of archives; reports as they are."""
    for pdf in batches:
        rows, size = [], 0
        for name, zipped, method, crc, content in pdf.itertuples(index=False):
            crc = None if pd.isna(crc) else int(crc)
            inner = _members(name, _Inflated(content, method, crc).readall()) if zipped else [(name, zipped, method, crc, content)]
            for row in inner:
                rows.append(row)
                size += len(row[-1])
                if size > _SPLIT_BYTES:
                    yield _member_frame(rows)
                    rows, size = [], 0
        if rows:
            yield _member_frame(rows)


def _member_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", "zipped", "method", "crc", "content"])
    return out.astype({"crc": "Int64"})


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of each member, streamed out in bounded batches."""
    for pdf in batches:
        while len(pdf):
            for name, zipped, method, crc, content in pdf.itertuples(index=False):
                if not zipped:
                    yield from _member_lines(name, _Inflated(content, method, None if pd.isna(crc) else int(crc)))
            deeper = pdf[pdf["zipped"].astype(bool)]
            pdf = pd.concat(list(_split([deeper])) or [deeper.iloc[:0]])


def _member_lines(name: str, stream: io.RawIOBase) -> Iterator[pd.DataFrame]:
    lines, first = [], 0
    for number, line in enumerate(io.TextIOWrapper(io.BufferedReader(stream, _STEP), encoding="utf-8", errors="replace")):
        lines.append(line.rstrip("\r\n"))
        if len(lines) == _BLOCK_ROWS:
            yield _frame(name, first, lines)
            lines, first = [], number + 1
    if lines:
        yield _frame(name, first, lines)


def _frame(name: str, first: int, lines: list[str]) -> pd.DataFrame:
    rows = range(first, first + len(lines))
    return pd.DataFrame({"file": name, "block": first // _BLOCK_ROWS, "row": rows, "line": lines})


# A cell with the comma before it: quoted, or up to the next comma.
_CELL = r'(?:^|,)(?:"(?:[^"]|"")*"|[^,]*)'


def split_csv(line: Column) -> Column:
    """Cells of a comma-separated line; commas inside quotes do not count."""

    def plain(cell: Column) -> Column:
        text = F.regexp_replace(cell, "^,", "")
        inner = F.replace(F.substr(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
        return F.when(text.startswith('"'), inner).otherwise(text)

    quoted = F.transform(F.regexp_extract_all(line, F.lit(_CELL), F.lit(0)), plain)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def parse_report(lines: DataFrame, namespaces: Sequence[str] | None = None) -> DataFrame:
    """Records of all tables: file, place, table, fields and values.

    Each record belongs to the last table opened above it, which is found
    without pulling a file into one task. Records before any table, with the
    wrong number of values, or of other namespaces are skipped.
    """
    place = ["file", "block", "row"]
    line = F.col("line")
    # The kind is read off the first cell; only table headers are split here,
    # records not before their table is known.
    kind = F.upper(F.trim(F.replace(F.substring_index(line, ",", 1), F.lit('"'), F.lit(""))))
    rows = lines.select(*place, "line", kind.alias("_kind")).filter(F.col("_kind").isin("I", "D"))
    cells = split_csv(line)
    header = F.struct(
        F.lower(F.trim(F.get(cells, F.lit(1)))).alias("namespace"),
        F.lower(F.trim(F.get(cells, F.lit(2)))).alias("name"),
        F.transform(_from_fifth(cells), lambda c: F.lower(c)).alias("fields"),
    )
    opened = rows.withColumn("_header", F.when(F.col("_kind") == "I", header))
    known = last_known(opened, ["file"], "row", ["_header"], chunk=F.col("block"))
    h = F.col("_header")
    records = known.filter((F.col("_kind") == "D") & h.isNotNull())
    if namespaces:
        records = records.filter(h["namespace"].isin(*[n.lower() for n in namespaces]))
    valued = records.select(
        *place,
        F.concat_ws("_", h["namespace"], h["name"]).alias("table"),
        h["fields"].alias("fields"),
        _from_fifth(split_csv(line)).alias("values"),
    )
    return valued.filter(F.size("values") == F.size("fields"))


def _from_fifth(cells: Column) -> Column:
    return F.slice(cells, 5, F.greatest(F.size(cells), F.lit(1)))


def report_table(records: DataFrame, name: str, fields: Sequence[str], keep: Sequence[str] = ("file", "block", "row")) -> DataFrame:
    """One table of known layout; unit codes are cleaned."""
    rows = records.filter((F.col("table") == name) & (F.col("fields") == F.array(*[F.lit(f) for f in fields])))

    def cell(i: int, f: str) -> Column:
        value = F.col("values")[i]
        return (clean_code(value) if f in CODE_FIELDS else value).alias(f)

    return rows.select(*keep, *[cell(i, f) for i, f in enumerate(fields)])


def table_layouts(records: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """The distinct tables and field lists of a set of reports.

    The only thing brought to the driver: one row per layout, however many
    files and records there are.
    """
    found = records.select("table", "fields").distinct().collect()
    return sorted((r["table"], tuple(r["fields"])) for r in found)


def report_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Every table found; layouts of one table are put together by field name.

    Reports are parsed once: records go to the shared folder, a partition for each table, and each table reads its own.
    """
    records = saved(records, "reports", "table")
    out: dict[str, DataFrame] = {}
    for name, fields in table_layouts(records):
        part = report_table(records, name, fields)
        out[name] = out[name].unionByName(part, allowMissingColumns=True) if name in out else part
    return out


def read_multi_table(spark: SparkSession, path: str, namespaces: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the plain report files under a path."""
    return report_tables(parse_report(read_lines(spark, path), namespaces))


def read_zip(spark: SparkSession, path: str, namespaces: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the zipped report files under a path."""
    return report_tables(parse_report(read_zip_lines(spark, path), namespaces))


def parse_report_filename(name: Column | str) -> Column:
    """Struct of file name, date and interval from either naming scheme."""
    c = F.trim(col(name))

    def group(i: int) -> Column:
        first = F.regexp_extract(c, NAME_PATTERN, i)
        second = F.regexp_extract(c, ARCHIVE_PATTERN, i)
        return F.nullif(F.when(c.rlike(NAME_PATTERN), first).otherwise(second), F.lit(""))

    stamp = group(2)
    # Each layout fits texts of its own length only.
    dates = [F.when(F.length(stamp) == len(f), F.try_to_timestamp(stamp, F.lit(f))) for f in NAME_DATES]
    return F.struct(group(1).alias("filename"), F.coalesce(*dates).cast(NTZ).alias("date"), group(3).alias("interval"))
