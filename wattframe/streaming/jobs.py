"""The five-minute jobs as Structured Streaming queries.

Facts live in Parquet tables partitioned by day. A batch merges its rows into
the days it touches and recomputes what hangs on them, always whole days, so a
batch that is run again leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from wattframe.operators.enrich import market_summary, trapezoid_energy, unit_intervals
from wattframe.operators.records import instance_id
from wattframe.operators.versioning import dedupe_last, upsert
from wattframe.streaming.state import FeedWatch, RecordDays, keyed_state

DAY = "yyyymmdd"


def stream_reports(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Lines of report files as they arrive; number each batch with `number_lines`."""
    reader = spark.readStream.format("text")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def number_lines(batch: DataFrame) -> DataFrame:
    """A batch of lines in the layout of `read_lines`."""
    return batch.select("file", "block", F.monotonically_increasing_id().alias("row"), "line")


def stream_table(spark: SparkSession, path: str, schema: StructType | str, per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _run(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 minutes"})).start()


# --- day-partitioned tables -----------------------------------------------------------------


def _tagged(df: DataFrame, ts: str) -> DataFrame:
    """`df` with the day of each row, if it isn't told yet."""
    if DAY in df.columns:
        return df
    return df.withColumn(DAY, F.year(ts) * 10_000 + F.month(ts) * 100 + F.dayofmonth(ts))


def read_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A day-partitioned table; an absent one is empty."""
    full = StructType([*[f for f in schema.fields if f.name != DAY], StructField(DAY, IntegerType())])
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_dealt_days(df: DataFrame, path: str) -> None:
    """`write_days` of rows that are dealt already so that a task has few days: they are neither shuffled nor sorted.

    A task has a file open for each of its days; one of more days than that sorts the rest.
    """
    conf = df.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, 64)
    try:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    finally:
        conf.set(WRITERS, before)


def write_days(df: DataFrame, path: str, ts: str) -> None:
    """Replaces exactly the days present in `df`."""
    tagged = _tagged(df, ts)
    # Rows of a day go together, and Spark splits a heavy day by its measured size.
    tagged.hint("rebalance", F.col(DAY)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(DAY).parquet(path)


def merge_days(batch: DataFrame, path: str, keys: Sequence[str], ts: str, columns: Sequence[str], mode: str = "replace") -> None:
    """Merges a batch into the days it touches; other days are not read.

    The touched days meet the table in a semi-join on the partition column,
    which prunes its files at run time.
    """
    spark = batch.sparkSession
    new = _tagged(batch, ts)
    days = new.select(DAY).distinct()
    stored = read_days(spark, path, StructType(batch.schema.fields)).join(F.broadcast(days), DAY, "left_semi")
    merged = upsert(stored, new, [*keys, DAY], columns, mode=mode)
    write_days(merged, path, ts)


def touched_days(batch: DataFrame, store: str, ts: str = "interval") -> set[date]:
    """The days to recompute: those a batch touches, and the day after each if the store has it.

    The first rows of a day are paired with or filled from the last ones of the day before. Only distinct days come to
    the driver, a number the calendar bounds, so one late row recomputes a day or two whatever lies between.
    """
    own = batch_days(batch, ts)
    return own | days_after(own, batch.sparkSession, store, StructType(batch.schema.fields))


def batch_days(batch: DataFrame, ts: str = "interval") -> set[date]:
    """The days a batch has rows of."""
    return {r[0] for r in batch.select(F.to_date(ts)).distinct().collect() if r[0] is not None}


def days_after(days: set[date], spark: SparkSession, store: str, schema: StructType) -> set[date]:
    """The days after these that a store holds rows of."""
    after = {d + timedelta(days=1) for d in days} - days
    if not after:
        return set()
    wanted = [int(d.strftime("%Y%m%d")) for d in after]
    known = read_days(spark, store, schema)
    there = {r[0] for r in known.filter(F.col(DAY).isin(wanted)).select(DAY).distinct().collect()}
    return {d for d in after if int(d.strftime("%Y%m%d")) in there}


def day_number(day: date) -> int:
    return day.year * 10_000 + day.month * 100 + day.day


def of_days(df: DataFrame, days: set[date], before: int = 0) -> DataFrame:
    """The rows of these days of a day-partitioned table, and of so many days before each; other files aren't read."""
    wanted = {d - timedelta(days=n) for d in days for n in range(before + 1)}
    return df.filter(F.col(DAY).isin(sorted(map(day_number, wanted))))


def span(days: set[date]) -> tuple[datetime, datetime]:
    """From the first of the days to the end of the last."""
    first, last = (datetime.combine(d, datetime.min.time()) for d in (min(days), max(days)))
    return first, last + timedelta(days=1)


def recompute(batch: DataFrame, store: str, sink: str, keys: Sequence[str], fact: Callable[[DataFrame, datetime, datetime], DataFrame], ts: str = "interval", dealt: bool = False) -> None:
    """Merge a batch into the store and rewrite the touched days of the sink from it.

    `fact` gets the stored rows of the touched days and the day before each, and the ends of the whole span; its rows on
    other days are left out. All days are recomputed in one job, however they lie. The batch is read once from
    its source, however many steps follow. With `dealt` the tasks of `fact` have few days each and write them as they are.
    """
    batch = batch.persist()
    try:
        if batch.isEmpty():
            return
        merge_days(batch, store, keys, ts, [c for c in batch.columns if c not in keys])
        days = touched_days(batch, store, ts)
        window = of_days(read_days(batch.sparkSession, store, StructType(batch.schema.fields)), days, 1).drop(DAY)
        rows = of_days(_tagged(fact(window, *span(days)), ts), days)
        write_dealt_days(rows, sink) if dealt else write_days(rows, sink, ts)
    finally:
        batch.unpersist()


# --- ingest -----------------------------------------------------------------------------------


def _known_days(batch: DataFrame, path: str, schema: StructType, ts: str) -> DataFrame:
    """The stored rows of the days a batch has rows of, and those without a day."""
    days = [int(d.strftime("%Y%m%d")) for d in batch_days(batch, ts)]
    return read_days(batch.sparkSession, path, schema).filter(F.col(DAY).isin(days) | F.col(DAY).isNull())


ARRIVED = "arrived"


def start_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, sink: str, checkpoint: str, order: Sequence[str] = (), trigger: dict | None = None) -> StreamingQuery:
    """Duplicate-tolerant append: the row of a key that arrived first wins, however late the next one comes.

    The order of arrival is the batch, then the columns `order` (those of the source that tell it, an offset or a
    sequence number), then the rest of the row, and is kept with each key as `arrived`. So the winner depends neither on
    the layout of a batch nor on how often it is run. The key holds the time, by which rows are merged by day.
    """
    if ts not in keys:
        raise ValueError(f"the key must hold {ts}: rows are merged by day")

    def work(batch: DataFrame, number: int) -> None:
        own = [*order, *[c for c in batch.columns if c not in (*keys, *order)]]
        arrived = F.struct(F.lit(number).cast("long").alias("batch"), *[F.col(c) for c in own])
        new = batch.select("*", arrived.alias(ARRIVED)).groupBy(*keys)
        new = new.agg(F.min_by(F.struct(*own, ARRIVED) if own else F.struct(ARRIVED), ARRIVED).alias("row"))
        new = _tagged(new.select(*keys, "row.*").select(*batch.columns, ARRIVED), ts).persist()
        try:
            schema = StructType([f for f in new.schema.fields if f.name != DAY])
            known = _known_days(new, sink, schema, ts).filter(F.col(f"{ARRIVED}.batch") != number)
            first = known.unionByName(new).groupBy(*keys, DAY).agg(F.min_by(F.struct(*own, ARRIVED), ARRIVED).alias("row"))
            write_days(first.select(*keys, DAY, "row.*"), sink, ts)
        finally:
            new.unpersist()

    return _run(stream, work, checkpoint, trigger)


def start_upsert(stream: DataFrame, keys: Sequence[str], order: str, ts: str, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keyed ingest where the last row wins, within a batch and across batches."""
    columns = [c for c in stream.columns if c not in keys]

    def work(batch: DataFrame, _: int) -> None:
        merge_days(dedupe_last(batch, keys, order), sink, keys, ts, columns)

    return _run(stream, work, checkpoint, trigger)


# --- facts --------------------------------------------------------------------------------------


Fact = Callable[[DataFrame, DataFrame, datetime, datetime, int], DataFrame]


def _last_prices(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last priced row of each day and region in the layout of `rows`, all but keys and price null; null where a day has no price."""
    price = F.when(F.col("price").isNotNull(), F.struct("interval", "price"))
    last = rows.groupBy(DAY, *by).agg(F.max_by(price, F.when(price.isNotNull(), F.col("interval"))).alias("last"), F.min("interval").alias("first"))
    here = {"interval": F.coalesce("last.interval", "first"), "price": F.col("last.price"), **{k: F.col(k) for k in by}}
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*here, DAY)]
    return last.select(*[c.alias(n) for n, c in here.items()], *others, DAY)


def _healed_days(changed: set[date], prices: DataFrame, by: Sequence[str], stored: DataFrame) -> set[date]:
    """The stored days that prices of these days are carried into: up to the day of the region's next price, or all later ones.

    Read from the table of last prices and the list of stored days alone.
    """
    spark = prices.sparkSession
    days = spark.createDataFrame([(day_number(d),) for d in changed], "changed int")
    there = prices.select(F.col(DAY).alias("changed"), *by).join(F.broadcast(days), "changed", "left_semi")
    next_price = F.min(F.when(F.col("price").isNotNull() & (F.col(DAY) > F.col("changed")), F.col(DAY))).alias("until")
    until = there.join(prices.select(*by, DAY, "price"), list(by)).groupBy("changed", *by).agg(next_price)
    until = until.groupBy("changed").agg(F.max(F.coalesce("until", F.lit(99_999_999))).alias("until"))
    carried = stored.select(DAY).distinct().join(F.broadcast(until), F.col(DAY).between(F.col("changed"), F.col("until")))
    return {datetime.strptime(str(r[0]), "%Y%m%d").date() for r in carried.select(DAY).distinct().collect()}


def start_facts_of_both(telemetry: DataFrame, market: DataFrame, market_keys: Sequence[str], fact: Fact, store: str, market_store: str, sink: str, checkpoint: str, trigger: dict | None = None, dealt: bool = False) -> StreamingQuery:
    """Keeps a fact up to date with arriving telemetry (one row per event_id) and market rows alike.

    Both sources run in one query, so no two writers meet in a day: a batch merges its telemetry and its market
    rows into their stores and recomputes in one job the days either touches. `<market_store>-last` holds the last
    price of each region and day and is rewritten for the days that change. By it a late price also mends the days it is
    carried into, through a gap of any length up to the region's next price; and `fact` gets, instead of
    all history, the market rows of the days in hand and the last prices of all others, beside the stored
    telemetry of those days and the day before each, the ends of their span and the number of the batch. `dealt` as in
    `recompute`.
    """
    both = telemetry.select(F.struct("*").alias("reading"), F.lit(None).cast(market.schema).alias("published"))
    both = both.unionByName(market.select(F.lit(None).cast(telemetry.schema).alias("reading"), F.struct("*").alias("published")))
    keys = ["event_id", "interval"]
    by = [k for k in market_keys if k != "interval"]
    last_store = f"{market_store}-last"

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            readings = batch.filter(F.col("reading").isNotNull()).select("reading.*")
            published = batch.filter(F.col("published").isNotNull()).select("published.*")
            days = set()
            if not readings.isEmpty():
                merge_days(readings, store, keys, "interval", [c for c in readings.columns if c not in keys])
                days |= batch_days(readings)
            days |= days_after(days, spark, store, telemetry.schema)
            if not published.isEmpty():
                merge_days(published, market_store, list(market_keys), "interval", [c for c in published.columns if c not in market_keys])
                changed = batch_days(published)
                write_days(_last_prices(of_days(read_days(spark, market_store, market.schema), changed), by), last_store, "interval")
                days |= changed | days_after(changed, spark, store, telemetry.schema)
                last = read_days(spark, last_store, market.schema)
                days |= _healed_days(changed, last, by, read_days(spark, store, telemetry.schema))
            if not days:
                return
            first, end = span(days)
            window = of_days(read_days(spark, store, telemetry.schema), days, 1).drop(DAY)
            near = of_days(read_days(spark, market_store, market.schema), days, 1)
            last = read_days(spark, last_store, market.schema).filter(F.col(DAY) <= day_number(max(days)))
            here = sorted({day_number(d - timedelta(days=n)) for d in days for n in (0, 1)})
            known = near.unionByName(last.filter(~F.col(DAY).isin(here))).drop(DAY)
            rows = of_days(_tagged(fact(window, known, first, end, number), "interval"), days)
            write_dealt_days(rows, sink) if dealt else write_days(rows, sink, "interval")
        finally:
            batch.unpersist()

    return _run(both, work, checkpoint, trigger)


def start_unit_facts(stream: DataFrame, market: Callable[[], DataFrame], units: Callable[[], DataFrame], store: str, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the unit fact up to date with arriving telemetry.

    Telemetry rows (one per event_id) go to `store`; the days they touch are
    recomputed into `sink`, with the price that held when a day began.
    """

    def work(batch: DataFrame, number: int) -> None:
        recompute(
            batch, store, sink, ["event_id", "interval"],
            lambda rows, first, last: unit_intervals(rows, market(), units(), first, last, version=number, chunk="day", carry_in=True, day=DAY),
            dealt=True,
        )

    return _run(stream, work, checkpoint, trigger)


def start_market_facts(stream: DataFrame, market: Callable[[], DataFrame], units: Callable[[], DataFrame], store: str, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the market fact up to date with arriving telemetry."""

    def work(batch: DataFrame, number: int) -> None:
        recompute(
            batch, store, sink, ["event_id", "interval"],
            lambda rows, first, last: market_summary(rows, market(), units(), first, last, version=number, chunk="day", lookback=timedelta(days=1)),
        )

    return _run(stream, work, checkpoint, trigger)


def start_rebuild(stream: DataFrame, rollup: Callable[[DataFrame], DataFrame], keys: Sequence[str], store: str, sink: str, checkpoint: str, day: str = "date", trigger: dict | None = None) -> StreamingQuery:
    """Recomputes the daily rollup of every day that late rows touch."""
    columns = [c for c in stream.columns if c not in keys]

    def work(batch: DataFrame, _: int) -> None:
        merge_days(batch, store, keys, "interval", columns)
        days = _tagged(batch, "interval").select(DAY).distinct()
        known = read_days(batch.sparkSession, store, StructType(batch.schema.fields))
        touched = known.join(F.broadcast(days), DAY, "left_semi").drop(DAY)
        write_days(rollup(touched), sink, day)

    return _run(stream, work, checkpoint, trigger)


def start_rollup(stream: DataFrame, keys: Sequence[str], sums: Sequence[str], ts: str, store: str, sink: str, checkpoint: str, width: str = "5 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Tumbling sums of all rows so far, also of late ones and of windows still open.

    `store` keeps the sums of each batch, a row for each window it touches, and the touched days of the sink are summed
    from it. A batch that is run again replaces its own sums.
    """

    def work(batch: DataFrame, number: int) -> None:
        grouped = batch.groupBy(F.window(ts, width), *keys)
        rolled = grouped.agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("readings"))
        own = rolled.select(F.col("window.start").alias("interval"), *keys, *sums, "readings", F.lit(number).cast("long").alias("batch"))
        own = own.persist()
        try:
            schema = StructType(own.schema.fields)
            known = _known_days(own, store, schema, "interval").filter(F.col("batch") != number)
            write_days(known.unionByName(_tagged(own, "interval")), store, "interval")
            totals = _known_days(own, store, schema, "interval").groupBy("interval", *keys, DAY)
            write_days(totals.agg(*[F.sum(c).alias(c) for c in (*sums, "readings")]), sink, "interval")
        finally:
            own.unpersist()

    return _run(stream, work, checkpoint, trigger)


def start_energy(stream: DataFrame, store: str, sink: str, checkpoint: str, lookback: timedelta = timedelta(minutes=5), trigger: dict | None = None) -> StreamingQuery:
    """Trapezoidal energy of arriving readings, with the ones before them.

    `stream` has the telemetry key, power and quality flag. Days are written
    whole, and the day after a touched one too, so a reading that arrives late also mends its successor.
    """
    keys = ["interval", "network_id", "unit_code"]

    def work(batch: DataFrame, _: int) -> None:
        recompute(batch, store, sink, keys, lambda rows, first, last: trapezoid_energy(rows, first, last, lookback, chunk="day"))

    return _run(stream, work, checkpoint, trigger)


# --- records and alerts ------------------------------------------------------------------------------

RECORD_DAY = "record_id string, day int, at long, value double, turned double, gap long, stands double"
RECORD = "record_id string, interval timestamp_ntz, value double, turned double, previous_interval timestamp_ntz, kept boolean"


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The records of one id among the rows that may be, in order of time; the first may say what stood before."""
    kept, standing, at = [], -np.inf, None
    for r in rows.sort_values(["at", "known"]).itertuples(index=False):
        if r.known:
            standing, at = r.turned, r.at
        elif r.turned > standing and (at is None or r.at - at >= max(r.gap, 1)):
            kept.append((r.record_id, r.at, r.value, r.turned, at))
            standing, at = r.turned, r.at
    return pd.DataFrame(kept, columns=["record_id", "at", "value", "turned", "before"]).astype({"before": "Int64"})


def start_records(stream: DataFrame, sink: str, checkpoint: str, min_intervals: int = 10, interval_minutes: int = 5, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the records of each id, judged anew when late rows come.

    `stream` has record_id, interval, value, aggregate, period and digits, one row per id and interval; the last that
    comes counts. A record that follows the last kept one within the debounce window is dropped, and the next is
    judged by the kept one. Every record names itself (instance_id) and the one it replaced.

    The rows of an id and day are one key of state, so a batch of one id is spread by its days. A day hands on the few
    rows that can be records whatever stood before it, kept by day in `<sink>-days`. From the earliest day a batch
    touches, an id's days that can still hold a record (their best beats what must stand by then) are chained, starting
    from the record before. Records that no longer stand stay in the sink with kept = false; read the standing ones with
    `read_records`. Null and zero values are no readings.
    """
    spark, days = stream.sparkSession, f"{sink}-days"
    gap = timedelta(minutes=min_intervals * interval_minutes)
    usable = stream.filter(F.coalesce(F.col("value") != 0, F.lit(False)) & ~F.isnan("value"))
    zoned = F.col("interval").cast("timestamp")
    rows = usable.select(
        "record_id", F.date_format("interval", "yyyyMMdd").cast("int").alias("day"), F.unix_micros(zoned).alias("at"),
        F.col("value").cast("double").alias("value"), "aggregate", "period", F.col("digits").cast("int").alias("digits"),
    )
    judged = rows.groupBy("record_id", "day").transformWithStateInPandas(RecordDays(gap), RECORD_DAY, "Update", "None")
    candidates, records = (StructType.fromDDL(s) for s in (RECORD_DAY, RECORD))
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")

    def work(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn(DAY, F.col("day")).persist()
        try:
            changed = batch.select("record_id", DAY).distinct()
            touched = [r[0] for r in changed.select(DAY).distinct().collect()]
            if not touched:
                return
            stored = read_days(spark, days, candidates).filter(F.col(DAY).isin(touched))
            write_days(stored.join(changed, ["record_id", DAY], "left_anti").unionByName(batch), days, "at")
            since = changed.groupBy("record_id").agg(F.min(DAY).alias("since"))
            told = read_days(spark, sink, records)
            held = told.join(since, "record_id")
            before = held.filter(F.col("kept") & (F.col(DAY) < F.col("since"))).groupBy("record_id")
            before = before.agg(F.max_by(F.struct("interval", "value", "turned"), "interval").alias("b"))
            # Rows from there on, of days whose best beats what stood at the end of some day before it.
            ahead = read_days(spark, days, candidates).filter(F.col(DAY) >= min(touched)).join(since, "record_id").filter(F.col(DAY) >= F.col("since"))
            so_far = Window.partitionBy("record_id").orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
            best = ahead.groupBy("record_id", DAY).agg(F.max("turned").alias("best"), F.max("stands").alias("stands"))
            open_days = best.withColumn("must", F.max("stands").over(so_far)).join(before, "record_id", "left")
            beats = (F.col("best") > F.coalesce("must", F.lit(float("-inf")))) & (F.col("best") > F.coalesce("b.turned", F.lit(float("-inf"))))
            chain = ahead.join(open_days.filter(beats).select("record_id", DAY), ["record_id", DAY], "left_semi")
            chain = chain.select("record_id", "at", "value", "turned", "gap", F.lit(False).alias("known"))
            at = F.unix_micros(F.col("b.interval").cast("timestamp"))
            chain = chain.unionByName(before.select("record_id", at.alias("at"), "b.value", "b.turned", F.lit(0).cast("long").alias("gap"), F.lit(True).alias("known")))
            shape = "record_id string, at long, value double, turned double, before long"
            now = chain.groupBy("record_id").applyInPandas(_chained, shape).select(
                "record_id", stamp("at").alias("interval"), "value", "turned", stamp("before").alias("previous_interval"), F.lit(True).alias("kept")
            )
            now = _tagged(now, "interval").persist()
            gone = held.filter(F.col("kept") & (F.col(DAY) >= F.col("since"))).drop("since")
            gone = gone.join(now.select("record_id", "interval"), ["record_id", "interval"], "left_anti").withColumn("kept", F.lit(False))
            new = now.unionByName(gone).persist()
            rewritten = [r[0] for r in new.select(DAY).distinct().collect()]
            rest = told.filter(F.col(DAY).isin(rewritten)).join(new.select("record_id", "interval"), ["record_id", "interval"], "left_anti")
            write_days(rest.unionByName(new), sink, "interval")
            new.unpersist()
            now.unpersist()
        finally:
            batch.unpersist()

    with keyed_state(spark):
        writer = judged.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "5 minutes"})).start()


def read_records(spark: SparkSession, sink: str) -> DataFrame:
    """The records that stand, each with its name and that of the one it replaced."""
    kept = read_days(spark, sink, StructType.fromDDL(RECORD)).filter("kept").drop("kept", "turned", DAY)
    before = F.col("previous_interval")
    return kept.withColumn("instance_id", instance_id(F.col("record_id"), F.col("interval"))).withColumn(
        "previous_instance_id", F.when(before.isNotNull(), instance_id(F.col("record_id"), before))
    )


def start_silence_alert(stream: DataFrame, sink: str, checkpoint: str, limit: timedelta = timedelta(minutes=30), clock: str = "ProcessingTime", lateness: timedelta = timedelta(hours=1), trigger: dict | None = None) -> StreamingQuery:
    """Tells which feeds have been silent for longer than the limit, and which are heard again.

    Each feed keeps its newest reading and one timer. With the clock "ProcessingTime" (live) a timer is due `limit` after
    the feed was last heard and fires by itself, also when every feed has stopped and no rows come. With "EventTime"
    (replays) the newest reading of all feeds is the time, and rows later than `lateness` aren't looked at.
    A task boils its rows down to one for each feed before they are shuffled. `sink` holds a row for every change:
    network_id, last_seen, silent.
    """
    spark = stream.sparkSession

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by("network_id").aggregate([("interval", "max")])
            yield from found.rename_columns(["network_id", "interval"]).select(["network_id", "interval"]).to_batches()

    rows = stream.select("network_id", F.col("interval").cast("timestamp").alias("interval"))
    rows = rows.filter("network_id IS NOT NULL AND interval IS NOT NULL").mapInArrow(newest, "network_id string, interval timestamp")
    if clock == "EventTime":
        rows = rows.withWatermark("interval", f"{int(lateness.total_seconds())} seconds")
    watch = FeedWatch(limit, clock, lateness)
    told = rows.groupBy("network_id").transformWithStateInPandas(watch, "network_id string, last_seen timestamp, silent boolean", "Append", clock)
    told = told.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
    with keyed_state(spark):
        writer = told.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_alerts(spark: SparkSession, sink: str, limit: timedelta = timedelta(minutes=30)) -> DataFrame:
    """The feeds silent now, their newest reading and since when they are overdue."""
    told = spark.read.schema("network_id string, last_seen timestamp_ntz, silent boolean").parquet(sink)
    last = told.groupBy("network_id").agg(F.max(F.struct("last_seen", "silent")).alias("last"))
    return last.filter("last.silent").select("network_id", "last.last_seen", (F.col("last.last_seen") + F.lit(limit)).alias("silent_since"))
