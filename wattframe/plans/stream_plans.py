"""The streaming jobs run over the event table until it is used up.

Each streams the table's files, waits for the job, and reads what it wrote in
the shared folder.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.timebucket import bucket
from wattframe.operators import rollups as R
from wattframe.operators.enrich import unit_intervals
from wattframe.plans.catalog import query
from wattframe.plans.enrich_plans import _KEYED, _MARKET_FACT, _UNIT_FACT
from wattframe.plans.metric_plans import MARKET_DAILY_SQL, rounded
from wattframe.plans.tables import Tables
from wattframe.session import saved, shared_folder
from wattframe.streaming import jobs as J

ONCE = {"availableNow": True}


def _late(ts: str = "ts") -> list:
    """The parts in which rows arrive: the second half of the month, the first, then late rows of every day."""
    late, half = F.col("event_id") % 7 == 0, F.dayofmonth(ts) > 15
    return [~late & half, ~late & ~half, late]


def _feed(folder: str, rows: DataFrame, parts, start) -> None:
    """Writes one part after the other to a folder, each by as many tasks as it has, and runs the job on what is new.

    `start` gets the folder's rows as a stream and starts the job, with the same checkpoint each time.
    """
    for part in parts:
        rows.filter(part).write.mode("append").parquet(folder)
        start(J.stream_table(rows.sparkSession, folder, rows.schema)).awaitTermination()


class LateTables(Tables):
    """The same domain tables, their events a stream of what has arrived in a folder."""

    def __init__(self, t: Tables, events: DataFrame):
        super().__init__(t.spark, t.dir)
        self.events = events

    def read(self, name: str) -> DataFrame:
        return self.events if name == "events" else super().read(name)


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _done(job) -> None:
    job.awaitTermination()


def _feed_telemetry(t: Tables, at: str, start) -> None:
    """Feeds a job with telemetry in three parts out of order."""
    _feed(f"{at}/events", t.read("events"), _late(), lambda events: start(LateTables(t, events).telemetry().select(*_CLEAN)))


_CLEAN = ["event_id", "interval", "network_id", "unit_code", "generated", "energy", "energy_storage", "is_forecast"]


@query("st1_unit_facts", f"WITH {_UNIT_FACT} SELECT * EXCLUDE (version) FROM unit_fact")
def _unit_facts(t: Tables):
    at = _folder(t)
    _feed_telemetry(t, at, lambda stream: J.start_unit_facts(stream, t.market, t.units, f"{at}/store", f"{at}/fact", f"{at}/cp", trigger=ONCE))
    return t.spark.read.parquet(f"{at}/fact").drop(J.DAY, "version")


def _facts_of_both(t: Tables, market: DataFrame, late) -> DataFrame:
    """Unit facts of two streams: telemetry in three parts, prices in two, of which the late ones come with the last part."""
    at = _folder(t)
    prices = iter([market.filter(~late), None, market.filter(late)])

    def fact(readings, known, first, last, number):
        return unit_intervals(readings, known, t.units(), first, last, version=number, chunk="day", carry_in=True, day=J.DAY)

    def start(stream):
        part = next(prices)
        if part is not None:
            part.write.mode("append").parquet(f"{at}/published")
        published = J.stream_table(t.spark, f"{at}/published", market.schema)
        keys = ["interval", "network_id", "network_region"]
        return J.start_facts_of_both(stream, published, keys, fact, f"{at}/store", f"{at}/market", f"{at}/fact", f"{at}/cp", trigger=ONCE, dealt=True)

    _feed_telemetry(t, at, start)
    return t.spark.read.parquet(f"{at}/fact").drop(J.DAY, "version")


@query("st1_unit_facts_late_prices", f"WITH {_UNIT_FACT} SELECT * EXCLUDE (version) FROM unit_fact")
def _late_prices(t: Tables):
    """Prices as a second stream, of which half come when their readings are long there."""
    return _facts_of_both(t, t.market(), F.hour("interval") % 2 == 0)


_GAP = "dayofmonth(interval) BETWEEN 10 AND 12"


@query(
    "st1_unit_facts_price_gap",
    f"""WITH gapped AS (SELECT * REPLACE (CASE WHEN NOT ({_GAP}) THEN price END AS price) FROM x_market),
        {_UNIT_FACT.replace("FROM x_market", "FROM gapped")} SELECT * EXCLUDE (version) FROM unit_fact""",
)
def _price_gap(t: Tables):
    """No prices for three days, and the last ones before them late: they are carried through the gap."""
    market = t.market().withColumn("price", F.when(~F.expr(_GAP), F.col("price")))
    return _facts_of_both(t, market, (F.dayofmonth("interval") == 9) & (F.hour("interval") >= 12))


@query(
    "st1_market_facts",
    f"""WITH {_MARKET_FACT} SELECT * EXCLUDE (version), NULL::DOUBLE AS energy_imports, NULL::DOUBLE AS energy_exports,
            NULL::DOUBLE AS emissions_imports, NULL::DOUBLE AS emissions_exports, NULL::DOUBLE AS market_value_imports,
            NULL::DOUBLE AS market_value_exports FROM market_fact WHERE interval < TIMESTAMP '2024-01-31'""",
)
def _market_facts(t: Tables):
    at = _folder(t)
    _feed_telemetry(t, at, lambda stream: J.start_market_facts(stream, t.market, t.units, f"{at}/store", f"{at}/fact", f"{at}/cp", trigger=ONCE))
    return t.spark.read.parquet(f"{at}/fact").drop(J.DAY, "version")


@query("st2_late_rebuild", MARKET_DAILY_SQL)
def _rebuild(t: Tables):
    """Event-level shares of the market fact; days are summed from them."""
    at = _folder(t)
    fact = t.ms()
    # A stream cannot aggregate into the fact, so the fact itself is streamed.
    source = f"{at}/source"
    fact.write.parquet(source)
    stream = J.stream_table(t.spark, source, fact.schema, per_batch=1)
    keys = ["interval", "network_id", "network_region"]
    _done(J.start_rebuild(stream, R.market_daily, keys, f"{at}/store", f"{at}/daily", f"{at}/cp", trigger=ONCE))
    return rounded(t.spark.read.parquet(f"{at}/daily").drop(J.DAY), 4)


_TUMBLING = """SELECT time_bucket(INTERVAL '5 minutes', ts) AS interval, event_type, round(sum(value), 4) AS value, count(*) AS readings
        FROM events GROUP BY 1, 2"""


@query("st3_tumbling_rollup", _TUMBLING)
@query("st3_tumbling_rollup_all", _TUMBLING)
def _tumbling(t: Tables):
    """Every window, late rows and the newest hour included."""
    at = _folder(t)
    events = t.read("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    _feed(
        f"{at}/events", events, _late(),
        lambda stream: J.start_rollup(stream, ["event_type"], ["value"], "ts", f"{at}/store", f"{at}/out", f"{at}/cp", trigger=ONCE),
    )
    return t.spark.read.parquet(f"{at}/out").select("interval", "event_type", F.round("value", 4).alias("value"), "readings")


_PART = "CASE WHEN event_id % 7 = 0 THEN 2 WHEN day(ts) > 15 THEN 0 ELSE 1 END"


@query(
    "st4_dedupe_first",
    f"""SELECT user_id, time_bucket(INTERVAL '30 minutes', ts) AS interval, arg_min(value, ({_PART}, event_id)) AS value, min(({_PART}, event_id))[2] AS event_id,
            min({_PART})::BIGINT AS batch FROM events GROUP BY 1, 2""",
)
def _dedupe(t: Tables):
    """The value of each half-hour that arrived first, in the order of three parts and of event_id inside a part."""
    at = _folder(t)
    events = t.read("events").withColumn("interval", bucket("ts", "30m"))

    def start(stream):
        rows = stream.select("user_id", "interval", "value", "event_id")
        return J.start_dedupe(rows, ["user_id", "interval"], "interval", f"{at}/out", f"{at}/cp", ["event_id"], trigger=ONCE)

    _feed(f"{at}/events", events, _late(), start)
    return t.spark.read.parquet(f"{at}/out").select("user_id", "interval", "value", "event_id", "arrived.batch")


@query(
    "st4_upsert_last",
    """SELECT user_id, interval, value, event_id FROM (SELECT user_id, time_bucket(INTERVAL '30 minutes', ts) AS interval, value, event_id,
            row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '30 minutes', ts) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _upsert(t: Tables):
    """The events come in their order, in two parts."""
    at = _folder(t)
    events = t.read("events").withColumn("interval", bucket("ts", "30m")).select("user_id", "interval", "value", "event_id")
    middle = events.agg(F.max("event_id") / 2).scalar()
    early = F.col("event_id") <= middle
    _feed(
        f"{at}/events", events, [early, ~early],
        lambda stream: J.start_upsert(stream, ["user_id", "interval"], "event_id", "interval", f"{at}/out", f"{at}/cp", trigger=ONCE),
    )
    return t.spark.read.parquet(f"{at}/out").drop(J.DAY)


@query(
    "st5_records",
    """WITH RECURSIVE s AS (SELECT 'au.nem.' || lower(network_region) || '.demand.interval.high' AS record_id, interval, round(demand, 4) AS value,
            round_even(round(demand, 4), 0) AS r FROM x_ms WHERE demand IS NOT NULL AND round(demand, 4) <> 0),
        kept(record_id, since, r, before) AS (
            SELECT record_id, min(interval), arg_min(r, interval), NULL::TIMESTAMP FROM s GROUP BY 1
            UNION ALL
            SELECT k.record_id, min(s.interval), arg_min(s.r, s.interval), k.since FROM kept k
                JOIN s ON s.record_id = k.record_id AND s.interval >= k.since + INTERVAL 50 MINUTES AND s.r > k.r GROUP BY k.record_id, k.since, k.r)
        SELECT record_id, interval, value, before AS previous_interval,
            sha256(record_id || '|' || strftime(interval, '%Y-%m-%d %H:%M:%S')) AS instance_id,
            sha256(record_id || '|' || strftime(before, '%Y-%m-%d %H:%M:%S')) AS previous_instance_id
        FROM kept k JOIN s USING (record_id) WHERE s.interval = k.since""",
)
def _records(t: Tables):
    """The demand of every region, in three parts out of order: late readings are judged where they belong."""
    at = _folder(t)
    series = t.ms().select(
        F.concat(F.lit("au.nem."), F.lower("network_region"), F.lit(".demand.interval.high")).alias("record_id"),
        "interval",
        F.round("demand", 4).alias("value"),
        F.lit("high").alias("aggregate"),
        F.lit("interval").alias("period"),
        F.lit(0).alias("digits"),
    )
    series = saved(series, "series")
    late, half = F.minute("interval") % 7 == 0, F.dayofmonth("interval") > 15
    parts = [~late & half, ~late & ~half, late]
    _feed(f"{at}/source", series, parts, lambda stream: J.start_records(stream, f"{at}/out", f"{at}/cp", trigger=ONCE))
    return J.read_records(t.spark, f"{at}/out")


@query(
    "st6_trapezoid_energy",
    f"""WITH {_KEYED}, paired AS (SELECT *, lag(generated) OVER (PARTITION BY network_id, unit_code ORDER BY interval) AS prev
            FROM keyed WHERE network_id NOT IN ('WEM', 'WEMDE', 'AEMO_ROOFTOP_BACKFILL'))
        SELECT interval, network_id, unit_code, generated,
            (generated + prev) / 2 / (60 / CASE network_id WHEN 'AEMO_ROOFTOP' THEN 30.0::DOUBLE ELSE 5.0::DOUBLE END) AS energy,
            2 AS energy_quality_flag FROM paired WHERE prev IS NOT NULL AND flag < 2""",
)
def _energy(t: Tables):
    from wattframe.plans.enrich_plans import keyed_telemetry

    at = _folder(t)
    # Out of order, and the readings before midnight last.
    late, half = F.hour("interval") == 23, F.dayofmonth("interval") > 15
    parts = [~late & half, ~late & ~half, late]
    _feed(f"{at}/source", keyed_telemetry(t), parts, lambda stream: J.start_energy(stream, f"{at}/store", f"{at}/energy", f"{at}/cp", trigger=ONCE))
    return t.spark.read.parquet(f"{at}/energy").drop(J.DAY)


@query(
    "st7_feed_silence",
    """WITH s AS (SELECT network_id, max(interval) AS last_seen FROM x_telemetry WHERE network_id <> 'WEM' OR interval < TIMESTAMP '2024-01-20' GROUP BY 1),
        c AS (SELECT max(last_seen) AS now FROM s)
        SELECT network_id, last_seen, last_seen + INTERVAL 30 MINUTES AS silent_since FROM s, c WHERE last_seen + INTERVAL 30 MINUTES < now""",
)
def _silence(t: Tables):
    """A replay in three parts out of order, so the newest reading of all feeds is the time."""
    at = _folder(t)
    heard = (F.col("network_id") != "WEM") | (F.col("interval") < F.lit("2024-01-20").cast("timestamp_ntz"))

    def start(stream):
        return J.start_silence_alert(stream.filter(heard), f"{at}/out", f"{at}/cp", clock="EventTime", lateness=timedelta(days=366), trigger=ONCE)

    _feed_telemetry(t, at, start)
    return J.read_alerts(t.spark, f"{at}/out")


@query(
    "s22_stream_reports",
    """SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y/%m/%d %H:%M:%S') AS settlementdate, 'U-' || user_id AS duid,
            value AS scadavalue FROM events WHERE event_id % 20 < 10""",
)
def _reports(t: Tables):
    """Report files written as text, streamed, parsed batch by batch."""
    from wattframe.plans.source_plans import report_lines
    from wattframe.sources.reports import parse_report, report_table

    at = _folder(t)
    lines = report_lines(t)
    ordered = lines.repartition(8, "file").sortWithinPartitions("file", "row")
    ordered.select("line", "file").write.partitionBy("file").text(f"{at}/reports")
    stream = J.stream_reports(t.spark, f"{at}/reports/*")

    def work(batch: DataFrame, number: int) -> None:
        rows = report_table(parse_report(J.number_lines(batch), ["dispatch"]), "dispatch_unit_scada", ["settlementdate", "duid", "scadavalue"], keep=[])
        rows.write.mode("overwrite").parquet(f"{at}/scada/batch={number}")

    _done(stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{at}/cp").trigger(**ONCE).start())
    out = t.spark.read.parquet(f"{at}/scada").drop("batch")
    return out.withColumn("scadavalue", F.col("scadavalue").cast("double"))


@query(
    "s21_write_series",
    """SELECT network_region, fueltech_id, count(*) AS points, round(sum(energy), 4) AS total FROM x_daily GROUP BY 1, 2""",
)
def _write(t: Tables):
    from wattframe.sources.sinks import write_series

    at = _folder(t)
    write_series(t.daily(), f"{at}/series", ["network_region", "fueltech_id"])
    back = t.spark.read.schema("energy double, network_region string, fueltech_id string").json(f"{at}/series")
    return back.groupBy("network_region", "fueltech_id").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("energy"), 4).alias("total")
    )
