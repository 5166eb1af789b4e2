"""Parsers over raw text and documents made from the given tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.timebucket import floor_minutes
from wattframe.plans.catalog import query
from wattframe.plans.sqltext import r4
from wattframe.plans.tables import Tables
from wattframe.sources import feeds as S
from wattframe.sources import reports as R


def _stamp(c, pattern="yyyy/MM/dd HH:mm:ss"):
    return F.date_format(c, pattern)


def report_lines(t: Tables):
    """The events as report files of two tables, with comments and bad rows."""
    n = F.col("event_id")
    at = _stamp(floor_minutes("ts", 5))
    uid = F.col("user_id").cast("string")
    scada = F.concat_ws(",", F.lit("D"), F.lit("DISPATCH"), F.lit("UNIT_SCADA"), F.lit("1"), F.concat(F.lit('"'), at, F.lit('"')), F.concat(F.lit("u-"), uid), F.col("value").cast("string"))
    price = F.concat_ws(",", F.lit("D"), F.lit("DISPATCH"), F.lit("PRICE"), F.lit("2"), at, F.concat(F.lit('"NSW1, mainland"')), F.col("value").cast("string"))
    short = F.concat_ws(",", F.lit("D"), F.lit("DISPATCH"), F.lit("PRICE"), F.lit("2"), at)
    k = n % 20
    lines = F.array_compact(
        F.array(
            F.when(n % 100 == 0, F.lit("C,NEMP.WORLD,REPORT")),
            F.when(k == 0, F.lit("I,DISPATCH,UNIT_SCADA,1,SETTLEMENTDATE,DUID,SCADAVALUE")),
            F.when(k == 10, F.lit("I,DISPATCH,PRICE,2,SETTLEMENTDATE,REGIONID,RRP")),
            F.when(k < 10, scada).when(k == 15, short).when(k == 16, F.lit("X,unknown,row")).otherwise(price),
        )
    )
    return t.read("events").select(
        F.floor(n / 1000).cast("string").alias("file"),
        F.floor(n / 50).alias("block"),
        F.posexplode(lines).alias("_p", "line"),
        n.alias("_n"),
    ).select("file", "block", (F.col("_n") * 10 + F.col("_p")).alias("row"), "line")


@query(
    "s1_report_unit_scada",
    """SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y/%m/%d %H:%M:%S') AS settlementdate, 'U-' || user_id AS duid,
            value AS scadavalue FROM events WHERE event_id % 20 < 10""",
)
def _scada(t: Tables):
    records = R.parse_report(report_lines(t), ["dispatch"])
    rows = R.report_table(records, "dispatch_unit_scada", ["settlementdate", "duid", "scadavalue"], keep=[])
    return rows.withColumn("scadavalue", F.col("scadavalue").cast("double"))


@query(
    "s1_report_tables",
    """SELECT 'dispatch_price' AS name, event_id, value, 'NSW1, mainland' AS code
        FROM events WHERE event_id % 20 >= 10 AND event_id % 20 NOT IN (15, 16)
        UNION ALL SELECT 'dispatch_unit_scada', event_id, value, 'U-' || user_id FROM events WHERE event_id % 20 < 10""",
)
def _tables(t: Tables):
    found = R.report_tables(R.parse_report(report_lines(t)))
    columns = {"dispatch_price": ("rrp", "regionid"), "dispatch_unit_scada": ("scadavalue", "duid")}
    parts = [
        rows.select(
            F.lit(name).alias("name"),
            F.floor(F.col("row") / 10).alias("event_id"),
            F.col(columns[name][0]).cast("double").alias("value"),
            F.col(columns[name][1]).alias("code"),
        )
        for name, rows in sorted(found.items())
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "s3_report_filenames",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'PUBLIC_DVD_' || upper(event_type) ELSE 'PUBLIC_ARCHIVE#' || upper(event_type) || '#FILE01' END AS filename,
            CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts)::TIMESTAMP WHEN event_id % 4 = 2 THEN date_trunc('second', ts)::TIMESTAMP
                ELSE date_trunc('minute', ts)::TIMESTAMP END AS date,
            CASE WHEN event_id % 4 = 2 THEN lpad(event_id::VARCHAR, 16, '0') END AS interval FROM events""",
)
def _names(t: Tables):
    n, kind = F.col("event_id"), F.upper("event_type")
    ts = F.col("ts")
    serial = F.lpad(n.cast("string"), 16, "0")
    name = (
        F.when(n % 4 == 0, F.concat(F.lit("PUBLIC_DVD_"), kind, F.lit("_"), _stamp(ts, "yyyyMMdd"), F.lit(".zip")))
        .when(n % 4 == 2, F.concat(F.lit("PUBLIC_DVD_"), kind, F.lit("_"), _stamp(ts, "yyyyMMddHHmmss"), F.lit("_"), serial, F.lit(".csv")))
        .otherwise(F.concat(F.lit("PUBLIC_ARCHIVE#"), kind, F.lit("#FILE01#"), _stamp(ts, "yyyyMMddHHmm"), F.lit(".zip")))
    )
    return t.read("events").select("event_id", R.parse_report_filename(name).alias("f")).select("event_id", "f.*")


@query(
    "s4_facility_csv",
    """SELECT event_id // 100 AS file, time_bucket(INTERVAL '30 minutes', ts) AS trading_interval, 'U' || user_id AS facility_code,
            coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 5 <> 0 THEN value / 2 END * 2) AS generated,
            coalesce(CASE WHEN event_id % 5 <> 0 THEN value / 2 END, CASE WHEN event_id % 3 = 0 THEN value END / 2) AS energy FROM events""",
)
def _facility(t: Tables):
    n, v = F.col("event_id"), F.col("value")
    raw = t.read("events").select(
        F.floor(n / 100).alias("file"),
        _stamp(floor_minutes("ts", 30), "yyyy-MM-dd HH:mm:ss").alias("Trading Interval"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("Facility Code"),
        F.when(n % 3 == 0, v.cast("string")).otherwise("").alias("EOI Quantity (MW)"),
        F.when(n % 5 != 0, (v / 2).cast("string")).otherwise(" ").alias("Energy Generated (MWh)"),
    )
    out = S.parse_facility_csv(raw, interval_minutes=30)
    return out.select("file", "trading_interval", "facility_code", "generated", "energy")


def _batch(t: Tables, size: int = 40):
    return t.read("events").withColumn("batch", F.floor(F.col("event_id") / size))


def _iso(c):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def dispatch_docs(t: Tables):
    """Dispatch solutions of forty events each, with a look-ahead interval."""
    n, v = F.col("event_id"), F.col("value")
    facility = F.struct(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("facilityCode"), F.when(n % 7 != 0, v - 60).alias("quantity")
    )
    base = _batch(t).groupBy("batch").agg(F.min("ts").alias("ts"), F.collect_list(facility).alias("f"), F.min("value").alias("p"))
    at = floor_minutes("ts", 5)
    price = F.when(F.col("batch") % 3 == 0, F.lit("n/a")).otherwise(F.col("p").cast("string"))

    def run(when):
        return F.struct(
            _iso(when).alias("dispatchInterval"),
            F.struct(price.alias("energy")).alias("prices"),
            F.array(
                F.struct(F.lit("regulation").alias("marketService"), F.array_repeat(F.col("f")[0], 1).alias("facilitySchedule")),
                F.struct(F.lit("energy").alias("marketService"), F.col("f").alias("facilitySchedule")),
            ).alias("schedule"),
        )

    doc = F.struct(
        _iso(at).alias("primaryDispatchInterval"),
        F.array(run(at), run(at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5)))).alias("solutionData"),
    )
    return base.select(F.to_json(doc).alias("value"))


_BATCHED = "b AS (SELECT *, event_id // 40 AS batch, time_bucket(INTERVAL '5 minutes', min(ts) OVER (PARTITION BY event_id // 40)) AS tm FROM events)"


@query(
    "s8_dispatch_telemetry",
    f"""WITH {_BATCHED} SELECT tm AS interval, 'U' || user_id AS unit_code, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value - 60 END AS generated,
            (CASE WHEN event_id % 7 = 0 THEN 0 ELSE value - 60 END) / 12 AS energy FROM b""",
)
def _dispatch(t: Tables):
    return S.parse_dispatch(dispatch_docs(t))[0].select("interval", "unit_code", "generated", "energy")


@query(
    "s8_dispatch_prices",
    f"""WITH {_BATCHED} SELECT tm AS interval, 'WEM' AS network_id, 'WEM' AS network_region, min(value) AS price_dispatch
        FROM b WHERE batch % 3 <> 0 GROUP BY batch, tm""",
)
def _dispatch_price(t: Tables):
    return S.parse_dispatch(dispatch_docs(t))[1]


@query(
    "s9_scada_json",
    """SELECT date_trunc('second', ts)::TIMESTAMP AS interval, 'U' || user_id AS unit_code, value * 12 AS generated, value AS energy FROM events""",
)
def _scada_json(t: Tables):
    entry = F.struct(
        _iso(F.col("ts")).alias("dispatchInterval"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("code"),
        F.col("value").alias("quantity"),
    )
    docs = _batch(t).groupBy("batch").agg(F.collect_list(entry).alias("facilityScadaDispatchIntervals"))
    rows = docs.select(F.to_json(F.struct("facilityScadaDispatchIntervals")).alias("value"))
    return S.parse_scada(rows).select("interval", "unit_code", "generated", "energy")


@query(
    "s9_price_json",
    """WITH b AS (SELECT *, event_id // 48 AS batch FROM events), f AS (SELECT batch FROM b WHERE batch % 4 <> 0 OR event_id % 48 <> 0
            GROUP BY 1 HAVING count(*) = 48)
        SELECT date_trunc('second', ts)::TIMESTAMP AS interval, value AS price FROM b WHERE batch IN (SELECT batch FROM f) AND value <> 0""",
)
def _price_json(t: Tables):
    entry = F.struct(_iso(F.col("ts")).alias("tradingInterval"), F.col("value").alias("referenceTradingPrice"))
    rows = _batch(t, 48).filter((F.col("batch") % 4 != 0) | (F.col("event_id") % 48 != 0))
    docs = rows.groupBy("batch").agg(F.collect_list(entry).alias("referenceTradingPrices"))
    values = docs.select(F.to_json(F.struct("referenceTradingPrices")).alias("value"))
    return S.parse_prices(values).select("interval", "price")


def postcode_docs(t: Tables):
    """Percentages and capacities by postcode area, some areas without capacity."""
    uid = F.col("user_id")
    area = F.concat((uid % 10).cast("string"), F.lpad((uid % 7).cast("string"), 2, "0"))
    at = F.date_format(floor_minutes("ts", 15), "yyyy-MM-dd'T'HH:mm:ss")
    point = _batch(t).groupBy("batch", area.alias("area"), at.alias("at")).agg(F.max("value").alias("v"))
    points = point.groupBy("batch", "area").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("points"))
    entry = F.struct("area", "points")
    capacity = F.when(F.substring("area", 3, 1) != "3", F.struct(F.col("area"), (F.substring("area", 1, 1).cast("double") * 10 + 5).alias("c")))
    docs = points.groupBy("batch").agg(
        F.map_from_entries(F.collect_list(entry)).alias("performance"),
        F.map_from_entries(F.collect_list(capacity)).alias("capacity"),
        F.max(F.create_map(F.lit("vic"), F.lit(12)).cast("string")).alias("_x"),
    )
    return docs.select(F.to_json(F.struct("performance", "capacity")).alias("value"))


_AREAS = """areas AS (SELECT event_id // 40 AS batch, (user_id % 10)::VARCHAR || lpad((user_id % 7)::VARCHAR, 2, '0') AS area,
            time_bucket(INTERVAL '15 minutes', ts) AS interval, max(value) AS v FROM events GROUP BY 1, 2, 3),
    named AS (SELECT *, CASE area[1] WHEN '1' THEN 'NSW' WHEN '2' THEN 'NSW' WHEN '3' THEN 'VIC' WHEN '4' THEN 'QLD' WHEN '5' THEN 'SA'
            WHEN '6' THEN 'WA' WHEN '7' THEN 'TAS' WHEN '0' THEN 'NT' END AS state, area[1]::DOUBLE * 10 + 5 AS c FROM areas WHERE area[3] <> '3')"""


@query(
    "s10_rooftop_from_postcode",
    f"""WITH {_AREAS} SELECT state, interval, round(sum(v / 100 * c), 6) AS generated, round(sum(v / 100 * c) / 4, 6) AS energy
        FROM named WHERE state IS NOT NULL GROUP BY 1, 2""",
)
def _postcode(t: Tables):
    out = S.rooftop_from_postcode(postcode_docs(t))
    return out.withColumns({"generated": F.round("generated", 6), "energy": F.round("energy", 6)})


@query(
    "s10_rooftop_state_capacity",
    f"""WITH {_AREAS}, a AS (SELECT DISTINCT batch, area, c FROM named)
        SELECT CASE area[1] WHEN '2' THEN 'NSW' WHEN '3' THEN 'VIC' WHEN '4' THEN 'QLD' WHEN '5' THEN 'SA' WHEN '6' THEN 'WA'
            WHEN '7' THEN 'TAS' WHEN '0' THEN 'NT' END AS state, sum(c) AS capacity_registered, NULL::BIGINT AS unit_number
        FROM a WHERE area[1] IN ('0', '2', '3', '4', '5', '6', '7') GROUP BY 1""",
)
def _state_capacity(t: Tables):
    return S.rooftop_state_capacity(postcode_docs(t))


@query(
    "s11_rooftop_capacity_monthly",
    """WITH m AS (SELECT network_region AS state, date_trunc('month', interval)::TIMESTAMP AS month,
            sum(energy * 4.5::DOUBLE) / 1000 AS a FROM x_daily GROUP BY 1, 2)
        SELECT 'ROOFTOP_APVI_' || state AS facility_code, state, month,
            round(sum(a) OVER (PARTITION BY state ORDER BY month), 6) AS capacity_registered FROM m""",
)
def _bins(t: Tables):
    rows = t.daily().select(
        F.lower("network_region").alias("state"),
        F.date_format("interval", "yyyy-MM").alias("month"),
        *[(F.col("energy") * (i + 1) / 10).alias(b) for i, b in enumerate(S.CAPACITY_BINS)],
    )
    out = S.rooftop_capacity_monthly(rows)
    return out.withColumn("capacity_registered", F.round("capacity_registered", 6))


@query(
    "s12_observations",
    """SELECT 'W' || (event_id // 40 % 8) AS station_id, 'NSW' AS state, date_trunc('second', ts)::TIMESTAMP AS observation_time,
            value AS temp_air, CASE WHEN event_id % 2 = 0 THEN 'Cloudy' END AS cloud FROM events WHERE event_id % 5 <> 0""",
)
def _observations(t: Tables):
    n = F.col("event_id")
    entry = F.struct(
        _stamp(F.col("ts"), "yyyyMMddHHmmss").alias("aifstime_utc"),
        F.when(n % 5 != 0, F.col("value")).alias("air_temp"),
        F.when(n % 2 == 0, "Cloudy").otherwise("-").alias("cloud"),
    )
    docs = _batch(t).groupBy("batch").agg(F.collect_list(entry).alias("data"))
    header = F.array(F.struct(F.lit("NSW").alias("state_time_zone")))
    doc = F.to_json(F.struct(F.struct(header.alias("header"), F.col("data")).alias("observations")))
    rows = docs.select(F.concat(F.lit("W"), (F.col("batch") % 8).cast("string")).alias("station_id"), doc.alias("value"))
    return S.parse_observations(rows).select("station_id", "state", "observation_time", "temp_air", "cloud")


#: Reports in one XML document, as a published file holds many: a parser is set up for each document.
REPORTS = 200


def _report_files(batches):
    """XML documents out of the reports of a task, so many each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        reports = batch.column(0).drop_null()
        ends = np.append(np.arange(0, len(reports), REPORTS), len(reports)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), reports), "")
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise("<reports>", joined, "</reports>", "")], ["value"])


@query(
    "s13_pollution_xml",
    """SELECT 'N' || l_suppkey AS npi_facility_id, year(l_shipdate) AS report_year, 'Substance ' || (l_partkey % 6) AS name, 'Air Total' AS destination,
            l_quantity AS quantity_kg, l_returnflag = 'A' AS direct_measurement, l_linestatus = 'O' AS engineering_calc FROM lineitem WHERE l_linenumber <> 2""",
)
def _xml(t: Tables):
    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    yes = lambda c: F.when(c, "true").otherwise("false")
    emission = tag(
        "emission",
        F.concat(
            tag("substance", F.concat(F.lit("Substance "), (F.col("l_partkey") % 6).cast("string"))),
            tag("destination", F.lit("Air Total")),
            tag("quantity_in_kg", F.when(F.col("l_linenumber") == 2, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))),
            tag("direct_measurement_estimation", yes(F.col("l_returnflag") == "A")),
            tag("engineering_calculations_estimation", yes(F.col("l_linestatus") == "O")),
        ),
    )
    report = tag(
        "report",
        F.concat(
            tag("facility_name", F.lit("Site")),
            tag("jurisdiction_facility_id", F.concat(F.lit("N"), F.col("l_suppkey").cast("string"))),
            tag("year", F.year("l_shipdate").cast("string")),
            tag("emissions", emission),
        ),
    )
    files = t.read("lineitem").select(report.alias("value")).mapInArrow(_report_files, "value string")
    out = S.parse_pollution(S.split_reports(files))
    return out.select("npi_facility_id", "report_year", "name", "destination", "quantity_kg", "direct_measurement", "engineering_calc")


@query(
    "s14_stat_csv",
    f"""SELECT o_orderdate::TIMESTAMP AS stat_date, 'au' AS country, 'CPI' AS stat_type, {r4("o_totalprice")} AS value FROM orders
        WHERE o_orderkey % 500 > 2 AND o_orderkey % 7 <> 0 AND o_orderdate > TIMESTAMP '1996-06-01'""",
)
def _stat(t: Tables):
    n = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "dd/MM/yyyy")
    line = (
        F.when(n % 500 == 0, F.lit("G1 CONSUMER PRICE INFLATION"))
        .when(n % 500 == 1, F.lit("Title,Quarterly,Index"))
        .when(n % 500 == 2, F.lit("Series ID,GCPIAGSAQP,GCPIAG"))
        .when(n % 7 == 0, F.concat(date, F.lit(",1.0,")))
        .otherwise(F.concat(date, F.lit(",1.0,"), F.col("o_totalprice").cast("string")))
    )
    lines = t.read("orders").select(
        F.floor(n / 500).cast("string").alias("file"), F.floor(n / 100).alias("block"), n.alias("row"), line.alias("line")
    )
    return S.parse_stat_csv(lines, "GCPIAG", after=datetime(1996, 6, 1))


@query(
    "s16_notices",
    r"""SELECT doc_id, doc_id AS notice_id, upper(lang) AS notice_type, source AS description, TIMESTAMP '2024-07-08' AS issue_date,
            TIMESTAMP '2024-07-08 20:01:41' AS created_at, 'Line ' || doc_id AS external_reference, 'AEMO' AS issued_by,
            nullif(trim(text, ' '), '') AS reason FROM documents WHERE doc_id % 3 <> 0""",
)
def _notices(t: Tables):
    rule = F.lit("\n" + "-" * 67 + "\n")
    n = F.col("doc_id").cast("string")
    head = F.concat(rule, F.lit("                           MARKET NOTICE"), rule, F.lit("\nFrom :              AEMO\nTo   :              NEMITWEB1\nCreation Date :     08/07/2024     20:01:41\n"), rule)
    body = F.concat(
        F.lit("\nNotice ID               :         "), n,
        F.lit("\nNotice Type ID          :         "), F.upper("lang"),
        F.lit("\nNotice Type Description :         "), F.col("source"),
        F.lit("\nIssue Date              :         08/07/2024\nExternal Reference      :         Line "), n, F.lit("\n"), rule,
    )
    text = F.concat(head, body, F.lit("\nReason :\n\n"), F.col("text"), rule, F.lit("END OF REPORT"))
    rows = t.read("documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, text).otherwise(F.col("text")).alias("text"))
    return S.parse_notices(rows, "text", ["doc_id"])


def _pack(batches):
    """Zip files out of the sorted lines of a task; odd ones are zipped twice."""
    import io
    import zipfile

    import pandas as pd

    def packed(name, rows):
        data = "\n".join(rows).encode()
        for depth in range(1 + int(name) % 2):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{name}.{'zip' if depth else 'csv'}", data)
            data = buffer.getvalue()
        return pd.DataFrame({"path": [f"{name}.zip"], "content": [data]})

    current, rows = None, []
    for pdf in batches:
        for name, line in zip(pdf["file"], pdf["line"], strict=True):
            if name != current and current is not None:
                yield packed(current, rows)
                rows = []
            current = name
            rows.append(line)
    if current is not None:
        yield packed(current, rows)


@query(
    "s2_read_zip",
    """SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y/%m/%d %H:%M:%S') AS settlementdate, 'U-' || user_id AS duid,
            value AS scadavalue FROM events WHERE event_id % 20 < 10""",
)
def _zip(t: Tables):
    lines = report_lines(t).repartition(8, "file").sortWithinPartitions("file", "row").select("file", "line")
    zips = lines.mapInPandas(_pack, "path string, content binary")
    records = R.parse_report(R.unzip_lines(zips))
    rows = R.report_table(records, "dispatch_unit_scada", ["settlementdate", "duid", "scadavalue"], keep=[])
    return rows.withColumn("scadavalue", F.col("scadavalue").cast("double"))
