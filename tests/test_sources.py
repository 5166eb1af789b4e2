import io
import json
import zipfile
from datetime import datetime

import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from wattframe.operators.ingest import process_tables
from wattframe.sources import feeds as S
from wattframe.sources import reports as R
from wattframe.sources import sinks as W

REPORT = """C,NEMP.WORLD,DISPATCHIS,AEMO
D,DISPATCH,EARLY,1,before any table
I,DISPATCH,UNIT_SCADA,1,SETTLEMENTDATE,DUID,SCADAVALUE
D,DISPATCH,UNIT_SCADA,1,"2024/01/01 00:05:00", bw01 ,600.5
D,DISPATCH,UNIT_SCADA,1,"2024/01/01 00:05:00",BW02
X,what,is,this
D,DISPATCH,UNIT_SCADA,1,"2024/01/01 00:10:00","BW,02",10

I,TRADING,PRICE,2,SETTLEMENTDATE,REGIONID,RRP
D,TRADING,PRICE,2,"2024/01/01 00:05:00",NSW1,"-12.5"
D,TRADING,PRICE,2,"2024/01/01 00:05:00",VIC1,
C,"END OF REPORT",11
"""


def test_report_reader(spark, tmp_path):
    (tmp_path / "PUBLIC_A_202401010005.CSV").write_text(REPORT)
    (tmp_path / "PUBLIC_B_202401010010.CSV").write_text(REPORT.replace("bw01", "bw03"))
    tables = R.read_multi_table(spark, str(tmp_path))
    assert sorted(tables) == ["dispatch_unit_scada", "trading_price"]
    scada = rows(tables["dispatch_unit_scada"].select("duid", "scadavalue"))
    assert scada == sorted([("BW01", "600.5"), ("BW03", "600.5"), ("BW,02", "10"), ("BW,02", "10")], key=repr)
    only = R.read_multi_table(spark, str(tmp_path), ["trading"])
    assert list(only) == ["trading_price"] and only["trading_price"].count() == 4


def test_report_split_over_many_tasks(spark, tmp_path):
    """A file read in small pieces gives the same records."""
    body = ["I,A,ONE,1,X,Y"] + [f"D,A,ONE,1,{i},a" for i in range(3000)]
    body += ["I,A,TWO,1,X,Y,Z"] + [f"D,A,TWO,1,{i},b,c" for i in range(3000)]
    (tmp_path / "big.csv").write_text("\n".join(body))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        lines = R.read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        got = R.parse_report(lines).groupBy("table").agg(F.count(F.lit(1)), F.sum(F.col("values")[0].cast("int"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(tuple(r) for r in got) == [("a_one", 3000, 4498500), ("a_two", 3000, 4498500)]


def test_zip_reader_opens_nested_zips(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.CSV", REPORT.replace("bw01", "deep1"))
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("top.csv", REPORT)
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("readme.txt", "D,not,a,report")
    tables = R.read_zip(spark, str(tmp_path))
    duids = {r.duid for r in tables["dispatch_unit_scada"].collect()}
    assert duids == {"BW01", "DEEP1", "BW,02"}


def test_members_of_one_archive_go_to_many_tasks(spark, tmp_path):
    def packed(members, how=zipfile.ZIP_DEFLATED):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", how) as z:
            for name, data in members.items():
                z.writestr(name, data)
        return buffer.getvalue()

    reports = {f"d{i}.csv": "I,A,T,1,X,Y\n" + "".join(f"D,A,T,1,{i},{j}\n" for j in range(50 + i)) for i in range(30)}
    days = {f"day{i}.zip": packed({f"h{i}.csv": f"I,A,T,1,X,Y\nD,A,T,1,{100 + i},0\n"}) for i in range(20)}
    deep = packed({"x.zip": packed({"y.zip": packed({"z.csv": "I,A,T,1,X,Y\nD,A,T,1,999,0\n"}, zipfile.ZIP_BZIP2)})}, zipfile.ZIP_STORED)
    (tmp_path / "all.zip").write_bytes(packed({**reports, **days, "deep.zip": deep, "empty.csv": "", "none.zip": packed({})}))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        lines = R.read_zip_lines(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() > 3
        got = R.parse_report(lines).groupBy(F.col("values")[0].cast("int").alias("x")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {i: 50 + i for i in range(30)} | {100 + i: 1 for i in range(20)} | {999: 1}
    assert {r.x: r["count"] for r in got} == want


def test_a_member_is_read_in_steps_and_checked(tmp_path):
    data = b"".join(b"D,A,T,1,%d\n" % i for i in range(300_000))
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.csv", data)
    ((_, _, method, crc, content),) = R._members("big", (tmp_path / "big.zip").read_bytes())
    assert R._Inflated(content, method, crc).readall() == data
    assert len(R._Inflated(content, method, crc).read(1000)) == 1000
    with pytest.raises(zipfile.BadZipFile):
        R._Inflated(content, method, crc + 1).readall()
    with pytest.raises(zipfile.BadZipFile):
        R._Inflated(content[: len(content) // 2], method, crc).readall()


def test_reports_feed_the_processors(spark, tmp_path):
    (tmp_path / "r.csv").write_text(REPORT)
    tables = R.read_multi_table(spark, str(tmp_path))
    feeds = process_tables(tables, "row")
    got = rows(feeds["dispatch_unit_scada"].select("unit_code", "generated", "energy"))
    assert got == sorted([("BW01", 600.5, 600.5 / 12), ("BW,02", 10.0, 10.0 / 12)], key=repr)


def test_layouts_of_one_table_are_merged(spark, tmp_path):
    (tmp_path / "old.csv").write_text("I,A,T,1,X\nD,A,T,1,1\n")
    (tmp_path / "new.csv").write_text("I,A,T,2,X,Y\nD,A,T,2,2,b\n")
    table = R.read_multi_table(spark, str(tmp_path))["a_t"]
    assert rows(table.select("x", "y")) == sorted([("1", None), ("2", "b")], key=repr)


def test_filenames(spark):
    names = ["PUBLIC_DVD_DISPATCHREGIONSUM_202408010000.zip", "PUBLIC_ARCHIVE#DISPATCHREGIONSUM#FILE01#202408010000.zip", "PUBLIC_DISPATCHIS_20240801000500_0000000123456789.zip", "nothing.txt"]
    df = frame(spark, "n string", *[(n,) for n in names]).select(R.parse_report_filename("n").alias("f")).select("f.*")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("PUBLIC_DVD_DISPATCHREGIONSUM", datetime(2024, 8, 1), None)
    assert got[1] == ("PUBLIC_ARCHIVE#DISPATCHREGIONSUM#FILE01", datetime(2024, 8, 1), None)
    assert got[2] == ("PUBLIC_DISPATCHIS", datetime(2024, 8, 1, 0, 5), "0000000123456789")
    assert got[3] == (None, None, None)


def test_facility_csv(spark, tmp_path):
    head = "Trading Date,Interval Number,Trading Interval,Participant Code,Facility Code,Energy Generated (MWh),EOI Quantity (MW),Extracted At\n"
    body = "".join(f"2013-01-01,{i},2013-01-01 {8 + i // 2:02d}:{i % 2 * 30:02d}:00,P,FAC,{5 * i}.0,,x\n" for i in range(4))
    (tmp_path / "f.csv").write_text(head + body)
    got = rows(S.read_facility_csv(spark, str(tmp_path)).select("trading_interval", "generated", "energy", "interval_minutes"), "trading_interval")
    assert [g[1:] for g in got] == [(10.0 * i, 5.0 * i, 30) for i in range(4)]


def test_dispatch_json(spark, tmp_path):
    run = {
        "dispatchInterval": "2024-05-01T08:00:00+08:00",
        "prices": {"energy": "oops"},
        "schedule": [
            {"marketService": "regulation", "facilitySchedule": [{"facilityCode": "NO", "quantity": 1}]},
            {"marketService": "energy", "facilitySchedule": [{"facilityCode": "A", "quantity": 24}, {"facilityCode": "B"}]},
        ],
    }
    ahead = {**run, "dispatchInterval": "2024-05-01T08:05:00+08:00", "prices": {"energy": 55.5}}
    (tmp_path / "a.json").write_text(json.dumps({"primaryDispatchInterval": run["dispatchInterval"], "solutionData": [run, ahead]}))
    (tmp_path / "b.json").write_text(json.dumps({"primaryDispatchInterval": ahead["dispatchInterval"], "solutionData": [{**ahead, "schedule": []}]}))
    scada, price = S.read_dispatch_json(spark, str(tmp_path))
    when = datetime(2024, 5, 1, 8)
    assert rows(scada.select("interval", "unit_code", "generated", "energy")) == [(when, "A", 24.0, 2.0), (when, "B", 0.0, 0.0)]
    assert rows(price.select("interval", "price_dispatch")) == [(datetime(2024, 5, 1, 8, 5), 55.5)]


def test_price_json_needs_a_full_day(spark, tmp_path):
    entry = lambda i, p: {"tradingInterval": f"2024-05-01T{i // 2:02d}:{i % 2 * 30:02d}:00+08:00", "referenceTradingPrice": p}
    (tmp_path / "full.json").write_text(json.dumps({"referenceTradingPrices": [entry(i, 0 if i == 3 else i + 1.0) for i in range(48)]}))
    (tmp_path / "short.json").write_text(json.dumps({"referenceTradingPrices": [entry(i, 9.0) for i in range(47)]}))
    got = S.read_price_json(spark, str(tmp_path))
    assert got.count() == 47 and got.filter("price = 9.0").count() == 1


def test_rooftop_by_postcode(spark):
    doc = json.dumps({"performance": {"20": {"2024-01-01T10:00:00": 50, "2024-01-01T10:15:00": 10}, "21": {"2024-01-01T10:00:00": 100}, "39": {"2024-01-01T10:00:00": 1}, "9x": {"t": 1}}, "capacity": {"20": 10, "21": 4, "9x": 3}, "installations": {"nsw": 77}})
    df = frame(spark, "value string", (doc,))
    got = rows(S.rooftop_from_postcode(df), "interval")
    assert got == [("NSW", at(600), 9.0, 2.25), ("NSW", at(615), 1.0, 0.25)]
    assert [tuple(r) for r in S.rooftop_state_capacity(df).collect()] == [("NSW", 14.0, 77)]


def test_monthly_bins_accumulate(spark):
    bins = ", ".join(f"`{b}` double" for b in S.CAPACITY_BINS)
    df = frame(spark, f"state string, month string, {bins}", ("nsw", "2024-02", *[1000.0] * 9), ("nsw", "2024-01", *[500.0] * 9))
    got = rows(S.rooftop_capacity_monthly(df).select("month", "capacity_registered"), "month")
    assert got == [(datetime(2024, 1, 1), 4.5), (datetime(2024, 2, 1), 13.5)]


def test_pollution_xml(spark, tmp_path):
    (tmp_path / "n.xml").write_text(
        "<reports><report><facility_name>Big</facility_name><jurisdiction_facility_id>7</jurisdiction_facility_id><year>2020</year>"
        "<emissions><emission><substance>Lead</substance><destination>Air Total</destination><quantity_in_kg>1,234.5</quantity_in_kg>"
        "<direct_measurement_estimation>true</direct_measurement_estimation></emission>"
        "<emission><substance>Lead</substance><destination>Water</destination><quantity_in_kg>n/a</quantity_in_kg></emission></emissions></report>"
        "<report><facility_name>No id</facility_name><emissions><emission><substance>X</substance><destination>Air</destination>"
        "<quantity_in_kg>1</quantity_in_kg></emission></emissions></report></reports>"
    )
    got = S.read_pollution_xml(spark, str(tmp_path)).collect()
    assert len(got) == 1
    assert (got[0]["name"], got[0].quantity_kg, got[0].report_year, got[0].direct_measurement, got[0].mass_balance) == ("Lead", 1234.5, 2020, True, False)


def test_stat_csv(spark, tmp_path):
    (tmp_path / "g1.csv").write_text("G1 CONSUMER PRICES\nTitle,a,b\nSeries ID,OTHER,GCPIAG\n31/03/2023,1,2.5\n30/06/2023,1,\nbad,1,2\n30/09/2023,1,3.25\n")
    assert rows(S.read_stat_csv(spark, str(tmp_path), "GCPIAG").select("stat_date", "value"), "stat_date") == [(datetime(2023, 3, 31), 2.5), (datetime(2023, 9, 30), 3.25)]
    late = S.read_stat_csv(spark, str(tmp_path), "GCPIAG", after=datetime(2023, 6, 1))
    assert late.count() == 1


def test_observations(spark, tmp_path):
    doc = {"observations": {"header": [{"state_time_zone": "NSW"}], "data": [{"aifstime_utc": "20240101000000", "air_temp": 20.5, "cloud": "-"}, {"aifstime_utc": "20240101003000", "air_temp": None}]}}
    (tmp_path / "066037.json").write_text(json.dumps(doc))
    got = S.read_observations(spark, str(tmp_path)).collect()
    assert [(r.station_id, r.state, r.observation_time, r.temp_air, r.cloud) for r in got] == [("066037", "NSW", at(0), 20.5, None)]


def test_fact_writer_replaces_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "fact")
    df = frame(spark, "interval timestamp_ntz, v double", (datetime(2024, 1, 1), 1.0), (datetime(2024, 2, 1), 2.0))
    W.write_fact(df, path)
    W.write_fact(frame(spark, "interval timestamp_ntz, v double", (datetime(2024, 2, 2), 3.0)), path)
    assert rows(W.read_fact(spark, path)) == [(datetime(2024, 1, 1), 1.0), (datetime(2024, 2, 2), 3.0)]
    cut = W.read_fact(spark, path, datetime(2024, 2, 1), datetime(2024, 3, 1))
    assert cut.count() == 1 and "yyyymm" in cut._jdf.queryExecution().executedPlan().toString()


def test_series_tree(spark, tmp_path):
    df = frame(spark, "stat string, region string, v double", ("power", "NSW1", 1.0), ("power", "VIC1", 2.0))
    W.write_series(df, str(tmp_path / "out"), ["stat", "region"])
    assert (tmp_path / "out" / "stat=power" / "region=NSW1").is_dir()


def test_a_pollution_file_holds_many_reports(spark):
    import pyarrow as pa

    from wattframe.plans.source_plans import REPORTS, _report_files

    def report(n):
        emission = f"<emission><substance>S</substance><destination>Air</destination><quantity_in_kg>{n}</quantity_in_kg></emission>"
        return f"<report><facility_name>F</facility_name><jurisdiction_facility_id>N{n}</jurisdiction_facility_id><emissions>{emission}</emissions></report>"

    rows = [report(n) for n in range(2 * REPORTS + 1)] + [None]
    files = [f for b in _report_files([pa.RecordBatch.from_arrays([pa.array(rows)], ["value"])]) for f in b.column(0).to_pylist()]
    assert len(files) == 3 and not list(_report_files([]))
    got = S.parse_pollution(S.split_reports(spark.createDataFrame([(f,) for f in [*files, None]], "value string"))).collect()
    assert sorted(r.quantity_kg for r in got) == [float(n) for n in range(2 * REPORTS + 1)]
    assert {r.npi_facility_id for r in got} == {f"N{n}" for n in range(2 * REPORTS + 1)}
