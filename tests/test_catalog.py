"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module
from wattframe.plans.catalog import catalog

SF_DIR = "/root/testdata/sf0.001"

# One or two of every family; ALL_QUERIES=1 runs the lot.
SAMPLE = (
    "t1_bucket_sunday_week t1_bucket_financial_year g2_locf_created_gaps_only g6_locf_bounded g10_dense_series d1_latest_version "
    "s17_upsert_replace n1_to_telemetry n2_split_bidirectional n15_clamp_sum s7_unpivot_intervals x2_sigfig e1_trapezoid_energy "
    "e2_unit_intervals e5_market_summary e14_region_factor f4_flow_emissions f9_flow_power a1_energy_by_region_fueltech_1d "
    "a3_market_metrics_region_1d a12_market_daily a14_rebuild a21_rooftop_combined a27_weekly_mix a32_wide_export a36_pollution_series "
    "a40_energy_bundle j6_value_at q2_dropped_codes q9_list_facilities r1_detect_records_month r1_find_records r11_debounce_spaced "
    "r15_significance s1_report_unit_scada s8_dispatch_telemetry s13_pollution_xml st3_tumbling_rollup st4_upsert_last x8_to_series"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    q = catalog()[name]
    df = q.run(spark, SF_DIR)
    if q.sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, q.full_sql()) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns == ["interval", "network", "network_region", "fueltech", "power", "energy", "emissions", "market_value"]


def test_contract_functions():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    assert all(callable(q) for q in queries.values())
