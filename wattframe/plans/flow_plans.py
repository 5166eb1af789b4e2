"""Flows between regions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from wattframe.operators import flows as X
from wattframe.operators.enrich import region_intensity
from wattframe.plans.catalog import query
from wattframe.plans.enrich_plans import _EDGES
from wattframe.plans.tables import END, START, Tables

_TURNED = f"""{_EDGES}, turned AS (
        SELECT interval, CASE WHEN energy < 0 THEN b ELSE a END AS a, CASE WHEN energy < 0 THEN a ELSE b END AS b,
            abs(energy) AS energy FROM edges)"""


def _edges(t: Tables):
    return X.edge_energy(t.signed().filter(~F.col("is_forecast")), t.units())


@query(
    "f1_edge_energy",
    f"""WITH {_EDGES} SELECT interval, a AS interconnector_region_from, b AS interconnector_region_to,
            round(energy, 6) AS energy FROM edges""",
)
def _edge_energy(t: Tables):
    return _edges(t).withColumn("energy", F.round("energy", 6))


@query(
    "f2_normalise_edges",
    f"""WITH {_TURNED} SELECT interval, a AS interconnector_region_from, b AS interconnector_region_to,
            round(energy, 6) AS energy FROM turned""",
)
def _normalise(t: Tables):
    return X.normalise_edges(_edges(t)).withColumn("energy", F.round("energy", 6))


@query(
    "f3_region_flows",
    f"""WITH {_TURNED} SELECT interval, network_region, round(sum(im), 6) AS energy_imports, round(sum(ex), 6) AS energy_exports
        FROM (SELECT interval, a AS network_region, 0 AS im, energy AS ex FROM turned
            UNION ALL SELECT interval, b, energy, 0 FROM turned) GROUP BY 1, 2""",
)
def _region(t: Tables):
    return X.region_flows(_edges(t)).withColumns({c: F.round(c, 6) for c in ("energy_imports", "energy_exports")})


_SIMPLE = f"""WITH {_TURNED},
        i AS (SELECT interval, network_region, CASE WHEN sum(energy) > 0 THEN sum(emissions) / sum(energy) ELSE 0 END AS k
            FROM x_ui WHERE network_id = 'NEM' AND generated > 0 AND fueltech_id <> 'battery_charging' GROUP BY 1, 2),
        carried AS (SELECT t.*, energy * coalesce(k, 0) AS emissions FROM turned t
            LEFT JOIN i ON i.interval = t.interval AND i.network_region = t.a)
        SELECT interval, network_region, round(sum(im), 6) AS energy_imports, round(sum(ex), 6) AS energy_exports,
            round(sum(eim), 6) AS emissions_imports, round(sum(eex), 6) AS emissions_exports
        FROM (SELECT interval, a AS network_region, 0 AS im, energy AS ex, 0 AS eim, emissions AS eex FROM carried
            UNION ALL SELECT interval, b, energy, 0, emissions, 0 FROM carried) GROUP BY 1, 2"""
_FOUR = ("energy_imports", "energy_exports", "emissions_imports", "emissions_exports")


@query("f4_flow_emissions", _SIMPLE)
def _simple(t: Tables):
    out = X.flow_emissions(_edges(t), region_intensity(t.ui()))
    return out.withColumns({c: F.round(c, 6) for c in _FOUR})


def _mix_sql(regions=X.NEM_REGIONS) -> str:
    """The system of each interval solved by elimination; a region without supply has no intensity.

    No pivoting is needed: every diagonal is at least the sum of its row's other entries.
    """
    n = range(len(regions))
    supply = [f"sum(CASE WHEN r = '{regions[i]}' THEN own ELSE 0 END) + sum(CASE WHEN b = '{regions[i]}' THEN energy ELSE 0 END)" for i in n]
    flow = {(i, j): f"sum(CASE WHEN a = '{regions[j]}' AND b = '{regions[i]}' THEN energy ELSE 0 END)" for i in n for j in n if i != j}
    cells = [f"{supply[i]} AS a{i}{i}" for i in n] + [f"-({v}) AS a{i}{j}" for (i, j), v in flow.items()]
    cells += [f"sum(CASE WHEN r = '{regions[i]}' THEN emitted ELSE 0 END) AS b{i}" for i in n]
    steps = [f"""e0 AS (SELECT interval, {", ".join(cells)} FROM (
            SELECT interval, network_region AS r, own, emitted, NULL AS a, NULL AS b, 0 AS energy FROM g
            UNION ALL SELECT interval, NULL, 0, 0, a, b, energy FROM turned) GROUP BY interval)"""]
    for k in n:
        share = {i: f"CASE WHEN a{k}{k} > 1e-9 THEN a{i}{k} / a{k}{k} ELSE 0 END" for i in n if i > k}
        kept = [f"a{i}{j}" for i in n for j in n if i <= k] + [f"b{i}" for i in n if i <= k]
        new = [f"a{i}{j} - ({share[i]}) * a{k}{j} AS a{i}{j}" for i in share for j in n] + [f"b{i} - ({share[i]}) * b{k} AS b{i}" for i in share]
        steps.append(f"e{k + 1} AS (SELECT interval, {', '.join(kept + new)} FROM e{k})")
    last = f"e{len(regions)}"
    for k in reversed(n):
        rest = "".join(f" - a{k}{j} * x{j}" for j in n if j > k)
        steps.append(f"y{k} AS (SELECT *, CASE WHEN a{k}{k} > 1e-9 THEN (b{k}{rest}) / a{k}{k} ELSE 0 END AS x{k} FROM {last})")
        last = f"y{k}"
    mix = " UNION ALL ".join(f"SELECT interval, '{regions[i]}' AS network_region, greatest(x{i}, 0) AS x FROM {last}" for i in n)
    return f"""WITH {_TURNED}, g AS (SELECT interval, network_region, sum(energy) AS own, sum(emissions) AS emitted
            FROM x_ui WHERE network_id = 'NEM' AND generated > 0 AND fueltech_id <> 'battery_charging' GROUP BY 1, 2),
        {", ".join(steps)}, mix AS ({mix}),
        ends AS (SELECT t.interval, t.a AS network_region, 0 AS im, energy AS ex, 0 AS eim, energy * x AS eex
                FROM turned t JOIN mix m ON m.interval = t.interval AND m.network_region = t.a
            UNION ALL SELECT t.interval, t.b, energy, 0, energy * x, 0
                FROM turned t JOIN mix m ON m.interval = t.interval AND m.network_region = t.a),
        s AS (SELECT interval, network_region, sum(im) AS im, sum(ex) AS ex, sum(eim) AS eim, sum(eex) AS eex FROM ends GROUP BY 1, 2)
        SELECT m.interval, m.network_region, round(coalesce(im, 0), 6) AS energy_imports, round(coalesce(ex, 0), 6) AS energy_exports,
            round(coalesce(eim, 0), 6) AS emissions_imports, round(coalesce(eex, 0), 6) AS emissions_exports
        FROM mix m LEFT JOIN s USING (interval, network_region) WHERE interval IN (SELECT interval FROM g)"""


@query("f5_flow_emissions_mix", _mix_sql())
def _mix(t: Tables):
    out = X.flow_emissions_mix(_edges(t), region_intensity(t.ui()))
    return out.withColumns({c: F.round(c, 6) for c in _FOUR})


@query(
    "f5_flow_balance",
    f"""WITH {_TURNED}, s AS (SELECT interval, network_region, sum(im) AS im, sum(ex) AS ex
            FROM (SELECT interval, a AS network_region, 0 AS im, energy AS ex FROM turned
                UNION ALL SELECT interval, b, energy, 0 FROM turned) GROUP BY 1, 2)
        SELECT interval, network_region, round(im, 6) AS energy_imports, round(ex, 6) AS energy_exports, true AS balanced
        FROM s WHERE (im > 0 OR ex > 0) AND interval IN (SELECT interval FROM x_ui
            WHERE network_id = 'NEM' AND generated > 0 AND fueltech_id <> 'battery_charging')""",
)
def _balance(t: Tables):
    """The mix solves its system: own and imported emissions are those of all supply at the intensity of the exports."""
    nodes = region_intensity(t.ui())
    out = X.flow_emissions_mix(_edges(t), nodes)
    rows = out.join(nodes.select("interval", "network_region", "energy", "emissions"), ["interval", "network_region"], "left")
    c = F.col
    mix = c("emissions_exports") / c("energy_exports")
    supply, emitted = F.coalesce("energy", F.lit(0.0)) + c("energy_imports"), F.coalesce("emissions", F.lit(0.0)) + c("emissions_imports")
    # Without a supply, or without exports to tell the mix by, there is nothing to check.
    open_ = (c("energy_exports") <= 0) | (supply <= 0)
    return rows.filter((c("energy_imports") > 0) | (c("energy_exports") > 0)).select(
        "interval",
        "network_region",
        F.round("energy_imports", 6).alias("energy_imports"),
        F.round("energy_exports", 6).alias("energy_exports"),
        (open_ | (F.abs(emitted - mix * supply) <= 1e-6 * F.greatest(F.lit(1.0), emitted))).alias("balanced"),
    )


@query("f6_solve_flows", _SIMPLE)
def _solve(t: Tables):
    out = X.solve_flows(_edges(t), region_intensity(t.ui()))
    return out.withColumns({c: F.round(c, 6) for c in _FOUR})


@query(
    "f7_topology",
    """SELECT DISTINCT interconnector_region_from, interconnector_region_to FROM x_units
        WHERE interconnector AND network_id = 'NEM'""",
)
def _topology(t: Tables):
    return X.topology(t.units())


@query(
    "f7_topology_regions",
    """WITH e AS (SELECT DISTINCT interconnector_region_from AS a, interconnector_region_to AS b FROM x_units
            WHERE interconnector AND network_id = 'NEM')
        SELECT r AS network_region, sum(i)::BIGINT AS flows_into, sum(o)::BIGINT AS flows_out_of
        FROM (SELECT a AS r, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e) GROUP BY 1""",
)
def _topology_regions(t: Tables):
    return X.topology_regions(X.topology(t.units()))


def _flow_sql(bucket: str, first: str, second: str) -> str:
    return f"""WITH s AS (SELECT {bucket} AS interval, network_region,
            coalesce(sum(energy_imports), 0) AS ei, coalesce(sum(energy_exports), 0) AS ee,
            coalesce(sum(emissions_imports), 0) AS mi, coalesce(sum(emissions_exports), 0) AS me
        FROM x_ms WHERE network_id = 'NEM' GROUP BY 1, 2)
        SELECT interval, network_region, round({first}, 6) AS {second}_imports{{u}}, round({first.replace("ei", "ee")}, 6) AS {second}_exports{{u}},
            round(mi, 6) AS emissions_imports, round(me, 6) AS emissions_exports,
            0::DOUBLE AS market_value_imports, 0::DOUBLE AS market_value_exports,
            CASE WHEN ei > 0 THEN round(mi / ei, 6) ELSE 0 END AS factor_imports,
            CASE WHEN ee > 0 THEN round(me / ee, 6) ELSE 0 END AS factor_exports FROM s"""


@query("f9_flow_power", _flow_sql("interval", "ei * 12", "power").replace("{u}", ""))
def _power(t: Tables):
    out = X.flow_power(t.ms())
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("interval", "network_region")})


@query("f10_flow_energy", _flow_sql("date_trunc('day', interval)::TIMESTAMP", "ei / 1000", "energy").replace("{u}", "_gwh"))
def _energy(t: Tables):
    out = X.flow_energy(t.ms(), "1d")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("interval", "network_region")})


@query(
    "f11_net_interchange_split",
    """WITH net AS (SELECT interval, network_region, max(net_interchange) AS net FROM x_market GROUP BY 1, 2)
        SELECT interval, network_region, CASE WHEN net < 0 THEN net ELSE 0 END AS imports, CASE WHEN net > 0 THEN net ELSE 0 END AS exports
        FROM (SELECT n.network_region, r.interval AS interval FROM (SELECT DISTINCT network_region FROM net) n,
                range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval))
            LEFT JOIN net USING (network_region, interval)""",
)
def _net(t: Tables):
    return X.net_interchange_split(t.market(), START, END)


_EDGE_POWER = """WITH p AS (
            SELECT date_trunc('hour', interval)::TIMESTAMP AS interval,
                interconnector_region_from || '->' || interconnector_region_to AS flow, round(sum(generated), 2) AS power
            FROM x_signed JOIN x_units USING (unit_code) WHERE interconnector GROUP BY 1, 2),
        g AS (SELECT flow, r.interval AS interval FROM (SELECT DISTINCT flow FROM p),
            range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) AS r(interval))"""


def _edge_power(t: Tables):
    out = X.edge_power(t.signed(), t.units(), START, END, timedelta(hours=1))
    return out.withColumn("power", F.round("power", 2))


@query("f12_edge_power", f"{_EDGE_POWER} SELECT interval, flow, power FROM g LEFT JOIN p USING (flow, interval)")
def _named(t: Tables):
    return _edge_power(t).select("interval", "flow", "power")


@query(
    "f12_invert_flow",
    f"""{_EDGE_POWER} SELECT interval, split_part(flow, '->', 2) || '->' || split_part(flow, '->', 1) AS flow,
            CASE WHEN power <> 0 THEN -power END AS power FROM g LEFT JOIN p USING (flow, interval)""",
)
def _inverted(t: Tables):
    return X.invert_flow(_edge_power(t)).select("interval", "flow", "power")
