"""Joins, panel aggregates, windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, day, int4, num, nums, query, whole
from catalog.cleaning import CLEAN_COMPLAINTS, RAW, season_sql
from catalog.standins import (
    AS_OF, BUILDING_STATS, BUILDINGS, COMPLAINTS, DENSE, FIRST_BOROUGH, INSPECTIONS, MASTER, MASTER_SQL, PANEL_SQL, REGIONS, VIOLATIONS,
    buildings, cells_sql, complaints, grid_sql, inspections, master, panel, raw_buildings, raw_complaints, raw_inspections,
)
from placewise.operators import features as W
from placewise.operators import panel as P
from placewise.operators.clean import dedup_key
from placewise.operators.position import split_by_date, split_by_position, split_per_class, with_position
from placewise.plans.master import create_master, dense_panel



def keyed(df, *cols):
    """Key columns with the date as a day, then the given ones."""
    return df.select("zip_code", F.to_date("date").alias("date"), *cols)


_CREATED = ", ".join([
    f"WITH {COMPLAINTS}", RAW, CLEAN_COMPLAINTS,
    f"""inspections AS (SELECT l_shipdate AS inspection_date, '100' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS zip_code
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('R', 'A'))""", VIOLATIONS,
    f"""buildings AS (SELECT '100' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS zip_code, CASE WHEN p_brand <> 'Brand#11' THEN CAST(5 * p_size AS DOUBLE) END AS building_age
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
      WHERE p_brand = 'Brand#11' OR 5 * p_size <= {AS_OF} - 1800)""", BUILDING_STATS,
    cells_sql().replace("FROM complaints", "FROM cleaned"), grid_sql().replace("FROM complaints", "FROM cleaned"),
    FIRST_BOROUGH.replace("FROM complaints", "FROM cleaned"), DENSE, MASTER,
])
_MASTER_COLS = f"zip_code, {day('date')}, borough, complaint_count, CAST(building_count AS BIGINT) AS building_count, {nums('avg_resolution_days restaurant_violations_nearby building_age_mean building_age_median old_building_pct')}"


@query("create_master", f"{_CREATED} SELECT {_MASTER_COLS} FROM master")
def create_master_query(t: Tables):
    table = create_master(raw_complaints(t), raw_inspections(t), raw_buildings(t), AS_OF, REGIONS)
    return table.withColumn("date", F.to_date("date"))


@query("join_left_one_key", f"{PANEL_SQL} SELECT zip_code, {day('date')}, complaint_count, borough FROM dense")
def join_left_one_key(t: Tables):
    rows = complaints(t)
    return keyed(dense_panel(rows).join(P.group_first(rows), "zip_code", "left"), "complaint_count", "borough")


@query("join_left_two_keys", f"{MASTER_SQL} SELECT zip_code, {day('date')}, {num('restaurant_violations_nearby')} FROM master")
def join_left_two_keys(t: Tables):
    return keyed(P.join_violations(panel(t), inspections(t)), "restaurant_violations_nearby")


@query("join_left_stats", f"{MASTER_SQL} SELECT zip_code, {day('date')}, {nums('building_age_mean building_age_median old_building_pct')}, building_count FROM master")
def join_left_stats(t: Tables):
    return keyed(P.join_buildings(panel(t), buildings(t)), "building_age_mean", "building_age_median", "old_building_pct", "building_count")


@query("cross_grid", f"WITH {COMPLAINTS}, {cells_sql()}, {grid_sql()} SELECT zip_code, {day('period')} FROM grid")
def cross_grid(t: Tables):
    return P.cross_grid(P.agg_location_period(complaints(t), keep_undated=True))


@query("agg_location_period", f"WITH {COMPLAINTS}, {cells_sql()} SELECT zip_code, {day('period')}, complaint_count, {num('avg_resolution_days')} FROM cells")
def agg_location_period(t: Tables):
    return P.agg_location_period(complaints(t))


@query("agg_location_week", f"WITH {COMPLAINTS}, {cells_sql('week')} SELECT zip_code, {day('period')}, complaint_count, {num('avg_resolution_days')} FROM cells")
def agg_location_week(t: Tables):
    return P.agg_location_period(complaints(t), freq="week")


@query("zero_fill_panel", f"{PANEL_SQL} SELECT zip_code, {day('date')}, complaint_count, {num('avg_resolution_days')} FROM dense")
def zero_fill_panel(t: Tables):
    return keyed(dense_panel(complaints(t)), "complaint_count", "avg_resolution_days")


@query("zero_fill_weekly", f"WITH {COMPLAINTS}, {cells_sql('week')}, {grid_sql('INTERVAL 7 DAY')}, {FIRST_BOROUGH}, {DENSE} SELECT zip_code, {day('date')}, complaint_count, {num('avg_resolution_days')} FROM dense")
def zero_fill_weekly(t: Tables):
    return keyed(dense_panel(complaints(t), freq="week"), "complaint_count", "avg_resolution_days")


@query("group_first", f"WITH {COMPLAINTS}, {FIRST_BOROUGH.replace('borough', 'status')} SELECT zip_code, status FROM first_status")
def group_first(t: Tables):
    return P.group_first(complaints(t, closed=False), value="status")


@query("group_size", f"WITH {INSPECTIONS}, {VIOLATIONS} SELECT zip_code, {day('period')}, violation_count FROM monthly")
def group_size(t: Tables):
    return P.monthly_violations(inspections(t))


@query("group_multi_stats", f"WITH {BUILDINGS}, {BUILDING_STATS} SELECT zip_code, building_count, {nums('building_age_mean building_age_median old_building_pct')} FROM bstats")
def group_multi_stats(t: Tables):
    return P.building_stats(buildings(t))


@query("trailing_sum", f"WITH {INSPECTIONS}, {VIOLATIONS} SELECT zip_code, {day('period')}, violation_count, {num('v', 'restaurant_violations_nearby')} FROM viol")
def trailing_sum(t: Tables):
    return P.trailing_sum(P.monthly_violations(inspections(t)))


@query("trailing_sum_calendar", f"""WITH {INSPECTIONS}, {VIOLATIONS} SELECT zip_code, {day('period')}, {num('''sum(violation_count) OVER (
  PARTITION BY zip_code ORDER BY year(period) * 12 + month(period) RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)''', 'restaurant_violations_nearby')} FROM monthly""")
def trailing_sum_calendar(t: Tables):
    return P.trailing_sum(P.monthly_violations(inspections(t)), by_calendar=True).drop("violation_count")


_W = "OVER (PARTITION BY zip_code ORDER BY date)"
_LAGS = [1, 2, 3, 4, 12]
_WINDOWS = [3, 6, 12]


def _frame(k: int) -> str:
    return f"OVER (PARTITION BY zip_code ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _panel_window(cols: str) -> str:
    return f"{PANEL_SQL} SELECT zip_code, {day('date')}, {cols} FROM dense"


@query("lag_features", _panel_window(", ".join(whole(f"lag(complaint_count, {k}) {_W}", f"lag_{k}") for k in _LAGS)))
def lag_features(t: Tables):
    df = panel(t)
    cols = W.lag_columns(F.col("complaint_count"), W.location_window())
    return keyed(df.withColumns(cols), *cols)


def _rolling(stat: str):
    def run(t: Tables):
        cols = {n: c for n, c in W.rolling_columns(F.col("complaint_count"), W.location_window()).items() if n.startswith(f"rolling_{stat}_")}
        return keyed(panel(t).withColumns(cols), *cols)

    return run


query("rolling_mean", _panel_window(", ".join(num(f"avg(complaint_count) {_frame(k)}", f"rolling_mean_{k}") for k in _WINDOWS)))(_rolling("mean"))
query("rolling_std", _panel_window(", ".join(num(f"stddev_samp(complaint_count) {_frame(k)}", f"rolling_std_{k}") for k in _WINDOWS)))(_rolling("std"))
query("rolling_max", _panel_window(", ".join(whole(f"max(complaint_count) {_frame(k)}", f"rolling_max_{k}") for k in _WINDOWS)))(_rolling("max"))


def _trend(name: str):
    def run(t: Tables):
        cols = W.trend_columns(F.col("complaint_count"), W.location_window())
        return keyed(panel(t).withColumn(name, cols[name]), name)

    return run


query("mom_change", _panel_window(whole(f"complaint_count - lag(complaint_count) {_W}", "mom_change")))(_trend("mom_change"))
query("yoy_change", _panel_window(whole(f"complaint_count - lag(complaint_count, 12) {_W}", "yoy_change")))(_trend("yoy_change"))
query("mom_pct_change", _panel_window(num(
    f"CASE WHEN lag(complaint_count) {_W} <> 0 THEN (complaint_count - lag(complaint_count) {_W}) / CAST(lag(complaint_count) {_W} AS DOUBLE) END", "mom_pct_change"
)))(_trend("mom_pct_change"))


@query("last_n_rows", f"{PANEL_SQL} SELECT zip_code, {day('date')}, complaint_count FROM (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY date DESC) AS rn FROM dense) WHERE rn <= 6")
def last_n_rows(t: Tables):
    return keyed(W.last_n_rows(panel(t), 6), "complaint_count")


_STEP_COLS = ["complaint_count", "avg_resolution_days"]


@query("sequences", f"""{PANEL_SQL}, r AS (SELECT *, row_number() {_W} AS rn FROM dense)
  SELECT a.zip_code, {day('a.date')}, CAST(b.rn - a.rn + 12 AS INTEGER) AS step, b.complaint_count, {num('coalesce(b.avg_resolution_days, -1)', 'avg_resolution_days')},
  {num('a.complaint_count', 'target')} FROM r a JOIN r b ON a.zip_code = b.zip_code AND b.rn BETWEEN a.rn - 12 AND a.rn - 1 WHERE a.rn > 12""")
def sequences(t: Tables):
    df = panel(t).fillna(-1.0, subset=["avg_resolution_days"])
    windows = W.sequences(df, _STEP_COLS)
    return keyed(windows.select("*", F.posexplode("seq").alias("step", "s")), "step", "s.*", "target")


@query("row_id", """SELECT o_orderkey, 'complaint_' || CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS VARCHAR) AS id FROM orders""")
def row_id(t: Tables):
    rows = with_position(t.orders.select("o_orderkey", "o_orderdate"), ["-o_orderdate", "o_orderkey"])
    return rows.select("o_orderkey", F.concat(F.lit("complaint_"), (F.col("position") - 1).cast("string")).alias("id"))


@query("union_pages", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'")
def union_pages(t: Tables):
    cols = ["l_orderkey", "l_linenumber"]
    return t.lineitem.where("l_returnflag = 'R'").select(*cols).unionByName(t.lineitem.where("l_returnflag <> 'R'").select(*cols))


@query("split_chronological", f"""{PANEL_SQL}, c AS (SELECT date, sum(count(*)) OVER (ORDER BY date) AS upto, sum(count(*)) OVER () AS n FROM dense GROUP BY date)
  SELECT zip_code, {day('d.date', 'date')}, CASE WHEN upto <= floor(n * 0.7) THEN 'train' WHEN upto <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM dense d JOIN c ON d.date = c.date""")
def split_chronological(t: Tables):
    return keyed(split_by_date(panel(t)), "split")


def _positional(order: str) -> str:
    return f"""{PANEL_SQL}, r AS (SELECT zip_code, date, row_number() OVER (ORDER BY {order}) AS p, count(*) OVER () AS n FROM dense)
  SELECT zip_code, {day('date')}, CASE WHEN p <= floor(n * 0.7) THEN 'train' WHEN p <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM r"""


@query("split_chronological_exact", _positional("date, zip_code"))
def split_chronological_exact(t: Tables):
    return keyed(split_by_position(panel(t), ["date", "zip_code"]), "split")


@query("split_positional", _positional("zip_code, date"))
def split_positional(t: Tables):
    return keyed(split_by_position(panel(t), ["zip_code", "date"]), "split")


@query("split_per_class", """SELECT vec_id, label, CASE WHEN p <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split
  FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""")
def split_classes(t: Tables):
    return split_per_class(t.embeddings.select("vec_id", "label"), "label", ["vec_id"]).drop("position")


@query("sort_keys", f"{PANEL_SQL} SELECT zip_code, {day('date')}, complaint_count FROM dense ORDER BY zip_code, date")
def sort_keys(t: Tables):
    return keyed(panel(t), "complaint_count").orderBy("zip_code", "date")
