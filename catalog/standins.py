"""The given tables in the shape of the domain's inputs, as DataFrames and as SQL.

Clean stand-ins: orders act as complaints, returned lines as inspections, part sizes as buildings.
Raw stand-ins carry the same data as messy text, to exercise the cleaners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.base import Tables
from placewise.functions.dates import resolution_days
from placewise.operators.panel import join_buildings, join_violations
from placewise.plans.master import MASTER_COLUMNS, dense_panel
from placewise.session import materialize

AS_OF = 2025
# Mapping used by the raw stand-in; 'MIDDLE EAST' is left out on purpose where a miss is wanted.
REGIONS = {"AFRICA": "Africa", "AMERICA": "America", "ASIA": "Asia", "EUROPE": "Europe", "MIDDLE EAST": "Middle East"}
BAD_ZIP_BELOW = -900


def complaints(t: Tables, closed: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    base = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    cols = [
        F.col("o_orderkey").cast("string").alias("unique_key"),
        F.col("o_orderdate").alias("created_date"),
        F.col("c_nationkey").cast("string").alias("zip_code"),
        F.col("r_name").alias("borough"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("descriptor"),
        *extra,
    ]
    if not closed:
        return base.select(*cols)
    ship = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed_date"))
    return base.join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        *cols, "closed_date", resolution_days(F.col("o_orderdate"), F.col("closed_date")).alias("resolution_days")
    )


def inspections(t: Tables) -> DataFrame:
    return (
        t.lineitem.where(F.col("l_returnflag") == "R")
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("l_shipdate").alias("inspection_date"), F.col("s_nationkey").cast("string").alias("zip_code"))
    )


def buildings(t: Tables) -> DataFrame:
    return (
        t.lineitem.select("l_suppkey", "l_partkey").distinct()
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("s_nationkey").cast("string").alias("zip_code"), (2.0 * F.col("p_size")).alias("building_age"))
    )


def panel(t: Tables) -> DataFrame:
    return dense_panel(complaints(t), tag="borough")


def master(t: Tables) -> DataFrame:
    """The panel with its context, stored once, as its users read it several times."""
    joined = join_buildings(join_violations(panel(t), inspections(t)), buildings(t))
    return materialize(joined.select(*MASTER_COLUMNS))


def raw_complaints(t: Tables) -> DataFrame:
    c = complaints(t, extra=("o_totalprice", "c_acctbal"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return c.select(
        F.col("unique_key").alias("Unique Key"),
        F.when(F.col("descriptor") == "2-HIGH", "unknown").otherwise(F.date_format("created_date", stamp)).alias("Created Date"),
        F.date_format("closed_date", stamp).alias("Closed Date"),
        F.when(F.col("status") == "O", F.lower("borough")).otherwise(F.col("borough")).alias("Borough"),
        F.when(F.col("c_acctbal") < BAD_ZIP_BELOW, "N/A")
        .otherwise(F.concat(F.lit("100"), F.lpad("zip_code", 2, "0"), F.lit("-0001"))).alias("Incident Zip"),
        (40.3 + F.col("o_totalprice") / 490001).cast("string").alias("Latitude"),
        F.when(F.col("status") == "P", "").otherwise((-74.0 + F.col("c_acctbal") / 25000).cast("string")).alias("Longitude"),
        F.col("descriptor").alias("Descriptor"),
        F.col("status").alias("Status"),
    )


def raw_inspections(t: Tables) -> DataFrame:
    words = (
        F.when(F.col("l_returnflag") == "R", "Evidence of MICE or live mice")
        .when(F.col("l_returnflag") == "A", "Food temperature not held").otherwise(F.lit(None).cast("string"))
    )
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("INSPECTION DATE"),
        F.when(F.col("l_linestatus") == "F", "04L").otherwise("10F").alias("VIOLATION CODE"),
        words.alias("VIOLATION DESCRIPTION"),
        F.concat(F.lit("100"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit(".0")).alias("ZIPCODE"),
        (F.col("s_nationkey") % 6).cast("string").alias("BORO"),
    )


def raw_buildings(t: Tables) -> DataFrame:
    year = AS_OF - 5 * F.col("p_size")
    return (
        t.lineitem.select("l_suppkey", "l_partkey").distinct()
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.when(F.col("p_brand") == "Brand#11", "n/a").otherwise(year.cast("string")).alias("YearBuilt"),
            F.concat(F.lit("100"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("ZipCode"),
        )
    )


_DAYS = "date_diff('microsecond', created_date, closed_date) / CAST(86400000000 AS DOUBLE)"

COMPLAINTS = f"""complaints AS (
  SELECT *, CASE WHEN closed_date IS NULL OR created_date IS NULL THEN NULL
                 WHEN closed_date < created_date THEN CAST(0 AS DOUBLE) ELSE {_DAYS} END AS resolution_days
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, o_orderdate AS created_date, closed_date,
               CAST(c_nationkey AS VARCHAR) AS zip_code, r_name AS borough, o_orderstatus AS status,
               o_orderpriority AS descriptor, o_totalprice, c_acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed_date FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey))"""

INSPECTIONS = """inspections AS (
  SELECT l_shipdate AS inspection_date, CAST(s_nationkey AS VARCHAR) AS zip_code
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R')"""

BUILDINGS = """buildings AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS zip_code, CAST(2 * p_size AS DOUBLE) AS building_age
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey)"""


def cells_sql(freq: str = "month") -> str:
    return f"""cells AS (
  SELECT zip_code, CAST(date_trunc('{freq}', created_date) AS DATE) AS period, count(unique_key) AS complaint_count,
         avg(resolution_days) AS avg_resolution_days
  FROM complaints WHERE created_date IS NOT NULL GROUP BY 1, 2)"""


def grid_sql(step: str = "INTERVAL 1 MONTH") -> str:
    return f"""places AS (SELECT DISTINCT zip_code FROM complaints),
periods AS (SELECT CAST(unnest(generate_series(min(period), max(period), {step})) AS DATE) AS period FROM cells),
grid AS (SELECT zip_code, period FROM places CROSS JOIN periods)"""


FIRST_BOROUGH = """first_borough AS (
  SELECT zip_code, borough FROM (
    SELECT zip_code, borough, row_number() OVER (PARTITION BY zip_code ORDER BY created_date DESC NULLS LAST, borough DESC) AS rn
    FROM complaints WHERE borough IS NOT NULL) WHERE rn = 1)"""

DENSE = """dense AS (
  SELECT g.zip_code, g.period, CAST(g.period AS TIMESTAMP) AS date, f.borough,
         CASE WHEN c.zip_code IS NULL THEN 0 ELSE c.complaint_count END AS complaint_count,
         CASE WHEN c.zip_code IS NULL THEN 0 ELSE c.avg_resolution_days END AS avg_resolution_days
  FROM grid g LEFT JOIN cells c ON g.zip_code = c.zip_code AND g.period = c.period
  LEFT JOIN first_borough f ON g.zip_code = f.zip_code)"""

VIOLATIONS = """monthly AS (
  SELECT zip_code, CAST(date_trunc('month', inspection_date) AS DATE) AS period, count(*) AS violation_count
  FROM inspections WHERE zip_code IS NOT NULL AND inspection_date IS NOT NULL GROUP BY 1, 2),
viol AS (
  SELECT zip_code, period, violation_count, CAST(sum(violation_count) OVER (
    PARTITION BY zip_code ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS DOUBLE) AS v FROM monthly)"""

BUILDING_STATS = """bstats AS (
  SELECT zip_code, avg(building_age) AS building_age_mean, median(building_age) AS building_age_median,
         count(building_age) AS building_count, avg(CASE WHEN building_age > 50 THEN 1.0 ELSE 0.0 END) AS old_building_pct
  FROM buildings WHERE zip_code IS NOT NULL GROUP BY 1)"""

MASTER = """joined AS (
  SELECT d.*, coalesce(t.v, 0) AS restaurant_violations_nearby, b.building_age_mean AS bm, b.building_age_median AS bd,
         b.building_count, b.old_building_pct AS bo
  FROM dense d LEFT JOIN viol t ON d.zip_code = t.zip_code AND d.period = t.period
  LEFT JOIN bstats b ON d.zip_code = b.zip_code),
master AS (
  SELECT zip_code, date, borough, complaint_count, avg_resolution_days, restaurant_violations_nearby,
         coalesce(bm, (SELECT median(bm) FROM joined)) AS building_age_mean,
         coalesce(bd, (SELECT median(bd) FROM joined)) AS building_age_median, building_count,
         coalesce(bo, (SELECT median(bo) FROM joined)) AS old_building_pct
  FROM joined)"""

PANEL_SQL = "WITH " + ", ".join([COMPLAINTS, cells_sql(), grid_sql(), FIRST_BOROUGH, DENSE])
MASTER_SQL = ", ".join([PANEL_SQL, INSPECTIONS, VIOLATIONS, BUILDINGS, BUILDING_STATS, MASTER])
