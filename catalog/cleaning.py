"""Cleaners, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, day, int4, moment, num, nums, query
from catalog.standins import (
    AS_OF, BAD_ZIP_BELOW, COMPLAINTS, MASTER_SQL, PANEL_SQL, REGIONS, complaints, master, panel, raw_buildings, raw_complaints, raw_inspections,
)
from placewise.functions import columns as C
from placewise.functions.scoring import contributing_factors, positive_factors
from placewise.operators import clean
from placewise.operators.position import drop_first_n
from placewise.operators.texts import document_contains, metadata_equals
from placewise.functions.columns import fill_text, stringify_metadata

KNOWN_REGIONS = {k: v for k, v in REGIONS.items() if k != "MIDDLE EAST"}

RAW = """raw AS (SELECT *, '100' || lpad(zip_code, 2, '0') AS zip, CASE WHEN descriptor = '2-HIGH' THEN NULL ELSE created_date END AS made,
  CAST(40.3 AS DOUBLE) + o_totalprice / 490001 AS lat,
  CASE WHEN status <> 'P' THEN CAST(-74.0 AS DOUBLE) + c_acctbal / 25000 END AS lon FROM complaints)"""

_SEASON = """CASE WHEN month({d}) IN (12, 1, 2) THEN 'winter' WHEN month({d}) IN (3, 4, 5) THEN 'spring'
  WHEN month({d}) IN (6, 7, 8) THEN 'summer' WHEN month({d}) IN (9, 10, 11) THEN 'fall' END"""


def season_sql(d: str) -> str:
    return _SEASON.format(d=d)


def parts_sql(d: str) -> str:
    return ", ".join([
        int4(f"year({d})", "year"), int4(f"month({d})", "month"), int4(f"day({d})", "day"), int4(f"isodow({d}) - 1", "day_of_week"),
        int4(f"weekofyear({d})", "week_of_year"), int4(f"quarter({d})", "quarter"),
    ])


CLEAN_COMPLAINTS = f"""cleaned AS (SELECT unique_key, made AS created_date, closed_date, zip AS zip_code, lat AS latitude, lon AS longitude,
  CASE borough WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'America' WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe'
    WHEN 'MIDDLE EAST' THEN 'Middle East' END AS borough, descriptor, status,
  CASE WHEN made IS NULL OR closed_date IS NULL THEN NULL ELSE greatest(date_diff('microsecond', made, closed_date) / CAST(86400000000 AS DOUBLE), 0) END AS resolution_days
  FROM raw WHERE c_acctbal >= {BAD_ZIP_BELOW} AND lat BETWEEN 40.4 AND 41.0 AND lon BETWEEN -74.3 AND -73.6)"""


@query("clean_complaints", f"""WITH {COMPLAINTS}, {RAW}, {CLEAN_COMPLAINTS}
  SELECT unique_key, {moment('created_date')}, {moment('closed_date')}, borough, zip_code, {nums('latitude longitude resolution_days')}, descriptor, status,
  {parts_sql('created_date')}, {season_sql('created_date')} AS season FROM cleaned WHERE borough <> 'Middle East'""")
def clean_complaints(t: Tables):
    return clean.clean_complaints(raw_complaints(t), KNOWN_REGIONS).drop("incident_zip")


_RAW_INSPECTIONS = """inspected AS (SELECT l_shipdate, l_linestatus, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag IN ('R', 'A'))"""


@query("clean_inspections", f"""WITH {_RAW_INSPECTIONS} SELECT {day('l_shipdate', 'inspection_date')}, {int4('year(l_shipdate)', 'inspection_year')},
  {int4('month(l_shipdate)', 'inspection_month')}, CASE l_linestatus WHEN 'F' THEN '04L' ELSE '10F' END AS violation_code,
  '100' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS zip_code,
  CASE s_nationkey % 6 WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Brooklyn' WHEN 4 THEN 'Queens' WHEN 5 THEN 'Staten Island' END AS borough
  FROM inspected""")
def clean_inspections(t: Tables):
    # 'temperature' contains 'rat', so both kinds of text pass the substring filter
    out = clean.clean_inspections(raw_inspections(t))
    return out.select(F.to_date("inspection_date").alias("inspection_date"), "inspection_year", "inspection_month", "violation_code", "zip_code", "borough")


@query("clean_buildings", f"""WITH b AS (SELECT s_nationkey, p_size, p_brand FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
  SELECT '100' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS zip_code,
  {num(f"CASE WHEN p_brand <> 'Brand#11' THEN {AS_OF} - 5 * p_size END", 'year_built')}, {num("CASE WHEN p_brand <> 'Brand#11' THEN 5 * p_size END", 'building_age')}
  FROM b WHERE p_brand = 'Brand#11' OR 5 * p_size <= {AS_OF} - 1800""")
def clean_buildings(t: Tables):
    return clean.clean_buildings(raw_buildings(t), AS_OF).select("zip_code", "year_built", "building_age")


@query("rename_snake", f"SELECT c_custkey AS customer_key, c_name AS full_name, {num('c_acctbal', 'account_balance')} FROM customer")
def rename_snake(t: Tables):
    return clean.rename_snake(t.customer.select("c_custkey", "c_name", "c_acctbal").toDF("Customer Key", "FULL NAME", "Account Balance"))


@query("project_cols", f"{PANEL_SQL} SELECT zip_code, {day('date', 'ds')}, complaint_count AS y FROM dense")
def project_cols(t: Tables):
    return panel(t).select("zip_code", F.to_date("date").alias("ds"), F.col("complaint_count").alias("y"))


@query("available_cols", f"SELECT c_name, {num('c_acctbal')} FROM customer")
def available_cols(t: Tables):
    return t.customer.select(*clean.available(t.customer, ["c_name", "c_phone", "c_acctbal"]))


@query("coalesce_alias_col", f"SELECT p_partkey, {num('p_size', 'year_built')} FROM part")
def coalesce_alias_col(t: Tables):
    renamed = t.part.withColumnsRenamed({"p_size": "cnstrct_yr", "p_retailprice": "yearconstructed"})
    return renamed.select("p_partkey", C.to_numeric(F.col(clean.first_alias(renamed, C_YEARS)).cast("string")).alias("year_built"))


C_YEARS = ["yearbuilt", "year_built", "cnstrct_yr", "yearconstructed"]


@query("with_constant", f"{PANEL_SQL} SELECT zip_code, {day('date')}, {num('50', 'building_age_mean')}, {num('0.5', 'old_building_pct')} FROM dense")
def with_constant(t: Tables):
    return panel(t).select("zip_code", F.to_date("date").alias("date"), F.lit(50.0).alias("building_age_mean"), F.lit(0.5).alias("old_building_pct"))


@query("filter_not_null", f"WITH {COMPLAINTS} SELECT unique_key, {moment('closed_date')} FROM complaints WHERE closed_date IS NOT NULL")
def filter_not_null(t: Tables):
    return complaints(t).dropna(subset=["closed_date"]).select("unique_key", "closed_date")


@query("filter_regex", f"WITH {COMPLAINTS} SELECT unique_key, '100' || lpad(zip_code, 2, '0') AS zip_code FROM complaints WHERE c_acctbal >= {BAD_ZIP_BELOW}")
def filter_regex(t: Tables):
    zips = clean.rename_snake(raw_complaints(t)).select("unique_key", C.zip5(F.col("incident_zip")).alias("zip_code"))
    return zips.where(C.is_zip5(F.col("zip_code")))


@query("filter_between", f"WITH {COMPLAINTS}, {RAW} SELECT unique_key, {num('lat', 'latitude')}, {num('lon', 'longitude')} FROM raw WHERE lat BETWEEN 40.4 AND 41.0 AND lon BETWEEN -74.3 AND -73.6")
def filter_between(t: Tables):
    at = clean.rename_snake(raw_complaints(t)).select("unique_key", *[C.to_numeric(F.col(c)).alias(c) for c in ("latitude", "longitude")])
    return at.where(C.in_box(F.col("latitude"), F.col("longitude"), (40.4, 41.0), (-74.3, -73.6)))


@query("filter_between_or_null", f"WITH {COMPLAINTS} SELECT unique_key, {num('resolution_days')} FROM complaints WHERE resolution_days BETWEEN 10 AND 400 OR resolution_days IS NULL")
def filter_between_or_null(t: Tables):
    days = F.col("resolution_days")
    return complaints(t).where(days.between(10, 400) | days.isNull()).select("unique_key", days)


@query("filter_keywords", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'rodent|rat|mice|mouse|vermin')")
def filter_keywords(t: Tables):
    return t.documents.where(C.has_keyword(F.col("text"), ["rodent", "rat", "mice", "mouse", "vermin"])).select("doc_id")


@query("filter_keywords_words", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '\\b(?:ring|red)\\b')")
def filter_keywords_words(t: Tables):
    return t.part.where(C.has_keyword(F.col("p_name"), ["ring", "red"], whole_words=True)).select("p_partkey", "p_name")


@query("filter_like_or", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand LIKE 'Brand#2%' OR p_name LIKE '%ring%'")
def filter_like_or(t: Tables):
    return t.part.where(F.col("p_brand").like("Brand#2%") | F.col("p_name").like("%ring%")).select("p_partkey", "p_name", "p_brand")


@query("filter_eq_fallback", f"{PANEL_SQL} SELECT 'zip' AS kind, zip_code, {day('date')}, complaint_count FROM dense WHERE zip_code = '7' UNION ALL SELECT 'borough', zip_code, {day('date')}, complaint_count FROM dense WHERE borough = 'ASIA' UNION ALL SELECT 'all', zip_code, {day('date')}, complaint_count FROM dense")
def filter_eq_fallback(t: Tables):
    table = panel(t).select("zip_code", F.to_date("date").alias("date"), "complaint_count", "borough")
    cases = {"zip": ("7", "ASIA"), "borough": (None, "ASIA"), "all": (None, None)}
    parts = [clean.at_place(table, *place).select(F.lit(kind).alias("kind"), "zip_code", "date", "complaint_count") for kind, place in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filter_metadata_eq", f"WITH {COMPLAINTS} SELECT 'complaint_' || unique_key AS id FROM complaints WHERE zip_code = '7' AND status = 'F'")
def filter_metadata_eq(t: Tables):
    docs = complaints(t, closed=False).select(F.concat(F.lit("complaint_"), "unique_key").alias("id"), stringify_metadata(["zip_code", "status"]).alias("metadata"))
    return docs.where(metadata_equals(zip_code="7", status="F")).select("id")


@query("filter_document_contains", "SELECT doc_id FROM documents WHERE contains(text, 'tion')")
def filter_document_contains(t: Tables):
    return t.documents.where(document_contains("tion")).select("doc_id")


@query("filter_isin", f"{PANEL_SQL} SELECT zip_code, {day('date')}, complaint_count FROM dense WHERE month(date) IN (6, 7, 8)")
def filter_isin(t: Tables):
    return panel(t).where(F.month("date").isin(6, 7, 8)).select("zip_code", F.to_date("date").alias("date"), "complaint_count")


_FACTORS = """f AS (SELECT c_custkey, c_acctbal / 1000 AS h, CAST(c_nationkey AS DOUBLE) / 3 AS r FROM customer)"""


@query("filter_positive_in_map", f"WITH {_FACTORS} SELECT c_custkey, 'Historical Activity' AS factor, {num('h', 'score')} FROM f WHERE h > 0 UNION ALL SELECT c_custkey, 'Restaurant Violations', {num('r', 'score')} FROM f WHERE r > 0")
def filter_positive_in_map(t: Tables):
    factors = F.create_map(
        F.lit("historical_complaints"), F.col("c_acctbal") / 1000, F.lit("restaurant_violations"), F.col("c_nationkey").cast("double") / 3,
        F.lit("nearby_construction"), F.lit(4.0),
    )
    return t.customer.select("c_custkey", F.inline(positive_factors(factors)).alias("factor", "score"))


@query("filter_threshold", f"WITH {_FACTORS} SELECT c_custkey, 'historical_complaints' AS name, {num('h', 'score')} FROM f WHERE h >= 5 UNION ALL SELECT c_custkey, 'restaurant_violations', {num('r', 'score')} FROM f WHERE r >= 5")
def filter_threshold(t: Tables):
    listed = contributing_factors({"historical_complaints": F.col("c_acctbal") / 1000, "restaurant_violations": F.col("c_nationkey").cast("double") / 3})
    rows = t.customer.select("c_custkey", F.inline(listed).alias("name", "score", "description", "weight"))
    return rows.select("c_custkey", "name", "score")


@query("filter_nonzero_mask", f"""{PANEL_SQL} SELECT {num('100 * avg(abs((complaint_count - p) / complaint_count))', 'mape')} FROM (
  SELECT complaint_count, lag(complaint_count) OVER (PARTITION BY zip_code ORDER BY date) AS p FROM dense) WHERE p IS NOT NULL AND complaint_count <> 0""")
def filter_nonzero_mask(t: Tables):
    from placewise.operators.metrics import regression_metrics
    from placewise.plans.forecast import baseline_lag1

    return regression_metrics(baseline_lag1(panel(t))).select("mape")


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY date) AS rn FROM dense)"


@query("drop_first_n", f"{PANEL_SQL}, {_RANKED} SELECT zip_code, {day('date')}, complaint_count FROM ranked WHERE rn > 12")
def drop_first_n_each(t: Tables):
    return drop_first_n(panel(t), 12).select("zip_code", F.to_date("date").alias("date"), "complaint_count")


@query("drop_first_n_first_key", f"{PANEL_SQL}, {_RANKED} SELECT zip_code, {day('date')}, complaint_count FROM ranked WHERE rn > 12 OR zip_code <> (SELECT min(zip_code) FROM dense)")
def drop_first_n_first_key(t: Tables):
    return drop_first_n(panel(t), 12, first_key_only=True).select("zip_code", F.to_date("date").alias("date"), "complaint_count")


_RANK = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC"


@query("dedup_key", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {num('l_quantity')}, {moment('l_shipdate')} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RANK}) AS rn FROM lineitem) WHERE rn = 1")
def dedup_key(t: Tables):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]
    return clean.dedup_key(t.lineitem.select(*cols), "l_orderkey", newest="l_shipdate")


@query("dedup_rows", "SELECT DISTINCT text FROM documents")
def dedup_rows(t: Tables):
    return clean.dedup_key(t.documents.select("text"))


@query("fill_text", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def fill_text_query(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", fill_text(F.col("quality")).alias("quality"))
