"""Scalar functions over whole tables: text, dates, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, day, int4, moment, num, nums, query, whole
from catalog.cleaning import parts_sql, season_sql
from catalog.exploring import PREDICTIONS, SIMS, predictions
from catalog.standins import AS_OF, COMPLAINTS, MASTER_SQL, PANEL_SQL, complaints, inspections, master, panel
from placewise import settings
from placewise.functions import columns as C
from placewise.functions import dates as D
from placewise.functions import scoring as S
from placewise.operators import metrics as M
from placewise.operators.explore import location_stats
from placewise.operators.texts import chunk_text
from placewise.operators.vectors import class_scores
from placewise.plans.assess import assess_location, default_stats, panel_stats, score_places
from placewise.plans.forecast import classify

# ---- text


@query("zip5", "SELECT c_custkey, substr(c_name, 1, 5) AS zip_code FROM customer")
def zip5(t: Tables):
    return t.customer.select("c_custkey", C.zip5(F.col("c_name")).alias("zip_code"))


@query("norm_borough", """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Staten Island' END AS borough FROM customer""")
def norm_borough(t: Tables):
    names = F.array(*[F.lit(x) for x in ("manhattan", "Brooklyn", "BRONX", "Staten Island", "Hoboken")])
    raw = F.element_at(names, F.col("c_nationkey") % 5 + 1)
    return t.customer.select("c_custkey", C.lookup(F.upper(raw), settings.BOROUGH_NAMES).alias("borough"))


@query("boro_code", """SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Brooklyn' WHEN 4 THEN 'Queens' WHEN 5 THEN 'Staten Island' END AS borough FROM customer""")
def boro_code(t: Tables):
    return t.customer.select("c_custkey", C.lookup(F.col("c_nationkey").cast("string"), settings.BORO_CODES).alias("borough"))


@query("zip_prefix_borough", """SELECT c_custkey, CASE c_nationkey % 5 WHEN 1 THEN 'Staten Island' WHEN 2 THEN 'Bronx' WHEN 3 THEN 'Queens' WHEN 4 THEN 'Brooklyn' ELSE 'Manhattan' END AS borough FROM customer""")
def zip_prefix_borough(t: Tables):
    prefixes = F.array(*[F.lit(x) for x in ("999", "103", "104", "111", "112")])
    zips = F.concat(F.element_at(prefixes, F.col("c_nationkey") % 5 + 1), F.lit("01"))
    return t.customer.select("c_custkey", C.lookup(F.substring(zips, 1, 3), settings.ZIP_PREFIX_BOROUGHS, "Manhattan").alias("borough"))


@query("dict_lookup", f"{PANEL_SQL} SELECT zip_code, {day('date')}, {season_sql('date')} AS season FROM dense")
def dict_lookup(t: Tables):
    return panel(t).select("zip_code", F.to_date("date").alias("date"), C.lookup(F.month("date"), settings.SEASONS).alias("season"))


@query("stringify_metadata", f"WITH {COMPLAINTS} SELECT unique_key, coalesce(strftime(closed_date, '%Y-%m-%d %H:%M:%S'), '') AS closed, borough, status FROM complaints")
def stringify_metadata(t: Tables):
    wanted = [c for c in ("closed_date", "borough", "status", "resolution_description") if c in complaints(t).columns]
    m = C.stringify_metadata(wanted)
    return complaints(t).select("unique_key", m.alias("m")).select(
        "unique_key", F.col("m")["closed_date"].alias("closed"), F.col("m")["borough"].alias("borough"), F.col("m")["status"].alias("status")
    )


@query("label_text", "SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Event' AS label FROM events")
def label_text(t: Tables):
    return t.events.select("event_id", C.label_text(F.concat("event_type", F.lit("_event"))).alias("label"))


@query("preview_text", "SELECT doc_id, substr(text, 1, 200) || '...' AS preview FROM documents")
def preview_text(t: Tables):
    # the preview is the feature: the first characters of each text
    return t.documents.select("doc_id", C.preview_text(F.col("text")).alias("preview"))


_STRIP = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


CHUNKS_SQL = f"""WITH f AS (SELECT doc_id, list_reduce(
    list_transform(string_split(text, chr(10)), lambda p: {{'done': CAST([] AS VARCHAR[]), 'open': '', 'p': p}}),
    lambda a, x: {{'done': CASE WHEN length(a.open) + length(x.p) < 500 OR a.open = '' THEN a.done ELSE list_append(a.done, trim(a.open, {_STRIP})) END,
      'open': CASE WHEN length(a.open) + length(x.p) < 500 THEN a.open || x.p || chr(10) ELSE x.p || chr(10) END, 'p': ''}},
    {{'done': CAST([] AS VARCHAR[]), 'open': '', 'p': ''}}) AS s FROM documents),
  c AS (SELECT doc_id, CASE WHEN s.open = '' THEN s.done ELSE list_append(s.done, trim(s.open, {_STRIP})) END AS chunks FROM f)
  SELECT doc_id, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_index, unnest(chunks) AS text FROM c"""


@query("chunk_text", CHUNKS_SQL)
def chunk_text_query(t: Tables):
    return chunk_text(t.documents.select("doc_id", "text"), separator="\n")


# ---- dates and numbers


@query("parse_ts", f"SELECT event_id, CASE WHEN event_type <> 'error' THEN {moment('ts', 'x').replace(' AS x', '')} END AS ts FROM events")
def parse_ts(t: Tables):
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", D.parse_ts(text).alias("ts"))


@query("parse_ts_formats", f"SELECT event_id, {moment(chr(100) + 'ate_trunc(' + chr(39) + 'minute' + chr(39) + ', ts)', 'ts')} FROM events")
def parse_ts_formats(t: Tables):
    text = F.date_format("ts", "MM/dd/yyyy HH:mm")
    return t.events.select("event_id", D.parse_ts(text, ["MM/dd/yyyy HH:mm"]).alias("ts"))


@query("date_parts", f"SELECT o_orderkey, {parts_sql('o_orderdate')} FROM orders")
def date_parts(t: Tables):
    parts = D.date_parts(F.col("o_orderdate"))
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("season", f"SELECT o_orderkey, {season_sql('o_orderdate')} AS season FROM orders")
def season(t: Tables):
    return t.orders.select("o_orderkey", D.season(F.month("o_orderdate")).alias("season"))


@query("is_summer", f"SELECT o_orderkey, {int4('CASE WHEN month(o_orderdate) IN (6, 7, 8) THEN 1 ELSE 0 END', 'is_summer')} FROM orders")
def is_summer(t: Tables):
    return t.orders.select("o_orderkey", D.is_summer(F.month("o_orderdate")).alias("is_summer"))


@query("cyclical_month", f"SELECT o_orderkey, {num('sin(2 * pi() * month(o_orderdate) / 12)', 'month_sin')}, {num('cos(2 * pi() * month(o_orderdate) / 12)', 'month_cos')} FROM orders")
def cyclical_month(t: Tables):
    m = F.month("o_orderdate")
    return t.orders.select("o_orderkey", D.month_sin(m).alias("month_sin"), D.month_cos(m).alias("month_cos"))


@query("period_start", f"SELECT o_orderkey, {day(chr(100) + 'ate_trunc(' + chr(39) + 'month' + chr(39) + ', o_orderdate)', 'month')}, {day(chr(100) + 'ate_trunc(' + chr(39) + 'week' + chr(39) + ', o_orderdate)', 'week')} FROM orders")
def period_start(t: Tables):
    return t.orders.select("o_orderkey", D.period_start(F.col("o_orderdate")).alias("month"), D.period_start(F.col("o_orderdate"), "week").alias("week"))


@query("period_sequence", f"SELECT {day('p', 'period')} FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS p FROM orders)")
def period_sequence(t: Tables):
    ends = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select(F.explode(D.period_sequence(D.period_start(F.col("a")), D.period_start(F.col("b")))).alias("period"))


@query("resolution_days", f"WITH {COMPLAINTS} SELECT unique_key, {num('resolution_days')} FROM complaints")
def resolution_days(t: Tables):
    return complaints(t).select("unique_key", "resolution_days")


@query("building_age", f"SELECT p_partkey, {num(f'{AS_OF} - (1950 + p_size)', 'building_age')} FROM part")
def building_age(t: Tables):
    return t.part.select("p_partkey", D.building_age(1950.0 + F.col("p_size"), AS_OF).alias("building_age"))


@query("to_numeric", f"SELECT event_id, {num('CASE WHEN event_type <> ' + chr(39) + 'error' + chr(39) + ' THEN value END', 'value')} FROM events")
def to_numeric(t: Tables):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", C.to_numeric(text).alias("value"))


@query("fill_zero", f"{PANEL_SQL} SELECT zip_code, {day('date')}, {num('coalesce(lag(complaint_count, 12) OVER (PARTITION BY zip_code ORDER BY date), 0)', 'lag_12')} FROM dense")
def fill_zero(t: Tables):
    from placewise.operators.features import lag_columns, location_window

    lagged = panel(t).withColumns(lag_columns(F.col("complaint_count"), location_window(), [12]))
    return lagged.select("zip_code", F.to_date("date").alias("date"), F.coalesce(F.col("lag_12").cast("double"), F.lit(0.0)).alias("lag_12"))


@query("fill_median", f"WITH {COMPLAINTS} SELECT unique_key, {num('coalesce(resolution_days, (SELECT median(resolution_days) FROM complaints))', 'resolution_days')} FROM complaints")
def fill_median(t: Tables):
    from placewise.operators.panel import fill_median as fill
    from placewise.operators.position import exact_quantiles

    rows = complaints(t).select("unique_key", "resolution_days")
    return fill(rows, {"resolution_days": exact_quantiles(rows, ["resolution_days"], [0.5])["resolution_days"][0]})


@query("fill_category", "SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), 'Unknown') AS category FROM documents LEFT JOIN labels USING (doc_id)")
def fill_category(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic").cast("string"), F.lit("Unknown")).alias("category"))


# ---- scores

_Z = "CASE WHEN ({s}) = 0 THEN 5 ELSE greatest(0, least(10, 5 + 2.5 * (({v}) - ({m})) / ({s}))) END"


def z_sql(v: str, m: str, s: str) -> str:
    return _Z.format(v=v, m=m, s=s)


_G = """g AS (SELECT avg(complaint_count) AS cm, stddev_samp(complaint_count) AS cs, avg(restaurant_violations_nearby) AS vm,
  stddev_samp(restaurant_violations_nearby) AS vs FROM master)"""
_L = """l AS (SELECT zip_code, max(borough) AS borough, CAST(sum(complaint_count) AS BIGINT) AS total_complaints,
  CAST(sum(complaint_count) FILTER (rn <= 6) AS BIGINT) AS recent_complaints, avg(restaurant_violations_nearby) AS restaurant_violations, avg(building_age_mean) AS building_age
  FROM (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY date DESC) AS rn FROM master) GROUP BY 1)"""


# The published bands, written out so that a changed setting shows.
def level_sql(v: str) -> str:
    return f"CASE WHEN {v} < 3 THEN 'Low' WHEN {v} < 6 THEN 'Low-Moderate' WHEN {v} < 8 THEN 'Moderate' WHEN {v} < 9 THEN 'High' ELSE 'Very High' END"


def color_sql(v: str) -> str:
    return f"CASE WHEN {v} < 3 THEN '#28a745' WHEN {v} < 5 THEN '#7cb342' WHEN {v} < 7 THEN '#ffc107' WHEN {v} < 8.5 THEN '#fd7e14' ELSE '#dc3545' END"


def band3_sql(v: str) -> str:
    return f"CASE WHEN {v} < 4 THEN 'low' WHEN {v} < 7 THEN 'moderate' ELSE 'high' END"


def age_sql(v: str) -> str:
    return f"CASE WHEN {v} < 20 THEN 2.0 WHEN {v} < 40 THEN 4.0 WHEN {v} < 60 THEN 6.0 WHEN {v} < 80 THEN 7.5 ELSE 9.0 END"


def text_sql(v: str) -> str:
    return f"""CASE WHEN {v} < 3 THEN '🟢 **Low Risk** - Minimal rat activity indicators. Maintain standard prevention practices.'
      WHEN {v} < 5 THEN '🟡 **Low-Moderate Risk** - Some activity indicators present. Consider enhanced monitoring.'
      WHEN {v} < 7 THEN '🟠 **Moderate Risk** - Notable activity indicators. Active prevention measures recommended.'
      WHEN {v} < 8.5 THEN '🔴 **High Risk** - Significant activity indicators. Immediate action recommended.'
      ELSE '⚫ **Very High Risk** - Critical activity levels. Professional intervention strongly recommended.' END"""


def season_score_sql(month: str) -> str:
    return f"""CASE {month} WHEN 1 THEN 4.0 WHEN 2 THEN 3.5 WHEN 3 THEN 4.0 WHEN 4 THEN 5.0 WHEN 5 THEN 6.0 WHEN 6 THEN 7.5
      WHEN 7 THEN 8.5 WHEN 8 THEN 9.0 WHEN 9 THEN 8.0 WHEN 10 THEN 6.5 WHEN 11 THEN 5.0 WHEN 12 THEN 4.0 ELSE 5.0 END"""


@query("zscore_to_10", f"SELECT c_custkey, {num(z_sql('c_acctbal', 'm', 's'), 'score')} FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def zscore(t: Tables):
    mean, std = t.customer.agg(F.avg("c_acctbal")).scalar(), t.customer.agg(F.stddev_samp("c_acctbal")).scalar()
    return t.customer.select("c_custkey", S.zscore_to_10(F.col("c_acctbal"), mean, std).alias("score"))


def places_with(t: Tables, name: str, make):
    table = master(t)
    stats = panel_stats(table)
    return location_stats(table).select("zip_code", make(stats).alias(name))


@query("score_history", f"{MASTER_SQL}, {_G}, {_L} SELECT zip_code, {num(z_sql('total_complaints / 960.0', 'cm / 12', 'cs / 12'), 'score')} FROM l, g")
def score_history(t: Tables):
    # the per-period rate: totals of 80 periods against the panel's mean
    return places_with(t, "score", lambda s: S.score_history(F.col("total_complaints") / 80.0, s["complaints_mean"], s["complaints_std"]))


@query("score_forecast", f"{PANEL_SQL} SELECT zip_code, {day('date')}, {num('greatest(0, least(10, 5 * l / greatest(CASE WHEN a <> 0 THEN a ELSE 10 END, 1)))', 'score')} FROM (SELECT *, lag(complaint_count) OVER w AS l, avg(complaint_count) OVER (PARTITION BY zip_code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a FROM dense WINDOW w AS (PARTITION BY zip_code ORDER BY date)) WHERE l IS NOT NULL")
def score_forecast(t: Tables):
    from placewise.operators.features import lag_columns, location_window, rolling_columns

    y, w = F.col("complaint_count"), location_window()
    rows = panel(t).withColumns(lag_columns(y, w, [1]) | rolling_columns(y, w, [3])).where(F.col("lag_1").isNotNull())
    score = S.score_forecast(F.col("lag_1"), F.col("rolling_mean_3"), F.lit(10.0))
    return rows.select("zip_code", F.to_date("date").alias("date"), score.alias("score"))


@query("score_violations", f"{MASTER_SQL}, {_G}, {_L} SELECT zip_code, {num(z_sql('restaurant_violations', 'vm', 'vs'), 'score')} FROM l, g")
def score_violations(t: Tables):
    return places_with(t, "score", lambda s: S.score_violations(F.col("restaurant_violations"), s["violations_mean"], s["violations_std"]))


@query("score_building_age", f"SELECT p_partkey, {num(age_sql('CASE WHEN p_brand <> ' + chr(39) + 'Brand#11' + chr(39) + ' THEN 2 * p_size END'), 'score')} FROM part")
def score_building_age(t: Tables):
    age = F.when(F.col("p_brand") != "Brand#11", 2 * F.col("p_size"))
    return t.part.select("p_partkey", S.score_building_age(age).alias("score"))


@query("score_season", f"SELECT o_orderkey, {num(season_score_sql('month(o_orderdate)'), 'score')} FROM orders")
def score_season(t: Tables):
    return t.orders.select("o_orderkey", S.score_season(F.month("o_orderdate")).alias("score"))


_IMAGE = """i AS (SELECT c_custkey, CASE c_nationkey % 7 WHEN 0 THEN 'rat' WHEN 1 THEN 'droppings' WHEN 2 THEN 'burrow' WHEN 3 THEN 'gnaw_marks' WHEN 4 THEN 'no_evidence' WHEN 5 THEN 'cat' END AS k,
  abs(c_acctbal) / 9973 AS p FROM customer)"""
_IMAGE_SCORE = "CASE k WHEN 'rat' THEN 10.0 WHEN 'droppings' THEN 8.0 WHEN 'burrow' THEN 7.5 WHEN 'gnaw_marks' THEN 7.0 ELSE 0.0 END * p"


def images(t: Tables):
    names = F.array(*[F.lit(x) for x in ("rat", "droppings", "burrow", "gnaw_marks", "no_evidence", "cat", None)])
    return t.customer.select("*", F.element_at(names, F.col("c_nationkey") % 7 + 1).alias("k"), (F.abs("c_acctbal") / 9973).alias("p"))


@query("score_image", f"WITH {_IMAGE} SELECT c_custkey, {num(_IMAGE_SCORE, 'score')} FROM i")
def score_image(t: Tables):
    return images(t).select("c_custkey", S.score_image(F.col("k"), F.col("p")).alias("score"))


# a score between 0 and 10 for every customer, and four factors for the weighted sum
_SCORE = "(c_acctbal + 1000) / 1100"


def score_col():
    return (F.col("c_acctbal") + 1000) / 1100


def _banded(name: str, sql, fn):
    query(name, f"SELECT c_custkey, {sql(_SCORE)} AS band FROM customer")(
        lambda t: t.customer.select("c_custkey", fn(score_col()).alias("band"))
    )


_banded("risk_level", level_sql, S.risk_level)
_banded("risk_color", color_sql, S.risk_color)
_banded("risk_band3", band3_sql, S.risk_band3)
_banded("risk_text", text_sql, S.risk_text)


@query("format_score", f"SELECT c_custkey, 'Risk Score: ' || printf('%.1f', {_SCORE}) || '/10 (' || {level_sql(_SCORE)} || ')' AS line FROM customer")
def format_score(t: Tables):
    return t.customer.select("c_custkey", S.format_score(score_col()).alias("line"))


_SUM = "0.30 * h + 0.25 * f + 0.20 * v + 0.15 * b"
_FOUR = f"""x AS (SELECT i.c_custkey, {_IMAGE_SCORE} AS img, {_SCORE} AS h, CAST(c_nationkey AS DOUBLE) / 2.5 AS f, 10 - {_SCORE} AS v, CAST(c_nationkey AS DOUBLE) / 3 AS b
  FROM i JOIN customer c ON i.c_custkey = c.c_custkey)"""


def four_factors():
    return {
        "historical_complaints": score_col(),
        "forecast_risk": F.col("c_nationkey").cast("double") / 2.5,
        "restaurant_violations": 10 - score_col(),
        "building_age": F.col("c_nationkey").cast("double") / 3,
        "nearby_construction": F.lit(0.0),
        "image_evidence": S.score_image(F.col("k"), F.col("p")),
    }


@query("risk_score", f"WITH {_IMAGE}, {_FOUR} SELECT c_custkey, {num(f'greatest(1, least(10, CASE WHEN img > 0 THEN least(10, {_SUM} + 0.2 * img) ELSE {_SUM} END))', 'risk_score')} FROM x")
def risk_score(t: Tables):
    return images(t).select("c_custkey", S.risk_score(four_factors()).alias("risk_score"))


_LISTED = f"""listed AS (SELECT c_custkey, name, score, weight, place, row_number() OVER (PARTITION BY c_custkey ORDER BY score * weight DESC, place) AS rn FROM (
  SELECT c_custkey, 'historical_complaints' AS name, h AS score, 0.30 AS weight, 0 AS place FROM x UNION ALL SELECT c_custkey, 'forecast_risk', f, 0.25, 1 FROM x
  UNION ALL SELECT c_custkey, 'restaurant_violations', v, 0.20, 2 FROM x UNION ALL SELECT c_custkey, 'building_age', b, 0.15, 3 FROM x
  UNION ALL SELECT c_custkey, 'image_evidence', img, 0, 6 FROM x) WHERE score >= 5)"""


@query("contributing_factors", f"WITH {_IMAGE}, {_FOUR}, {_LISTED} SELECT c_custkey, CAST(rn - 1 AS INTEGER) AS place, name, {nums('score weight')} FROM listed")
def contributing_factors(t: Tables):
    listed = S.contributing_factors(four_factors())
    rows = images(t).select("c_custkey", F.posexplode(listed).alias("place", "f"))
    return rows.select("c_custkey", "place", "f.name", "f.score", "f.weight")


@query("array_sort_desc", f"WITH {_IMAGE}, {_FOUR}, {_LISTED} SELECT c_custkey, string_agg(name, ',' ORDER BY rn) AS names FROM listed GROUP BY 1")
def array_sort_desc(t: Tables):
    listed = S.contributing_factors(four_factors())
    rows = images(t).select("c_custkey", F.array_join(F.transform(listed, lambda f: f["name"]), ",").alias("names"))
    return rows.where(F.col("names") != "")


@query("array_topn", f"WITH {_IMAGE}, {_FOUR}, {_LISTED} SELECT c_custkey, string_agg(name, ',' ORDER BY rn) AS names FROM listed WHERE rn <= 3 GROUP BY 1")
def array_topn(t: Tables):
    listed = F.slice(S.contributing_factors(four_factors()), 1, 3)
    rows = images(t).select("c_custkey", F.array_join(F.transform(listed, lambda f: f["name"]), ",").alias("names"))
    return rows.where(F.col("names") != "")


@query("normalize_weights", f"SELECT label, {num('count(*) / sum(count(*)) OVER ()', 'weight')} FROM embeddings GROUP BY 1")
def normalize_weights(t: Tables):
    counts = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("weight"))


@query("weighted_ensemble", f"""{PREDICTIONS} SELECT zip_code, {day('date')}, {num('sum(w * y_pred) / sum(w)', 'y_pred')} FROM (
  SELECT *, CASE model WHEN 'baseline' THEN 0.5 WHEN 'rolling' THEN 0.3 ELSE 0.2 END AS w FROM predictions) GROUP BY zip_code, date""")
def weighted_ensemble(t: Tables):
    mixed = M.weighted_ensemble(predictions(t), {"baseline": 0.5, "rolling": 0.3, "additive": 0.2})
    return mixed.select("zip_code", F.to_date("date").alias("date"), "y_pred")


@query("weighted_ensemble_plain", f"""{PREDICTIONS} SELECT zip_code, {day('date')}, {num('sum(w * y_pred)', 'y_pred')} FROM (
  SELECT *, CASE model WHEN 'baseline' THEN 0.5 WHEN 'rolling' THEN 0.3 ELSE 0.2 END AS w FROM predictions) GROUP BY zip_code, date""")
def weighted_ensemble_plain(t: Tables):
    mixed = M.weighted_ensemble(predictions(t), {"baseline": 0.5, "rolling": 0.3, "additive": 0.2}, renormalize=False)
    return mixed.select("zip_code", F.to_date("date").alias("date"), "y_pred")


@query("clip_nonnegative", f"SELECT c_custkey, {num('CASE WHEN c_acctbal IS NOT NULL THEN greatest(c_acctbal, 0) END', 'balance')} FROM customer")
def clip_nonnegative(t: Tables):
    return t.customer.select("c_custkey", C.clip_nonnegative(F.col("c_acctbal")).alias("balance"))


@query("softmax_argmax", f"""WITH {SIMS}, e AS (SELECT vec_id, c, s, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM sims)
  SELECT vec_id, CAST(arg_max(c, s) AS VARCHAR) AS predicted_class, {num('max(x) / sum(x)', 'confidence')}, {num('max(CASE WHEN c = 4 THEN x END) / sum(x)', 'probability_4')},
  {int4('CASE WHEN arg_max(c, s) <> 9 THEN 1 ELSE 0 END', 'is_evidence')} FROM e GROUP BY 1""")
def softmax_argmax(t: Tables):
    scored, classes = class_scores(t.embeddings)
    got = scored.select("vec_id", classify(F.col("scores"), [str(c) for c in classes], "9").alias("r"))
    return got.select(
        "vec_id", "r.predicted_class", "r.confidence", F.col("r.probabilities")["4"].alias("probability_4"), F.col("r.is_rat_evidence").alias("is_evidence")
    )


# ---- whole risk records

_RECORD = ", ".join([
    MASTER_SQL, _G, _L,
    f"""h AS (SELECT *, {z_sql('total_complaints / 12.0', 'cm / 12', 'cs / 12')} AS hist, {z_sql('restaurant_violations', 'vm', 'vs')} AS viol_score,
      {age_sql('building_age')} AS age_score, 8.5 AS season_score FROM l, g)""",
    "s AS (SELECT *, greatest(1, least(10, 0.30 * hist + 0.25 * hist + 0.20 * viol_score + 0.15 * age_score)) AS risk_score FROM h)",
    """c AS (SELECT zip_code, name, score, label, row_number() OVER (PARTITION BY zip_code ORDER BY score * weight DESC, place) AS rn FROM (
      SELECT zip_code, 'historical_complaints' AS name, 'Historical complaint volume in the area' AS label, hist AS score, 0.30 AS weight, 0 AS place FROM s
      UNION ALL SELECT zip_code, 'forecast_risk', 'Predicted future complaint activity', hist, 0.25, 1 FROM s
      UNION ALL SELECT zip_code, 'restaurant_violations', 'Nearby restaurant rodent violations', viol_score, 0.20, 2 FROM s
      UNION ALL SELECT zip_code, 'building_age', 'Age of buildings in the area', age_score, 0.15, 3 FROM s
      UNION ALL SELECT zip_code, 'seasonal_factor', 'Seasonal activity patterns', season_score, 0, 5 FROM s) WHERE score >= 5)""",
    """k AS (SELECT zip_code, string_agg(name, ',' ORDER BY rn) AS names, string_agg(CASE WHEN rn <= 3 THEN '- ' || label || ': ' || printf('%.1f', CAST(score AS DOUBLE)) || '/10' || chr(10) ELSE '' END, '' ORDER BY rn) AS lines FROM c GROUP BY 1)""",
])
_EXPLAIN = f"""'**Risk Score: ' || printf('%.1f', CAST(risk_score AS DOUBLE)) || '/10 (' || {level_sql('risk_score')} || ')**' || chr(10) || chr(10) || '**Key Contributing Factors:**' || chr(10) || lines"""


@query("explain_score", f"{_RECORD} SELECT s.zip_code, {_EXPLAIN} AS explanation FROM s JOIN k ON s.zip_code = k.zip_code")
def explain_score(t: Tables):
    table = master(t)
    return score_places(location_stats(table), panel_stats(table), month=7).select("zip_code", "explanation")


@query("assess_location", f"""{_RECORD} SELECT s.zip_code, borough, {num('risk_score')}, {level_sql('risk_score')} AS risk_level, {color_sql('risk_score')} AS risk_color,
  {num('hist', 'historical_complaints')}, {num('hist', 'forecast_risk')}, {num('viol_score', 'restaurant_violations_score')}, {num('age_score', 'building_age_score')}, {num('season_score', 'seasonal_factor')},
  names AS contributing, total_complaints, recent_complaints, {nums('restaurant_violations building_age')}, {_EXPLAIN} AS explanation FROM s JOIN k ON s.zip_code = k.zip_code""")
def assess_location_query(t: Tables):
    record = assess_location(master(t), month=7)
    factors = F.col("factors")
    return record.select(
        "location.zip_code", "location.borough", "risk_score", "risk_level", "risk_color",
        factors["historical_complaints"].alias("historical_complaints"), factors["forecast_risk"].alias("forecast_risk"),
        factors["restaurant_violations"].alias("restaurant_violations_score"), factors["building_age"].alias("building_age_score"),
        factors["seasonal_factor"].alias("seasonal_factor"),
        F.array_join(F.transform("contributing_factors", lambda f: f["name"]), ",").alias("contributing"),
        "historical_stats.total_complaints", "historical_stats.recent_complaints",
        "historical_stats.restaurant_violations", "historical_stats.building_age", "explanation",
    )


@query("assess_default_stats", f"""{MASTER_SQL}, {_L} SELECT zip_code, {num('greatest(1, least(10, 0.30 * h + 0.25 * h + 0.20 * v + 0.15 * a))', 'risk_score')} FROM (
  SELECT zip_code, {z_sql('total_complaints / 12.0', '10 / 12.0', '5 / 12.0')} AS h, {z_sql('restaurant_violations', '5', '3.0')} AS v, {age_sql('building_age')} AS a FROM l)""")
def assess_default_stats(t: Tables):
    return score_places(location_stats(master(t)), default_stats(), month=7).select("zip_code", "risk_score")
