"""Aggregates, metrics, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, day, int4, num, nums, query, whole
from catalog.panels import keyed
from catalog.standins import MASTER_SQL, PANEL_SQL, complaints, master, panel
from placewise.functions.dates import month_name
from placewise.functions.scoring import argmax
from placewise.operators import explore as E
from placewise.operators import metrics as M
from placewise.operators.features import location_window, rolling_columns
from placewise.operators.position import exact_quantiles
from placewise.operators.vectors import class_scores
from placewise.plans.forecast import additive_forecast, as_predictions, baseline_lag1
from placewise.session import materialize

ADDITIVE = """timed AS (SELECT zip_code, date, CAST(complaint_count AS DOUBLE) AS y, CAST(year(date) * 12 + month(date) - 1 AS DOUBLE) AS t, month(date) AS m FROM dense),
fit AS (SELECT zip_code, coalesce(regr_slope(y, t), 0) AS slope, avg(y) - coalesce(regr_slope(y, t), 0) * avg(t) AS intercept FROM timed GROUP BY 1),
season AS (SELECT a.zip_code, m, avg(y - intercept - slope * t) AS s FROM timed a JOIN fit f ON a.zip_code = f.zip_code GROUP BY 1, 2),
additive AS (SELECT a.zip_code, a.date, a.y, greatest(0, f.intercept + f.slope * a.t + s.s) AS y_pred
  FROM timed a JOIN fit f ON a.zip_code = f.zip_code JOIN season s ON a.zip_code = s.zip_code AND a.m = s.m)"""

PREDICTIONS = f"""{PANEL_SQL}, {ADDITIVE}, predictions AS (
  SELECT * FROM (SELECT zip_code, date, 'baseline' AS model, CAST(complaint_count AS DOUBLE) AS y, CAST(lag(complaint_count) OVER (PARTITION BY zip_code ORDER BY date) AS DOUBLE) AS y_pred FROM dense
  UNION ALL SELECT zip_code, date, 'rolling', CAST(complaint_count AS DOUBLE), avg(complaint_count) OVER (PARTITION BY zip_code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) FROM dense
  UNION ALL SELECT zip_code, date, 'additive', y, y_pred FROM additive) WHERE y_pred IS NOT NULL)"""

METRICS = """avg(abs(y - greatest(y_pred, 0))) AS mae, sqrt(avg(power(y - greatest(y_pred, 0), 2))) AS rmse,
  1 - sum(power(y - greatest(y_pred, 0), 2)) / (var_pop(y) * count(y)) AS r2,
  100 * avg(CASE WHEN y <> 0 THEN abs((y - greatest(y_pred, 0)) / y) END) AS mape"""
MODELS = f"{PREDICTIONS}, scored AS (SELECT model, {METRICS} FROM predictions GROUP BY 1)"

SIMS = """parts AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
centres AS (SELECT label AS c, d, avg(v) AS m FROM parts GROUP BY 1, 2),
sims AS (SELECT vec_id, label, c, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) AS s FROM parts JOIN centres USING (d) GROUP BY 1, 2, 3),
predicted AS (SELECT vec_id, label, arg_max(c, s) AS pred FROM sims GROUP BY 1, 2)"""


def predictions(t: Tables):
    """Three SQL-expressible forecasts in the long form."""
    table = materialize(panel(t))  # read by each of them
    rolling = rolling_columns(F.col("complaint_count"), location_window(), [3])["rolling_mean_3"]
    parts = [
        baseline_lag1(table),
        as_predictions(table.withColumn("p", rolling).where(F.col("p").isNotNull()), "rolling", "p"),
        additive_forecast(table),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def classified(t: Tables):
    """Nearest class mean for every embedding."""
    scored, classes = class_scores(t.embeddings)
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select("vec_id", "label", F.element_at(names, argmax(F.col("scores")) + 1).alias("pred"))


@query("global_median", f"{MASTER_SQL} SELECT {num('median(complaint_count)', 'complaint_count')}, {num('median(avg_resolution_days)', 'avg_resolution_days')}, {num('median(restaurant_violations_nearby)', 'restaurant_violations_nearby')} FROM master")
def global_median(t: Tables):
    cols = ["complaint_count", "avg_resolution_days", "restaurant_violations_nearby"]
    found = exact_quantiles(master(t), cols, [0.5])
    return t.spark.createDataFrame([tuple(found[c][0] for c in cols)], ", ".join(f"{c} double" for c in cols))


@query("exact_median_lines", f"SELECT {num('median(l_extendedprice)', 'l_extendedprice')}, {num('median(l_quantity)', 'l_quantity')} FROM lineitem")
def exact_median_lines(t: Tables):
    cols = ["l_extendedprice", "l_quantity"]
    found = exact_quantiles(t.lineitem, cols, [0.5])
    return t.spark.createDataFrame([tuple(found[c][0] for c in cols)], ", ".join(f"{c} double" for c in cols))


@query("global_stats", f"""{MASTER_SQL} SELECT {num('avg(complaint_count)', 'complaints_mean')}, {num('stddev_samp(complaint_count)', 'complaints_std')}, max(complaint_count) AS complaints_max,
  {num('avg(restaurant_violations_nearby)', 'violations_mean')}, {num('stddev_samp(restaurant_violations_nearby)', 'violations_std')},
  {num('avg(building_age_mean)', 'building_age_mean')}, {num('stddev_samp(building_age_mean)', 'building_age_std')} FROM master""")
def global_stats(t: Tables):
    return E.global_stats(master(t))


def _stats_sql(by: str, order: str) -> str:
    return f"""{MASTER_SQL} SELECT {by}, {whole('sum(complaint_count)', 'total_complaints')}, {whole('sum(complaint_count) FILTER (rn <= 6)', 'recent_complaints')},
  {num('avg(restaurant_violations_nearby)', 'restaurant_violations')}, {num('avg(building_age_mean)', 'building_age')}
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM master) GROUP BY 1"""


@query("location_stats", _stats_sql("zip_code", "date DESC"))
def location_stats(t: Tables):
    return E.location_stats(master(t))


@query("location_stats_borough", _stats_sql("borough", "zip_code DESC, date DESC"))
def location_stats_borough(t: Tables):
    return E.location_stats(master(t), "borough")


@query("location_stats_default", f"""{MASTER_SQL}, s AS (SELECT zip_code, sum(complaint_count) AS a FROM master GROUP BY 1)
  SELECT CAST(p_partkey AS VARCHAR) AS zip_code, {whole('coalesce(a, 0)', 'total_complaints')} FROM part LEFT JOIN s ON CAST(p_partkey AS VARCHAR) = s.zip_code""")
def location_stats_default(t: Tables):
    asked = t.part.select(F.col("p_partkey").cast("string").alias("zip_code"))
    return E.location_stats_or_default(E.location_stats(master(t)), asked).select("zip_code", "total_complaints")


@query("group_sum", f"{PANEL_SQL} SELECT 'borough' AS kind, borough AS key, {whole('sum(complaint_count)', 'complaint_count')} FROM dense GROUP BY 2 UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), CAST(sum(complaint_count) AS BIGINT) FROM dense GROUP BY 2 UNION ALL SELECT 'date', strftime(date, '%Y-%m-%d'), CAST(sum(complaint_count) AS BIGINT) FROM dense GROUP BY 2")
def group_sum(t: Tables):
    table = panel(t)
    keys = {"borough": F.col("borough"), "year": F.year("date").cast("string"), "date": F.date_format("date", "yyyy-MM-dd")}
    parts = [E.group_sum(table, k.alias("key")).select(F.lit(n).alias("kind"), "key", "complaint_count") for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("group_mean_month", f"{PANEL_SQL} SELECT {int4('month(date)', 'month')}, {num('avg(complaint_count)', 'complaint_count')} FROM dense GROUP BY month(date)")
def group_mean_month(t: Tables):
    return E.group_mean_month(panel(t))


@query("summary_kpis", f"""{PANEL_SQL} SELECT count(*) AS records, count(DISTINCT zip_code) AS zip_codes, {int4('min(year(date))', 'first_year')}, {int4('max(year(date))', 'last_year')},
  {whole('sum(complaint_count)', 'total_complaints')}, {num('avg(complaint_count)', 'mean_complaints')} FROM dense""")
def summary_kpis(t: Tables):
    return E.summary_kpis(panel(t))


_MEASURES = ["complaint_count", "avg_resolution_days", "restaurant_violations_nearby", "building_age_mean", "building_age_median", "building_count", "old_building_pct"]


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {num(f'avg({c})', 'mean')}, {num(f'stddev_samp({c})', 'std')}, {num(f'min({c})', 'min')},
  {num(f'quantile_cont({c}, 0.25)', 'q25')}, {num(f'quantile_cont({c}, 0.5)', 'q50')}, {num(f'quantile_cont({c}, 0.75)', 'q75')}, {num(f'max({c})', 'max')} FROM master"""


@query("describe", f"{MASTER_SQL} " + " UNION ALL ".join(_describe_sql(c) for c in _MEASURES))
def describe(t: Tables):
    return E.describe(master(t), _MEASURES)


@query("schema_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS type, count({c}) AS non_null FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"""
    for c, k in [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]
))
def schema_profile(t: Tables):
    return E.schema_profile(t.documents.join(t.labels, "doc_id", "left"))


@query("distinct_values", f"{PANEL_SQL} SELECT DISTINCT zip_code FROM dense ORDER BY 1")
def distinct_values(t: Tables):
    return complaints(t, closed=False).select("zip_code").distinct().orderBy("zip_code")


_CORR = ["complaint_count", "restaurant_violations_nearby", "building_age_mean", "old_building_pct"]


@query("corr_matrix", f"{MASTER_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {num(f'corr({a}, {b})', 'corr')} FROM master" for a in _CORR for b in _CORR))
def corr_matrix(t: Tables):
    return E.corr_matrix(master(t), _CORR)


def _histogram_sql(table: str, value: str, bins: int) -> str:
    return f"""h AS (SELECT CAST({value} AS DOUBLE) AS v FROM {table}), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS step FROM h),
  g AS (SELECT v, lo, step, least(floor((v - lo) / step), {bins} - 1) AS i FROM h, b),
  n AS (SELECT CASE WHEN v < lo + i * step THEN i - 1 WHEN i < {bins} - 1 AND v >= lo + (i + 1) * step THEN i + 1 ELSE i END AS bin, count(*) AS rows FROM g GROUP BY 1)
  SELECT CAST(r.range AS INTEGER) AS bin, {num('lo + r.range * step', 'left_edge')}, {num('lo + (r.range + 1) * step', 'right_edge')}, coalesce(n.rows, 0) AS rows
  FROM range({bins}) r CROSS JOIN b LEFT JOIN n ON n.bin = r.range"""


@query("histogram", f"{PANEL_SQL}, {_histogram_sql('dense', 'complaint_count', 50)}")
def histogram(t: Tables):
    return E.histogram(panel(t), "complaint_count", 50)


@query("histogram_errors", f"{PREDICTIONS}, {_histogram_sql('(SELECT y - y_pred AS e FROM predictions WHERE model = ' + chr(39) + 'baseline' + chr(39) + ')', 'e', 30)}")
def histogram_errors(t: Tables):
    return E.histogram(M.residuals(baseline_lag1(panel(t))), "residual", 30)


@query("share_of_total", f"SELECT label, count(*) AS support, {num('100.0 * count(*) / sum(count(*)) OVER ()', 'share_pct')} FROM embeddings GROUP BY 1")
def share_of_total(t: Tables):
    return E.share_of_total(t.embeddings.groupBy("label").agg(F.count("*").alias("support")), "support")


@query("regression_metrics", f"{PREDICTIONS} SELECT {nums('mae rmse r2 mape')} FROM (SELECT {METRICS} FROM predictions WHERE model = 'additive')")
def regression_metrics(t: Tables):
    return M.regression_metrics(additive_forecast(panel(t)))


@query("compare_models", f"{MODELS} SELECT model, {nums('mae rmse r2 mape')} FROM scored")
def compare_models(t: Tables):
    return M.compare_models(predictions(t))


@query("best_of", f"{MODELS} SELECT arg_min(model, mae) AS best_mae, arg_min(model, rmse) AS best_rmse, arg_min(model, mape) AS best_mape, arg_max(model, r2) AS best_r2 FROM scored")
def best_of(t: Tables):
    return M.best_of(M.compare_models(predictions(t)))


@query("ablation_delta", f"{MODELS} SELECT model, {num('rmse')}, {num('rmse - (SELECT rmse FROM scored WHERE model = ' + chr(39) + 'additive' + chr(39) + ')', 'delta')} FROM scored")
def ablation_delta(t: Tables):
    return M.ablation_delta(M.compare_models(predictions(t)), base="additive")


@query("residuals", f"{PREDICTIONS} SELECT zip_code, {day('date')}, model, {num('y - y_pred', 'residual')} FROM predictions")
def residuals(t: Tables):
    return keyed(M.residuals(predictions(t)), "model", "residual")


@query("qq_points", f"""{PREDICTIONS} SELECT zip_code, {day('date')}, {num('e', 'ordered')}, row_number() OVER (ORDER BY e, zip_code, date) AS position
  FROM (SELECT zip_code, date, y - y_pred AS e FROM predictions WHERE model = 'baseline')""")
def qq_points(t: Tables):
    points = M.qq_points(M.residuals(baseline_lag1(panel(t))), "residual", ["zip_code", "date"])
    return keyed(points, "ordered", "position")


def _ratio_sql(coefficients, x: str) -> str:
    return "(" + ") / (".join(" + ".join(f"{c!r}::DOUBLE * power({x}, {7 - i})" for i, c in enumerate(side)) for side in coefficients) + ")"


@query("qq_theoretical", f"""{PREDICTIONS}, placed AS (SELECT e, row_number() OVER (ORDER BY e, zip_code, date) AS i, count(*) OVER () AS n
    FROM (SELECT zip_code, date, y - y_pred AS e FROM predictions WHERE model = 'baseline')),
  spots AS (SELECT *, CASE WHEN i = n THEN power(0.5, 1.0 / n) WHEN i = 1 THEN 1 - power(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM placed),
  tails AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS t FROM spots)
  SELECT i AS position, {num('e', 'ordered')}, {num(f"CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql(M.NORMAL_CENTRE, '(0.180625 - q * q)')} WHEN t <= 5 THEN sign(q) * {_ratio_sql(M.NORMAL_TAIL, '(t - 1.6)')} ELSE sign(q) * {_ratio_sql(M.NORMAL_FAR_TAIL, '(t - 5)')} END", 'theoretical')} FROM tails""")
def qq_theoretical(t: Tables):
    points = M.qq_points(M.residuals(baseline_lag1(panel(t))), "residual", ["zip_code", "date"])
    return points.select("position", "ordered", "theoretical")


@query("confusion_matrix", f"WITH {SIMS} SELECT label, " + ", ".join(f'count(*) FILTER (pred = {c}) AS "{c}"' for c in range(10)) + " FROM predicted GROUP BY 1")
def confusion_matrix(t: Tables):
    return M.confusion_matrix(classified(t), list(range(10)))


@query("classification_report", f"""WITH {SIMS}, k AS (SELECT DISTINCT label AS class FROM embeddings),
  c AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS hits, count(*) FILTER (pred = class) AS found, count(*) FILTER (label = class) AS support FROM predicted, k GROUP BY 1),
  r AS (SELECT class, support, hits, CASE WHEN found > 0 THEN hits / found ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
    CASE WHEN found + support > 0 THEN 2 * hits / (found + support) ELSE 0 END AS f1 FROM c)
  SELECT CAST(class AS VARCHAR) AS class, {nums('precision recall f1')}, support FROM r
  UNION ALL SELECT 'accuracy', {', '.join([num('sum(hits) / sum(support)', n) for n in ('precision', 'recall', 'f1')])}, CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'macro avg', {num('avg(precision)', 'precision')}, {num('avg(recall)', 'recall')}, {num('avg(f1)', 'f1')}, CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', {num('sum(precision * support) / sum(support)', 'precision')}, {num('sum(recall * support) / sum(support)', 'recall')}, {num('sum(f1 * support) / sum(support)', 'f1')}, CAST(sum(support) AS BIGINT) FROM r""")
def classification_report(t: Tables):
    return M.classification_report(classified(t))


@query("accuracy_pct", f"SELECT {num('100 * avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END)', 'accuracy_pct')} FROM labels")
def accuracy_pct(t: Tables):
    return M.accuracy_pct(t.labels.select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred")))


@query("sort_measure", f"{PANEL_SQL} SELECT borough, {whole('sum(complaint_count)', 'complaint_count')} FROM dense GROUP BY 1 ORDER BY 2 DESC, 1")
def sort_measure(t: Tables):
    return E.group_sum(panel(t), "borough").orderBy(F.col("complaint_count").desc(), "borough")


@query("topk_groups", f"{PANEL_SQL} SELECT zip_code, {whole('sum(complaint_count)', 'complaint_count')} FROM dense GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def topk_groups(t: Tables):
    return E.top_groups(panel(t), "zip_code", 20)


@query("head_n", f"{PANEL_SQL} SELECT zip_code, {day('date')}, complaint_count FROM dense ORDER BY zip_code, date LIMIT 100")
def head_n(t: Tables):
    return keyed(panel(t), "complaint_count").orderBy("zip_code", "date").limit(100)


@query("month_name", f"{PANEL_SQL} SELECT {int4('month(date)', 'month')}, strftime(min(date), '%b') AS month_name, {num('avg(complaint_count)', 'complaint_count')} FROM dense GROUP BY month(date)")
def month_names(t: Tables):
    return E.group_mean_month(panel(t)).withColumn("month_name", month_name(F.col("month")))
