"""Encoding, scaling, models and predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import Tables, day, int4, num, nums, query, whole
from catalog.cleaning import season_sql
from catalog.exploring import ADDITIVE, PREDICTIONS
from catalog.panels import keyed
from catalog.standins import MASTER_SQL, PANEL_SQL, master, panel
from placewise.operators import features as W
from placewise.operators.ablation import ablation
from placewise.operators.metrics import compare_models
from placewise.operators.vectors import pca_2d
from placewise.plans import forecast as FC
from placewise.plans.waves import fit_waves, predict_waves, waves_sum
from placewise.session import scratch_path

TRAIN_BEFORE = "2000-01-01"
# The rows from here up to the end of training decide when boosting stops, as in the training job.
VALIDATE_FROM = "1999-01-01"
# One training for all queries that need its models: (application, folder) -> where they are stored.
_STORED: dict[tuple[str, str], str] = {}


@query("label_encode", f"""{PANEL_SQL}, b AS (SELECT borough, row_number() OVER (ORDER BY borough) - 1 AS i FROM (SELECT DISTINCT borough FROM dense)),
  s AS (SELECT season, row_number() OVER (ORDER BY season) - 1 AS i FROM (SELECT DISTINCT {season_sql('date')} AS season FROM dense))
  SELECT zip_code, {day('date')}, CAST(b.i AS INTEGER) AS borough_encoded, CAST(s.i AS INTEGER) AS season_encoded
  FROM (SELECT *, {season_sql('date')} AS season FROM dense) d JOIN b ON d.borough = b.borough JOIN s ON d.season = s.season""")
def label_encode(t: Tables):
    table = panel(t).withColumn("season", W.season(F.month("date")))
    lists = {c: W.categories_of(table, c) for c in W.CATEGORICAL}
    return keyed(table.withColumns({f"{c}_encoded": W.encode(F.col(c), k) for c, k in lists.items()}), "borough_encoded", "season_encoded")


@query("encode_unseen", "SELECT c_custkey, CAST(CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'MIDDLE EAST' THEN 3 ELSE 4 END AS INTEGER) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def encode_unseen(t: Tables):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    seen = W.categories_of(named.where("r_name <> 'ASIA'"), "r_name")
    return named.select("c_custkey", W.encode(F.col("r_name"), seen).alias("code"))


@query("standard_scale", f"SELECT l_orderkey, l_linenumber, {num('(l_quantity - a) / s', 'l_quantity')}, {num('(l_discount - b) / d', 'l_discount')} FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_discount) AS b, stddev_pop(l_discount) AS d FROM lineitem)")
def standard_scale(t: Tables):
    return W.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])


_O = "OVER (PARTITION BY zip_code ORDER BY date"
_FEATURES = (
    {f"lag_{k}": f"lag(complaint_count, {k}) {_O})" for k in (1, 2, 3, 4, 12)}
    | {
        f"rolling_{n}_{k}": f"{f}(complaint_count) {_O} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        for k in (3, 6, 12) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))
    }
    | {
        "year": "year(date)", "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)",
        "is_summer": "CASE WHEN month(date) IN (6, 7, 8) THEN 1 ELSE 0 END",
        "mom_change": f"complaint_count - lag(complaint_count) {_O})", "yoy_change": f"complaint_count - lag(complaint_count, 12) {_O})",
        "mom_pct_change": f"CASE WHEN lag(complaint_count) {_O}) <> 0 THEN (complaint_count - lag(complaint_count) {_O})) / CAST(lag(complaint_count) {_O}) AS DOUBLE) END",
        "restaurant_violations_nearby": "restaurant_violations_nearby", "building_age_mean": "building_age_mean", "old_building_pct": "old_building_pct",
    }
)


def features_sql(keep: str) -> str:
    raw = ", ".join(f"CAST({e} AS DOUBLE) AS f_{n}" for n, e in _FEATURES.items())
    filled = ", ".join(f"coalesce(f_{n}, (SELECT median(f_{n}) FROM kept)) AS f_{n}" for n in _FEATURES)
    scaled = ", ".join(
        f"(f_{n} - (SELECT avg(f_{n}) FROM filled)) / (SELECT CASE WHEN stddev_pop(f_{n}) = 0 THEN 1 ELSE stddev_pop(f_{n}) END FROM filled) AS {n}" for n in _FEATURES
    )
    return f"""{MASTER_SQL}, feat AS (SELECT zip_code, date, borough, {season_sql('date')} AS season, complaint_count, {raw}, row_number() {_O}) AS rn FROM master),
  kept AS (SELECT * FROM feat WHERE {keep}), filled AS (SELECT zip_code, date, borough, season, complaint_count, {filled} FROM kept),
  scaled AS (SELECT zip_code, date, complaint_count, borough, season, {scaled} FROM filled),
  b AS (SELECT borough, row_number() OVER (ORDER BY borough) - 1 AS i FROM (SELECT DISTINCT borough FROM kept)),
  s AS (SELECT season, row_number() OVER (ORDER BY season) - 1 AS i FROM (SELECT DISTINCT season FROM kept)),
  encoded AS (SELECT x.*, CAST(b.i AS INTEGER) AS borough_encoded, CAST(s.i AS INTEGER) AS season_encoded FROM scaled x JOIN b ON x.borough = b.borough JOIN s ON x.season = s.season)"""


_FEATURE_COLS = f"zip_code, {day('date')}, complaint_count, borough_encoded, season_encoded, {', '.join(num(n) for n in _FEATURES)}"


def _features(t: Tables, **options):
    table = master(t)
    model = W.fit_features(table, **options)
    return model.apply(table), model


@query("feature_pipeline", f"{features_sql('rn > 12')} SELECT {_FEATURE_COLS} FROM encoded")
def feature_pipeline(t: Tables):
    df, model = _features(t)
    return keyed(df, "complaint_count", *model.names)


@query("feature_pipeline_first_key", f"{features_sql('rn > 12 OR zip_code <> (SELECT min(zip_code) FROM master)')} SELECT {_FEATURE_COLS} FROM encoded")
def feature_pipeline_first_key(t: Tables):
    df, model = _features(t, drop_first_key_only=True)
    return keyed(df, "complaint_count", *model.names)


@query("feature_matrix", f"{features_sql('rn > 12')} SELECT zip_code, {day('date')}, CAST(26 AS INTEGER) AS width, {num(' + '.join(list(_FEATURES) + ['borough_encoded', 'season_encoded']), 'total')} FROM encoded")
def feature_matrix(t: Tables):
    df, model = _features(t)
    values = vector_to_array(F.col("features"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return keyed(W.feature_matrix(df, model.names), F.size(values).alias("width"), total.alias("total"))


def _trained(t: Tables):
    """Master table, and the models that were trained on its earlier dates with the library's parameters, once a folder."""
    table, key = master(t), (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        path = scratch_path(t.spark, "trained")
        features = W.fit_features(table, train_before=TRAIN_BEFORE, trend_shift=1)
        early = features.apply(table).where(F.col("date") < F.lit(TRAIN_BEFORE))
        trees = FC.fit_boosted(early, features.names, validation=F.col("date") >= F.lit(VALIDATE_FROM))
        FC.save_models(features, trees, t.spark, path)
        _STORED[key] = path
    return table, *FC.load_models(t.spark, _STORED[key])


@query("gbt_forecast")
def gbt_forecast(t: Tables):
    table, features, trees = _trained(t)
    return FC.predict_boosted(features.apply(table).where(F.col("date") >= F.lit(TRAIN_BEFORE)), trees)


@query("feature_importance")
def feature_importance(t: Tables):
    return FC.feature_importance(t.spark, _trained(t)[2])


@query("predict_location")
def predict_location(t: Tables):
    """Fitted values for the last three rows of every asked place; parts that are no place get zeros."""
    table, features, trees = _trained(t)
    asked = t.part.select(F.col("p_partkey").cast("string").alias("zip_code"))
    return FC.predict_location(table, features, trees, 3, asked)


@query("boosted_fit_quality", f"{MASTER_SQL}, numbered AS (SELECT date, row_number() OVER (PARTITION BY zip_code ORDER BY date) AS i FROM master) SELECT count(*) AS row_count, 1 AS better_than_mean FROM numbered WHERE i > 12 AND date < TIMESTAMP '{VALIDATE_FROM}'")
def boosted_fit_quality(t: Tables):
    """Whether the trees fit the rows they learnt from better than the mean of these rows does."""
    table, features, trees = _trained(t)
    errors = FC.predict_boosted(features.apply(table).where(F.col("date") < F.lit(VALIDATE_FROM)), trees)
    better = F.avg((F.col("y") - F.col("y_pred")) ** 2) < F.var_pop("y")
    return errors.agg(F.count("*").alias("row_count"), better.alias("better_than_mean"))


@query("model_store")
def model_store(t: Tables):
    """The stored features and trees, loaded and applied to the whole panel."""
    table, features, trees = _trained(t)
    return trees.transform(features.apply(table)).select("zip_code", "date", "complaint_count", "y_pred")


@query("sequence_forecast")
def sequence_forecast(t: Tables):
    table = master(t)
    features = W.fit_features(table, train_before=TRAIN_BEFORE)
    rows = features.apply(table)
    model = FC.fit_sequence(rows.where(F.col("date") < F.lit(TRAIN_BEFORE)), features.numeric)
    return FC.predict_sequence(rows, model, features.numeric).where(F.col("date") >= F.lit(TRAIN_BEFORE))


@query("train_all_compare")
def train_all_compare(t: Tables):
    """Every model and the ensemble, trained on the earlier dates and compared on the later ones."""
    table, features, trees = _trained(t)
    return compare_models(FC.train_forecasters(table, features, TRAIN_BEFORE, trees=trees)["predictions"])


@query("baseline_lag1", f"{PREDICTIONS} SELECT zip_code, {day('date')}, {nums('y y_pred')} FROM predictions WHERE model = 'baseline'")
def baseline_lag1(t: Tables):
    return keyed(FC.baseline_lag1(panel(t)), "y", "y_pred")


@query("additive_forecast", f"{PANEL_SQL}, {ADDITIVE} SELECT zip_code, {day('date')}, {nums('y y_pred')} FROM additive")
def additive_forecast(t: Tables):
    return keyed(FC.additive_forecast(panel(t)), "y", "y_pred")


@query("additive_unknown_place", f"""{PANEL_SQL}, {ADDITIVE}, asked AS (SELECT CAST(p_partkey AS VARCHAR) AS zip_code FROM part)
  SELECT q.zip_code, {num('coalesce(greatest(0, intercept + slope * (2002 * 12 + 5) + s), 0)', 'y_pred')} FROM asked q LEFT JOIN fit f ON q.zip_code = f.zip_code
  LEFT JOIN (SELECT * FROM season WHERE m = 6) s ON q.zip_code = s.zip_code""")
def additive_unknown_place(t: Tables):
    model = FC.fit_additive(panel(t))
    asked = t.part.select(F.col("p_partkey").cast("string").alias("zip_code"), F.lit("2002-06-01").cast("date").alias("date"))
    return FC.predict_additive(asked, model).select("zip_code", "y_pred")


_LAST = "(SELECT max(date) FROM dense)"


@query("forecast_horizon", f"""{PANEL_SQL}, {ADDITIVE}, ahead AS (SELECT h, {_LAST} + to_months(CAST(h AS INTEGER)) AS d FROM range(1, 4) r(h)),
  f AS (SELECT i.zip_code, h, greatest(0, intercept + slope * (year(d) * 12 + month(d) - 1) + s) AS p FROM fit i CROSS JOIN ahead JOIN season s ON i.zip_code = s.zip_code AND s.m = month(d)),
  n AS (SELECT zip_code, max(CASE WHEN h = 1 THEN p END) AS next_month, sum(p) AS next_3_months FROM f GROUP BY 1),
  o AS (SELECT zip_code, sum(complaint_count) AS recent FROM dense WHERE date > {_LAST} - INTERVAL 3 MONTH GROUP BY 1)
  SELECT n.zip_code, {nums('next_month next_3_months')}, CASE WHEN next_3_months - recent > recent * 0.05 THEN 'increasing' WHEN next_3_months - recent < -recent * 0.05 THEN 'decreasing' ELSE 'stable' END AS trend
  FROM n JOIN o ON n.zip_code = o.zip_code""")
def forecast_horizon(t: Tables):
    return FC.forecast_horizon(panel(t))


_INTERVALS = f"""{PANEL_SQL}, {ADDITIVE}, newest AS (SELECT date_trunc('month', max(date)) AS l FROM dense),
  origin AS (SELECT l - to_months(CAST(k AS INTEGER)) AS o FROM newest, range(0, 24) r(k)),
  seen AS (SELECT zip_code, o, y, t, m FROM timed JOIN origin ON date < o),
  ofit AS (SELECT zip_code, o, coalesce(regr_slope(y, t), 0) AS slope, avg(y) - coalesce(regr_slope(y, t), 0) * avg(t) AS intercept FROM seen GROUP BY 1, 2),
  oseason AS (SELECT x.zip_code, x.o, x.m, avg(y - intercept - slope * t) AS s FROM seen x JOIN ofit f ON x.zip_code = f.zip_code AND x.o = f.o GROUP BY 1, 2, 3),
  back AS (SELECT f.zip_code, h, abs(d.y - greatest(0, intercept + slope * d.t + coalesce(s, 0))) AS r
    FROM ofit f CROSS JOIN range(1, 4) g(h) JOIN timed d ON d.zip_code = f.zip_code AND d.date = o + to_months(CAST(h - 1 AS INTEGER))
    LEFT JOIN oseason s ON s.zip_code = f.zip_code AND s.o = f.o AND s.m = d.m),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY zip_code, h ORDER BY r) AS i, count(*) OVER (PARTITION BY zip_code, h) AS n,
    row_number() OVER (PARTITION BY h ORDER BY r) AS j, count(*) OVER (PARTITION BY h) AS k FROM back),
  own AS (SELECT zip_code, h, min(n) AS n, min(CASE WHEN i >= ceil((n + 1) * 0.8 - 1e-9) THEN r END) AS w FROM ranked GROUP BY 1, 2),
  common AS (SELECT h, min(CASE WHEN j >= ceil((k + 1) * 0.8 - 1e-9) THEN r END) AS c FROM ranked GROUP BY 1),
  ahead AS (SELECT h, l + to_months(CAST(h AS INTEGER)) AS d FROM newest, range(1, 4) r(h)),
  made AS (SELECT i.zip_code, h, d, greatest(0, intercept + slope * (year(d) * 12 + month(d) - 1) + s) AS y_pred FROM fit i CROSS JOIN ahead JOIN season s ON i.zip_code = s.zip_code AND s.m = month(d)),
  wide AS (SELECT zip_code, o.h, CASE WHEN n < 10 OR w IS NULL THEN c ELSE w END AS width, n < 10 OR w IS NULL AS pooled FROM own o JOIN common c ON o.h = c.h)"""


@query("forecast_intervals", f"""{_INTERVALS} SELECT m.zip_code, {int4('m.h', 'horizon')}, {day('d', 'date')}, {num('y_pred')}, {num('greatest(0, y_pred - width)', 'low')}, {num('y_pred + width', 'high')}, {int4('pooled')}
  FROM made m LEFT JOIN wide w ON m.zip_code = w.zip_code AND m.h = w.h""")
def forecast_intervals(t: Tables):
    return FC.forecast_intervals(panel(t))


@query("interval_coverage", "SELECT CAST(h AS INTEGER) AS horizon, 1 AS near FROM range(1, 4) r(h)")
def interval_coverage(t: Tables):
    """Whether intervals for 80 % hold at least 75 % of the forecasts of the last twelve origins; the last month is not over."""
    table = panel(t)
    whole_months = table.where(F.col("date") < table.agg(F.max("date")).scalar())
    return FC.interval_coverage(whole_months).select("horizon", (F.col("covered") >= 0.75).alias("near"))


@query("additive_waves")
def additive_waves(t: Tables):
    """Piecewise trend and yearly waves per place, as fitted values."""
    table = panel(t)
    return keyed(FC.as_predictions(predict_waves(table, fit_waves(table)), "waves", "y_pred"), "y", "y_pred")


@query("additive_waves_balance", f"{PANEL_SQL} SELECT zip_code, 0.0::DOUBLE AS residuals, 0.0::DOUBLE AS sloped FROM dense GROUP BY 1")
def additive_waves_balance(t: Tables):
    """Residuals of a least-squares fit are balanced: they and their products with time add up to nothing."""
    table = panel(t)
    made = table.join(fit_waves(table), "zip_code").withColumn("r", F.col("complaint_count") - waves_sum(F.col("date")))
    sums = made.groupBy("zip_code").agg(F.sum("r").alias("a"), F.sum(F.col("r") * (FC.month_index(F.col("date")) - F.col("first"))).alias("b"))
    return sums.select("zip_code", F.round(F.abs(F.round("a", 3)), 3).alias("residuals"), F.abs(F.round("b", 3)).alias("sloped"))


# yearly folds and feature groups of the ablation
_GROUPS = {"lags": ["lag_1", "lag_2", "lag_3"], "calendar": ["month_sin", "month_cos"]}
_RAW = {n: _FEATURES[n] for own in _GROUPS.values() for n in own}


@query("feature_ablation", f"""{MASTER_SQL}, raw AS (SELECT year(date) AS fold, CAST(complaint_count AS DOUBLE) AS y, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _RAW.items())} FROM master),
  kept AS (SELECT * FROM raw WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _RAW)}), folds AS (SELECT fold, count(*) AS c FROM kept GROUP BY 1)
  SELECT g AS left_out, {int4('fold')}, {whole('c', 'row_count')} FROM folds, (VALUES (''), ('lags'), ('calendar')) v(g) WHERE fold > (SELECT min(fold) FROM folds)""")
def feature_ablation(t: Tables):
    """Models without each feature group, trained on all earlier years and tested on each year; SQL knows the folds only."""
    return _ablated(t).select("left_out", "fold", F.col("rows").alias("row_count"))


@query("feature_ablation_errors")
def feature_ablation_errors(t: Tables):
    return _ablated(t)


def _ablated(t: Tables):
    table = W.add_features(master(t), "complaint_count", lags=[1, 2, 3])
    return ablation(table, list(_RAW), _GROUPS, "complaint_count", F.year("date"))


@query("yoy_trend", f"""{PANEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY date DESC) AS rn FROM dense),
  s AS (SELECT zip_code, sum(complaint_count) FILTER (rn <= 12) AS a, CASE WHEN count(*) FILTER (rn BETWEEN 13 AND 24) = 12 THEN sum(complaint_count) FILTER (rn BETWEEN 13 AND 24) END AS b FROM r GROUP BY 1)
  SELECT zip_code, {whole('a', 'last_12')}, {whole('b', 'previous_12')}, {num('CASE WHEN b <> 0 THEN 100.0 * (a - b) / b END', 'yoy_pct')} FROM s""")
def yoy_trend(t: Tables):
    return FC.yoy_trend(panel(t))


@query("embedding_classifier")
def embedding_classifier(t: Tables):
    """Dense head on the stored vectors; predicted class against label for every vector."""
    model = FC.fit_embedding_classifier(t.embeddings, classes=10)
    rows = t.embeddings.select("vec_id", "label", FC.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return model.transform(rows.withColumnRenamed("label", "y")).select("vec_id", "y", F.col("prediction").cast("int").alias("pred"))


@query("pca_2d")
def pca(t: Tables):
    return pca_2d(t.embeddings, keep=["vec_id", "label"])


@query("pca_2d_axes", "SELECT count(*) AS row_count, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, 0.0::DOUBLE AS shared, 1 AS ordered FROM embeddings")
def pca_axes(t: Tables):
    """What principal components must be: centred, uncorrelated, and the first no narrower than the second."""
    zero = lambda c: F.abs(F.round(c, 6))
    return pca_2d(t.embeddings, keep=["vec_id"]).agg(
        F.count("*").alias("row_count"), zero(F.avg("pc1")).alias("mean1"), zero(F.avg("pc2")).alias("mean2"),
        zero(F.covar_pop("pc1", "pc2")).alias("shared"), (F.var_pop("pc1") >= F.var_pop("pc2")).alias("ordered"),
    )


@query("embedding_classifier_quality", "SELECT count(*) AS row_count, 1 AS better FROM embeddings")
def embedding_classifier_quality(t: Tables):
    """Whether the classifier names more labels rightly than always saying the commonest one."""
    model = FC.fit_embedding_classifier(t.embeddings, classes=10)
    rows = t.embeddings.select(F.col("label").alias("y"), FC.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    most = t.embeddings.groupBy("label").count().agg(F.max("count")).scalar()
    return model.transform(rows).agg(F.count("*").alias("row_count"), (F.sum((F.col("prediction") == F.col("y")).cast("int")) > most).alias("better"))


@query("sequence_forecast_balance", f"""{MASTER_SQL}, numbered AS (SELECT date, row_number() OVER (PARTITION BY zip_code ORDER BY date) AS i FROM master)
  SELECT count(*) AS row_count, 0.0::DOUBLE AS residual FROM numbered WHERE i > 24 AND date < TIMESTAMP '{TRAIN_BEFORE}'""")
def sequence_forecast_balance(t: Tables):
    """The residuals of a regression with an intercept add up to nothing on the rows it was fitted on."""
    table = master(t)
    features = W.fit_features(table, train_before=TRAIN_BEFORE)
    early = features.apply(table).where(F.col("date") < F.lit(TRAIN_BEFORE))
    model = FC.fit_sequence(early, features.numeric)
    fitted = model.transform(FC.flat_sequences(early, features.numeric))
    return fitted.agg(F.count("*").alias("row_count"), F.abs(F.round(F.avg(F.col("y") - F.col("y_pred")), 6)).alias("residual"))
