"""Risk records for all places at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placewise.functions import scoring as S
from placewise.operators.explore import global_stats, location_stats, location_stats_or_default
from placewise.plans.forecast import classify
from placewise.settings import CONTRIBUTION_THRESHOLD, DEFAULT_STATS, FACTORS, IMAGE_CLASSES, RISK_WEIGHTS


def default_stats() -> dict[str, Column]:
    return {name: F.lit(value) for name, value in DEFAULT_STATS.items()}


def panel_stats(panel: DataFrame) -> dict[str, Column]:
    """The panel's normalisation statistics as scalar subqueries; Spark runs one aggregate for all."""
    stats = global_stats(panel)
    return {c: stats.select(c).scalar() for c in stats.columns}


def factor_columns(
    stats: Mapping[str, Column],
    total: Column,
    violations: Column,
    age: Column,
    month: Column,
    predicted: Column | None = None,
    image_class: Column | None = None,
    confidence: Column | None = None,
) -> dict[str, Column]:
    """The seven factor scores; without a forecast the history score takes its place."""
    history = S.score_history(total, stats["complaints_mean"], stats["complaints_std"])
    if predicted is None:
        forecast = history
    else:
        mean = stats["complaints_mean"]
        forecast = F.coalesce(S.score_forecast(predicted, mean, mean), history)
    return {
        "historical_complaints": history,
        "forecast_risk": forecast,
        "restaurant_violations": S.score_violations(violations, stats["violations_mean"], stats["violations_std"]),
        "building_age": S.score_building_age(age),
        "nearby_construction": F.lit(0.0),
        "seasonal_factor": S.score_season(month),
        "image_evidence": F.lit(0.0) if image_class is None else S.score_image(image_class, confidence),
    }


def score_places(
    places: DataFrame,
    stats: Mapping[str, Column],
    month: Column | int | None = None,
    predicted: str | None = None,
    image: tuple[str, str] | None = None,
    weights: Mapping[str, float] = RISK_WEIGHTS,
    threshold: float = CONTRIBUTION_THRESHOLD,
) -> DataFrame:
    """Adds factors (map), contributing_factors, risk_score, level, colour and explanation to location statistics.

    `month` defaults to the current month.
    """
    when = F.month(F.current_date()) if month is None else (F.lit(month) if isinstance(month, int) else month)
    found = factor_columns(
        stats, F.col("total_complaints"), F.col("restaurant_violations"), F.col("building_age"), when,
        F.col(predicted) if predicted else None,
        F.col(image[0]) if image else None,
        F.col(image[1]) if image else None,
    )
    # each factor is computed once and then read by the score, the map and the list
    out = places.withColumn("f", F.struct(*[found[n].alias(n) for n in FACTORS]))
    factors = {n: F.col(f"f.{n}") for n in FACTORS}
    out = out.withColumn("risk_score", S.risk_score(factors, weights))
    out = out.withColumn("contributing_factors", S.contributing_factors(factors, threshold, weights))
    score = F.col("risk_score")
    return out.withColumns({
        "factors": F.create_map(*[x for n in FACTORS for x in (F.lit(n), factors[n])]),
        "risk_level": S.risk_level(score),
        "risk_color": S.risk_color(score),
        "explanation": S.explain_score(score, F.col("contributing_factors")),
    }).drop("f")


def image_evidence(
    files: DataFrame, vectors: DataFrame, scores: Column | str, by: str = "zip_code", key: str = "path",
    classes: Sequence = IMAGE_CLASSES, no_evidence="no_evidence",
) -> DataFrame:
    """The strongest finding of every place, as `assess_location(images=...)` takes it.

    `files` lists images (key, place), for example from `read_images`; `vectors` holds key and what `scores`, the raw
    class scores, needs. Evidence goes before no evidence, then the higher confidence, then the larger key; a file without
    a vector counts for nothing. Each place's rows collapse on the map side.
    """
    raw = F.col(scores) if isinstance(scores, str) else scores
    seen = files.select(F.col(key).alias("_key"), by).join(vectors.withColumnRenamed(key, "_key"), "_key")
    found = seen.select(by, "_key", classify(raw, classes, no_evidence).alias("c"))
    best = F.max(F.struct("c.is_rat_evidence", "c.confidence", "_key", "c.predicted_class")).alias("b")
    return found.groupBy(by).agg(best).select(by, "b.predicted_class", "b.confidence", "b.is_rat_evidence")


def assess_location(
    panel: DataFrame,
    by: str = "zip_code",
    month: Column | int | None = None,
    forecasts: DataFrame | None = None,
    images: DataFrame | None = None,
    coordinates: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """One nested risk record per place; `by` is zip_code, borough or any other column of the panel.

    `asked` lists the wanted places; one that the panel does not know is scored from 0 complaints and
    the default age. `forecasts` (place, predicted), `images` (place, predicted_class, confidence) and `coordinates`
    (place, latitude, longitude) are optional tables keyed by place. A lookup is a filter on the result.
    """
    labels = ["borough"] if by == "zip_code" and "borough" in panel.columns else []
    places = location_stats(panel, by, labels=labels)
    if asked is not None:
        places = location_stats_or_default(places, asked.select(by), by)
    if forecasts is not None:
        places = places.join(forecasts.select(by, "predicted"), by, "left")
    if images is not None:
        places = places.join(images.select(by, "predicted_class", "confidence"), by, "left")
    if coordinates is not None:
        places = places.join(coordinates.select(by, "latitude", "longitude"), by, "left")
    scored = score_places(
        places, panel_stats(panel), month,
        "predicted" if forecasts is not None else None,
        ("predicted_class", "confidence") if images is not None else None,
    )

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in scored.columns else F.lit(None).cast(kind)).alias(name)

    return scored.select(
        F.struct(
            given("zip_code", "string"), given("borough", "string"),
            given("latitude", "double"), given("longitude", "double"),
        ).alias("location"),
        "risk_score", "risk_level", "risk_color", "factors", "contributing_factors",
        F.struct("total_complaints", "recent_complaints", "restaurant_violations", "building_age").alias("historical_stats"),
        "explanation",
    )
