"""Risk factors, weighted score, bands, explanation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from placewise.functions.columns import banded, clip, lookup, one_decimal
from placewise.settings import (
    AGE_BANDS,
    COLOR_BANDS,
    CONTRIBUTION_THRESHOLD,
    DEFAULT_SEASON_SCORE,
    FACTOR_DESCRIPTIONS,
    FACTOR_LABELS,
    FACTORS,
    IMAGE_CLASS_SCORES,
    LEVEL_BANDS,
    RISK_WEIGHTS,
    SEASON_SCORES,
    SHORT_BANDS,
    TEXT_BANDS,
)


def normalize_weights(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {name: w / total for name, w in weights.items()}


def zscore_to_10(value: Column, mean: Column, std: Column) -> Column:
    """5 at the mean, 2.5 per standard deviation, within 0..10; a zero deviation gives 5."""
    return F.when(std == 0, F.lit(5.0)).otherwise(clip(5 + 2.5 * ((value - mean) / std), 0.0, 10.0))


def score_history(total: Column, mean: Column, std: Column, months: int = 12) -> Column:
    return zscore_to_10(total / months, mean / 12, std / 12)


def score_forecast(predicted: Column, average: Column, fallback_average: Column) -> Column:
    """5 when the forecast equals the average; a missing or zero average uses the fallback."""
    base = F.when(average != 0, average).otherwise(fallback_average)
    return clip(5 * predicted / F.greatest(base, F.lit(1.0)), 0.0, 10.0)


def score_violations(count: Column, mean: Column, std: Column) -> Column:
    return zscore_to_10(count, mean, std)


def score_building_age(age: Column) -> Column:
    return banded(age, AGE_BANDS)


def score_season(month: Column) -> Column:
    return lookup(month, SEASON_SCORES, DEFAULT_SEASON_SCORE)


def score_image(predicted_class: Column, confidence: Column) -> Column:
    """Class score times confidence; no image or an unknown class gives 0."""
    return F.coalesce(lookup(predicted_class, IMAGE_CLASS_SCORES, 0.0) * confidence, F.lit(0.0))


def risk_score(factors: Mapping[str, Column], weights: Mapping[str, float] = RISK_WEIGHTS) -> Column:
    """Weighted sum, up to 2 points of image bonus, within 1..10."""
    total = F.lit(0.0)
    for name, weight in normalize_weights(weights).items():
        if name in factors:
            total = total + F.lit(weight) * factors[name]
    image = factors.get("image_evidence", F.lit(0.0))
    total = F.when(image > 0, clip(total + image * 0.2, high=10.0)).otherwise(total)
    return clip(total, 1.0, 10.0)


def risk_level(score: Column) -> Column:
    return banded(score, LEVEL_BANDS)


def risk_color(score: Column) -> Column:
    return banded(score, COLOR_BANDS)


def risk_band3(score: Column) -> Column:
    return banded(score, SHORT_BANDS)


def risk_text(score: Column) -> Column:
    return banded(score, TEXT_BANDS)


def contributing_factors(
    factors: Mapping[str, Column],
    threshold: float = CONTRIBUTION_THRESHOLD,
    weights: Mapping[str, float] = RISK_WEIGHTS,
) -> Column:
    """array<struct<name,score,description,weight>>, largest score x weight first, ties in factor order."""
    share = normalize_weights(weights)
    ranked = F.array(*[
        F.struct(
            (-(factors[name] * share.get(name, 0.0))).alias("sort_value"),
            F.lit(place).alias("place"),
            F.lit(name).alias("name"),
            factors[name].alias("score"),
            F.lit(FACTOR_DESCRIPTIONS.get(name, name)).alias("description"),
            F.lit(share.get(name, 0.0)).alias("weight"),
        )
        for place, name in enumerate(f for f in FACTORS if f in factors)
    ])
    kept = F.array_sort(F.filter(ranked, lambda f: f["score"] >= threshold))
    return F.transform(
        kept,
        lambda f: F.struct(
            f["name"].alias("name"),
            f["score"].alias("score"),
            f["description"].alias("description"),
            f["weight"].alias("weight"),
        ),
    )


def positive_factors(factors: Column) -> Column:
    """Entries of a factor map that have a display name and a value above 0, renamed."""
    named = F.filter(
        F.map_entries(factors),
        lambda e: e["key"].isin(*FACTOR_LABELS) & (e["value"] > 0),
    )
    return F.transform(
        named,
        lambda e: F.struct(lookup(e["key"], FACTOR_LABELS).alias("factor"), e["value"].alias("score")),
    )


def format_score(score: Column) -> Column:
    return F.concat(F.lit("Risk Score: "), one_decimal(score), F.lit("/10 ("), risk_level(score), F.lit(")"))


def explain_score(score: Column, contributing: Column, top: int = 3) -> Column:
    lines = F.transform(
        F.slice(contributing, 1, top),
        lambda f: F.concat(F.lit("- "), f["description"], F.lit(": "), one_decimal(f["score"]), F.lit("/10\n")),
    )
    listed = F.concat(F.lit("\n**Key Contributing Factors:**\n"), F.array_join(lines, ""))
    return F.concat(
        F.lit("**"), format_score(score), F.lit("**\n"),
        F.when(F.size(contributing) > 0, listed).otherwise(F.lit("\nNo major risk factors identified.\n")),
    )


def softmax(scores: Column) -> Column:
    """Class scores to probabilities, shifted by the maximum."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based index of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
