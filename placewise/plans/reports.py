"""Prompts for reports, summaries and questions, built as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewise.functions.columns import one_decimal
from placewise.functions.scoring import risk_band3
from placewise.operators.explore import location_stats
from placewise.plans.assess import panel_stats, score_places
from placewise.plans.forecast import forecast_horizon, yoy_trend
from placewise.settings import (
    QUESTION_CLOSING,
    QUESTION_CONTEXT,
    QUESTION_OPENING,
    REPORT_INSTRUCTIONS,
    REPORT_OPENING,
    SUMMARY_CLOSING,
    SUMMARY_OPENING,
)


def _or_na(value: Column | None) -> Column:
    return F.lit("N/A") if value is None else F.coalesce(value.cast("string"), F.lit("N/A"))


def _bullet(name: str, value: Column | None) -> Column:
    return F.concat(F.lit(f"- {name}: "), _or_na(value), F.lit("\n"))


def report_prompt(
    location: Column,
    score: Column,
    total: Column | None = None,
    recent: Column | None = None,
    yoy: Column | None = None,
    samples: Column | None = None,
    next_month: Column | None = None,
    next_3_months: Column | None = None,
    confidence: Column | None = None,
    trend: Column | None = None,
    image_class: Column | None = None,
    image_confidence: Column | None = None,
    image_evidence: Column | None = None,
    context: Column | None = None,
) -> Column:
    """One report prompt per row; optional sections appear only where their data exist."""
    parts = [
        F.lit(REPORT_OPENING),
        F.concat(F.lit("**Location:** "), location, F.lit("\n")),
        F.concat(F.lit("**Overall Risk Score:** "), one_decimal(score), F.lit("/10\n\n")),
        F.lit("## Historical Data\n"),
        _bullet("Total complaints in area", total),
        _bullet("Recent complaints (last 6 months)", recent),
        _bullet("Year-over-year trend", yoy),
    ]
    if samples is not None:
        lines = F.transform(F.slice(samples, 1, 3), lambda s: F.concat(F.lit("  - "), s, F.lit("\n")))
        parts.append(F.when(
            F.size(samples) > 0, F.concat(F.lit("- Sample complaint descriptions:\n"), F.array_join(lines, ""))
        ))
    parts += [
        F.lit("\n## Forecast Data\n"),
        _bullet("Predicted complaints (next month)", next_month),
        _bullet("Predicted complaints (next 3 months)", next_3_months),
        _bullet("Forecast confidence", confidence),
        _bullet("Trend direction", trend),
    ]
    if image_class is not None:
        percent = F.concat(one_decimal(100 * F.coalesce(image_confidence, F.lit(0.0))), F.lit("%"))
        flag = F.lit(False) if image_evidence is None else F.coalesce(image_evidence, F.lit(False))
        warning = F.when(flag, F.lit("- **WARNING**: Rat evidence detected in uploaded image\n")).otherwise(F.lit(""))
        parts.append(F.when(image_class.isNotNull(), F.concat(
            F.lit("\n## Image Analysis\n"), _bullet("Detected evidence", image_class),
            F.lit("- Confidence: "), percent, F.lit("\n"), warning,
        )))
    if context is not None:
        parts.append(F.when(F.length(context) > 0, F.concat(F.lit("\n## Retrieved Context\n"), context, F.lit("\n"))))
    parts.append(F.lit(REPORT_INSTRUCTIONS))
    return F.concat_ws("", *parts)


def summary_prompt(score: Column, factors: Column) -> Column:
    return F.concat(
        F.lit(f"\n{SUMMARY_OPENING}\n- Risk level: "), risk_band3(score),
        F.lit(" ("), one_decimal(score), F.lit("/10)\n- Key factors: "),
        F.array_join(F.slice(factors, 1, 3), ", "), F.lit(f"\n\n{SUMMARY_CLOSING}\n"),
    )


def question_prompt(question: Column, context: Column, location: Column | None = None) -> Column:
    place = F.lit("") if location is None else F.when(
        F.length(location) > 0, F.concat(F.lit("Location context: "), location)
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"\n{QUESTION_OPENING}\n\nQuestion: "), question, F.lit("\n\n"), place,
        F.lit(f"\n\n{QUESTION_CONTEXT}\n"), context, F.lit(f"\n\n{QUESTION_CLOSING}\n"),
    )


def report_table(
    panel: DataFrame, contexts: DataFrame | None = None, images: DataFrame | None = None, month: Column | int | None = None
) -> DataFrame:
    """One report prompt per zip of the panel: score, history, outlook, and image and context where given.

    `contexts` holds zip_code and context; `images` holds zip_code, predicted_class, confidence and
    is_rat_evidence. Pass a stored panel: statistics, trend and outlook each read it.
    """
    rows = location_stats(panel)
    image = None
    if images is not None:
        rows = rows.join(images.select("zip_code", "predicted_class", "confidence", "is_rat_evidence"), "zip_code", "left")
        image = ("predicted_class", "confidence")
    rows = score_places(rows, panel_stats(panel), month, image=image)
    rows = rows.join(yoy_trend(panel), "zip_code", "left").join(forecast_horizon(panel), "zip_code", "left")
    if contexts is not None:
        rows = rows.join(contexts.select("zip_code", "context"), "zip_code", "left")
    yoy = F.concat(F.when(F.col("yoy_pct") >= 0, "+").otherwise(""), one_decimal(F.col("yoy_pct")), F.lit("%"))
    prompt = report_prompt(
        F.col("zip_code"), F.col("risk_score"), F.col("total_complaints"), F.col("recent_complaints"), yoy,
        next_month=one_decimal(F.col("next_month")), next_3_months=one_decimal(F.col("next_3_months")), trend=F.col("trend"),
        image_class=F.col("predicted_class") if image else None,
        image_confidence=F.col("confidence") if image else None,
        image_evidence=F.col("is_rat_evidence") if image else None,
        context=F.col("context") if contexts is not None else None,
    )
    summary = summary_prompt(F.col("risk_score"), F.transform("contributing_factors", lambda f: f["description"]))
    return rows.select("zip_code", "risk_score", "risk_level", prompt.alias("prompt"), summary.alias("summary"))
