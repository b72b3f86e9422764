"""Raw tables to the master panel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from placewise.operators.clean import available, clean_buildings, clean_complaints, clean_inspections, rename_snake
from placewise.operators.panel import agg_location_period, join_buildings, join_violations, zero_fill
from placewise.session import materialize
from placewise.settings import BOROUGH_NAMES

MASTER_COLUMNS = [
    "zip_code", "date", "borough", "complaint_count", "avg_resolution_days", "restaurant_violations_nearby",
    "building_age_mean", "building_age_median", "building_count", "old_building_pct",
]

COMPLAINT_INPUTS = [
    "unique_key", "created_date", "closed_date", "borough", "incident_zip", "latitude", "longitude",
]


def dense_panel(complaints: DataFrame, location: str = "zip_code", freq: str = "month", tag: str | None = None) -> DataFrame:
    """Cleaned complaints to the dense panel, with one pass over the complaints.

    The period cells (a few numbers per location and period) are checkpointed, because the grid
    needs their first and last period besides their rows.
    """
    cells = materialize(agg_location_period(complaints, location=location, freq=freq, keep_undated=True, tag=tag))
    return zero_fill(cells, location, freq, tag)


def create_master(
    complaints: DataFrame,
    inspections: DataFrame | None = None,
    buildings: DataFrame | None = None,
    as_of_year: int = 2025,
    borough_names: Mapping[str, str] = BOROUGH_NAMES,
    **violation_options,
) -> DataFrame:
    """Clean the raw tables, aggregate, densify, attach borough, violations and buildings.

    The optional tables may be None; their columns then take the defaults. Sort only when writing.
    """
    # the cleaner keeps one row per key, so only what the panel needs goes through that shuffle
    named = rename_snake(complaints)
    needed = clean_complaints(named.select(*available(named, COMPLAINT_INPUTS)), borough_names)
    panel = dense_panel(needed, tag="borough" if "borough" in needed.columns else None)
    checked = clean_inspections(inspections) if inspections is not None else None
    aged = clean_buildings(buildings, as_of_year) if buildings is not None else None
    panel = join_violations(panel, checked, **violation_options)
    panel = join_buildings(panel, aged)
    return panel.select(*[c for c in MASTER_COLUMNS if c in panel.columns])
