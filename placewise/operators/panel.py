"""Location-by-period panel and the context joined to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.functions.dates import period_sequence, period_start, period_step
from placewise.session import materialize
from placewise.settings import DEFAULT_BUILDING_AGE, DEFAULT_OLD_SHARE, TRAILING_MONTHS


def agg_location_period(
    df: DataFrame,
    time: str = "created_date",
    location: str = "zip_code",
    freq: str = "month",
    keep_undated: bool = False,
    tag: str | None = None,
) -> DataFrame:
    """Per location and period: count of non-null keys, mean resolution days (null when there are none).

    Counts and sums combine on the map side, so a location with a third of the rows costs one
    partial row per task. `tag` (a low-cardinality column such as borough) adds its newest value.
    """
    key = "unique_key" if "unique_key" in df.columns else time
    days = F.col("resolution_days") if "resolution_days" in df.columns else F.lit(None).cast("double")
    period = period_start(F.col(time), freq)
    rows = df if keep_undated else df.where(F.col(time).isNotNull())
    measures = [F.count(key).alias("complaint_count"), F.sum(days).alias("_days"), F.count(days).alias("_closed")]
    if tag is None:
        cells = rows.groupBy(location, period.alias("period")).agg(*measures)
    else:
        # numeric buffers only in the pass over the raw rows, so that it stays a hash aggregate
        fine = rows.groupBy(location, period.alias("period"), tag).agg(*measures, F.max(time).alias("_newest"))
        cells = fine.groupBy(location, "period").agg(
            F.sum("complaint_count").alias("complaint_count"),
            F.sum("_days").alias("_days"),
            F.sum("_closed").alias("_closed"),
            F.max(F.when(F.col(tag).isNotNull(), F.struct("_newest", tag))).alias("_tag"),
        )
    mean = F.when(F.col("_closed") > 0, F.col("_days") / F.col("_closed"))
    return cells.select(
        location, "period", "complaint_count", mean.alias("avg_resolution_days"),
        *(["_tag"] if tag is not None else []),
    )


def cross_grid(cells: DataFrame, location: str = "zip_code", freq: str = "month") -> DataFrame:
    """Every location with every period from the first to the last: one row per pair."""
    ends = cells.agg(F.struct(F.min("period").alias("first"), F.max("period").alias("last"))).scalar()  # one row, computed once
    first, last = ends["first"], ends["last"]
    return (
        cells.select(location).distinct()
        .select(location, F.explode(period_sequence(first, last, freq)).alias("period"))
    )


def zero_fill(
    cells: DataFrame, location: str = "zip_code", freq: str = "month", tag: str | None = None
) -> DataFrame:
    """Dense panel: every location has every period; only cells without rows become 0.

    Each known cell emits itself and the empty periods up to the next known one, so the grid needs
    one shuffle by location and no product or join. A cell with rows but none closed keeps its null
    mean. Locations whose dates are all unreadable still get a full row of zeros.
    """
    first = cells.agg(F.min("period")).scalar()
    last = cells.agg(F.max("period")).scalar()
    w = Window.partitionBy(location).orderBy("period")
    ahead = F.lead("period").over(w)
    start = F.when(F.row_number().over(w) == 1, first).otherwise(F.col("period"))
    stop = F.coalesce((ahead - period_step(freq)).cast("date"), last)
    spread = cells.withColumn("_start", start).withColumn("_stop", stop)
    if tag is not None:
        newest = F.max("_tag").over(Window.partitionBy(location))
        spread = spread.withColumn(tag, newest[tag]).drop("_tag")
    grid = spread.withColumn(
        "_cell", F.explode(period_sequence(F.col("_start"), F.col("_stop"), freq))
    )
    known = F.col("_cell").eqNullSafe(F.col("period"))
    return grid.select(
        location,
        F.col("_cell").alias("period"),
        F.when(known, F.col("complaint_count")).otherwise(F.lit(0)).cast("bigint").alias("complaint_count"),
        F.when(known, F.col("avg_resolution_days")).otherwise(F.lit(0.0)).alias("avg_resolution_days"),
        F.col("_cell").cast("timestamp").alias("date"),
        *([tag] if tag is not None else []),
    )


def group_first(df: DataFrame, location: str = "zip_code", value: str = "borough", newest: str = "created_date") -> DataFrame:
    """Newest non-null value per location; ties go to the larger value."""
    fine = df.where(F.col(value).isNotNull()).groupBy(location, value).agg(F.max(newest).alias("_newest"))
    return fine.groupBy(location).agg(F.max_by(value, F.struct("_newest", value)).alias(value))


def monthly_violations(inspections: DataFrame, location: str = "zip_code", time: str = "inspection_date") -> DataFrame:
    """Rows per location and month."""
    return (
        inspections.where(F.col(location).isNotNull() & F.col(time).isNotNull())
        .groupBy(location, period_start(F.col(time)).alias("period"))
        .agg(F.count("*").alias("violation_count"))
    )


def trailing_sum(
    monthly: DataFrame,
    location: str = "zip_code",
    months: int = TRAILING_MONTHS,
    by_calendar: bool = False,
    value: str = "violation_count",
    name: str = "restaurant_violations_nearby",
) -> DataFrame:
    """Sum over the current and the previous rows; `by_calendar` counts months instead of rows."""
    if by_calendar:
        axis = F.year("period") * 12 + F.month("period")
        w = Window.partitionBy(location).orderBy(axis).rangeBetween(-(months - 1), 0)
    else:
        w = Window.partitionBy(location).orderBy("period").rowsBetween(-(months - 1), 0)
    return monthly.withColumn(name, F.sum(value).over(w).cast("double"))


def building_stats(buildings: DataFrame, location: str = "zip_code", old_age: float = 50) -> DataFrame:
    """Mean, exact median, known-age count, share above `old_age` (unknown ages stay in the denominator).

    Ages are counted per distinct value first, so the median of a huge location is taken over its
    few hundred distinct ages.
    """
    ages = buildings.groupBy(location, "building_age").agg(F.count("*").alias("_n"))
    age, n = F.col("building_age"), F.col("_n")
    known = F.when(age.isNotNull(), n).otherwise(F.lit(0))
    return (
        ages.where(F.col(location).isNotNull())
        .groupBy(location)
        .agg(
            F.sum(age * n).alias("_sum"),
            F.sum(known).alias("building_count"),
            F.percentile(age, F.lit(0.5), n).alias("building_age_median"),
            F.sum(F.when(age > old_age, n).otherwise(F.lit(0))).alias("_old"),
            F.sum(n).alias("_all"),
        )
        .select(
            location,
            F.when(F.col("building_count") > 0, F.col("_sum") / F.col("building_count")).alias("building_age_mean"),
            "building_age_median",
            "building_count",
            (F.col("_old") / F.col("_all")).alias("old_building_pct"),
        )
    )


def join_violations(panel: DataFrame, inspections: DataFrame | None, location: str = "zip_code", **options) -> DataFrame:
    """Trailing violation sum on (location, month); 0 where there is none or no table."""
    if inspections is None or "inspection_date" not in inspections.columns:
        return panel.withColumn("restaurant_violations_nearby", F.lit(0.0))
    sums = trailing_sum(monthly_violations(inspections, location), location, **options)
    joined = panel.join(sums.select(location, "period", "restaurant_violations_nearby"), [location, "period"], "left")
    return joined.fillna(0.0, subset=["restaurant_violations_nearby"])


def join_buildings(panel: DataFrame, buildings: DataFrame | None, location: str = "zip_code") -> DataFrame:
    """Building statistics per location; a missing one takes the median over the panel's rows.

    The panel is dense, so every location weighs the same and the median over rows is the median
    over the panel's locations: one value per location, not per row.
    """
    if buildings is None or "building_age" not in buildings.columns:
        return panel.withColumns({
            "building_age_mean": F.lit(DEFAULT_BUILDING_AGE),
            "old_building_pct": F.lit(DEFAULT_OLD_SHARE),
        })
    # a row per location, read by the join and by the medians: computed once
    stats = materialize(building_stats(buildings, location))
    filled = ["building_age_mean", "building_age_median", "old_building_pct"]
    used = stats.join(panel.select(location).distinct(), location, "left_semi")
    medians = used.agg(F.struct(*[F.median(c).alias(c) for c in filled])).scalar()
    joined = panel.join(stats, location, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), medians[c]) for c in filled})


def fill_median(df: DataFrame, medians: dict[str, float | Column | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), m if isinstance(m, Column) else F.lit(m)) for c, m in medians.items()})
