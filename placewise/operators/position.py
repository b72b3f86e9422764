"""Exact row positions, splits and quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Keys that are drawn for each range; they come to the driver.
DRAWN = 100


def _directed(order: Sequence[str]) -> list[tuple[Column, bool]]:
    """Columns of an order and whether each descends, which a leading minus says."""
    return [(F.col(c.removeprefix("-")), c.startswith("-")) for c in order]


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [c.desc() if down else c.asc() for c, down in _directed(order)]


def _not_before(keys: Sequence[tuple[Column, bool]], split: Column) -> Column:
    """Whether a row stands at or behind a splitter; null comes first, in a descending column last."""
    after = F.lit(True)
    for i in reversed(range(len(keys))):
        (key, down), other = keys[i], split[f"k{i}"]
        beyond = (key < other) | (key.isNull() & other.isNotNull()) if down else (key > other) | (key.isNotNull() & other.isNull())
        after = F.coalesce(beyond, F.lit(False)) | (key.eqNullSafe(other) & after)
    return after


def ranges(df: DataFrame, order: Sequence[str], count: int) -> Column:
    """Number of the range, from 0, of each row: splitters are every DRAWN-th of the keys that come first by a hash.

    A row finds its range by halving, so its cost is the logarithm of the number of ranges.
    """
    keys = _directed(order)
    named = df.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)])
    ordered = [F.desc(f"k{i}") if down else F.asc(f"k{i}") for i, (_, down) in enumerate(keys)]
    drawn = named.orderBy(F.xxhash64(*named.columns)).limit(DRAWN * count)
    splits = drawn.orderBy(*ordered).collect()[DRAWN::DRAWN] if count > 1 else []
    if not splits:
        return F.lit(0)
    kinds = [f.dataType for f in named.schema.fields]
    listed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, kinds))]) for row in splits])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splits).bit_length()))])

    def step(at: Column, size: Column) -> Column:
        split = F.get(listed, at + size - 1)
        return F.when(split.isNotNull() & _not_before(keys, split), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_position(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "position", size: str | None = None) -> DataFrame:
    """1-based rank by `order` within `group`, exact and distributed; `size` adds the group's row count.

    Splitters cut (group, order) into ranges of about equal size, so one large group spreads over many tasks. One pass counts
    the rows of every range and group, their running sums are a small table, and rows are ranked inside their range: one
    shuffle of the rows, and nothing is stored. `order` must be a total order; a leading minus means descending.
    """
    groups = list(group)
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_range", ranges(df, [*groups, *order], count))
    heads = placed.groupBy("_range", *groups).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = heads.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], before.alias("_before"), F.sum("_rows").over(whole).alias("_all"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rank = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*sort_columns(order)))
    ranked = placed.withColumn("_rank", rank).join(starts, same)
    return ranked.select(
        *[F.col(c) for c in df.columns],
        (F.col("_rank") + F.col("_before")).cast("bigint").alias(name),
        *([F.col("_all").alias(size)] if size else []),
    )


def drop_first_n(df: DataFrame, n: int, key: str = "zip_code", time: str = "date", first_key_only: bool = False) -> DataFrame:
    """Remove the first n rows of every key, or only of the smallest key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(time))
    ranked = df.withColumn("_rank", rank)
    if first_key_only:
        smallest = df.agg(F.min(key)).scalar()
        keep = (F.col("_rank") > n) | (F.col(key) != smallest)
    else:
        keep = F.col("_rank") > n
    return ranked.where(keep).drop("_rank")


def split_by_date(df: DataFrame, train: float = 0.70, val: float = 0.15, time: str = "date") -> DataFrame:
    """Column `split`; a date goes whole to the part in which its last row falls, and the first date always trains.

    Only one row per distinct date is ranked, and the two cut-off dates come back as scalars, so the
    rows themselves are neither sorted nor shuffled. This is the split to use at scale.
    """
    per_date = df.groupBy(time).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy())
    ranked = per_date.withColumns({"_upto": upto, "_all": total})

    def last_within(share: float) -> Column:
        inside = F.col("_upto") <= F.floor(F.col("_all") * share)
        return ranked.agg(F.max(F.when(inside, F.col(time)))).scalar()

    return df.withColumn(
        "split",
        F.when(F.col(time) <= F.coalesce(last_within(train), ranked.agg(F.min(time)).scalar()), "train").when(F.col(time) <= last_within(train + val), "val").otherwise("test"),
    )


def split_by_position(df: DataFrame, order: Sequence[str], train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Column `split` by exact row position: int(n * train) rows, then up to int(n * (train + val))."""
    total = F.col("_size")
    return (
        with_position(df, order, size="_size")
        .withColumn(
            "split",
            F.when(F.col("position") <= F.floor(total * F.lit(train)), "train")
            .when(F.col("position") <= F.floor(total * F.lit(train + val)), "val")
            .otherwise("test"),
        )
        .drop("_size")
    )


def split_per_class(df: DataFrame, label: str, order: Sequence[str], train: float = 0.8) -> DataFrame:
    """First int(count * train) rows of every class go to train, the rest to val."""
    placed = with_position(df, order, group=[label], size="_size")
    cut = F.floor(F.col("_size") * F.lit(train))
    return placed.withColumn("split", F.when(F.col("position") <= cut, "train").otherwise("val")).drop("_size")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of many columns.

    Pass 1 brackets each quantile with approximate ones. Pass 2 counts what lies below a bracket
    and aggregates the distinct values inside it, so only a sliver of the rows is ever ranked and a
    repeated value costs one row. The bracket is checked against the exact rank and widened if needed.
    """
    names = list(columns)
    first = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(names)}
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    todo = [(c, k) for c in names if counts[c] > 0 for k in range(len(probs))]
    # a finer bracket for more rows keeps the values ranked inside it few
    accuracy = max(accuracy, min(max(counts.values()) // 1_000_000, 1_000_000))
    slack = 4.0 / accuracy
    while todo:
        sides = {
            c: sorted({min(max(probs[k] + s, 0.0), 1.0) for cc, k in todo if cc == c for s in (-slack, slack)})
            for c, _ in todo
        }
        row = df.agg(*[
            F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(p) for p in ps]), accuracy).alias(c)
            for c, ps in sides.items()
        ]).first()
        brackets = []
        for c, k in todo:
            ends = dict(zip(sides[c], row[c]))
            brackets.append((c, k, ends[max(probs[k] - slack, 0.0)], ends[min(probs[k] + slack, 1.0)]))
        below = df.agg(*[
            F.count(F.when(F.col(c).cast("double") < lo, 1)).alias(f"b{i}") for i, (c, _, lo, _) in enumerate(brackets)
        ]).first()
        hits = F.array(*[
            F.when(F.col(c).cast("double").between(lo, hi), F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")))
            for i, (c, _, lo, hi) in enumerate(brackets)
        ])
        values = (
            df.select(F.explode(F.array_compact(hits)).alias("h"))
            .groupBy(F.col("h.i").alias("i"), F.col("h.v").alias("v"))
            .agg(F.count("*").alias("n"))
        )
        ranks = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
        upto = values.withColumn("upto", ranks)
        picks = []
        for i, (c, k, _, _) in enumerate(brackets):
            spot = probs[k] * (counts[c] - 1)
            lo_rank = int(spot) + 1 - below[f"b{i}"]
            hi_rank = lo_rank + (1 if spot > int(spot) else 0)
            in_row = F.col("i") == i
            picks += [
                F.min(F.when(in_row & (F.col("upto") >= lo_rank), F.col("v"))).alias(f"lo{i}"),
                F.min(F.when(in_row & (F.col("upto") >= hi_rank), F.col("v"))).alias(f"hi{i}"),
                F.coalesce(F.max(F.when(in_row, F.col("upto"))), F.lit(0)).alias(f"top{i}"),
            ]
        got = upto.agg(*picks).first()
        missed = []
        for i, (c, k, _, _) in enumerate(brackets):
            spot = probs[k] * (counts[c] - 1)
            lo_rank = int(spot) + 1 - below[f"b{i}"]
            hi_rank = lo_rank + (1 if spot > int(spot) else 0)
            if lo_rank < 1 or hi_rank > got[f"top{i}"]:
                missed.append((c, k))
                continue
            part = spot - int(spot)
            found[c][k] = got[f"lo{i}"] + (got[f"hi{i}"] - got[f"lo{i}"]) * part
        todo, slack = missed, slack * 8
    return found
