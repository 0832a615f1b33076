"""Growth over periods per (entity, metric)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.rows import name_of
from tallyscope.operators.columns import melt_numbers
from tallyscope.operators.metrics import column_totals, named_columns, ranked_candidates
from tallyscope.operators.ordered import RANGE, Ranges, in_ranges


def metric_rows(wide: DataFrame, columns: Sequence[str], entity: str = "entity_id", date: str = "period_date",
                only: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """(entity, metric_id, period_date, seq, value): the rows behind each metric.

    Only rows with both a date and a number remain.  ``order`` (a numeric
    column) orders rows of the same date; without it they are ordered by value.
    """
    named = named_columns(wide, columns)
    if only is not None:
        named = named.where(F.col("metric_id").isin(list(only)))
    picked = ranked_candidates(column_totals(wide, entity, None, columns), named, entity).where("rank = 1").select(
        entity, "column_name", "metric_id")
    keep = [name_of(entity), f"{name_of(date)} AS period_date"]
    if order:
        keep.append(f"CAST({name_of(order)} AS DOUBLE) AS seq")
    long = melt_numbers(wide, columns, keep).where("period_date IS NOT NULL")
    if not order:
        long = long.withColumn("seq", F.col("value"))
    return long.join(picked, [entity, "column_name"]).select(entity, "metric_id", "period_date", "seq", "value")


def direction(growth: Column) -> Column:
    return (
        F.when(growth.isNull(), "insufficient_data").when(growth > 2.5, "improving")
        .when(growth < -2.5, "declining").otherwise("stable")
    )


def _steps(ranges: Ranges) -> DataFrame:
    """Rows with the number and date before them in their range."""
    w = ranges.window()
    return ranges.rows.withColumns({"before": F.lag("value").over(w), "date_before": F.lag("period_date").over(w)})


def analyze_trends(rows: DataFrame, entity: str = "entity_id", ranges: int | None = None) -> DataFrame:
    """Total and mean growth of each metric of each entity with two or more rows.

    A change from zero to another value has no finite rate; the mean growth is
    then NULL.  Steps that stay at zero are skipped.

    Equal rows collapse first.  Then rows lie in ranges of (entity, metric,
    date, order) of about equal size, so an entity with very many dates, or very
    many rows of one date, is spread over tasks.  A range is summed up by its
    ends and the sum of its steps; neighbouring ranges are joined by one step.
    """
    keys = [entity, "metric_id"]
    copies = rows.groupBy(*keys, "period_date", "seq", "value").agg(F.count(F.lit(1)).alias("copies"))
    placed = Ranges(in_ranges(copies, keys, ["period_date", "seq", "value"], ranges, name="trend-rows"), tuple(keys), ("period_date", "seq", "value"), ())
    change = F.try_divide(F.col("value"), F.col("before")) - 1
    repeated = F.when(F.col("value") != 0, F.col("copies") - 1).otherwise(0)  # equal rows in a row: no change
    place = F.struct("period_date", "seq", "value")
    parts = _steps(placed).groupBy(RANGE, *keys).agg(
        F.sum("copies").alias("rows"),
        F.count_if(F.col("date_before").isNull() | (F.col("date_before") != F.col("period_date"))).alias("dates"),
        F.min(place).alias("first"), F.max(place).alias("last"),
        F.coalesce(F.sum(change), F.lit(0.0)).alias("step_sum"), (F.count(change) + F.sum(repeated)).alias("step_n"),
        F.max(((F.col("before") == 0) & (F.col("value") != 0)).cast("int")).alias("jump"),
    )
    # One row per range that a metric of an entity lies in.
    in_order = Window.partitionBy(*keys).orderBy(RANGE)
    linked = parts.withColumn("previous", F.lag("last").over(in_order))
    between = F.try_divide(F.col("first.value"), F.col("previous.value")) - 1
    out = linked.groupBy(*keys).agg(
        F.sum("rows").alias("period_count"),
        (F.sum("dates") - F.count_if(F.col("previous.period_date") == F.col("first.period_date"))).alias("distinct_periods"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        (F.sum("step_sum") + F.coalesce(F.sum(between), F.lit(0.0))).alias("change_sum"),
        (F.sum("step_n") + F.count(between)).alias("change_n"),
        F.max(F.greatest(F.coalesce("jump", F.lit(0)), F.coalesce(((F.col("previous.value") == 0) & (F.col("first.value") != 0)).cast("int"), F.lit(0)))).alias("jumps"),
    ).where("period_count >= 2").withColumns({"first_value": F.col("first.value"), "last_value": F.col("last.value")})
    growth = F.try_divide(F.col("last_value") - F.col("first_value"), F.abs("first_value")) * 100.0
    mean = F.when((F.col("change_n") > 0) & (F.col("jumps") == 0), F.col("change_sum") / F.col("change_n") * 100.0)
    return out.select(
        entity, "metric_id", "first_value", "last_value", growth.alias("growth_rate"), mean.alias("avg_period_growth"),
        direction(growth).alias("direction"), "period_count", "distinct_periods")


def period_series(rows: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, metric_id, period, value): the last row of each date stands for it."""
    return rows.groupBy(entity, "metric_id", "period_date").agg(F.max_by("value", "seq").alias("value")).withColumn(
        "period", scalars.period_label(F.col("period_date")))


def series_map(series: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Series as a map from date label to value (one entry per calendar date)."""
    entries = F.array_sort(F.collect_list(F.struct("period", "value")))
    return series.groupBy(entity, "metric_id").agg(F.map_from_entries(entries).alias("period_series"))


def latest_change(series: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Last period against the one before, in percent of the earlier value's size.

    ``row_number() <= 2`` lets every task send two rows a metric only.
    """
    latest_first = Window.partitionBy(entity, "metric_id").orderBy(F.desc("period_date"))
    two = series.withColumn("place", F.row_number().over(latest_first)).where("place <= 2")
    pick = lambda c, place: F.max(F.when(F.col("place") == place, F.col(c)))
    found = two.groupBy(entity, "metric_id").agg(
        pick("period", 1).alias("period"), pick("value", 1).alias("value"), pick("period", 2).alias("previous_period"), pick("value", 2).alias("previous_value"))
    base = F.when(F.col("previous_value") == 0, 1.0).otherwise(F.abs("previous_value"))
    return found.where("previous_value IS NOT NULL").select(
        entity, "metric_id", "period", "value", "previous_period", "previous_value",
        ((F.col("value") - F.col("previous_value")) / base * 100.0).alias("change_pct"))


def attach_trends(metrics: DataFrame, trends: DataFrame, series: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Metric rows with their series and a note about the total change."""
    text = F.concat(F.lit("Total change across observed periods: "), scalars.signed(F.col("growth_rate"), 1), F.lit("%."))
    noted = trends.where(F.col("metric_id").isin(vocab.TREND_METRICS)).select(
        entity, "metric_id", F.when(F.col("growth_rate").isNotNull(), text).alias("trend_note"))
    maps = series_map(series.join(noted.select(entity, "metric_id"), [entity, "metric_id"], "left_semi"), entity)
    return metrics.join(noted, [entity, "metric_id"], "left").join(maps, [entity, "metric_id"], "left")
