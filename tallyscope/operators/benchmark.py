"""An entity against a competitor and a market: comparisons, gaps, priorities.

Works on many groups at once.  A group is (primary_id, secondary_id) with an
optional market_id; values are (entity_id, metric_id, value) with ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.registry import with_metric
from tallyscope.operators.scenario import PAIR, metric_overlap, paired_values, rule_rows


def comparison_status(primary: Column, benchmark: Column, direction: Column) -> Column:
    better = ((direction == "higher_better") & (primary > benchmark)) | ((direction == "lower_better") & (primary < benchmark))
    return (
        F.when(primary.isNull() | benchmark.isNull(), "na")
        .when((primary == benchmark) | (direction == "neutral"), "level")
        .when(better, "ahead").otherwise("behind")
    )


def comparisons(groups: DataFrame, values: DataFrame) -> DataFrame:
    """Primary and competitor joined on the metric, the market added where known."""
    listed = values.where(F.col("metric_id").isin(vocab.COMPARED_METRICS))
    both = with_metric(paired_values(groups, listed), "display_name", "unit", "direction")
    if "market_id" in groups.columns:
        markets = listed.select(F.col("entity_id").alias("market_id"), "metric_id", F.col("value").alias("market_value"))
        both = both.join(groups.select(*PAIR, "market_id"), list(PAIR)).join(markets, ["market_id", "metric_id"], "left")
    else:
        both = both.withColumn("market_value", F.lit(None).cast("double"))
    p, s = F.col("primary_value"), F.col("secondary_value")
    return both.select(
        *PAIR, "metric_id", "display_name", "unit", "direction", "primary_value", "secondary_value", "market_value",
        (p - s).alias("absolute_gap"), (F.try_divide(p - s, F.abs(s)) * 100.0).alias("percentage_gap"),
        comparison_status(p, s, F.col("direction")).alias("status"))


def status_order(status: Column) -> Column:
    return F.when(status == "behind", 0).when(status == "ahead", 1).when(status == "level", 2).otherwise(3)


def numbered(rows: DataFrame) -> DataFrame:
    """Comparison rows with their place in the display order of the group."""
    place = Window.partitionBy(*PAIR).orderBy(status_order(F.col("status")), "metric_id")
    return rows.withColumn("place", F.row_number().over(place))


def gap_priority(importance: Column, percentage_gap: Column) -> Column:
    size = F.abs(F.coalesce(percentage_gap, F.lit(0.0)))
    return (
        F.when((importance == "high") & (size >= 10), "high").when((importance == "high") & (size >= 3), "medium")
        .when((importance == "medium") & (size >= 15), "high").when((importance == "medium") & (size >= 5), "medium")
        .when((importance == "low") & (size >= 25), "medium").otherwise("low")
    )


def priority_order(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def gaps(compared: DataFrame) -> DataFrame:
    """Metrics behind the competitor with targets, priority and their order."""
    behind = with_metric(compared.where("status = 'behind'"), "importance")
    p, s = F.col("primary_value"), F.col("secondary_value")
    near = (p + s) / 2
    text = F.concat(
        scalars.signed(near - p, 2), scalars.unit_suffix(F.col("unit")), F.lit(" to reach near-term target, "),
        scalars.signed(s - p, 2), scalars.unit_suffix(F.col("unit")), F.lit(" to match benchmark."))
    rows = behind.select(
        *PAIR, "metric_id", "display_name", "unit", "direction", "importance", p.alias("current_value"),
        s.alias("benchmark_value"), "absolute_gap", "percentage_gap", near.alias("near_term_target"),
        s.alias("long_term_target"), gap_priority(F.col("importance"), F.col("percentage_gap")).alias("priority"),
        text.alias("required_improvement"))
    size = F.abs(F.coalesce("percentage_gap", F.lit(0.0)))
    place = Window.partitionBy(*PAIR).orderBy(priority_order(F.col("priority")), size.desc(), "metric_id")
    return rows.withColumn("place", F.row_number().over(place))


def top_gaps(found: DataFrame, k: int) -> DataFrame:
    return found.where(F.col("place") <= k)


def priority_matrix(found: DataFrame) -> DataFrame:
    """Coordinates of each gap: relative size across, priority upwards."""
    size = F.abs("percentage_gap")
    scale = F.max(F.when(F.col("priority") != "low", size)).over(Window.partitionBy(*PAIR))
    y = F.when(F.col("priority") == "high", 0.85).when(F.col("priority") == "medium", 0.5).otherwise(0.2)
    return found.withColumn("scale", F.greatest(F.coalesce(scale, F.lit(0.0)), F.lit(1.0))).where(
        "percentage_gap IS NOT NULL"
    ).select(*PAIR, "metric_id", "priority", F.least(F.lit(1.0), size / F.col("scale")).alias("x"), y.alias("y"))


def priority_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(*PAIR, "priority").agg(F.count(F.lit(1)).alias("gaps"))


def head_to_head(compared: DataFrame) -> DataFrame:
    status = F.col("status")
    return compared.groupBy(*PAIR).agg(
        F.count_if(status == "ahead").alias("ahead"), F.count_if(status == "behind").alias("behind"),
        F.count_if(status == "level").alias("level"), F.count(F.lit(1)).alias("compared"))


def benchmark_warnings(groups: DataFrame, values: DataFrame, summary: DataFrame) -> DataFrame:
    """Compatibility warnings; ``values`` holds base metrics only."""
    starts = summary.select("entity_id", F.date_format("period_start", "yyyy").alias("year"))
    market = F.col("market_id") if "market_id" in groups.columns else F.lit(None).cast("string")
    wide = groups.select(*PAIR, market.alias("market_id")).join(metric_overlap(groups, values), list(PAIR), "left")
    for key, tag in (("primary_id", "a"), ("secondary_id", "b")):
        wide = wide.join(starts.select(F.col("entity_id").alias(key), F.col("year").alias(f"{tag}_year")), key, "left")
    shared = (
        groups.select(*PAIR, market.alias("market_id"))
        .join(values.select(F.col("entity_id").alias("primary_id"), "metric_id"), "primary_id")
        .join(values.select(F.col("entity_id").alias("market_id"), "metric_id"), ["market_id", "metric_id"], "left_semi")
        .groupBy(*PAIR).agg(F.count(F.lit(1)).alias("market_overlap"))
    )
    wide = wide.join(shared, list(PAIR), "left").fillna(0, ["overlap", "market_overlap"])
    # --- fixed values: message texts ---
    return rule_rows(wide, PAIR, [
        (F.col("overlap") < 3, {"warning": F.concat(F.lit("Only "), F.col("overlap").cast("string"), F.lit(
            " metric(s) overlap between primary and competitor datasets — the benchmark view will be sparse."))}),
        (F.col("a_year") != F.col("b_year"), {"warning": "Datasets appear to cover different reporting periods — "
                                                           "comparisons should be interpreted with that in mind."}),
        (F.col("market_id").isNotNull() & (F.col("market_overlap") == 0), {
            "warning": "Market dataset does not share any metrics with the primary — market column will remain blank "
                       "across comparisons."}),
    ])


def benchmark_confidence(compared: DataFrame) -> DataFrame:
    coverage = F.col("compared") / F.lit(len(vocab.COMPARED_METRICS))
    return head_to_head(compared).select(
        *PAIR, coverage.alias("metric_coverage"), F.least(F.lit(1.0), coverage).alias("overall"))
