"""Financial health of every entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.rows import quoted, stack_rows
from tallyscope.operators.metrics import pivot_values

DIMENSIONS = list(vocab.HEALTH_WEIGHTS)
INPUTS = sorted({c[1] for c in vocab.HEALTH_CURVES} - {"revenue_growth"})


def mean_of_known(values: Sequence[Column]) -> Column:
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(known) > 0, total / F.size(known))


def health_inputs(entities: DataFrame, ratios: DataFrame, trends: DataFrame | None = None,
                  keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """One row per entity: the ratios the score reads and the revenue trend."""
    usable = ratios.where(F.col("value").isNotNull() & (F.col("status") != "unavailable"))
    wide = entities.select(*keys).join(pivot_values(usable, INPUTS, *keys), list(keys), "left")
    if trends is None:
        return wide.withColumn("revenue_growth", F.lit(None).cast("double")).withColumn("revenue_direction", F.lit(None).cast("string"))
    revenue = trends.where("metric_id = 'revenue'").select(
        *keys, F.col("growth_rate").alias("revenue_growth"), F.col("direction").alias("revenue_direction"))
    return wide.join(revenue, list(keys), "left")


def score_health(inputs: DataFrame, weights: Mapping[str, float] = vocab.HEALTH_WEIGHTS) -> DataFrame:
    """Dimension scores, weighted overall score over the scored dimensions, grade."""
    scored = inputs
    for dim in DIMENSIONS:
        curves = [scalars.curve_score(F.col(i), zero, full) for d, i, zero, full in vocab.HEALTH_CURVES if d == dim]
        scored = scored.withColumn(dim, mean_of_known(curves))
    weight = sum((F.when(F.col(d).isNotNull(), weights[d]).otherwise(0.0) for d in DIMENSIONS), F.lit(0.0))
    points = sum((F.coalesce(F.col(d) * weights[d], F.lit(0.0)) for d in DIMENSIONS), F.lit(0.0))
    scored_dims = sum((F.col(d).isNotNull().cast("int") for d in DIMENSIONS), F.lit(0))
    return scored.withColumn("dimensions_scored", scored_dims).withColumn(
        "overall_score", F.when(scored_dims > 0, F.coalesce(F.try_divide(points, weight), F.lit(0.0))).otherwise(0.0)
    ).withColumn("grade", F.when(scored_dims > 0, scalars.grade(F.col("overall_score"))).otherwise("F"))


def dimension_rows(health: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(keys, ord, dimension, score) of the scored dimensions."""
    cells = [[str(i), quoted(d), d] for i, d in enumerate(DIMENSIONS)]
    return health.selectExpr(*keys, stack_rows(cells, ["ord", "dimension", "score"])).where("score IS NOT NULL")


def weakest_dimension(health: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    best = F.min(F.struct("score", "ord", "dimension"))
    return dimension_rows(health, keys).groupBy(*keys).agg(best.alias("w")).select(
        *keys, F.col("w.dimension").alias("dimension"), F.col("w.score").alias("score"))


def top_dimensions(health: DataFrame, k: int = 3, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    return dimension_rows(health, keys).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def health_notes(health: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(keys, ord, note): the remarks that apply to each entity."""
    missing = F.array_compact(F.array(*[F.when(F.col(d).isNull(), d) for d in DIMENSIONS]))
    nothing = F.col("dimensions_scored") == 0
    # --- fixed values: message texts ---
    notes = [
        (nothing, F.lit("Insufficient financial metrics to compute a health score.")),
        (nothing, F.lit("Provide at least revenue / profit / assets or equity in your dataset.")),
        (~nothing & (F.size(missing) > 0),
         F.concat(F.lit("Dimensions not scored (missing data): "), F.array_join(missing, ", "), F.lit("."))),
        (~nothing & (F.col("net_margin") < 0), F.lit("Net margin is negative — the company is loss-making on aggregate.")),
        (~nothing & (F.col("debt_to_equity") > 2.0), F.lit("Debt-to-equity above 2.0 signals elevated leverage.")),
        (~nothing & (F.col("current_ratio") < 1.0),
         F.lit("Current ratio below 1.0 — short-term liabilities exceed short-term assets.")),
        (~nothing & (F.col("revenue_direction") == "declining"),
         F.concat(F.lit("Revenue is declining across observed periods ("), scalars.fixed(F.col("revenue_growth"), 1), F.lit("% total change)."))),
    ]
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.when(c, t).alias("note")) for i, (c, t) in enumerate(notes)])
    return health.select(*keys, F.explode(listed).alias("n")).select(*keys, "n.ord", "n.note").where("note IS NOT NULL")


def self_confidence(summary: DataFrame, values: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Share of core metrics found, share of a year's periods, and their blend."""
    core = values.where(F.col("metric_id").isin(vocab.CORE_METRICS)).groupBy(entity).agg(F.count(F.lit(1)).alias("core_found"))
    covered = F.coalesce("core_found", F.lit(0)) / F.lit(len(vocab.CORE_METRICS))
    periods = F.least(F.lit(1.0), F.col("rows") / F.lit(12))
    return summary.join(core, entity, "left").select(
        entity, covered.alias("metric_coverage"), F.when(F.col("rows") > 0, periods).alias("period_coverage"),
    ).withColumn("overall", F.coalesce(0.6 * F.col("metric_coverage") + 0.4 * F.col("period_coverage"), F.col("metric_coverage"))
    ).withColumn("level", scalars.coverage_level(F.col("overall")))
