"""Self, merger and benchmark analysis of many entities in one run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.operators import benchmark, health, insights, metrics, ratios, scenario, trends
from tallyscope.operators.columns import numeric_columns


@dataclass
class SelfAnalysis:
    """Every part of the analysis of single entities, each a lazy DataFrame.

    ``wide`` is a table of any number of entities with one row per period or
    transaction.  The extracted metrics are written once: all parts read them.
    """

    wide: DataFrame
    entity: str = "entity_id"
    date: str | None = "period_date"
    columns: Sequence[str] | None = None
    profile: DataFrame | None = None

    @cached_property
    def names(self) -> list[str]:
        return list(self.columns or [c for c in numeric_columns(self.wide) if c not in (self.entity, self.date)])

    @cached_property
    def metrics(self) -> DataFrame:
        found = metrics.extract_metrics(self.wide, self.entity, self.date, self.names, self.profile)
        return materialize(found, "metrics")

    @cached_property
    def values(self) -> DataFrame:
        return metrics.value_map(self.metrics, self.entity)

    @cached_property
    def entities(self) -> DataFrame:
        return self.metrics.select(self.entity).distinct()

    @cached_property
    def summary(self) -> DataFrame:
        return metrics.entity_summary(self.wide, self.entity, self.date)

    @cached_property
    def ratios(self) -> DataFrame:
        return ratios.compute_ratios(self.values, self.entity)

    @cached_property
    def all_values(self) -> DataFrame:
        return ratios.with_ratios(self.values, self.entity)

    @cached_property
    def metric_rows(self) -> DataFrame:
        return trends.metric_rows(self.wide, self.names, self.entity, self.date)

    @cached_property
    def trends(self) -> DataFrame:
        from tallyscope.functions import vocab

        rows = trends.metric_rows(self.wide, self.names, self.entity, self.date, vocab.TREND_METRICS)
        return trends.analyze_trends(rows, self.entity)

    @cached_property
    def series(self) -> DataFrame:
        return trends.period_series(self.metric_rows, self.entity)

    @cached_property
    def health(self) -> DataFrame:
        found = self.trends if self.date else None
        return health.score_health(health.health_inputs(self.entities, self.ratios, found, (self.entity,)))

    @cached_property
    def insights(self) -> DataFrame:
        wide = insights.self_inputs(self.entities, self.values, self.ratios, self.trends, self.health, self.entity)
        return insights.self_insights(wide, self.entity)

    @cached_property
    def confidence(self) -> DataFrame:
        return health.self_confidence(self.summary, self.values, self.entity)


@dataclass
class MergerAnalysis:
    """Every part of the combination of many pairs (primary_id, secondary_id).

    The combined values, ratios and the wide row of each pair are written once:
    rules, scores and insights read one small table.
    """

    base: SelfAnalysis
    pairs: DataFrame
    deal_type: str | None = None

    @cached_property
    def checked(self) -> DataFrame:
        return scenario.checked_pairs(self.pairs)

    @cached_property
    def combined(self) -> DataFrame:
        return materialize(scenario.combined_scenario(self.checked, self.base.values), "combined")

    @cached_property
    def ratios(self) -> DataFrame:
        return materialize(scenario.combined_ratios(self.combined), "combined-ratios")

    @cached_property
    def table(self) -> DataFrame:
        return scenario.scenario_table(self.checked, self.base.all_values, self.combined, self.ratios)

    @cached_property
    def health(self) -> DataFrame:
        return health.score_health(scenario.pair_health_inputs(self.checked, self.ratios))

    @cached_property
    def wide(self) -> DataFrame:
        return materialize(scenario.pair_wide(self.checked, self.base.values, self.combined, self.ratios), "pairs")

    @cached_property
    def synergies(self) -> DataFrame:
        return scenario.synergies(self.wide)

    @cached_property
    def risks(self) -> DataFrame:
        return scenario.risks(self.wide)

    @cached_property
    def attractiveness(self) -> DataFrame:
        return scenario.attractiveness(self.wide, self.health, self.synergies, self.risks)

    @cached_property
    def overlap(self) -> DataFrame:
        return scenario.metric_overlap(self.checked, self.base.values)

    @cached_property
    def warnings(self) -> DataFrame:
        return scenario.merger_warnings(self.checked, self.base.values, self.base.summary, self.deal_type)

    @cached_property
    def insights(self) -> DataFrame:
        return insights.merger_insights(self.wide, self.synergies, self.risks)


@dataclass
class BenchmarkAnalysis:
    """Every part of the comparison of many groups (primary_id, secondary_id, market_id)."""

    base: SelfAnalysis
    groups: DataFrame

    @cached_property
    def checked(self) -> DataFrame:
        return scenario.checked_pairs(self.groups)

    @cached_property
    def comparisons(self) -> DataFrame:
        return benchmark.comparisons(self.checked, self.base.all_values)

    @cached_property
    def gaps(self) -> DataFrame:
        return benchmark.gaps(self.comparisons)

    @cached_property
    def warnings(self) -> DataFrame:
        return benchmark.benchmark_warnings(self.checked, self.base.values, self.base.summary)

    @cached_property
    def confidence(self) -> DataFrame:
        return benchmark.benchmark_confidence(self.comparisons)

    @cached_property
    def insights(self) -> DataFrame:
        return insights.benchmark_insights(self.checked, self.gaps)

    @cached_property
    def health(self) -> DataFrame:
        """Health of the primary entities without trends, for context."""
        primaries = self.groups.select(F.col("primary_id").alias("entity_id")).distinct()
        return health.score_health(health.health_inputs(primaries, self.base.ratios))
