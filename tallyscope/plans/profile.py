"""The whole profile of one table, each part a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.rows import materialize
from tallyscope.operators import classes, correlation, distributions, periods, quality, summaries
from tallyscope.operators.columns import numeric_columns, string_columns


@dataclass
class TableProfile:
    """Profile of ``table``: missing tokens are normalised first.

    The column facts are written once (one row per column of the table): most
    parts start from them.
    """

    table: DataFrame
    weights: Mapping[str, float] = field(default_factory=lambda: dict(vocab.QUALITY_WEIGHTS))

    @cached_property
    def clean(self) -> DataFrame:
        return scalars.normalize_missing(self.table)

    @cached_property
    def columns(self) -> DataFrame:
        return materialize(classes.classify(classes.column_facts(self.clean)), "column-profile")

    @cached_property
    def overview(self) -> DataFrame:
        return summaries.overview(self.columns)

    @cached_property
    def missing(self) -> DataFrame:
        """Missing cells per column, taken from the column facts."""
        return self.columns.select("rows", "ord", "column_name", "missing_count", F.round("missing_ratio", 6).alias("missing_ratio"))

    @cached_property
    def missing_totals(self) -> DataFrame:
        return summaries.missing_totals(self.missing)

    @cached_property
    def duplicates(self) -> DataFrame:
        return summaries.duplicate_rows(self.clean)

    @cached_property
    def id_columns(self) -> DataFrame:
        return self.columns.where("column_class = 'id'")

    @cached_property
    def id_duplicates(self) -> DataFrame:
        """Repeats per identifier column, from its counts: surplus = values - distinct values."""
        return self.id_columns.select(
            "column_name", (F.col("non_null") - F.col("unique_count")).alias("duplicate_row_count"), "non_null")

    @cached_property
    def numeric_stats(self) -> DataFrame:
        """Statistics of the columns classed numerical."""
        wanted = self.columns.where("column_class = 'numerical'").select("column_name")
        return summaries.numeric_stats(self.clean, numeric_columns(self.clean)).join(F.broadcast(wanted), "column_name", "left_semi")

    @cached_property
    def outliers(self) -> DataFrame:
        return distributions.outliers(self.clean, numeric_columns(self.clean))

    @cached_property
    def histograms(self) -> DataFrame:
        wanted = self.columns.where("column_class = 'numerical'").select("column_name")
        return distributions.histogram(self.clean).join(F.broadcast(wanted), "column_name", "left_semi")

    @cached_property
    def correlations(self) -> DataFrame:
        """Pairs of columns classed numerical."""
        wanted = self.columns.where("column_class = 'numerical'").select("column_name")
        pairs = correlation.correlation_pairs(self.clean)
        for side in ("column_a", "column_b"):
            pairs = pairs.join(F.broadcast(wanted.withColumnRenamed("column_name", side)), side, "left_semi")
        return pairs

    @cached_property
    def quality(self) -> DataFrame:
        """The four dimensions, overall score and grade: one-row inputs side by side."""
        parts = quality.completeness(self.missing_totals)
        for part in (
            quality.uniqueness(self.duplicates, self.id_duplicates), quality.validity(self.columns),
            quality.consistency(self.clean, self.columns, string_columns(self.clean)),
        ):
            parts = parts.join(F.broadcast(part))
        return quality.overall(parts, self.weights)

    @cached_property
    def column_quality(self) -> DataFrame:
        ids = self.id_columns.select(
            "column_name", F.col("non_null").alias("count"), (F.col("non_null") - F.col("unique_count")).alias("duplicate_count"))
        return quality.column_scores(self.columns, self.outliers, ids)

    @cached_property
    def evidence(self) -> DataFrame:
        return periods.profile_evidence(self.overview, self.missing_totals, self.duplicates, self.quality)

    @cached_property
    def column_evidence(self) -> DataFrame:
        return periods.column_evidence(self.columns)
