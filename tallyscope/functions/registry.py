"""The metric registry as rows, and name patterns built from its phrases.

``METRICS`` is the single source of the dimension tables below.  All of them
are fixed by the registry (57 metrics), so broadcasting them is always safe.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions import vocab
from tallyscope.functions.rows import literal_rows


@dataclass(frozen=True)
class Metric:
    metric_id: str
    ord: int
    display_name: str
    unit: str
    direction: str
    category: str
    aliases: tuple[str, ...]
    excluded: tuple[str, ...]
    question_aliases: tuple[str, ...] = ()

    @property
    def is_derived(self) -> bool:
        return not self.aliases

    @property
    def kind(self) -> str:
        """How values over periods combine: mean, latest, sum or other."""
        if self.unit == "percent":
            return "mean"
        if self.metric_id in vocab.STOCK_METRICS:
            return "stock"
        return "flow" if self.metric_id in vocab.FLOW_METRICS else "other"

    @property
    def importance(self) -> str:
        return next((tier for tier, ids in vocab.IMPORTANCE.items() if self.metric_id in ids), "low")


def metrics_of(rows: Sequence[tuple] = tuple(vocab.METRIC_ROWS), questions: Mapping[str, Sequence[str]] = vocab.QUESTION_ALIASES) -> list[Metric]:
    """Metrics in the order of their rows, each with the phrases questions use for it."""
    out = []
    for place, (metric_id, name, unit, direction, category, aliases, excluded) in enumerate(rows):
        out.append(Metric(metric_id, place, name, unit, direction, category, tuple(aliases), tuple(excluded), tuple(questions.get(metric_id, ()))))
    return out


METRICS = metrics_of()
BY_ID = {m.metric_id: m for m in METRICS}


def phrase_pattern(phrase: str, end: str = r"[\s_\-]") -> str:
    """Words of the phrase with any of blank, _ or - between and around them."""
    body = r"[\s_\-]*".join(re.escape(word) for word in phrase.split())
    return rf"(?i)(?:^|[\s_\-]){body}(?:$|{end})"


QUESTION_END = r"[\s_\-\?\.\!,]"


def column_phrases(metric: Metric) -> list[tuple[str, str]]:
    """(phrase, pattern) of the names standing for a metric."""
    return [(a, phrase_pattern(a)) for a in metric.aliases]


def excluded_phrases(metric: Metric) -> list[tuple[str, str]]:
    return [(a, phrase_pattern(a)) for a in metric.excluded]


def question_phrases(metric: Metric) -> list[tuple[str, str]]:
    return column_phrases(metric) + [(a, phrase_pattern(a, QUESTION_END)) for a in metric.question_aliases]


def metric_dimension(spark: SparkSession, metrics: list[Metric] | None = None) -> DataFrame:
    """One row per metric; a user table with the same columns can replace it."""
    rows = [(m.metric_id, m.ord, m.display_name, m.unit, m.direction, m.category, m.is_derived, m.kind,
             m.importance, m.metric_id in vocab.ADDITIVE_METRICS, m.metric_id in vocab.COMPARED_METRICS,
             m.metric_id in vocab.TREND_METRICS, m.metric_id in vocab.CORE_METRICS)
            for m in (metrics or METRICS)]
    return literal_rows(
        spark, rows,
        "metric_id string, ord int, display_name string, unit string, direction string, category string, "
        "is_derived boolean, kind string, importance string, is_additive boolean, is_compared boolean, "
        "is_trended boolean, is_core boolean",
    )


def with_metric(df: DataFrame, *columns: str) -> DataFrame:
    """Add registry columns to rows carrying ``metric_id`` (fixed-size broadcast)."""
    dim = metric_dimension(df.sparkSession).select("metric_id", *columns)
    return df.join(F.broadcast(dim), "metric_id")


def extend(extra: list[Metric]) -> list[Metric]:
    """Registry with user metrics appended; a repeated id replaces the original."""
    merged = {m.metric_id: m for m in METRICS}
    for m in extra:
        merged[m.metric_id] = replace(m, ord=merged[m.metric_id].ord if m.metric_id in merged else len(merged))
    return sorted(merged.values(), key=lambda m: m.ord)
