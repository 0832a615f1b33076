"""Recognising metrics in names and extracting their values per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import vocab
from tallyscope.functions.registry import (
    METRICS, Metric, column_phrases, excluded_phrases, with_metric,
)
from tallyscope.functions.rows import literal_rows, name_of, quoted
from tallyscope.operators.columns import melt_numbers, numeric_columns

PERIODIC_MAX_ROWS = 60


def any_of(patterns: Sequence[str]) -> str:
    """One pattern that hits when any of the patterns does."""
    return "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns)


def padded(text: str) -> str:
    return f"concat(' ', {name_of(text)}, ' ')"


def longest_word(phrase: str) -> str:
    return max(phrase.split(), key=len)


def _mentions_sql(text: str, phrase: str, found: Mapping[str, str] | None = None) -> str:
    """Cheap necessary condition: the longest word of the phrase occurs; ``found`` has SQL that already knows it."""
    word = longest_word(phrase)
    return found[word] if found else f"contains(lower({name_of(text)}), {quoted(word)})"


def match_length_sql(text: str, phrase: str, pattern: str, found: Mapping[str, str] | None = None) -> str:
    """Characters matched by the first hit of the pattern, NULL without a hit.

    Plain substring search settles almost every phrase; the regular expression
    runs only where its longest word is present.
    """
    hit = f"nullif(length(regexp_extract({padded(text)}, {quoted(pattern)}, 0)), 0)"
    return f"CASE WHEN {_mentions_sql(text, phrase, found)} THEN {hit} END"


def unless_excluded_sql(text: str, metric: Metric, value: str, found: Mapping[str, str] | None = None) -> str:
    if not metric.excluded:
        return value
    blocked = " OR ".join(
        f"({_mentions_sql(text, phrase, found)} AND {padded(text)} RLIKE {quoted(pattern)})" for phrase, pattern in excluded_phrases(metric))
    return f"CASE WHEN NOT ({blocked}) THEN {value} END"


def match_struct(name: str, metrics: Sequence[Metric] = METRICS) -> Column:
    """Struct(specificity, order, metric_id) of the best metric, or NULL.

    A map-only expression: no row is multiplied by the pattern table.  Structs
    compare field by field, so the greatest has the longest match, then the
    first place in the registry.
    """
    candidates = []
    for m in metrics:
        if m.is_derived:
            continue
        first = f"coalesce({', '.join(match_length_sql(name, ph, pt) for ph, pt in column_phrases(m))})"
        hit = unless_excluded_sql(name, m, first)
        candidates.append(f"named_struct('specificity', {hit}, 'order', {-m.ord}, 'metric_id', {quoted(m.metric_id)})")
    return F.expr(f"array_max(filter(array({', '.join(candidates)}), c -> c.specificity IS NOT NULL))")


def match_names(df: DataFrame, name: str, metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """Rows plus (metric_id, specificity, confidence) of the text in ``name``."""
    best = F.col("best_match")
    confidence = F.least(F.lit(1.0), F.round(0.65 + best["specificity"] * 0.04, 4))
    return df.withColumn("best_match", match_struct(name, metrics)).withColumns({
        "metric_id": best["metric_id"], "specificity": best["specificity"],
        "match_confidence": F.when(best.isNotNull(), confidence),
    }).drop("best_match")


def entity_summary(wide: DataFrame, entity: str = "entity_id", date: str | None = "period_date") -> DataFrame:
    """Rows, shape and period of every entity."""
    dated = [F.min(date).alias("period_start"), F.max(date).alias("period_end")] if date else [
        F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end")]
    rows = F.col("rows")
    shape = (
        F.when(rows == 0, "unknown").when(rows == 1, "single_period")
        .when(F.lit(date is not None) & (rows <= PERIODIC_MAX_ROWS), "periodic").otherwise("transactional")
    )
    return wide.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), *dated).withColumn("shape", shape)


def column_totals(wide: DataFrame, entity: str, date: str | None, columns: Sequence[str] | None,
                  tie_break: Sequence[str] = ()) -> DataFrame:
    """Per (entity, column): count, sum, mean, max and latest value.

    All are combined map-side, so an entity holding a large share of the rows
    arrives at the shuffle as one row per task and column.
    """
    wanted = list(columns) if columns is not None else [c for c in numeric_columns(wide) if c != entity]
    keep = [name_of(entity)] + ([f"CAST({name_of(date)} AS TIMESTAMP) AS at"] if date else [])
    keep += [f"-{name_of(t)} AS tie_{i}" for i, t in enumerate(tie_break)]
    long = melt_numbers(wide, wanted, keep)
    latest = F.lit(None).cast("double")
    if date:
        order = F.struct("at", *[f"tie_{i}" for i in range(len(tie_break))])
        latest = F.max_by("value", F.when(F.col("at").isNotNull(), order))
    return long.groupBy(entity, "column_name").agg(
        F.count("value").alias("n"), F.sum("value").alias("sum"), F.avg("value").alias("mean"),
        F.max("value").alias("max"), latest.alias("latest"))


def named_columns(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ord, column_name, metric_id, specificity, match_confidence) of the columns that match.

    Bounded by the width of the table, so it may be broadcast.
    """
    names = literal_rows(wide.sparkSession, enumerate(columns), "ord int, column_name string")
    return match_names(names, "column_name").where(F.col("metric_id").isNotNull())


def ranked_candidates(totals: DataFrame, named: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Every column standing for a metric of an entity, best first (rank 1)."""
    order = Window.partitionBy(entity, "metric_id").orderBy(F.desc("match_confidence"), "ord")
    return totals.join(F.broadcast(named), "column_name").withColumn("rank", F.row_number().over(order))


def match_summary(candidates: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Picked column and the other candidates of each metric of each entity."""
    others = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "column_name"))))
    return candidates.groupBy(entity, "metric_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("column_name"))).alias("picked_column"),
        F.max(F.when(F.col("rank") == 1, F.col("match_confidence"))).alias("confidence"),
        F.transform(others, lambda s: s["column_name"]).alias("other_candidates"))


def extract_metrics(
    wide: DataFrame, entity: str = "entity_id", date: str | None = "period_date",
    columns: Sequence[str] | None = None, profile: DataFrame | None = None, tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per (entity, recognised metric) with value, status and source column.

    ``profile`` (column_name, column_class) restricts matching to columns
    classed numerical; without it all numeric columns are candidates.
    """
    wanted = list(columns) if columns is not None else [c for c in numeric_columns(wide) if c not in (entity, date)]
    named = named_columns(wide, wanted)
    if profile is not None:
        numeric = profile.where(F.col("column_class") == "numerical").select("column_name")
        named = named.join(F.broadcast(numeric), "column_name", "left_semi")  # one row per column
    candidates = ranked_candidates(column_totals(wide, entity, date, wanted, tie_break), named, entity)
    picked = with_metric(candidates.where(F.col("rank") == 1).drop("ord"),
                         "display_name", "unit", "direction", "category", "kind")
    rows = picked.join(entity_summary(wide, entity, date), entity)

    shape, kind = F.col("shape"), F.col("kind")
    is_mean = F.col("unit") == "percent"
    is_latest = (kind == "stock") & (shape == "periodic")
    is_flow = (kind == "flow") & (shape == "periodic")
    estimated = ~is_mean & is_latest & F.col("latest").isNull()
    value = (
        F.when(is_mean, F.col("mean"))
        .when(is_latest, F.coalesce("latest", "max"))
        .when(is_flow, F.col("sum"))
        .when(shape == "single_period", F.when(F.col("mean") != 0, F.col("mean")).otherwise(F.col("sum")))
        .otherwise(F.coalesce("sum", "mean"))
    )
    note = (
        F.when(is_mean, "Aggregated as mean of column values (percentage metric).")
        .when(estimated, "Latest-by-date unavailable; used max as an approximation.")
        .when(is_latest, "Latest value across periods.")
        .when(is_flow, "Summed across periods.")
        .when(shape == "single_period", "Single-period value.")
        .otherwise("Aggregated across all rows.")
    )
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    status = F.when(finite.isNull(), "unavailable").when(estimated, "estimated").otherwise("reported")
    return rows.select(
        entity, "metric_id", "display_name", finite.alias("value"), "unit", status.alias("status"), "direction",
        "category", F.col("column_name").alias("source_column"), F.col("match_confidence").alias("confidence"),
        note.alias("note"), "shape", "rows", "period_start", "period_end",
    )


def value_map(metrics: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, metric_id, value) of the metrics that have a value."""
    return metrics.where(F.col("value").isNotNull()).select(entity, "metric_id", "value")


def pivot_values(values: DataFrame, ids: Sequence[str], *keys: str) -> DataFrame:
    """One row per key with a column per metric id, NULL where absent."""
    return values.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN metric_id = {quoted(i)} THEN value END) AS {name_of(i)}") for i in ids])


def in_display_order(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("entity_id", "category", "metric_id")


def kpi_ranking(metrics: DataFrame, entity: str = "entity_id", k: int = 6) -> DataFrame:
    """The first k available metrics of each entity in the fixed KPI order."""
    place = F.create_map(*[v for i, m in enumerate(vocab.KPI_ORDER) for v in (F.lit(m), F.lit(i))])
    # Metrics outside the list keep their display order after it.
    order = Window.partitionBy(entity).orderBy(F.coalesce(place[F.col("metric_id")], F.lit(999)), "category", "metric_id")
    return metrics.where(F.col("value").isNotNull()).withColumn("kpi_rank", F.row_number().over(order)).where(F.col("kpi_rank") <= k)


