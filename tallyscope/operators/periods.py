"""Values of a metric in a year, a quarter, a span of years, or relative to the data.

Input rows are (entity_id, metric_id, period_date, seq, value) as given by
``trends.metric_rows``.  Aggregation follows the metric: percentages average,
stocks take the last row, everything else sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars
from tallyscope.functions.registry import with_metric

KEYS = ("entity_id", "metric_id")


def aggregate(rows: DataFrame, *keys: str) -> DataFrame:
    """Value per key: mean, latest or sum by the kind of the metric."""
    totals = rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.sum("value").alias("sum"),
        F.max_by("value", F.struct("period_date", "seq")).alias("last"))
    kind = F.col("kind")
    value = F.when(kind == "mean", F.col("mean")).when(kind == "stock", F.col("last")).otherwise(F.col("sum"))
    return with_metric(totals, "kind").select(*keys, value.alias("value"))


def yearly(rows: DataFrame) -> DataFrame:
    return aggregate(rows.withColumn("year", F.year("period_date")), *KEYS, "year")


def quarterly(rows: DataFrame) -> DataFrame:
    dated = rows.withColumn("year", F.year("period_date")).withColumn("quarter", F.quarter("period_date"))
    return aggregate(dated, *KEYS, "year", "quarter")


def available_years(rows: DataFrame) -> DataFrame:
    years = rows.select(*KEYS, F.year("period_date").alias("year")).distinct()
    return years.groupBy(*KEYS).agg(F.array_sort(F.collect_list("year")).alias("years"))


def labelled(values: DataFrame, label: Column | str) -> DataFrame:
    text = label if isinstance(label, Column) else F.lit(label)
    return values.select(*KEYS, text.alias("period"), "value")


def in_year(rows: DataFrame, year: int) -> DataFrame:
    """Every (entity, metric); a year without rows gives NULL and a note."""
    found = aggregate(rows.where(F.year("period_date") == year), *KEYS)
    every = available_years(rows)
    listed = F.concat(F.lit("["), F.array_join(F.transform("years", lambda y: y.cast("string")), ", "), F.lit("]"))
    note = F.when(F.col("value").isNull(), F.concat(F.lit(f"No data for FY{year}. Available years: "), listed, F.lit(".")))
    return every.join(found, list(KEYS), "left").select(*KEYS, F.lit(f"FY{year}").alias("period"), "value", note.alias("note"))


def in_quarter(rows: DataFrame, quarter: int, year: int | None = None) -> DataFrame:
    """One quarter; without a year that quarter of every year is pooled."""
    chosen = rows.where(F.quarter("period_date") == quarter)
    if year is not None:
        chosen = chosen.where(F.year("period_date") == year)
    return labelled(aggregate(chosen, *KEYS), f"Q{quarter}" + (f" {year}" if year is not None else ""))


def in_years(rows: DataFrame, start: int, end: int) -> DataFrame:
    return labelled(aggregate(rows.where(F.year("period_date").between(start, end)), *KEYS), f"{start}-{end}")


def ranked_years(rows: DataFrame) -> DataFrame:
    """Yearly values with recency 1 for the last year present, 2 for the one before."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("year"))
    return yearly(rows).withColumn("recency", F.row_number().over(newest))


def latest_year(rows: DataFrame) -> DataFrame:
    return labelled(ranked_years(rows).where("recency = 1"), F.concat(F.lit("FY"), F.col("year").cast("string"), F.lit(" (latest)")))


def previous_year(rows: DataFrame) -> DataFrame:
    """The second latest year that is present, not the calendar year before."""
    return labelled(ranked_years(rows).where("recency = 2"), F.concat(F.lit("FY"), F.col("year").cast("string"), F.lit(" (previous)")))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Change from the second period to the first: absolute and in percent."""
    a = first.select(*KEYS, F.col("period").alias("period_a"), F.col("value").alias("value_a"))
    b = second.select(*KEYS, F.col("period").alias("period_b"), F.col("value").alias("value_b"))
    delta = F.col("value_a") - F.col("value_b")
    pct = F.try_divide(delta, F.abs("value_b")) * 100.0
    both = with_metric(a.join(b, list(KEYS), "full_outer"), "unit", "display_name")
    text = F.when(pct.isNotNull(), F.concat(scalars.signed(pct, 2), F.lit("%"))).otherwise("not calculable")
    return both.select(*KEYS, "period_a", "value_a", "period_b", "value_b", delta.alias("delta"), pct.alias("pct"),
                       F.when(delta.isNotNull(), scalars.format_value(delta, F.col("unit"))).alias("delta_text"),
                       F.when(delta.isNotNull(), text).alias("pct_text"))


def metric_lookup(metrics: DataFrame) -> DataFrame:
    """Evidence row of each available metric of each entity."""
    start, end = scalars.period_label(F.col("period_start")), scalars.period_label(F.col("period_end"))
    period = F.when(F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), F.concat(start, F.lit(" to "), end)).otherwise(end)
    return metrics.where("value IS NOT NULL AND status <> 'unavailable'").select(
        "entity_id", "metric_id", F.concat("display_name", F.lit(" ("), F.col("entity_id"), F.lit(")")).alias("label"), "value",
        scalars.format_value(F.col("value"), F.col("unit")).alias("display_value"), "unit", "status", period.alias("period"),
        F.when(F.col("status") == "reported", "high").otherwise("medium").alias("confidence"))


def aggregate_period(metrics: DataFrame, kind: str) -> DataFrame:
    """Answer for data without a time series: only latest and raw have a value."""
    known = kind in ("latest", "raw")
    note = "Aggregate value; per-period breakdown unavailable." if known else (
        "Per-period breakdown is unavailable — the dataset has no time series.")
    return metrics.select("entity_id", "metric_id", F.lit(kind).alias("period"),
                          (F.col("value") if known else F.lit(None).cast("double")).alias("value"), F.lit(note).alias("note"))


def ratio_lookup(ratios: DataFrame) -> DataFrame:
    return ratios.select(
        "entity_id", "metric_id", F.concat("display_name", F.lit(" ("), F.col("entity_id"), F.lit(")")).alias("label"), "value",
        scalars.format_value(F.col("value"), F.col("unit")).alias("display_value"), "status",
        F.col("note").alias("formula"), F.when(F.col("status") == "calculated", "high").otherwise("medium").alias("confidence"))


def trend_evidence(series: DataFrame, k: int = 8) -> DataFrame:
    """The first k points of each series."""
    in_time = Window.partitionBy(*KEYS).orderBy("period_date")
    first = series.withColumn("position", F.row_number().over(in_time)).where(F.col("position") <= k)
    named = with_metric(first, "unit", "display_name")
    return named.select(*KEYS, "position", "period", "value",
                        F.concat("display_name", F.lit(" — "), F.col("period")).alias("label"),
                        scalars.format_value(F.col("value"), F.col("unit")).alias("display_value"))


def health_evidence(health: DataFrame, dimensions: DataFrame, entity: str = "entity_id") -> DataFrame:
    whole = health.select(entity, F.lit(-1).alias("ord"), F.lit("Overall health score").alias("label"), F.col("overall_score").alias("value"),
                          F.concat(scalars.fixed(F.col("overall_score"), 1), F.lit("/100 (grade "), F.col("grade"), F.lit(")")).alias("display_value"))
    parts = dimensions.select(entity, "ord", F.concat(F.lit("Dimension: "), F.col("dimension")).alias("label"), F.col("score").alias("value"),
                              F.concat(scalars.fixed(F.col("score"), 1), F.lit("/100")).alias("display_value"))
    return whole.unionByName(parts)


def first_risks(risks: DataFrame, keys: tuple[str, ...], k: int = 6) -> DataFrame:
    """High severity first, otherwise in rule order."""
    place = Window.partitionBy(*keys).orderBy((F.col("severity") != "high").cast("int"), "rule")
    return risks.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def comparison_evidence(compared: DataFrame, k: int, with_market: bool) -> DataFrame:
    """Evidence rows of the first k comparison rows of each group."""
    rows = compared.where("market_value IS NOT NULL") if with_market else compared
    place = Window.partitionBy("primary_id", "secondary_id").orderBy("place")
    rows = rows.withColumn("shown", F.row_number().over(place)).where(F.col("shown") <= k)
    name, unit = F.col("display_name"), F.col("unit")

    def item(position: int, column: str, entity: str, who: Column) -> Column:
        value = F.col(column)
        return F.when(value.isNotNull(), F.struct(
            F.lit(position).alias("position"), F.lit(entity).alias("entity"), F.concat(name, F.lit(" ("), who, F.lit(")")).alias("label"),
            value.alias("value"), scalars.format_value(value, unit).alias("display_value")))

    gap = F.col("percentage_gap")
    items = [item(0, "primary_value", "primary", F.col("primary_id")), item(1, "secondary_value", "secondary", F.col("secondary_id"))]
    if with_market:
        items.append(item(2, "market_value", "market", F.lit("Market")))
    items.append(F.when(gap.isNotNull(), F.struct(
        F.lit(3).alias("position"), F.lit("gap").alias("entity"), F.concat(name, F.lit(" — gap")).alias("label"), gap.alias("value"),
        F.concat(scalars.signed(gap, 2), F.lit("% ("), F.col("status"), F.lit(")")).alias("display_value"))))
    return rows.select("primary_id", "secondary_id", "metric_id", "shown", F.explode(F.array_compact(F.array(*items))).alias("e")).select(
        "primary_id", "secondary_id", "metric_id", "shown", "e.*")


def gap_evidence(gaps: DataFrame, k: int = 6) -> DataFrame:
    unit, gap = F.col("unit"), F.col("percentage_gap")
    tail = F.when(gap.isNotNull(), F.concat(F.lit(", gap: "), scalars.signed(gap, 2), F.lit("%"))).otherwise("")
    return gaps.where(F.col("place") <= k).select(
        "primary_id", "secondary_id", "place", "metric_id",
        F.concat("display_name", F.lit(" ("), F.col("priority"), F.lit(" priority)")).alias("label"), gap.alias("value"),
        F.concat(F.lit("You: "), scalars.format_value(F.col("current_value"), unit), F.lit(", benchmark: "),
                 scalars.format_value(F.col("benchmark_value"), unit), tail).alias("display_value"))


def roadmap(gaps: DataFrame, k: int = 6) -> DataFrame:
    unit = F.col("unit")
    targeted = gaps.where("near_term_target IS NOT NULL AND place <= %d" % k)
    return targeted.select(
        "primary_id", "secondary_id", "place", "metric_id", F.col("display_name").alias("label"),
        F.concat(F.lit("Current "), scalars.format_value(F.col("current_value"), unit), F.lit(" → near-term "),
                 scalars.format_value(F.col("near_term_target"), unit), F.lit(" → long-term "),
                 scalars.format_value(F.col("long_term_target"), unit), F.lit(" (priority "), F.col("priority"), F.lit(")")).alias("display_value"))


def merger_overview(combined: DataFrame, k: int = 8) -> DataFrame:
    """The first k combined metrics of each pair in scenario order."""
    from tallyscope.functions import vocab

    order = F.create_map(*[x for i, m in enumerate(vocab.ADDITIVE_METRICS) for x in (F.lit(m), F.lit(i))])
    place = Window.partitionBy("primary_id", "secondary_id").orderBy(order[F.col("metric_id")])
    return combined.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select(
        "primary_id", "secondary_id", "place", "metric_id", F.col("display_name").alias("label"), "value",
        scalars.format_value(F.col("value"), F.col("unit")).alias("display_value"))


def profile_evidence(overview: DataFrame, missing: DataFrame, duplicates: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows, columns, quality, missing cells and duplicate rows as evidence (one-row inputs)."""
    row = overview.join(missing.select("total_missing", F.col("missing_ratio").alias("m_ratio"))).join(
        duplicates.select("duplicate_rows", F.col("duplicate_ratio").alias("d_ratio"))).join(quality.select("overall_score", "grade"))

    def item(position: int, label: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(label).alias("label"), value.cast("double").alias("value"), text.alias("display_value"))

    score = F.concat(scalars.fixed(F.col("overall_score"), 1), F.lit("/100 (grade "), F.col("grade"), F.lit(")"))
    missing_text = F.concat(scalars.grouped(F.col("total_missing").cast("double"), 0), F.lit(" cells ("),
                            scalars.fixed(F.col("m_ratio") * 100, 2), F.lit("% of the data)"))
    double_text = F.concat(scalars.grouped(F.col("duplicate_rows").cast("double"), 0), F.lit(" rows ("),
                           scalars.fixed(F.col("d_ratio") * 100, 2), F.lit("%)"))
    items = [
        item(0, "Rows", F.col("rows"), scalars.grouped(F.col("rows").cast("double"), 0)),
        item(1, "Columns", F.col("columns"), scalars.grouped(F.col("columns").cast("double"), 0)),
        item(2, "Overall quality", F.col("overall_score"), score),
        item(3, "Missing values", F.col("total_missing"), missing_text),
        item(4, "Duplicate rows", F.col("duplicate_rows"), double_text),
    ]
    return row.select(F.inline(F.array(*items)))


def column_evidence(profile: DataFrame, k: int = 50) -> DataFrame:
    return profile.orderBy("ord").limit(k).select(
        "ord", F.concat("column_name", F.lit(" ("), F.col("column_class"), F.lit(")")).alias("display_value"))
