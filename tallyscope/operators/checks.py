"""Validation of a loaded table and the shallow schema taken at load time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import vocab
from tallyscope.functions.rows import literal_rows, quoted, stack_rows
from tallyscope.operators.classes import column_facts
from tallyscope.operators.columns import col_of
from tallyscope.operators.summaries import sample_values

MISSING_WARN = 0.05
MISSING_HIGH = 0.5


def column_name_warnings(names: Sequence[str]) -> list[str]:
    """Duplicate, blank and control-character names of a raw header."""
    out = []
    repeated = sorted(n for n, c in Counter(names).items() if c > 1)
    if repeated:
        out.append(f"Duplicate column names detected: {repeated[:5]}")
    blank = [n for n in names if not n.strip()]
    if blank:
        out.append(f"{len(blank)} column(s) have empty/whitespace-only names")
    unusual = [n for n in names if set(n) & set("\n\r\t")]
    if unusual:
        out.append(f"{len(unusual)} column name(s) contain whitespace/control characters")
    return out


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get their position as suffix: Spark columns must differ."""
    seen = Counter(names)
    return [f"{n}_{i}" if seen[n] > 1 and n in names[:i] else n for i, n in enumerate(names)]


def null_counts(df: DataFrame) -> DataFrame:
    """Rows, all-null rows and nulls per column, in one scan."""
    everything_null = F.lit(True)
    for name in df.columns:
        everything_null = everything_null & col_of(name).isNull()
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(everything_null).alias("empty_rows"),
        *[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    cells = [[str(i), quoted(name), f"rows - n{i}"] for i, name in enumerate(df.columns)]
    return totals.selectExpr("rows", "empty_rows", stack_rows(cells, ["ord", "column_name", "nulls"]))


def empty_columns(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("rows") > 0) & (F.col("nulls") == F.col("rows"))).select("ord", "column_name")


def empty_rows(counts: DataFrame) -> DataFrame:
    share = F.when(F.col("rows") > 0, 100.0 * F.col("empty_rows") / F.col("rows")).otherwise(0.0)
    return counts.select("rows", "empty_rows", F.round(share, 2).alias("empty_pct")).limit(1)


def missing_warnings(counts: DataFrame) -> DataFrame:
    ratio = F.col("nulls") / F.when(F.col("rows") > 0, F.col("rows"))
    level = F.when(ratio >= MISSING_HIGH, "high").when(ratio >= MISSING_WARN, "warn")
    pct = F.format_string("%.1f", F.round(ratio * 100, 1))
    verb = F.when(ratio >= MISSING_HIGH, "has").otherwise("contains")
    message = F.concat(F.lit("Column '"), F.col("column_name"), F.lit("' "), verb, F.lit(" "), pct, F.lit("% missing values"))
    return counts.select("ord", "column_name", ratio.alias("ratio"), level.alias("level"), message.alias("message")).where("level is not null")


class InvalidTable(ValueError):
    """The table cannot be analysed at all."""


def validate(df: DataFrame, header: Sequence[str] | None = None) -> DataFrame:
    """Every warning of a table as (ord, check, message); no columns is fatal."""
    if not df.columns:
        raise InvalidTable("Dataset has no columns")
    spark = df.sparkSession
    counts = null_counts(df)
    named = [(i, "column_names", m) for i, m in enumerate(column_name_warnings(header or df.columns))]
    names = literal_rows(spark, named, "ord int, check string, message string")
    no_rows = counts.where("rows = 0").limit(1).select(F.lit(0).alias("ord"), F.lit("rows").alias("check"), F.lit("Dataset has 0 rows").alias("message"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "column_name"))), lambda s: s["column_name"])
    empties = empty_columns(counts).agg(F.count(F.lit(1)).alias("n"), F.slice(in_order, 1, 5).alias("first")).where("n > 0").select(
        F.lit(0).alias("ord"), F.lit("empty_columns").alias("check"),
        F.concat(F.col("n").cast("string"), F.lit(" column(s) are entirely null: "), F.array_join("first", ", ")).alias("message"))
    rows = empty_rows(counts).where("empty_rows > 0").select(
        F.lit(0).alias("ord"), F.lit("empty_rows").alias("check"),
        F.concat(F.col("empty_rows").cast("string"), F.lit(" entirely-empty row(s) ("), F.col("empty_pct").cast("string"), F.lit("%)")).alias("message"))
    ratios = missing_warnings(counts).select("ord", F.lit("missing_ratio").alias("check"), "message")
    return names.unionByName(no_rows).unionByName(empties).unionByName(rows).unionByName(ratios)


def ingest_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The shallow schema of a table as loaded: tokens are not yet normalised."""
    facts = column_facts(df, columns)
    kind, non_null, unique, rows = F.col("kind"), F.col("non_null"), F.col("unique_count"), F.col("rows")
    ratio = F.when(rows > 0, unique / rows).otherwise(0.0)
    inferred = (
        F.when(non_null == 0, "unknown").when(kind == "boolean", "boolean").when(kind == "integer", "integer")
        .when(kind == "float", F.when(F.col("all_whole") == 1, "integer").otherwise("float"))
        .when(kind.isin("timestamp", "date"), "datetime")
        .when((kind == "string") & (F.col("date_ratio") >= 0.9), "datetime")
        .when(kind.isin("string", "complex"), "string").otherwise("unknown")
    )
    hinted = F.col("column_name").rlike(vocab.INGEST_IDENTIFIER_NAME)
    typed = facts.withColumn("base_type", inferred)
    base = F.col("base_type")
    is_id = (unique == non_null) & (unique > 1) & (hinted | base.isin("integer", "string"))
    long_text = F.coalesce(F.col("avg_length") >= 40, F.lit(False))
    is_text = (base == "string") & ~is_id & long_text
    is_categorical = (
        ((base == "string") & ~is_id & ~long_text & ((ratio <= 0.05) | (unique <= 50)) & (unique > 0))
        | ((base == "integer") & ~is_id & (unique <= 10) & (ratio <= 0.5))
    )
    missing = rows - non_null
    return typed.select(
        "ord", "column_name", F.col("kind").alias("dtype"),
        F.when(is_id & (base == "string"), "identifier").otherwise(base).alias("inferred_type"),
        (missing > 0).alias("nullable"), "unique_count", missing.alias("missing_count"),
        F.round(F.when(rows > 0, missing / rows).otherwise(0.0), 6).alias("missing_ratio"),
        is_id.alias("is_identifier"), is_categorical.alias("is_categorical"),
        base.isin("integer", "float").alias("is_numerical"), (base == "datetime").alias("is_datetime"), is_text.alias("is_text"),
    )


def schema_with_samples(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    samples = sample_values(df, order_by).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("sample_values"))
    return ingest_schema(df).join(F.broadcast(samples), "column_name", "left")


__all__ = ["column_name_warnings", "unique_names", "null_counts", "empty_columns", "empty_rows", "missing_warnings",
           "validate", "InvalidTable", "ingest_schema", "schema_with_samples"]
