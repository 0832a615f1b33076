"""Per-class column statistics, missing values and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars
from tallyscope.functions.rows import materialize, name_of, quoted, stack_rows
from tallyscope.operators.columns import DIGEST_OVER_BYTES, col_of, melt, melt_numbers, number_sql, numeric_columns, row_key, value_key
from tallyscope.operators.quantiles import exact_quantiles, quantile_columns

#: Rows that are broadcast at most.
BROADCAST_ROWS = 100_000
PERCENTILES = {0.10: "p10", 0.25: "q1", 0.50: "median", 0.75: "q3", 0.90: "p90"}


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, date: str | None = None,
                  tie_break: Sequence[str] = ()) -> DataFrame:
    """Descriptive statistics per numeric column, exact percentiles included.

    With ``date``, ``latest_value`` is the number in the row of the greatest
    date; among equal dates the row smallest in ``tie_break`` (numeric columns)
    wins, which replaces file order.
    """
    wanted = list(columns) if columns is not None else numeric_columns(df)
    long = melt_numbers(df, wanted)
    aggs = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum("value").alias("sum"),
    ]
    basics = long.groupBy("column_name").agg(*aggs)
    if date:
        basics = basics.join(F.broadcast(latest_values(df, wanted, date, tie_break)), "column_name")
    quantiles = quantile_columns(exact_quantiles(long.select("column_name", "value"), list(PERCENTILES)), PERCENTILES)
    # One row per column on both sides.
    out = basics.join(F.broadcast(quantiles), "column_name").withColumn("iqr", F.col("q3") - F.col("q1"))
    floats = [c for c in out.columns if c not in ("column_name", "count")]
    return out.select("column_name", "count", *[scalars.safe_round(F.col(c)).alias(c) for c in floats])


def latest_values(df: DataFrame, columns: Sequence[str], date: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """(column_name, latest_value): the last number of each column by date, then smallest ``tie_break``.

    Grouped by column, a struct as the order would have all cells sorted first;
    over the whole table each task keeps one row.
    """
    at = f"CAST({name_of(date)} AS TIMESTAMP)"
    order = f"struct({', '.join([at, *[f'-{name_of(t)}' for t in tie_break]])})"
    found = [F.expr(f"max_by({number_sql(c)}, CASE WHEN {at} IS NOT NULL AND {number_sql(c)} IS NOT NULL THEN {order} END)").alias(f"v{i}") for i, c in enumerate(columns)]
    return df.agg(*found).selectExpr(stack_rows([[quoted(c), f"v{i}"] for i, c in enumerate(columns)], ["column_name", "latest_value"]))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, key, start, n): copies of every value, long values by digest and the text they start with."""
    cells = melt(df, columns).where(F.col("txt").isNotNull())
    start = F.when(F.octet_length("txt") > DIGEST_OVER_BYTES, F.left("txt", F.lit(DIGEST_OVER_BYTES)))
    return cells.select("column_name", value_key(F.col("txt")).alias("key"), start.alias("start")).groupBy("column_name", "key", "start").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column, ties by value.

    Values are counted and ranked by key.  ``rank() <= k`` lets Spark keep few
    rows per column in each task before the shuffle, so a column of unique
    values is not gathered.  Long values are ranked by how they start; those
    that may be among the k, all ties included, are few and written, and only
    for them whole texts are looked up, where there are any.
    ``value`` is the whole value; ``key`` identifies it (a digest if it is long).
    """
    counts = value_counts(df, columns)
    best = Window.partitionBy("column_name").orderBy(F.desc("n"), F.coalesce("start", "key"))
    first = counts.withColumn("place", F.rank().over(best)).where(F.col("place") <= k)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_count"))
    found = materialize(first.join(F.broadcast(totals), "column_name"), "top-values")  # totals: one row per column
    long = found.where("start IS NOT NULL").select("column_name", "key")
    n_long = long.count()
    if n_long:
        texts = melt(df, columns).where(F.octet_length("txt") > DIGEST_OVER_BYTES).select("column_name", value_key(F.col("txt")).alias("key"), "txt")
        # Ties can be many: broadcast only below a checked size.
        few = F.broadcast(long) if n_long <= BROADCAST_ROWS else long
        whole = texts.join(few, ["column_name", "key"], "left_semi").dropDuplicates(["column_name", "key"])
        found = found.join(whole, ["column_name", "key"], "left").withColumn("shown", F.coalesce("txt", "key"))
    else:
        found = found.withColumn("shown", F.col("key"))
    in_order = Window.partitionBy("column_name").orderBy(F.desc("n"), "shown", "key")
    return found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k).select(
        "column_name", "rank", F.col("shown").alias("value"), "key", F.col("n").alias("count"),
        F.round(F.col("n") / F.col("total"), 6).alias("ratio"), "total", "unique_count",
    )


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return top_values(df, columns, 1).select(
        "column_name", F.col("total").alias("count"), "unique_count", F.col("value").alias("mode"),
        F.col("count").alias("mode_frequency"), F.col("ratio").alias("mode_ratio"),
    )


def text_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = melt(df, columns).where(F.col("txt").isNotNull())
    return cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_distinct(value_key(F.col("txt"))).alias("unique_count"),
        scalars.safe_round(F.avg(F.length("txt"))).alias("avg_length"),
        F.min(F.length("txt")).alias("min_length"),
        F.max(F.length("txt")).alias("max_length"),
    )


def datetime_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range in whole elapsed days; date-like text is parsed first."""
    cells = melt(df, columns)
    at = F.coalesce("ts", F.when(F.col("kind") == "string", scalars.to_timestamp_lenient(F.col("txt"))))
    out = cells.withColumn("at", at).where(F.col("at").isNotNull()).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_distinct("at").alias("unique_count"),
        F.min("at").alias("min"),
        F.max("at").alias("max"),
    )
    micros = F.unix_micros("max") - F.unix_micros("min")
    return out.withColumn("range_days", F.floor(micros / F.lit(86_400_000_000)).cast("int"))


def boolean_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = melt(df, columns).where(F.col("txt").isNotNull())
    truth = scalars.to_boolean(F.col("txt"))
    return cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(truth).alias("true_count"),
        F.count_if(~truth).alias("false_count"),
        scalars.safe_round(F.avg(truth.cast("double"))).alias("true_ratio"),
    )


def id_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = melt(df, columns).where(F.col("txt").isNotNull())
    out = cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct(value_key(F.col("txt"))).alias("unique_count")
    )
    return out.withColumn("duplicate_count", F.col("count") - F.col("unique_count")).withColumn(
        "uniqueness_ratio", F.round(F.col("unique_count") / F.col("count"), 6)
    )


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column, most first: one wide aggregation, no shuffle of rows."""
    wanted = list(columns) if columns is not None else df.columns
    totals = df.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.count(col_of(c)).alias(f"n{i}") for i, c in enumerate(wanted)])
    cells = [[str(i), quoted(name), f"rows - n{i}"] for i, name in enumerate(wanted)]
    long = totals.selectExpr("rows", stack_rows(cells, ["ord", "column_name", "missing_count"]))
    ratio = F.when(F.col("rows") > 0, F.col("missing_count") / F.col("rows")).otherwise(0.0)
    return long.withColumn("missing_ratio", F.round(ratio, 6)).orderBy(F.desc("missing_count"), "ord")


def missing_totals(by_column: DataFrame) -> DataFrame:
    out = by_column.agg(
        F.sum("rows").alias("total_cells"),
        F.sum("missing_count").alias("total_missing"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
    )
    ratio = F.when(F.col("total_cells") > 0, F.col("total_missing") / F.col("total_cells")).otherwise(0.0)
    return out.withColumn("missing_ratio", F.round(ratio, 6))


def top_missing(by_column: DataFrame, k: int = 10) -> DataFrame:
    return by_column.where(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "ord").limit(k)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row.

    Equal rows collapse in the map-side combine before the single shuffle, so
    a block of copies of one row does not skew it; long texts travel as digests.
    """
    keys = row_key(df, columns)
    names = [f"k{i}" for i in range(len(keys))]
    copies = df.select(*[k.alias(n) for k, n in zip(keys, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    out = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"))
    out = out.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_rows"))
    ratio = F.when(F.col("total_rows") > 0, F.col("duplicate_rows") / F.col("total_rows")).otherwise(0.0)
    return out.withColumn("duplicate_ratio", F.round(ratio, 6))


def id_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repeated values and surplus rows per identifier column."""
    counts = value_counts(df, columns)
    return counts.groupBy("column_name").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_value_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_row_count"),
        F.sum("n").alias("non_null"),
    )


def id_duplicate_examples(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    return top_values(df, columns, k).where(F.col("count") > 1).select("column_name", "rank", "value", "count")


def sample_values(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The first k non-null values per column in the order of the key columns.

    One scan; ``row_number() <= k`` keeps k rows per column in each task.
    """
    wanted = list(columns) if columns is not None else df.columns
    keys = [f"{name_of(c)} AS at_{i}" for i, c in enumerate(order_by)]
    cells = df.selectExpr(*keys, stack_rows([[quoted(c), f"CAST({name_of(c)} AS STRING)"] for c in wanted], ["column_name", "value"])).where("value IS NOT NULL")
    position = Window.partitionBy("column_name").orderBy(*[f"at_{i}" for i in range(len(order_by))], "value")
    return cells.withColumn("position", F.row_number().over(position)).where(F.col("position") <= k).select("column_name", "position", "value")


def overview(profile: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """Rows, columns and the number of columns of each class; with ``files.bytes_of``, also files and bytes."""
    names = ["numerical", "categorical", "text", "date", "datetime", "id", "boolean", "unknown"]
    found = profile.agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        *[F.count_if(F.col("column_class") == c).alias(f"{c}_columns") for c in names],
    )
    # One row on both sides.
    return found if size is None else found.join(F.broadcast(size), F.lit(True))
