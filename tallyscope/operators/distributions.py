"""Histograms, shape labels, top-value shares and IQR outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import scalars
from tallyscope.operators.columns import melt_numbers, numeric_columns
from tallyscope.operators.quantiles import exact_quantiles, quantile_columns
from tallyscope.operators.summaries import top_values, value_counts

BINS = 20
IQR_MULTIPLIER = 1.5


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column_name, bin, lower, upper, count) over equal-width bins.

    Bins are left-closed and the last is closed on both sides.  A column whose
    minimum and maximum coincide gets one degenerate bin.  Empty bins appear
    with count 0.
    """
    long = melt_numbers(df, columns)
    ends = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    close = F.abs(F.col("hi") - F.col("lo")) <= F.greatest(F.abs("hi"), F.abs("lo")) * F.lit(1e-9)
    ends = ends.withColumn("flat", close).withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(bins))

    def edge(i):
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * F.col("step"))

    guess = F.least(F.floor((F.col("value") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                    F.lit(bins - 1)).cast("int")
    # Float division can put a value one bin off; compare with the edges themselves.
    low_fixed = F.when(F.col("value") < edge(F.col("guess")), F.col("guess") - 1).otherwise(F.col("guess"))
    fixed = F.when((F.col("value") >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1),
                   F.col("guess") + 1).otherwise(low_fixed)
    counted = (
        long.join(F.broadcast(ends), "column_name")
        .withColumn("guess", F.when(F.col("flat"), 0).otherwise(guess))
        .withColumn("bin", F.when(F.col("flat"), 0).otherwise(fixed))
        .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    every = ends.withColumn("bin", F.explode(F.when(F.col("flat"), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.lit(bins - 1)))))
    return every.join(counted, ["column_name", "bin"], "left").select(
        "column_name", "bin",
        F.when(F.col("flat"), F.col("lo")).otherwise(edge(F.col("bin"))).alias("lower"),
        F.when(F.col("flat"), F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skew label from (mean - median) / population standard deviation."""
    long = melt_numbers(df, columns)
    basics = long.groupBy("column_name").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    median = quantile_columns(exact_quantiles(long, [0.5]), {0.5: "median"})
    skew = (F.col("mean") - F.col("median")) / F.when(F.col("std") != 0, F.col("std"))
    close = F.abs(F.col("hi") - F.col("lo")) <= F.greatest(F.abs("hi"), F.abs("lo")) * F.lit(1e-9)
    label = (
        F.when(close, "degenerate").when(skew.isNull(), "constant").when(skew > 0.3, "right_skewed")
        .when(skew < -0.3, "left_skewed").otherwise("approximately_symmetric")
    )
    return basics.join(F.broadcast(median), "column_name").select("column_name", "mean", "median", "std", label.alias("shape"))


def categorical_distribution(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Top k values per column, and everything else as one row without a value."""
    top = top_values(df, columns, k)
    rest = top.groupBy("column_name").agg(
        (F.max("total") - F.sum("count")).alias("count"), F.max("total").alias("total"),
        F.max("unique_count").alias("unique_count"),
    ).select("column_name", F.lit(k + 1).alias("rank"), F.lit(None).cast("string").alias("value"), "count",
             F.round(F.col("count") / F.col("total"), 6).alias("ratio"), "unique_count")
    return top.select("column_name", "rank", "value", "count", "ratio", "unique_count").unionByName(rest)


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values strictly outside the quartiles by more than 1.5 IQR, per column."""
    long = melt_numbers(df, columns)
    quartiles = exact_quantiles(long, [0.25, 0.75])
    bounds = quartiles.groupBy("column_name").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("probability") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("probability") == 0.75, F.col("quantile"))).alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    reason = F.when(F.col("n") < 4, "insufficient_data").when(F.col("iqr") == 0, "zero_iqr")
    spread = F.when(F.col("iqr") == 0, 0.0).otherwise(F.col("iqr") * IQR_MULTIPLIER)
    bounds = bounds.withColumn("reason", reason) \
        .withColumn("lower_bound", F.when(F.col("n") >= 4, F.col("q1") - spread)) \
        .withColumn("upper_bound", F.when(F.col("n") >= 4, F.col("q3") + spread))
    outside = F.col("reason").isNull() & (
        (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
    # One bounds row per column of the table.
    counted = long.join(F.broadcast(bounds), "column_name").groupBy("column_name").agg(
        F.count_if(outside).alias("count"),
        *[F.first(c).alias(c) for c in ("n", "reason", "q1", "q3", "iqr", "lower_bound", "upper_bound")],
    )
    rounded = [scalars.safe_round(F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")]
    return counted.select("column_name", "n", "count", F.round(F.col("count") / F.col("n"), 6).alias("ratio"),
                          "reason", *rounded)


def outlier_ranking(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("count"), "column_name")


__all__ = ["histogram", "shape", "categorical_distribution", "outliers", "outlier_ranking", "top_values",
           "value_counts", "numeric_columns"]
