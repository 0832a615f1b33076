"""Data-quality scores of a table and of its columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.operators.columns import melt, value_key


def completeness(missing_totals: DataFrame) -> DataFrame:
    ratio = F.col("missing_ratio")
    score = F.when(F.col("total_cells") > 0, F.greatest(F.lit(0.0), 100.0 * (1.0 - ratio))).otherwise(100.0)
    return missing_totals.select(score.alias("completeness"))


def uniqueness(duplicates: DataFrame, id_duplicates: DataFrame) -> DataFrame:
    """100 less the duplicate share, less up to 10 points per id column."""
    surplus = F.col("duplicate_row_count") / F.col("non_null")
    penalty = id_duplicates.where("non_null > 0").agg(
        F.coalesce(F.sum(F.least(F.lit(1.0), surplus) * 10.0), F.lit(0.0)).alias("id_penalty"))
    both = duplicates.select("duplicate_ratio").join(F.broadcast(penalty))  # one row each
    return both.select(F.greatest(F.lit(0.0), 100.0 - F.col("duplicate_ratio") * 100.0 - F.col("id_penalty")).alias("uniqueness"))


def validity(profile: DataFrame) -> DataFrame:
    unknown = F.avg((F.col("column_class") == "unknown").cast("double"))
    return profile.agg(F.coalesce(F.greatest(F.lit(0.0), 100.0 - unknown * 100.0), F.lit(100.0)).alias("validity"))


def inconsistency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of values per string column padded with blanks or spelled in several cases.

    Spellings are compared through per-(column, spelling) counts, so a hot
    value is one row before the shuffle and long texts travel as digests.
    """
    stripped = F.regexp_replace("txt", rf"^{scalars.ANY_SPACE}|{scalars.ANY_SPACE}$", "")
    cells = melt(df, columns).where(F.col("txt").isNotNull())
    spellings = cells.select(
        "column_name",
        value_key(F.lower(stripped)).alias("folded"),
        value_key(stripped).alias("spelling"),
        (stripped != F.col("txt")).cast("long").alias("padded"),
    ).groupBy("column_name", "folded", "spelling").agg(F.count(F.lit(1)).alias("n"), F.sum("padded").alias("padded"))
    groups = spellings.groupBy("column_name", "folded").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"), F.sum("padded").alias("padded"))
    varied = F.sum(F.when(F.col("variants") > 1, F.col("n") - 1).otherwise(0))
    return groups.groupBy("column_name").agg(
        F.sum("n").alias("values"), F.sum("padded").alias("padded"), varied.alias("varied"),
    ).withColumn("inconsistency", F.least(F.lit(1.0), (F.col("padded") + F.col("varied")) / F.col("values")))


def consistency(df: DataFrame, profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over the string columns classed text or categorical; none gives 100.

    ``columns`` are the candidate string columns; the class is joined in, so no
    driver round trip decides which of them count.
    """
    classed = profile.where(F.col("column_class").isin("categorical", "text") & (F.col("kind") == "string")).select("column_name")
    counted = classed.join(inconsistency(df, columns), "column_name", "left")
    share = F.avg(F.coalesce("inconsistency", F.lit(0.0)))
    return counted.agg(F.coalesce(F.greatest(F.lit(0.0), 100.0 - share * 100.0), F.lit(100.0)).alias("consistency"))


def overall(dimensions: DataFrame, weights: Mapping[str, float] = vocab.QUALITY_WEIGHTS) -> DataFrame:
    """Weighted score and grade of a row holding the four dimensions."""
    total = sum(weights.values())
    score = F.lit(0.0) if total == 0 else sum(
        (F.col(name) * w for name, w in weights.items()), F.lit(0.0)) / F.lit(total)
    return dimensions.withColumn("overall_score", score).withColumn("grade", scalars.grade(F.col("overall_score")))


def column_scores(profile: DataFrame, outliers: DataFrame, ids: DataFrame) -> DataFrame:
    """Quality of each column; all three inputs have one row per column."""
    joined = (
        profile.join(F.broadcast(outliers.select("column_name", F.col("ratio").alias("outlier_ratio"))), "column_name", "left")
        .join(F.broadcast(ids.select("column_name", F.col("count").alias("id_count"), "duplicate_count")), "column_name", "left")
    )
    cls = F.col("column_class")
    penalty = (
        F.col("missing_ratio") * 40.0
        + F.when(cls == "numerical", F.least(F.coalesce("outlier_ratio", F.lit(0.0)), F.lit(0.5)) * 15.0).otherwise(0.0)
        + F.when((cls == "id") & (F.col("id_count") > 0),
                 F.least(F.col("duplicate_count") / F.col("id_count"), F.lit(1.0)) * 25.0).otherwise(0.0)
        + F.when(cls == "unknown", 25.0).otherwise(0.0)
    )
    return joined.select("ord", "column_name", "column_class", "missing_ratio", "unique_ratio",
                         F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty)).alias("quality_score"))
