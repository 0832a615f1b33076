"""Catalog of datasets as an append-only table: listing, lookup, status, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("uploaded", "detecting", "processing", "validated", "failed")


def list_datasets(catalog: DataFrame, limit: int = 50, offset: int = 0, user_id=None) -> DataFrame:
    """Newest first, of one owner if given.  ORDER BY with LIMIT keeps few rows per task."""
    rows = catalog if user_id is None else catalog.where(F.col("user_id") == F.lit(user_id))
    return rows.orderBy(F.desc("created_at"), "dataset_id").offset(offset).limit(limit)


def get_dataset(catalog: DataFrame, dataset_id, user_id=None) -> DataFrame:
    """One dataset; a dataset of another owner is as absent as an unknown one."""
    rows = catalog.where(F.col("dataset_id") == F.lit(dataset_id))
    return rows if user_id is None else rows.where(F.col("user_id") == F.lit(user_id))


def without(catalog: DataFrame, deleted: DataFrame) -> DataFrame:
    """The catalog less the deleted ids; write it as the next version of the table."""
    return catalog.join(deleted.select("dataset_id").distinct(), "dataset_id", "left_anti")


def status_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("status").count()


def choices(catalog: DataFrame, exclude_id=None) -> DataFrame:
    """Validated datasets other than the one already chosen."""
    rows = catalog.where("status = 'validated'")
    return rows if exclude_id is None else rows.where(F.col("dataset_id") != F.lit(exclude_id))


def current_status(log: DataFrame) -> DataFrame:
    """Latest status per dataset from the log (dataset_id, status, at, seq)."""
    latest = F.max_by("status", F.struct("at", "seq"))
    return log.groupBy("dataset_id").agg(latest.alias("status"), F.max("at").alias("updated_at"), F.count(F.lit(1)).alias("changes"))


def append_status(log_path: str, rows: DataFrame) -> None:
    """Add lifecycle rows; a status outside the known ones fails the write."""
    known = F.col("status").isin(*STATUSES)
    checked = rows.where(F.assert_true(known, F.concat(F.lit("unknown status "), F.col("status"))).isNull())
    checked.write.mode("append").parquet(log_path)


def save_profile(profile: DataFrame, path: str, dataset_id: str) -> None:
    """Append a profile part under its dataset with the time of writing."""
    stamped = profile.withColumn("dataset_id", F.lit(dataset_id)).withColumn("saved_at", F.current_timestamp())
    stamped.write.mode("append").partitionBy("dataset_id").parquet(path)


def load_profile(spark, path: str, dataset_id: str) -> DataFrame:
    """Latest saved version of one dataset; only its partition is read."""
    rows = spark.read.parquet(path).where(F.col("dataset_id") == dataset_id)
    newest = rows.agg(F.max("saved_at").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("saved_at") == F.col("newest"), "left_semi")  # one row


def update_metadata(path: str, changes: DataFrame) -> None:
    """Append changes (dataset_id, name, value, at, seq): nothing is rewritten, the latest change of a name counts."""
    changes.select("dataset_id", "name", "value", "at", "seq").write.mode("append").parquet(path)


def current_metadata(log: DataFrame) -> DataFrame:
    """(dataset_id, name, value, at, seq): the latest change per name; a NULL value takes the name away.

    A maximum per (dataset, name), combined in each task, so a dataset with very many changes is no skew.
    """
    order = F.struct("at", "seq", "value")
    latest = log.groupBy("dataset_id", "name").agg(F.max(order).alias("last"))
    return latest.where("last.value IS NOT NULL").select("dataset_id", "name", "last.value", "last.at", "last.seq")


def compact_metadata(spark, path: str, target: str) -> DataFrame:
    """Write what counts of the log to another folder, which replaces it; reading either gives the same state."""
    current_metadata(spark.read.parquet(path)).write.parquet(target)
    return spark.read.parquet(target)


def metadata_map(current: DataFrame) -> DataFrame:
    """One row per dataset with its metadata as a map; the names of a dataset are few."""
    return current.groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metadata"), F.max("at").alias("updated_at"))
