"""Small fixed tables as literal rows, and tables written once and read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyscope.session import checkpoint_folder


def quoted(value) -> str:
    """A SQL literal for a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def name_of(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A fixed table the optimizer can see: it folds filters and expressions over it.

    ``createDataFrame`` would give an opaque scan that starts tasks of its own
    each time it is broadcast.
    """
    fields = T._parse_datatype_string(schema).fields
    casts = ", ".join(f"CAST({name_of(f.name)} AS {f.dataType.simpleString()}) AS {name_of(f.name)}" for f in fields)
    names = ", ".join(name_of(f.name) for f in fields)
    lines = [f"({', '.join(quoted(v) for v in row)})" for row in rows]
    if not lines:
        nothing = ", ".join("NULL" for _ in fields)
        return spark.sql(f"SELECT {casts} FROM VALUES ({nothing}) AS t({names}) WHERE FALSE")
    return spark.sql(f"SELECT {casts} FROM VALUES {', '.join(lines)} AS t({names})")


def stack_rows(cells: Sequence[Sequence[str]], names: Sequence[str]) -> str:
    """``stack`` as SQL text: each cell row is a list of SQL expressions.

    One parsed text instead of hundreds of Column calls keeps plan building
    fast for wide tables.
    """
    flat = ", ".join(e for row in cells for e in row)
    return f"stack({len(cells)}, {flat}) AS ({', '.join(name_of(n) for n in names)})"


def place_of(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/tallyscope/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the table under the checkpoint folder and read it back.

    Used where several branches of one analysis read the same aggregated
    table: it is computed once, and a lost executor costs a re-read of files
    instead of a recomputation from the raw tables.
    """
    spark = df.sparkSession
    path = place_of(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before CPU-heavy expressions.

    For plain scans.  Only where they come in fewer partitions than there are
    cores (one small file); a large input already has more and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
