"""Wide table to long form: one row per (column, cell), the base of profiling.

A long form lets every per-column statistic be one ``groupBy(column_name)``
with map-side combine, so profiling a table of any width is a fixed number of
jobs rather than one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions import scalars
from tallyscope.functions.rows import name_of, quoted, stack_rows

# Values longer than this are grouped by digest: a shuffle then moves 64 bytes
# per value instead of a whole text.
DIGEST_OVER_BYTES = 64


def col_of(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, scalars.INTEGER_TYPES):
        return "integer"
    if isinstance(data_type, scalars.NUMERIC_TYPES):
        return "float"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.StringType):
        return "string"
    return "complex"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in ("integer", "float")]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "string"]


def as_number(col: Column) -> Column:
    """Double with -0.0 folded into 0.0 and NaN as NULL."""
    value = col.cast("double") + F.lit(0.0)
    return F.when(~F.isnan(value), value)


def as_text(col: Column, kind: str) -> Column:
    """Text that is equal exactly when two cells are equal."""
    if kind == "complex":
        return F.to_json(F.struct(col.alias("v"))).cast("string")
    if kind == "float":
        return as_number(col).cast("string")
    return col.cast("string")


def value_key(text: Column) -> Column:
    """The text itself when short, its marked SHA-256 digest when long.

    The marked digest is longer than any short text, so the two never meet.
    """
    return F.when(F.octet_length(text) > DIGEST_OVER_BYTES, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def number_sql(column: str) -> str:
    value = f"CAST({name_of(column)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({value}) THEN {value} + 0.0D END"


def text_sql(column: str, kind: str) -> str:
    if kind == "complex":
        return f"to_json(named_struct('v', {name_of(column)}))"
    if kind == "float":
        return f"CAST({number_sql(column)} AS STRING)"
    return f"CAST({name_of(column)} AS STRING)"


def melt(df: DataFrame, columns: Sequence[str] | None = None, float_text: bool = True) -> DataFrame:
    """(ord, column_name, kind, txt, num, ts) for every cell of the columns.

    Without ``float_text`` the text of a float is only empty or NULL: printing
    doubles is slow and their number identifies them.
    """
    wanted = list(columns) if columns is not None else df.columns
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    cells = []
    for ord_, name in enumerate(wanted):
        kind = kinds[name]
        number = number_sql(name) if kind in ("integer", "float") else "CAST(NULL AS DOUBLE)"
        moment = f"CAST({name_of(name)} AS TIMESTAMP)" if kind in ("date", "timestamp") else "CAST(NULL AS TIMESTAMP)"
        shown = f"CASE WHEN {number} IS NOT NULL THEN '' END" if kind == "float" and not float_text else text_sql(name, kind)
        cells.append([str(ord_), quoted(name), quoted(kind), shown, number, moment])
    return df.selectExpr(stack_rows(cells, ["ord", "column_name", "kind", "txt", "num", "ts"]))


def melt_numbers(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(column_name, value, *keep) for the non-null numbers; ``keep`` is SQL text."""
    wanted = list(columns) if columns is not None else numeric_columns(df)
    cells = [[quoted(name), number_sql(name)] for name in wanted]
    return df.selectExpr(*keep, stack_rows(cells, ["column_name", "value"])).where("value IS NOT NULL")


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Columns identifying a whole row, long texts as digests, NULLs equal."""
    fields = {f.name: f for f in df.schema.fields}
    out = []
    for name in columns if columns is not None else df.columns:
        kind = kind_of(fields[name].dataType)
        c = col_of(name)
        if kind in ("string", "complex"):
            c = value_key(as_text(c, kind))
        elif kind == "float":
            c = as_number(c)
        out.append(c.alias(name))
    return out
