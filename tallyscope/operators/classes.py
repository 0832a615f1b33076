"""Column facts in one pass, then type, class and cardinality from them.

The whole column is examined, not its first rows: "first" has no meaning on a
distributed table, and the full pass costs the same single scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.rows import name_of, stack_rows
from tallyscope.operators.columns import DIGEST_OVER_BYTES, kind_of, number_sql, text_sql, value_key


def _value_cells(df: DataFrame, wanted: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(ord, txt, whole, num) per cell: one of the last three identifies the value, all are NULL where it is missing.

    Whole numbers, truth values and moments stay numbers: printing them is slow.
    """
    cells = []
    for i, (name, kind) in enumerate(zip(wanted, kinds)):
        column = name_of(name)
        text = text_sql(name, kind) if kind in ("string", "complex") else "CAST(NULL AS STRING)"
        whole = {"boolean": f"CAST({column} AS BIGINT)", "integer": f"CAST({column} AS BIGINT)", "date": f"unix_micros(CAST({column} AS TIMESTAMP))", "timestamp": f"unix_micros(CAST({column} AS TIMESTAMP))"}.get(kind, "CAST(NULL AS BIGINT)")
        cells.append([str(i), text, whole, number_sql(name) if kind == "float" else "CAST(NULL AS DOUBLE)"])
    return df.selectExpr(stack_rows(cells, ["ord", "txt", "whole", "num"]))


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts, distinct values, shares of recognised forms.

    Two levels: equal (column, value) cells first become one row with their
    number, merged in each task before the shuffle, so no task sees a whole
    column.  Forms (dates, UUIDs, boolean words) are then tested once a value.
    Long texts travel as digests; of those only blanks around a short text can
    have a form, so that text goes with them.
    """
    wanted = list(columns) if columns is not None else df.columns
    types = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    kinds = [types[c] for c in wanted]
    strings = F.col("ord").isin([i for i, k in enumerate(kinds) if k == "string"])
    long = F.octet_length("txt") > DIGEST_OVER_BYTES
    trimmed = F.trim("txt")
    values = _value_cells(df, wanted, kinds).select(
        "ord", F.when(strings, value_key(F.col("txt"))).otherwise(F.col("txt")).alias("key"), "whole", "num",
        F.when(strings & long, F.when(F.octet_length(trimmed) <= DIGEST_OVER_BYTES, trimmed).otherwise("")).alias("within"),
        F.when(strings & long, F.length("txt")).alias("long_len"),
    ).groupBy("ord", "key", "whole", "num", "within").agg(F.count(F.lit(1)).alias("n"), F.max("long_len").alias("long_len"))
    held = F.col("key").isNotNull() | F.col("whole").isNotNull() | F.col("num").isNotNull()
    values = values.withColumns({"held": held, "form": F.when(strings, F.coalesce("within", "key")), "len": F.when(strings, F.coalesce("long_len", F.length("key")))})
    words = vocab.TRUE_TOKENS + vocab.FALSE_TOKENS
    word = F.lower(F.trim("form"))
    flag = F.coalesce(*[F.when(word == w, F.lit(1 << i).cast("bigint")) for i, w in enumerate(words)], F.lit(1 << len(words)).cast("bigint"))
    texts = F.when(F.col("form").isNotNull(), F.col("n"))
    share = lambda test: F.when(F.sum(texts) > 0, F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum(texts))
    moments = F.col("ord").isin([i for i, k in enumerate(kinds) if k in ("date", "timestamp")])
    moment = F.timestamp_micros("whole")
    found = values.groupBy("ord").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("held"), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if("held").alias("unique_count"),
        (F.sum(F.col("len") * F.col("n")) / F.sum(texts)).alias("avg_length"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        F.bit_or(F.when(F.col("form").isNotNull(), flag)).alias("word_flags"),
        share(scalars.to_timestamp_lenient(F.col("form")).isNotNull()).alias("date_ratio"),
        share(F.trim("form").rlike(vocab.UUID_VALUE)).alias("uuid_ratio"),
        F.min((F.col("num") % 1 == 0).cast("int")).alias("all_whole"),
        F.min(F.when(moments, (moment == F.date_trunc("day", moment)).cast("int"))).alias("all_midnight"),
    )
    other = F.lit(1 << len(words)).cast("bigint")
    few = (F.bit_count("word_flags") <= 4) & (F.col("word_flags").bitwiseAND(other) == 0)
    names = [F.get(F.array(*[F.lit(x) for x in xs]), F.col("ord")).alias(alias) for alias, xs in (("column_name", wanted), ("kind", kinds))]
    return found.withColumn("boolean_words", F.coalesce(few, F.lit(False))).select("ord", *names, *[c for c in found.columns if c not in ("ord", "word_flags")], "boolean_words")


def inferred_type(kind: Column, non_null: Column) -> Column:
    return (
        F.when(non_null == 0, "unknown")
        .when(kind == "boolean", "boolean")
        .when(kind == "integer", "integer")
        .when(kind == "float", F.when(F.col("all_whole") == 1, "integer").otherwise("float"))
        .when(kind.isin("timestamp", "date"), "datetime")
        .when((kind == "string") & F.col("boolean_words"), "boolean")
        .when((kind == "string") & (F.col("date_ratio") >= 0.9), "datetime")
        .when(kind.isin("string", "complex"), "string")
        .otherwise("unknown")
    )


def cardinality_class(unique: Column, ratio: Column, rows: Column) -> Column:
    return (
        F.when((rows == 0) | (unique == 0), "low")
        .when((ratio >= 0.999) & (unique > 1), "unique")
        .when(ratio > 0.5, "high")
        .when((ratio <= 0.05) | (unique <= 10), "low")
        .otherwise("medium")
    )


def column_class(name: Column) -> Column:
    """Class of a column from its facts; the order of the rules matters."""
    inferred, unique, rows = F.col("inferred_type"), F.col("unique_count"), F.col("rows")
    ratio = F.col("unique_ratio")
    textual = inferred == "string"
    is_id = (
        (textual & (F.col("uuid_ratio") >= 0.9))
        | (name.rlike(vocab.IDENTIFIER_NAME) & inferred.isin("integer", "string") & (unique >= 5))
        | (textual & (unique == F.col("non_null")) & (unique > 1) & (ratio >= 0.9))
    )
    return (
        F.when(inferred == "unknown", "unknown")
        .when(inferred == "boolean", "boolean")
        .when(name.rlike(vocab.BOOLEAN_NAME) & (unique <= 2), "boolean")
        .when(inferred == "datetime", F.when(F.col("all_midnight") == 1, "date").otherwise("datetime"))
        .when(F.coalesce(is_id, F.lit(False)), "id")
        .when(inferred.isin("integer", "float"),
              F.when((unique <= 10) & (ratio <= 0.05) & (rows >= 20), "categorical").otherwise("numerical"))
        .when(textual & (F.col("avg_length") >= 40), "text")
        .when(textual & ((ratio <= 0.05) | (unique <= 50)), "categorical")
        .when(textual, "text")
        .otherwise("unknown")
    )


def classify(facts: DataFrame) -> DataFrame:
    """Type, class, cardinality and missing share added to the column facts."""
    ratio = F.when(F.col("rows") > 0, F.col("unique_count") / F.col("rows")).otherwise(0.0)
    typed = (
        facts.withColumn("unique_ratio", ratio)
        .withColumn("missing_count", F.col("rows") - F.col("non_null"))
        .withColumn("missing_ratio",
                    F.when(F.col("rows") > 0, F.col("missing_count") / F.col("rows")).otherwise(0.0))
        .withColumn("inferred_type", inferred_type(F.col("kind"), F.col("non_null")))
        .withColumn("column_class", column_class(F.col("column_name")))
        .withColumn("cardinality_class", cardinality_class(F.col("unique_count"), F.col("unique_ratio"), F.col("rows")))
    )
    promoted = (F.col("column_class") == "id") & F.col("inferred_type").isin("string", "integer")
    return typed.withColumn("inferred_type", F.when(promoted, "identifier").otherwise(F.col("inferred_type")))


def column_classes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return classify(column_facts(scalars.normalize_missing(df), columns))


def cardinality_lists(profile: DataFrame) -> DataFrame:
    """Column names per cardinality class (a table's columns: bounded)."""
    names = F.array_sort(F.collect_list(F.struct("ord", "column_name")))
    return profile.groupBy("cardinality_class").agg(
        F.count(F.lit(1)).alias("columns"),
        F.transform(names, lambda s: s["column_name"]).alias("column_names"),
    )


def first_date_column(profile: DataFrame) -> DataFrame:
    """The column dating the rows: native timestamps first, then date-like text."""
    native = F.col("kind").isin("timestamp", "date")
    sniffed = (F.col("kind") == "string") & (F.col("date_ratio") >= 0.9)
    rank = F.when(native, 0).when(sniffed, 1)
    return (
        profile.withColumn("preference", rank).where(F.col("preference").isNotNull())
        .orderBy("preference", "ord").limit(1).select("column_name", "kind")
    )


def filter_profile(profile: DataFrame, classes: Sequence[str] = (), name_part: str = "",
                   sort_by: str = "column_name", descending: bool = False) -> DataFrame:
    """Columns of some classes whose name contains a text, in a chosen order."""
    out = profile
    if classes:
        out = out.where(F.col("column_class").isin(list(classes)))
    if name_part.strip():
        out = out.where(F.contains(F.lower("column_name"), F.lit(name_part.strip().lower())))
    order = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return out.orderBy(order, "ord")
