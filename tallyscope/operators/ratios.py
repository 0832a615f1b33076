"""The eighteen ratios, for every entity at once."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import vocab
from tallyscope.functions.registry import with_metric
from tallyscope.functions.rows import literal_rows, quoted, stack_rows
from tallyscope.operators.metrics import pivot_values

RATIO_IDS = [f[0] for f in vocab.RATIO_FORMULAS]


def formula_inputs(formulas=vocab.RATIO_FORMULAS) -> list[str]:
    ids: list[str] = []
    for _, n, d, _, spare_n, spare_d in formulas:
        ids += [n, d] + [x for spare in (spare_n, spare_d) if spare for x in re.split(r"[-+]", spare)]
    return sorted(set(ids))


def _spare(expression: str | None) -> str:
    if expression is None:
        return "CAST(NULL AS DOUBLE)"
    if "+" in expression:
        left, right = expression.split("+")
        return (f"CASE WHEN {left} IS NOT NULL OR {right} IS NOT NULL "
                f"THEN coalesce({left}, 0D) + coalesce({right}, 0D) END")
    return expression  # "a-b" and plain names are SQL already


def ratio_rows(values: DataFrame, keys: Sequence[str] = ("entity_id",), formulas=vocab.RATIO_FORMULAS) -> DataFrame:
    """(keys, metric_id, value, status, confidence, formula) of every computable ratio.

    ``values`` is (keys, metric_id, value).  A zero denominator gives a row
    without a value; a missing input gives no row.
    """
    wide = pivot_values(values, formula_inputs(formulas), *keys)
    cells = []
    for ratio, numerator, denominator, times, spare_n, spare_d in formulas:
        text = f"{numerator} / {denominator}" + ("  × 100" if times == 100.0 else "")
        cells.append([quoted(ratio), f"coalesce({numerator}, {_spare(spare_n)})",
                      f"coalesce({denominator}, {_spare(spare_d)})", quoted(times), quoted(text), quoted(denominator)])
    long = wide.selectExpr(*keys, stack_rows(cells, ["metric_id", "n", "d", "times", "formula", "below"]))
    zero = F.col("d") == 0
    return long.where(F.col("n").isNotNull() & F.col("d").isNotNull()).select(
        *keys, "metric_id",
        F.when(~zero, F.try_divide("n", "d") * F.col("times")).alias("value"),
        F.when(zero, "unavailable").otherwise("calculated").alias("status"),
        F.when(zero, 0.5).otherwise(0.9).alias("confidence"),
        F.when(zero, F.concat(F.lit("Denominator ("), F.col("below"), F.lit(") is zero — ratio undefined.")))
        .otherwise(F.col("formula")).alias("note"),
    )


def compute_ratios(values: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Ratios with their registry description."""
    return with_metric(ratio_rows(values, (entity,)), "display_name", "unit", "direction", "category").select(
        entity, "metric_id", "display_name", "value", "unit", "status", "direction", "category", "confidence", "note")


def missing_ratio_reasons(entities: DataFrame, values: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Why a ratio has no value: the absent primary inputs, else a zero denominator."""
    names = {f[0]: (f[1], f[2]) for f in vocab.RATIO_FORMULAS}
    spark = values.sparkSession
    # Two inputs for each of the eighteen ratios: a fixed dimension.
    needs = literal_rows(
        spark, [(r, pos, m) for r, pair in names.items() for pos, m in enumerate(pair)],
        "ratio_id string, pos int, metric_id string")
    needs = with_metric(needs, "display_name").select("ratio_id", "pos", F.col("metric_id").alias("input_id"), F.col("display_name").alias("input_name"))
    ratios = ratio_rows(values, (entity,)).where("status = 'calculated'").select(entity, F.col("metric_id").alias("ratio_id"))
    every = entities.select(entity, F.explode(F.array(*[F.lit(r) for r in names])).alias("ratio_id"))
    lacking = every.join(ratios, [entity, "ratio_id"], "left_anti")
    held = values.select(entity, F.col("metric_id").alias("input_id"), F.lit(True).alias("held"))
    inputs = lacking.join(F.broadcast(needs), "ratio_id").join(held, [entity, "input_id"], "left")
    absent = F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.struct("pos", "input_name"))))
    listed = F.array_join(F.transform(absent, lambda s: s["input_name"]), ", ")
    return inputs.groupBy(entity, "ratio_id").agg(F.size(absent).alias("missing_inputs"), listed.alias("names")).select(
        entity, "ratio_id", "missing_inputs",
        F.when(F.col("missing_inputs") > 0, F.concat(F.lit("Missing input(s): "), F.col("names"), F.lit(".")))
        .otherwise("The dataset has the inputs but the denominator is zero — ratio undefined.").alias("reason"))


def with_ratios(values: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Base values and ratio values together; one row per (entity, metric)."""
    ratios = ratio_rows(values, (entity,)).where("status = 'calculated'").select(entity, "metric_id", "value")
    base = values.where(~F.col("metric_id").isin(RATIO_IDS)).select(entity, "metric_id", "value")
    return base.unionByName(ratios)
