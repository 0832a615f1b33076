"""Pearson correlations of all numeric column pairs in one scan.

Up to ``WIDE`` columns they are one aggregation of built-in functions.  Wider
tables are added up as Gram blocks: every task keeps, for each pair of columns,
the number of rows where both hold a number, both means there, both squared
deviations and the co-deviation, and merges blocks of rows into them; tasks are
merged in the same way, in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.rows import materialize, quoted, stack_rows
from tallyscope.operators.columns import number_sql, numeric_columns

MIN_ROWS = 10
STRONG = 0.60
# Pairs evaluated by one aggregation; wider tables use several, so the
# generated code of one stage stays within the JVM's method limits.
PAIRS_PER_PASS = 600
#: Columns up to which all pairs fit one such aggregation; more go by Gram blocks.
WIDE = 34
ROWS_PER_BLOCK = 4_096
MERGE_GROUPS = 256
MOMENTS = ("n", "mean_a", "mean_b", "dev_a", "dev_b", "codev")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(i, j, column_a, column_b, coefficient) for i <= j.

    Rows where either side is NULL are skipped; fewer than 10 complete rows
    give NULL.  Columns with fewer than 10 values or no spread do not appear.
    Only one row per task is shuffled, whatever the table size.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if len(names) > WIDE:
        return _wide_pairs(df, names)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    numbers = df.selectExpr(*[f"{number_sql(n)} AS c{i}" for i, n in enumerate(names)])
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        block = pairs[start:start + PAIRS_PER_PASS]
        used = sorted({i for pair in block for i in pair})
        aggs = [f"count(c{i}) AS n{i}" for i in used] + [f"stddev_samp(c{i}) AS s{i}" for i in used]
        for i, j in block:
            # ``corr`` itself fails on a side without spread in ANSI mode.
            spread = f"sqrt(regr_sxx(c{j}, c{i}) * regr_syy(c{j}, c{i}))"
            aggs.append(f"CASE WHEN {spread} > 0 THEN greatest(-1D, least(1D, regr_sxy(c{j}, c{i}) / {spread})) END AS r{i}_{j}")
            aggs.append(f"count_if(c{i} IS NOT NULL AND c{j} IS NOT NULL) AS b{i}_{j}")
        cells = [
            [str(i), str(j), quoted(names[i]), quoted(names[j]),
             f"CASE WHEN b{i}_{j} >= {MIN_ROWS} THEN r{i}_{j} END",
             " AND ".join(f"n{x} >= {MIN_ROWS} AND s{x} > 0" for x in (i, j))]
            for i, j in block
        ]
        rows = numbers.selectExpr(*aggs).selectExpr(
            stack_rows(cells, ["i", "j", "column_a", "column_b", "coefficient", "usable"]))
        out = rows if out is None else out.unionByName(rows)
    valid = F.when(~F.isnan("coefficient"), F.col("coefficient"))
    return out.where("usable").select("i", "j", "column_a", "column_b", valid.alias("coefficient"))


def block_moments(values: np.ndarray) -> np.ndarray:
    """(6, p, p) MOMENTS of a block of rows; NaN is no number.  Entry (a, b) is about rows where both hold one."""
    there = ~np.isnan(values)
    mask = there.astype(np.float64)
    counts = there.sum(axis=0)
    # Deviations from the block's own means, so that large means cost no digits.
    centre = np.where(there, values, 0.0).sum(axis=0) / np.maximum(counts, 1)
    x = np.where(there, values - centre, 0.0)
    n, sums, squares, products = mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x
    mean = sums / np.maximum(n, 1)
    dev = np.maximum(squares - sums * mean, 0.0)
    return np.stack([n, mean + centre[:, None], mean.T + centre[None, :], dev, dev.T, products - sums * mean.T])


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MOMENTS of two disjoint sets of rows put together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    da, db, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + share * da, a[2] + share * db, a[3] + b[3] + weight * da * da, a[4] + b[4] + weight * db * db, a[5] + b[5] + weight * da * db])


def _wide_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``correlation_pairs`` of any number of columns; a task shuffles one row per column."""
    p = len(names)
    schema = "i int, part int, " + ", ".join(f"{m} array<double>" for m in MOMENTS)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_PER_BLOCK):
                rows = batch.slice(begin, ROWS_PER_BLOCK)
                block = block_moments(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in rows.columns], axis=1))
                total = block if total is None else merged_moments(total, block)
        if total is not None:
            part = TaskContext.get().partitionId() % MERGE_GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array([part] * p, pa.int32()), *[pa.array(list(m), pa.list_(pa.float64())) for m in total]], names=["i", "part", *MOMENTS])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for row in zip(*[rows[m] for m in MOMENTS]):
            total = np.stack(row) if total is None else merged_moments(total, np.stack(row))
        return pd.DataFrame({"i": rows["i"].iloc[:1], "part": [0], **{m: [v] for m, v in zip(MOMENTS, total)}})

    numbers = df.selectExpr(*[f"{number_sql(n)} AS c{i}" for i, n in enumerate(names)])
    parts = numbers.mapInArrow(gram, schema).groupBy("i", "part").applyInPandas(merge, schema)
    rows = materialize(parts.groupBy("i").applyInPandas(merge, schema), "moments")
    usable = f"(n[i] >= {MIN_ROWS} AND dev_a[i] > 0)"
    able = rows.where(usable).select(F.col("i").alias("j"))
    label = F.array(*[F.lit(n) for n in names])
    cells = rows.where(usable).select("i", F.posexplode(F.arrays_zip("n", "dev_a", "dev_b", "codev")).alias("j", "m")).where("i <= j").join(F.broadcast(able), "j")
    spread = F.sqrt(F.col("m.dev_a") * F.col("m.dev_b"))
    r = F.when((F.col("m.n") >= MIN_ROWS) & (spread > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("m.codev", spread))))
    return cells.select("i", "j", F.get(label, F.col("i")).alias("column_a"), F.get(label, F.col("j")).alias("column_b"), r.alias("coefficient"))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles, NULL shown as 0, 4 decimals."""
    mirrored = pairs.where(F.col("i") != F.col("j")).select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("column_b").alias("column_a"),
        F.col("column_a").alias("column_b"), "coefficient")
    return pairs.unionByName(mirrored).select(
        "column_a", "column_b",
        F.coalesce(scalars.safe_round(F.col("coefficient"), 4), F.lit(0.0)).alias("coefficient"))


def labelled_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct column pairs with strength and direction."""
    r = F.col("coefficient")
    return pairs.where((F.col("i") < F.col("j")) & r.isNotNull()).select(
        "i", "j", "column_a", "column_b", "coefficient",
        scalars.stepwise(F.abs(r), vocab.STRENGTH_LABELS, "very_weak").alias("strength"),
        F.when(r >= 0, "positive").otherwise("negative").alias("direction"))


def strong_positive(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("coefficient") >= STRONG).orderBy(F.desc("coefficient"), "i", "j")


def strong_negative(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("coefficient") <= -STRONG).orderBy("coefficient", "i", "j")


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc(F.abs("coefficient")), "i", "j").limit(k)
