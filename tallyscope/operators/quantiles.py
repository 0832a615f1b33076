"""Exact quantiles by radix selection, without sorting a column.

A number's order-preserving key is its sign, exponent and the first bits of its
mantissa.  The first round counts the numbers per key; the counts tell which
keys hold the wanted ranks and how many numbers lie before them.  While such a
key holds very many numbers, another round counts those by more bits of the
mantissa.  The last step counts the distinct numbers of the keys that are left
and picks the ranks.  Every round is one scan whose counts are combined in each
task, so only counts are shuffled; a hot value is one row.

Results are exact: keys only narrow the search.  A round with 8 bits has at most
half a million keys a column, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the mantissa after each round; the last has all of them.
ROUNDS = (8, 24, 40, 52)
#: A key with at most this many numbers is not narrowed further.
SMALL = 100_000
#: Smallest exponent of a full mantissa; smaller numbers count in its steps.
_LEAST = -1022
_OFFSET = 1 - _LEAST


def exponents(long: DataFrame, value: str) -> DataFrame:
    """Adds ``_e``, the exponent of the number, computed once for its keys."""
    return long.withColumn("_e", F.expr(f"CASE WHEN {value} <> 0D THEN greatest(floor(log2(abs({value}))), {_LEAST}L) END"))


def radix_key(value: str, bits: int) -> str:
    """SQL for the key of a double: larger numbers never have smaller keys, and 52 bits tell all numbers apart.

    A logarithm that is off by one next to a power of two gives the same key,
    as keys go on evenly across it.
    """
    size = f"abs({value})"
    # Powers of two by shifts where they fit: the general function is slow.
    scaled = (f"CASE WHEN _e BETWEEN 0 AND 62 THEN {size} / shiftleft(1L, CAST(_e AS INT)) WHEN _e BETWEEN -62 AND -1 THEN {size} * shiftleft(1L, CAST(-_e AS INT)) "
              f"ELSE {size} / pow(2D, _e) END")
    magnitude = f"((_e + {_OFFSET}) * {1 << bits}L + CAST(floor(({scaled} - 1D) * {1 << bits}D) AS BIGINT))"
    return (f"CASE WHEN _e IS NULL THEN 0L WHEN {size} = double('infinity') THEN CAST(sign({value}) AS BIGINT) * {(1024 + _OFFSET) << bits}L "
            f"ELSE CAST(sign({value}) AS BIGINT) * {magnitude} END")


def _placed(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Counts per key with the rows before it: ``before`` must hold those before the parent key."""
    in_order = Window.partitionBy(*keys).orderBy(order)
    return counts.withColumn("before", F.col("before") + F.sum("size").over(in_order) - F.col("size"))


def exact_quantiles(
    long: DataFrame,
    probabilities: Sequence[float],
    group: str = "column_name",
    value: str = "value",
    small: int = SMALL,
) -> DataFrame:
    """(group, n, probability, quantile), linear interpolation between ranks.

    ``long`` holds non-null numbers.  The number of groups must be bounded (the
    columns of a table): the keys with the wanted ranks, at most two per
    probability and group, reach the driver and are broadcast.
    """
    spark = long.sparkSession
    long = exponents(long.select(group, value), value)
    kind = long.schema[group].dataType.simpleString()
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("probability"), (F.lit(float(p)) * (F.col("n") - 1)).alias("position")) for p in probabilities])
    ranks = F.array_distinct(F.flatten(F.transform(wanted, lambda w: F.array(F.floor(w["position"]), F.ceil(w["position"])))))
    inside = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))

    counts = long.groupBy(group, F.expr(radix_key(value, ROUNDS[0])).alias("key")).agg(F.count(F.lit(1)).alias("size")).withColumn("before", F.lit(0).cast("bigint"))
    sized = _placed(counts, [group], "key").withColumn("n", F.sum("size").over(Window.partitionBy(group)))
    columns = [group, "n", "key", "size", "before", "ranks"]
    found = sized.withColumn("ranks", ranks).withColumn("ranks", inside).where("size(ranks) > 0").select(columns).collect()
    schema = f"{group} {kind}, n bigint, key bigint, size bigint, before bigint, ranks array<bigint>"
    settled: list[tuple[int, list]] = []
    for bits, finer in zip(ROUNDS, ROUNDS[1:]):
        settled.append((bits, [r for r in found if r["size"] <= small]))
        large = [tuple(r) for r in found if r["size"] > small]
        if not large:
            found = []
            break
        within = F.broadcast(spark.createDataFrame(large, schema).select(group, "n", F.col("key").alias("parent"), "before", "ranks"))
        met = long.withColumn("parent", F.expr(radix_key(value, bits))).join(within, [group, "parent"])
        counts = met.groupBy(group, "parent", "n", "before", "ranks", F.expr(radix_key(value, finer)).alias("key")).agg(F.count(F.lit(1)).alias("size"))
        found = _placed(counts, [group, "parent"], "key").withColumn("ranks", inside).where("size(ranks) > 0").select(columns).collect()
    settled.append((ROUNDS[-1], found))  # a number of its own each

    parts = []
    for bits, rows in settled:
        if rows or not parts and bits == ROUNDS[-1]:
            left = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema).select(group, "n", "key", "before", "ranks"))
            parts.append(long.withColumn("key", F.expr(radix_key(value, bits))).join(left, [group, "key"])
                         .groupBy(group, "n", "key", "before", "ranks", value).agg(F.count(F.lit(1)).alias("size")))
    numbers = parts[0]
    for part in parts[1:]:
        numbers = numbers.unionByName(part)
    # A key holds at most ``small`` numbers, or one.
    picked = _placed(numbers, [group, "key"], value).withColumn("ranks", inside).select(group, "n", value, F.explode("ranks").alias("rank"))
    targets = picked.withColumn("w", F.explode(wanted)).where((F.col("rank") == F.floor("w.position")) | (F.col("rank") == F.ceil("w.position")))
    low, high = F.min(value), F.max(value)
    part = F.first(F.col("w.position") - F.floor("w.position"))
    return targets.groupBy(group, "n", F.col("w.probability").alias("probability")).agg((low + (high - low) * part).alias("quantile"))


def quantile_columns(quantiles: DataFrame, names: dict[float, str], group: str = "column_name") -> DataFrame:
    """One row per group with a column per probability."""
    picks = [
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in names.items()
    ]
    return quantiles.groupBy(group).agg(*picks)
