"""Scans along an order without one task per key.

A plain window over a key puts all its rows into one task.  Here the rows of all
keys are dealt out once by ranges of (key, order): ranges hold about equal
numbers of rows, whatever the values of the order column are, and a key with
very many rows spans several.  Windows run inside a range.  A range can only go
on with one key of the range before it, so what enters it is one small row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tallyscope.functions.rows import materialize, name_of

RANGE = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None,
              prepare: Callable[[DataFrame], DataFrame] | None = None, name: str = "ranges") -> DataFrame:
    """The rows with ``_range``, counting up along (keys, order); written once, so that it stays as it is.

    ``prepare`` adds map-only columns after the rows are dealt out.  Rows equal
    in keys and order share a range.  ``ranges``: default the session's shuffle partitions.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *[F.col(name_of(c)) for c in (*keys, *order)]).withColumn(RANGE, F.spark_partition_id())
    return materialize(prepare(placed) if prepare else placed, name)


@dataclass(frozen=True)
class Ranges:
    """Rows in ranges, and the keys that go on from one range to the next."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    ends: tuple[tuple[int, tuple, tuple], ...]   # per range its number, first and last key

    @staticmethod
    def of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ranges:
        """``rows`` as ``in_ranges`` gave them; one row a range reaches the driver."""
        key = F.struct(*[F.col(name_of(k)) for k in keys])
        ends = rows.groupBy(RANGE).agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy(RANGE).collect()
        return Ranges(rows, tuple(keys), tuple(order), tuple((r[0], tuple(r["first"]), tuple(r["last"])) for r in ends))

    def window(self) -> WindowSpec:
        return Window.partitionBy(RANGE, *[F.col(name_of(k)) for k in self.keys]).orderBy(*[F.col(name_of(o)) for o in self.order])

    def crossing(self) -> list[tuple[int, int]]:
        """Neighbouring ranges (before, after) where the key goes on."""
        return [(a[0], b[0]) for a, b in zip(self.ends, self.ends[1:]) if a[2] == b[1]]

    def _table(self, numbers: dict[int, tuple], columns: Sequence[T.StructField] = ()) -> DataFrame:
        """(range, key, ...) rows: at most one a range."""
        fields = [T.StructField(f"_at_{RANGE}", T.IntegerType()), *[T.StructField(f"_at_{k}", self.rows.schema[k].dataType) for k in self.keys], *columns]
        return F.broadcast(self.rows.sparkSession.createDataFrame([(n, *v) for n, v in numbers.items()], T.StructType(fields)))

    def _meets(self) -> Column:
        out = F.col(RANGE) == F.col(f"_at_{RANGE}")
        for k in self.keys:
            out = out & F.col(name_of(k)).eqNullSafe(F.col(f"`_at_{k}`"))
        return out

    def with_earlier(self, name: str) -> DataFrame:
        """Adds a boolean: an earlier row of the key exists."""
        inside = F.row_number().over(self.window()) > 1
        later = {after for _, after in self.crossing()}
        entered = {number: first for number, first, _ in self.ends if number in later}
        if not entered:
            return self.rows.withColumn(name, inside)
        table = self._table(entered).withColumn("_entered", F.lit(True))
        return self.rows.join(table, self._meets(), "left").withColumn(name, inside | F.col("_entered").isNotNull()).select(*[name_of(c) for c in self.rows.columns], name)

    def remembering(self, make: Callable[[Ranges], DataFrame], columns: Mapping[str, Column], entering: Mapping[int, tuple]) -> DataFrame:
        """``make(self)`` and, per entry of ``columns``, its last non-null value in earlier rows of the key.

        ``entering``: by range, the key that goes on there and its values.
        """
        rows, names = make(self), list(columns)
        before = self.window().rowsBetween(Window.unboundedPreceding, -1)
        local = rows.withColumns({f"_own_{n}": c for n, c in columns.items()}).withColumns({f"_in_{n}": F.last(f"_own_{n}", ignorenulls=True).over(before) for n in names})
        kept = [name_of(c) for c in rows.columns]
        if not entering:
            return local.select(*kept, *[F.col(f"_in_{n}").alias(n) for n in names])
        types = [T.StructField(f"_from_{n}", local.schema[f"_own_{n}"].dataType) for n in names]
        joined = local.join(self._table(entering, types), self._meets(), "left")
        return joined.select(*kept, *[F.coalesce(f"_in_{n}", f"_from_{n}").alias(n) for n in names])

    def carried(self, make: Callable[[Ranges], DataFrame], columns: Mapping[str, Column]) -> tuple[DataFrame, dict[int, tuple]]:
        """``remembering`` with what enters each range, and that.

        ``make`` derives rows from ``self.rows``, row by row or by windows of
        ``window()``.  To find what enters the ranges it is run once more over the
        rows of keys that go on; their last values, one row a range, reach the driver.
        """
        names, crossing = list(columns), self.crossing()
        entering: dict[int, tuple] = {}
        if crossing:
            last, nothing = {r[0]: r[2] for r in self.ends}, (None,) * len(names)
            part = self.rows.join(self._table({a: last[a] for a, _ in crossing}), self._meets(), "left_semi")
            ends = make(Ranges(part, self.keys, self.order, self.ends)).withColumns({f"_own_{n}": c for n, c in columns.items()})
            place = F.struct(*[F.col(name_of(o)) for o in self.order])
            found = ends.groupBy(RANGE).agg(*[F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), place)).alias(n) for n in names])
            held = {r[0]: tuple(r[n] for n in names) for r in found.collect()}
            filled = {r[0] for r in self.ends if r[1] == r[2]}
            for a, b in crossing:
                # A range that one key fills hands on what it was given where it has nothing of its own.
                given = entering[a][len(self.keys):] if a in filled and a in entering else nothing
                entering[b] = (*last[a], *[x if x is not None else y for x, y in zip(held.get(a, nothing), given)])
        return self.remembering(make, columns, entering), entering


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """Add, per entry of ``columns``, its last non-null value in earlier rows; ``order`` is unique within a key."""
    placed = Ranges.of(in_ranges(df, keys, [order], ranges), keys, [order])
    return placed.carried(lambda part: part.rows, columns)[0].drop(RANGE)


def idle_sessions(events: DataFrame, key: str, at: str, idle_seconds: int) -> DataFrame:
    """(key, session, start, end, events): a session ends after more idle time than allowed.

    Events are first summed into time buckets no wider than the idle limit.  No
    gap inside such a bucket can exceed the limit, so sessions can only break
    between buckets: the window sees one row per key and bucket, however many
    events the key has.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    width = idle_seconds * 1_000_000
    buckets = events.where(F.col(at).isNotNull()).groupBy(key, F.floor(micros / F.lit(width)).alias("bucket")).agg(
        F.min(micros).alias("first"), F.max(micros).alias("last"), F.count(F.lit(1)).alias("n"))
    in_time = Window.partitionBy(key).orderBy("bucket")
    starts = (F.col("first") - F.lag("last").over(in_time) > width) | F.lag("last").over(in_time).isNull()
    numbered = buckets.withColumn("starts", starts.cast("int")).withColumn("session", F.sum("starts").over(in_time))
    return numbered.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("first")).alias("start"), F.timestamp_micros(F.max("last")).alias("end"), F.sum("n").alias("events"))
