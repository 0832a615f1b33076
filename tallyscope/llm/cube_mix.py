"""Mixing sources to target weights with the cube method.

A unit is the rows that share id, source and size (in words); its rows are
taken together.  A source whose target is r times its size takes every unit
floor(r) times and draws the fractional rest by balanced sampling: inclusion
probabilities move along directions that keep the number of documents and of
words unchanged (the null-space of the balancing constraints) until one of
three units is settled, a new one replaces it, and so on (flight).

Units are dealt into buckets by a hash, about ``BUCKET_UNITS`` to each, and
every task flies through its rows in order of the hash holding two open units
per source and bucket.  What stays open is flown again by groups of
buckets, level by level, until at most ``LAST_UNITS`` open units are left per
source; the last ones are flown for documents and words, then for words alone,
and a single unit is settled by its own hash (landing).  Buckets depend on the
data alone, so reruns agree.

Null texts have no words; null sources are one source, last in order; null
ids are ids.  Empty tables give empty results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize, name_of
from tallyscope.llm.common import WORD, unpacked

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BUCKET_UNITS = 4_000
LAST_UNITS = 20_000
HELD_BACK = 40
_OPEN = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``).

    Weights repeat over the sources in code point order, null last.  The targets
    share ``share`` times all words; a target stops at ``most`` times its source
    and the excess is shared again by weight.  The sources that stop are those
    with the smallest size for their weight, so one pass over them in that
    order settles all.  Windows are over the table of sources, one row each.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = table.select(
        "source", "source_size", "weight", "cap", (share * F.sum("source_size").over(everything)).alias("all"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(by_need), F.lit(0.0)).alias("caps_before"), F.coalesce(F.sum("weight").over(by_need), F.lit(0.0)).alias("weights_before"))
    stopped = ranked.withColumn("stops", F.col("cap") * (F.col("weights") - F.col("weights_before")) <= F.col("weight") * (F.col("all") - F.col("caps_before")))
    free = F.col("all") - F.coalesce(F.sum(F.expr("CASE WHEN stops THEN cap END")).over(everything), F.lit(0.0))
    over = F.sum(F.expr("CASE WHEN NOT stops THEN weight END")).over(everything)
    return stopped.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(free * F.col("weight") / over).alias("target"))


class Flight:
    """Open units of one source; each is [probability, number of rows, words, key]."""

    def __init__(self, words_only: bool = False):
        self.open: list[list] = []
        self.held = 1 if words_only else 2  # constraints

    def add(self, unit: list) -> list[list]:
        """Take a unit in; returns the units settled by it."""
        if unit[0] <= _OPEN or unit[0] >= 1 - _OPEN:
            unit[0] = round(unit[0])
            return [unit]
        self.open.append(unit)
        if len(self.open) <= self.held:
            return []
        if self.held == 2:
            (_, a1, a2, *_), (_, b1, b2, *_), (_, c1, c2, *_) = self.open
            way = [b1 * c2 - b2 * c1, c1 * a2 - c2 * a1, a1 * b2 - a2 * b1]  # orthogonal to rows and to words
            if not any(way):  # parallel constraints leave two free directions: settle two of the units
                way = [b1, -a1, 0] if a1 or b1 else [1, 0, 0]
                if not (a1 or b1):
                    way = [1, 0, 0]
                elif not (a2 * way[0] + b2 * way[1] == 0):
                    way = [b2, -a2, 0]
        else:
            way = [self.open[1][2], -self.open[0][2]]
            if not any(way):
                way = [1, -1]
        up = min([((1 - u[0]) if w > 0 else u[0]) / abs(w) for u, w in zip(self.open, way) if w])
        down = min([(u[0] if w > 0 else (1 - u[0])) / abs(w) for u, w in zip(self.open, way) if w])
        # Up with probability down / (up + down) keeps every inclusion probability.
        step = up if draw(unit[3]) * (up + down) < down else -down
        for u, w in zip(self.open, way):
            u[0] += step * w
        settled = [u for u in self.open if u[0] <= _OPEN or u[0] >= 1 - _OPEN]
        self.open = [u for u in self.open if not (u[0] <= _OPEN or u[0] >= 1 - _OPEN)]
        for u in settled:
            u[0] = round(u[0])
        return settled


def draw(key: int) -> float:
    """A number in 0..1 from a unit's hash."""
    x = (key * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) / 2.0 ** 64


def _fly(land: bool):
    """Flight over rows sorted by source, bucket and key; with ``land`` no unit stays open."""
    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> list[list]:
            if not land:
                return flight.open + list(waiting)
            out = []
            for u in waiting:
                out += flight.add(u)
            words = Flight(words_only=True)
            for u in flight.open:
                out += words.add(u)
            for u in words.open:
                u[0] = 1 if draw(u[3] ^ 0x5DEECE66D) < u[0] else 0
            out += words.open
            excess = sum(u[0] * u[2] for u in out) + taken - wanted
            last = [u for u in out if u[2]][-HELD_BACK:]
            moves = [-u[2] if u[0] else u[2] for u in last]
            choices = [(abs(excess), ())] + [(abs(excess + m), (i,)) for i, m in enumerate(moves)]
            choices += [(abs(excess + m + k), (i, j)) for i, m in enumerate(moves) for j, k in enumerate(moves[:i])]
            for i in min(choices)[1]:
                last[i][0] = 1 - last[i][0]
            return out

        flight, group, waiting, wanted, taken = Flight(), None, deque(), 0.0, 0
        names = ["source", "doc_id", "size", "n_rows", "whole", "key", "probability"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        done: list[list] = []

        def batch_of(units: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[u[4][i] for u in units] for i in range(6)] + [[float(u[0]) for u in units]], kinds)], names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*names, "bucket")]
            for *row, probability, bucket in zip(*columns):
                if group != (row[0], bucket):
                    done += ended()
                    flight, group, waiting, wanted, taken = Flight(), (row[0], bucket), deque(), 0.0, 0
                waiting.append([probability, row[3], row[3] * row[2], row[5], row])
                wanted += probability * row[3] * row[2]
                if len(waiting) > HELD_BACK:
                    settled = flight.add(waiting.popleft())
                    taken += sum(u[0] * u[2] for u in settled)
                    done += settled
            if done:
                yield batch_of(done)
                done = []
        done += ended()
        if done:
            yield batch_of(done)
    return fly


_UNIT = "source string, doc_id bigint, size bigint, n_rows bigint, whole bigint, key bigint, probability double"


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, bucket_units: int = BUCKET_UNITS) -> DataFrame:
    """``doc_id, source, size, n_rows, source_size, target, copies``: one row per unit and how often to take its rows."""
    units = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows"))
    units = materialize(units.withColumn("key", F.xxhash64(F.lit("mix"), "doc_id", "source", "size")), "units")
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_units"))
    aims = materialize(targets(per_source.select("source", "source_size"), weights, share, most).join(per_source.select(F.col("source").alias("s"), "n_units"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    named = aims.select(F.col("source").alias("s"), "source_size", "target", "n_units")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = units.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    start = aimed.select(
        "source", "doc_id", "size", "n_rows", F.floor("rate").alias("whole"), "key", (F.col("rate") - F.floor("rate")).alias("probability"),
        F.pmod(F.xxhash64("key"), F.ceil(F.col("n_units") / bucket_units)).alias("bucket"))

    def flown(rows: DataFrame, land: bool) -> DataFrame:
        sorted_rows = rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "key", "doc_id", "size")
        return materialize(sorted_rows.mapInArrow(_fly(land), _UNIT), "flown")

    closed = F.col("probability").isin(0.0, 1.0)
    flights = [flown(start, False)]
    while True:
        left = flights[-1].where(~closed)
        most_left = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most_left <= LAST_UNITS:
            break
        buckets = -(-most_left // max(bucket_units, 4 * HELD_BACK))
        flights.append(flown(left.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(len(flights))), F.lit(buckets))), False))
    flights.append(flown(left.withColumn("bucket", F.lit(0).cast("bigint")), True))
    settled = flights[0].where(closed)
    for f in flights[1:]:
        settled = settled.unionByName(f.where(closed))
    return settled.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.col("probability").cast("bigint")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them; columns as in ``docs``."""
    taken = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_n"), F.col("copies").alias("_copies"))
    own = docs.select(F.struct(*[F.col(name_of(c)) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    both = own.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_n")))
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select(*unpacked(docs.columns))
