"""Hard negatives by exact integer scores (Four-Russians method).

Every vector becomes whole numbers.  A candidate is kept as bit planes: the same
bit of eight dimensions is one byte.  For each anchor and each group of eight
dimensions a table holds the sum of the anchor's components over all 256
subsets; a candidate's score is the sum of its bytes' entries, plane by plane
from the highest (which counts negative), doubled in between.  Scores are exact
in 64 bits (32 where a bound from the largest components allows it; beyond 64
bits they wrap, and components outside +-2**62 are clipped).

Anchors are a stated query set and meet all rows: they go out in blocks of
about ``ANCHORS`` rows, one pass for the positives and one for the negatives of
a block; every task keeps the best few per anchor and sends only these, so no
pairs are shuffled and no key is hot.  The positives of a block (at most
``positives`` an anchor) are collected to bound the search for negatives.

Rows with a null label, a null vector or a null or non-finite component take no
part.  Shorter vectors count as padded with zeros.  Each repeated row counts for
itself; null ids are no anchors and come last among equal scores.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.session import checkpoint_folder

#: Anchors a pass (bounds what is broadcast and collected), and the sizes of the score blocks within a task.
ANCHORS, ANCHORS_AT_ONCE, ROWS_AT_ONCE = 4096, 256, 2048
_LAST = np.iinfo(np.int64).max


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``uid, vec_id, label, q`` of the rows that take part; where the id is divisible by 7 the label is the next of ten."""
    x = F.col("embedding")
    q = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-2.0 ** 62), F.least(F.lit(2.0 ** 62), v.cast("double") * scale))).cast("bigint"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(F.col("label").isNotNull() & x.isNotNull() & sound)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), q.alias("q"))


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """Bytes of the planes of two's complement: (plane, group of eight dimensions, row); the lowest dimension is the lowest bit."""
    return np.stack([np.packbits(((q >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)])


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """For each group of eight dimensions the sums over all subsets of them: (group, subset, anchor)."""
    groups = anchors.shape[1] // 8
    out = np.zeros((groups, 256, len(anchors)), dtype=kind)
    own = anchors.T.astype(kind).reshape(groups, 8, len(anchors))
    for bit in range(8):
        half = 1 << bit
        np.add(out[:, :half], own[:, bit:bit + 1], out=out[:, half:2 * half])
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products of rows (as bit planes) and anchors (as tables): (row, anchor)."""
    total = np.zeros((planes.shape[2], tables.shape[2]), dtype=tables.dtype)
    part = np.empty_like(total)
    for p in range(len(planes) - 1, -1, -1):
        if p < len(planes) - 1:
            total <<= 1
        for group, codes in zip(tables, planes[p]):
            np.take(group, codes, axis=0, out=part, mode="clip")
            if p == len(planes) - 1:
                total -= part
            else:
                total += part
    return total


class Best:
    """The first ``k`` rows of each list: higher scores first, ties by smaller id."""

    def __init__(self, lists: int, k: int, least: np.ndarray | None = None):
        self.k, self.empty = k, True
        self.score = np.zeros((lists, k), dtype=np.int64)
        self.id, self.uid = np.zeros((lists, k), dtype=np.int64), np.zeros((lists, k), dtype=np.int64)
        self.null, self.size = np.zeros((lists, k), dtype=bool), np.zeros(lists, dtype=np.int64)
        #: A row must have this score to enter a list.
        self.least = np.full(lists, np.iinfo(np.int64).min) if least is None else least

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, uid: np.ndarray) -> None:
        """Rows for the lists ``at``; several rows of a list may come at once."""
        if not len(at):
            return
        lists = np.unique(at)
        held = np.repeat(lists, self.k)[(np.arange(self.k) < self.size[lists][:, None]).ravel()]
        slot = np.broadcast_to(np.arange(self.k), (len(lists), self.k))[np.arange(self.k) < self.size[lists][:, None]]
        at, score, ids, null, uid = (np.concatenate(p) for p in ((held, at), (self.score[held, slot], score), (self.id[held, slot], ids), (self.null[held, slot], null), (self.uid[held, slot], uid)))
        # ~score turns the order around without leaving the range.
        order = np.lexsort((uid, ids, null, ~score, at))
        at, score, ids, null, uid = (v[order] for v in (at, score, ids, null, uid))
        begins = np.searchsorted(at, lists)
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        keep = place < self.k
        at, place = at[keep], place[keep]
        self.score[at, place], self.id[at, place], self.null[at, place], self.uid[at, place] = score[keep], ids[keep], null[keep], uid[keep]
        self.size[lists] = np.bincount(np.searchsorted(lists, at), minlength=len(lists))
        full = lists[self.size[lists] == self.k]
        self.least[full] = np.maximum(self.least[full], self.score[full, self.k - 1])

    def rows(self) -> pa.RecordBatch:
        at, slot = np.nonzero(np.arange(self.k) < self.size[:, None])
        ids = pa.array(self.id[at, slot], mask=self.null[at, slot])
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), ids, pa.array(self.score[at, slot])], names=["at", "other_id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, planes: int) -> Iterator[tuple]:
    """Bit planes, labels, ids, marks of null ids and uids of at most ``ROWS_AT_ONCE`` rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(begin, ROWS_AT_ONCE)
            lists = part.column("q")
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            q = np.zeros((part.num_rows, dims), dtype=np.int64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            q[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            ids = part.column("vec_id")
            yield bit_planes(q, planes), part.column("label").to_numpy(), ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("uid").to_numpy()


def _first_rows(shared, k: int):
    """Per task the first ``k`` rows of each list of a block of anchors.

    Without bounds a list is an anchor, for other rows of its label; with
    bounds it is an anchor and positive, for rows of other labels within them.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, uids, bounds, planes, kind = shared.value
        a = len(anchors)
        lists = 1 if bounds is None else bounds[0].shape[1]
        best = Best(a * lists, k, None if bounds is None else bounds[0].ravel().copy())
        seen = False
        for codes, label, ids, null, uid in _blocks(batches, anchors.shape[1], planes):
            seen = True
            for begin in range(0, a, ANCHORS_AT_ONCE):
                some = slice(begin, begin + ANCHORS_AT_ONCE)
                own = scores(codes, subset_sums(anchors[some], kind))
                same = label[:, None] == labels[None, some]
                for j in range(lists):
                    at = np.arange(begin, min(begin + ANCHORS_AT_ONCE, a)) * lists + j
                    fits = own >= best.least[at]
                    if bounds is None:
                        fits &= same & (uid[:, None] != uids[None, some])
                    else:
                        fits &= ~same & (own <= bounds[1][some, j])
                    row, column = np.nonzero(fits)
                    best.add(at[column], own[row, column].astype(np.int64), ids[row], null[row], uid[row])
        if seen:
            yield best.rows()
    return search


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each list over all tasks, with their ranks."""
    order = found.select("at", F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), F.col("other_id").isNull().alias("late"), F.col("other_id").alias("id"), "score").alias("r"))
    # Each task sent at most k rows a list.
    best = order.groupBy("at").agg(F.slice(F.sort_array(F.collect_list("r")), 1, k).alias("best"))
    return best.select("at", F.posexplode("best").alias("place", "r")).select("at", (F.col("place") + 1).alias("rank"), F.col("r.id").alias("other_id"), F.col("r.score").alias("score"))


def mined(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows whose id is divisible by ``every`` are anchors.  A negative's score lies
    between ``low`` and ``high`` percent of the positive's; that needs a positive score of 0 or more.
    """
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = materialize(whole_numbers(vectors, scale), "vectors")
    is_anchor = F.col("vec_id") % every == 0
    dims, most, least, count = rows.agg(F.max(F.size("q")), F.max(F.array_max("q")), F.min(F.array_min("q")), F.count_if(is_anchor)).first()
    if not count:
        return spark.createDataFrame([], schema)
    most, least = most or 0, least or 0
    dims = -(-max(dims, 1) // 8) * 8
    planes = max(most, -least - 1).bit_length() + 1
    kind = np.int32 if dims * max(most, -least) << planes < 2 ** 31 else np.int64
    blocks = -(-count // ANCHORS)
    base = f"{checkpoint_folder(spark).rstrip('/')}/tallyscope/negatives-{uuid.uuid4().hex}"
    for block in range(blocks):
        chosen = rows.where(is_anchor & (F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)).orderBy("uid").collect()  # about ANCHORS rows
        if not chosen:
            continue
        anchors = np.zeros((len(chosen), dims), dtype=np.int64)
        for i, r in enumerate(chosen):
            anchors[i, :len(r.q)] = r.q
        labels, uids = np.array([r.label for r in chosen]), np.array([r.uid for r in chosen])
        sent = spark.sparkContext.broadcast((anchors, labels, uids, None, planes, kind))
        found = _first(rows.mapInArrow(_first_rows(sent, positives), "at int, other_id bigint, score bigint"), positives).collect()
        down, up = np.ones((len(chosen), positives), dtype=np.int64), np.zeros((len(chosen), positives), dtype=np.int64)  # nothing fits
        pairs = []
        for r in found:
            if r.score >= 0:
                down[r.at, r.rank - 1], up[r.at, r.rank - 1] = -(-low * r.score // 100), high * r.score // 100
            pairs.append((r.at * positives + r.rank - 1, chosen[r.at].vec_id, r.other_id, r.score))
        sent = spark.sparkContext.broadcast((anchors, labels, uids, (down, up), planes, kind))
        near = _first(rows.mapInArrow(_first_rows(sent, negatives), "at int, other_id bigint, score bigint"), negatives)
        names = spark.createDataFrame(pairs, "at int, anchor_id bigint, positive_id bigint, positive_score bigint")
        out = near.join(F.broadcast(names), "at")  # at most ANCHORS * positives rows
        out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{base}/block={block}")
    return spark.read.schema(schema).parquet(base).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
