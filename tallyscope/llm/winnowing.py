"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash; in each window of
``WINDOW`` hashes the smallest is chosen, the rightmost of equal ones, and kept
with its position.  Two texts that share at least ``GRAM + WINDOW - 1`` code
points share a chosen hash.  Texts of under 250 code points have shorter grams
and windows (``SHORTER``, by the length of the text alone), so that a text and
one that shares its half always share a chosen hash.  Two texts are compared
with the grams of the shorter one, an edited text with those of its original.
A text shorter than a gram is one gram, a row of hashes shorter than a window
one window; an empty text has no fingerprint.

To set each document beside the next one in descending order of ids, documents
are dealt out once by ranges of ids and sorted within them; the first document
of a range is also sent to the range before it.  Ties of ids are broken by the
text; null ids come last, null texts are empty.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import mix

GRAM, WINDOW = 24, 40
#: Gram and window of texts with less code points than the first number: gram + window - 1 is at most half of the shortest such text.
SHORTER = ((7, 1, 1), (30, 3, 2), (250, 8, 8))
_BASE = np.uint64(0x9E3779B97F4A7C55)


def chosen(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (in code points) of the fingerprint of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if not n:
        return points, np.zeros(0, dtype=np.int64)
    k = min(gram, n)
    # Doubling: the hash of 2^j code points comes from two of half that length.
    total, width, power, part, done = None, 1, _BASE, points, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if total is None:
                    total, done = part, width
                else:
                    size = n - done - width + 1
                    total = total[:size] * power + part[done:done + size]
                    done += width
            if width * 2 > k:
                break
            part = part[:len(part) - width] * power + part[width:]
            power, width = power * power, width * 2
        h = mix(total[:n - k + 1])
    w = min(window, len(h))
    # The minimum of each window from minima of blocks of w: suffix minima of one block, prefix minima of the next.
    size = -(-len(h) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(h)] = h
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    starts = len(h) - w + 1
    least = np.minimum(left[:starts], right[w - 1:w - 1 + starts])
    # A position is a minimum if the largest of the minima of the windows that hold it is its own hash.
    wide = np.zeros((-(-(len(h) + w - 1) // w) + 1) * w, dtype=np.uint64)
    wide[w - 1:w - 1 + starts] = least
    blocks = wide.reshape(-1, w)
    left = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.maximum.accumulate(blocks, axis=1).ravel()
    at = np.flatnonzero(np.maximum(left[:len(h)], right[w - 1:w - 1 + len(h)]) == h)
    # Of equal minima only the rightmost of a window stays: look at those followed by an equal one within a window.
    by_hash = np.lexsort((at, h[at]))
    p, q = at[by_hash[:-1]], at[by_hash[1:]]
    close = (h[p] == h[q]) & (q - p < w)
    lost = [i for i, j in zip(p[close].tolist(), q[close].tolist())
            if not (least[max(0, i - w + 1):max(0, min(i, j - w, starts - 1) + 1)] == h[i]).any()]
    if lost:
        at = np.setdiff1d(at, lost)
    return h[at], at


def grams_of(n: int) -> tuple[int, int]:
    """Gram and window of a text of n code points."""
    return next(((gram, window) for below, gram, window in SHORTER if n < below), (GRAM, WINDOW))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shown(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as text: hash:position, in order of position."""
    return " ".join([f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), places.tolist())])


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, then as the documents: each with the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # range, id, text, fingerprint, gram and window of the row before
    for batch in batches:
        out = [[] for _ in names]
        for bucket, doc, text, lent in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "lent"))):
            grams = grams_of(len(text))
            own = chosen(text, *grams)
            if held is not None and held[0] == bucket:
                _, last, before, mark, used = held
                mixed = edited(before, text)
                other = chosen(mixed, *used)
                least = min(used, grams)  # an empty text has no fingerprint under any
                one, two = (m if g == least else chosen(t, *least) for t, m, g in ((before, mark, used), (text, own, grams)))
                for c, v in zip(out, (last, len(before), hashlib.sha256(mixed.encode("utf-8", "surrogatepass")).hexdigest(), shown(*mark), shown(*other), likeness(mark[0], other[0]), likeness(one[0], two[0]))):
                    c.append(v)
            held = None if lent else (bucket, doc, text, own, grams)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness (see the module).

    ``ranges``: number of id ranges (default: the session's shuffle partitions);
    bounds the table of range heads, which is broadcast.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    # Ranges count up as ids go down; null ids are a range of their own at the end.
    cut = F.lit([float(c) for c in cuts]) if cuts else F.expr("cast(array() AS array<double>)")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - F.array_position(F.sort_array(F.array_append(cut, F.col("doc_id") + 0.5)), F.col("doc_id") + 0.5).cast("int") + 1)
    dealt = docs.withColumn("bucket", bucket.cast("int"))
    heads = {r[0]: r[1] for r in dealt.groupBy("bucket").agg(F.max("doc_id")).collect()}  # one row per range
    order = sorted(heads)
    if not order:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    back = [(order[i - 1], b, heads[b]) for i, b in enumerate(order)]  # the range before each; before the first, the last
    lend = spark.createDataFrame([(b, h, to) for to, b, h in back], "bucket int, head bigint, target int")
    copies = dealt.join(F.broadcast(lend), "bucket")
    head = F.col("doc_id").eqNullSafe(F.col("head"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lent"))
    sent = copies.withColumn("to", F.explode(F.when(head, F.array(own, F.struct(F.col("target").alias("bucket"), F.lit(True).alias("lent")))).otherwise(F.array(own))))
    rows = sent.select("to.bucket", "to.lent", "doc_id", "text").repartition(ranges, "bucket").sortWithinPartitions("bucket", "lent", F.desc_nulls_last("doc_id"), "text")
    return rows.mapInArrow(_compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
