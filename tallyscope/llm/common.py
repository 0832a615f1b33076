"""Words, word hashes and shingles shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.rows import name_of

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Bytes of texts hashed at a time; a longer text is taken alone.
TEXTS_AT_ONCE = 1 << 18

_LONG_WORD = 64
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(docs: DataFrame, *plain: str) -> DataFrame:
    """The ``plain`` columns and all others in one struct ``_row``, so that working columns clash with none of them."""
    rest = [F.col(name_of(c)) for c in docs.columns if c not in plain]
    return docs.select(*[F.col(name_of(c)) for c in plain], (F.struct(*rest) if rest else F.lit(0)).alias("_row"))


def unpacked(columns: list[str], *plain: str) -> list[Column]:
    """The columns that ``packed`` took, in their order."""
    return [F.col(name_of(c)) if c in plain else F.col("_row").getField(c).alias(c) for c in columns]


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; empty for null."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def text_parts(column: pa.Array, limit: int = TEXTS_AT_ONCE) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column in parts of at most ``limit`` bytes (a longer text alone), each with its first row."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > begin and size + n + 1 > limit:
            yield begin, texts_of(column.slice(begin, i - begin))
            begin, size = i, 0
        size += n + 1
    if begin < len(column):
        yield begin, texts_of(column.slice(begin))


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word of a text, A-Z lower-cased, in order."""
    return hashed_words(text, lower)[0]


def hashed_words(text: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a text.

    Words are read eight bytes at a time from all word starts at once; the few
    words over 64 bytes are hashed one by one.
    """
    size = len(text)
    raw = np.zeros(size + 16, dtype=np.uint8)
    raw[:size] = np.frombuffer(text, dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    blank[size:] = True
    if lower:
        raw |= ((raw >= 65) & (raw <= 90)).view(np.uint8) << 5
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    length = ends - starts
    blocks = np.ndarray((size + 9,), dtype="<u8", buffer=raw.data, strides=(1,))
    out = mix(length.astype(np.uint64))
    active = np.arange(len(starts))
    at = 0
    while len(active) and at < _LONG_WORD:
        left = length[active] - at
        value = blocks[starts[active] + at] & _MASKS[np.minimum(left, 8)]
        out[active] = mix(out[active] ^ value)
        at += 8
        active = active[left > 8]
    for i in active.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i]:ends[i]].tobytes())
    return out, starts


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    run = min(k, n)
    h = words[:n - run + 1].copy()
    for j in range(1, run):
        h = h * _M2 + words[j:n - run + 1 + j]
    return np.unique(mix(h + np.uint64(run)))


def set_id(values: np.ndarray) -> int:
    """One 64-bit id of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(values ^ _M1), dtype=np.uint64) + np.uint64(len(values))]))[0].astype(np.int64))


def shingle_sets(texts: list[bytes], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of every text one after another, and their bounds; one pass over all texts."""
    words, at = hashed_words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.searchsorted(at, ends)))
    n = np.diff(bounds)
    counts = np.where(n < k, n > 0, n - k + 1).astype(np.int64)
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(out_bounds[-1], dtype=np.uint64)
    if len(words) >= k:
        h = words[:len(words) - k + 1].copy()
        for j in range(1, k):
            h = h * _M2 + words[j:len(words) - k + 1 + j]
        inside = np.arange(len(h)) + k <= np.repeat(bounds[1:], n)[:len(h)]
        out[np.repeat(n >= k, counts)] = mix(h[inside] + np.uint64(k))
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[out_bounds[i]] = shingles(words[bounds[i]:bounds[i + 1]], k)[0]
    return distinct_runs(out, out_bounds)


def distinct_runs(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values between two bounds sorted and made distinct, for all bounds; ``values`` is sorted in place."""
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[begin:end].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``set_id`` of the values between every two bounds."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ _M1), dtype=np.uint64)))[bounds]
    return mix(sums[1:] - sums[:-1] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def chosen_runs(values: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values between the chosen bounds only, and their bounds."""
    counts = np.diff(bounds)
    return values[np.repeat(chosen, counts)], np.concatenate(([0], np.cumsum(counts[chosen])))


def stored_runs(values: np.ndarray) -> np.ndarray:
    """Start of every run of equal neighbours."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))


class Rows:
    """Collects columns of arrays and gives Arrow batches of a bounded size."""

    def __init__(self, names: list[str], limit: int = 200_000):
        self.names, self.limit, self.parts, self.size = names, limit, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def ready(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size and (last or self.size >= self.limit):
            columns = [np.concatenate([p[i] for p in self.parts]) for i in range(len(self.names))]
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=self.names)
