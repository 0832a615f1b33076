"""Fill-in-the-middle texts, cut at token ends found eight bytes at a time (SWAR).

A text is viewed as little-endian 64-bit words of its UTF-8.  A unit is a word
with the blanks before it, or the blanks at the end of the text; a byte ends a
unit if it is no blank and a blank or the end follows.  These bytes are marked
by arithmetic on whole words, counted per word (``bitwise_count``), the counts
summed up, and the k-th mark is found by a search in the sums and a select within one word.
Blanks are ASCII, so no cut falls into a character.

Which units are the prefix and the middle, and the form, follow from a keyed
digest of the id alone, so reruns and retried tasks agree and no row moves.

Null texts are empty; an empty text and one that holds a mark stay plain.  A
null id counts as the empty text in the digest.  Rows are independent: repeated
rows get equal results, and extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def _every(byte: int) -> np.uint64:
    """A word with this value in each of its bytes."""
    return np.uint64(byte * 0x0101010101010101)


_HIGH, _LOW7, _BLANK = _every(0x80), _every(0x7F), _every(0x20)
_FROM_9, _FROM_14 = _every(0x80 - 9), _every(0x80 - 14)
_ONE, _8, _56 = np.uint64(1), np.uint64(8), np.uint64(56)


class Units:
    """Unit ends of a text and selection among them."""

    def __init__(self, text: bytes):
        self.size = len(text)
        self.words = x = np.frombuffer(text + b" " * (-self.size % 8), dtype="<u8")
        low = x & _LOW7
        other = x ^ _BLANK
        space = ~(((other & _LOW7) + _LOW7) | other)           # high bit where the byte is a space
        control = (low + _FROM_9) & ~(low + _FROM_14) & ~x     # high bit where it is 9 to 13
        blank = (space | control) & _HIGH
        following = blank >> _8
        if len(x):
            following[:-1] |= blank[1:] << _56
            following[-1] |= np.uint64(0x80) << _56            # a blank follows the text
        self.ends = ~blank & following & _HIGH
        self.sums = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)
        #: Blanks at the end are a unit of their own.
        self.tail = bool(self.size) and text[-1] in b" \t\n\v\f\r"
        self.count = (int(self.sums[-1]) if len(x) else 0) + self.tail

    def end(self, k: int) -> int:
        """Bytes of the first ``k`` units."""
        if not k:
            return 0
        if k == self.count:
            return self.size
        word = int(np.searchsorted(self.sums, k))
        marks = int(self.ends[word])
        for _ in range(k - 1 - (int(self.sums[word - 1]) if word else 0)):
            marks &= marks - 1
        return word * 8 + (marks & -marks).bit_length() // 8

    def characters(self, *sizes: int) -> list[int]:
        """Code points of the first bytes, for each size: bytes but continuation bytes."""
        more = self.words & ~(self.words << _ONE) & _HIGH
        sums = np.cumsum(np.bitwise_count(more), dtype=np.int64)
        out = []
        for size in sizes:
            word, rest = divmod(size, 8)
            before = int(sums[word - 1]) if word else 0
            within = (int(more[word]) & ((1 << 8 * rest) - 1)).bit_count() if rest else 0
            out.append(size - before - within)
        return out


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the digest of an id."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(text[4 * i:4 * i + 4], "big") for i in range(4)]


def form_of(text: bytes, doc_id: int | None, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, number of units, form, and code points of the prefix and of the middle (none where plain)."""
    units = Units(text)
    n = units.count
    one, two, three, four = numbers(doc_id, seed)
    if not text or three % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return text, n, "plain", None, None
    first, last = sorted((one % (n + 1), two % (n + 1)))
    a, b = units.end(first), units.end(last)
    to_a, to_b = units.characters(a, b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < spm:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), n, "spm", to_a, to_b - to_a
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), n, "psm", to_a, to_b - to_a


def transformed(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row.

    ``rate`` percent of the texts are transformed, ``spm`` percent of these with the suffix first.
    """
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                texts = rows.column("text").cast(pa.binary()).to_pylist()
                out = [form_of(t or b"", i, seed, rate, spm) for t, i in zip(texts, rows.column("doc_id").to_pylist())]
                facts = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values(), 1)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *facts, pa.array([r[0] for r in out], pa.binary()).cast(pa.string())], names=["doc_id", *kinds, "output"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(transform, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: each mark stands once in a transformed text."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def between(start: str, stop: str) -> Column:
        return F.substring_index(F.substring_index(output, stop, 1), start, -1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
