"""FM-index of a shard of training texts, word by word.

The words of a shard are numbered in the order of their hashes; each text ends
with a mark of its own.  Suffixes are sorted by doubling: only those not yet
told apart are sorted again, with rank, next rank and place packed in one
64-bit number (so a shard has less than 2**21 places).  The last column of the
sorted matrix is kept as a wavelet matrix, one bit vector a level with the
number of ones before each 64-bit word.  Backward search narrows the rows of
many phrases at once; an occurrence is located by walking back to a sampled
place.  Every start of a text is sampled, so no walk passes an end mark.
"""

from __future__ import annotations

import numpy as np

#: Places of a shard must fit this many bits.
PLACE_BITS = 21
SAMPLE = 8
LOCATED_AT_ONCE = 500_000
_PLACES = np.uint64((1 << PLACE_BITS) - 1)
_SHIFT, _TWICE = np.uint64(PLACE_BITS), np.uint64(2 * PLACE_BITS)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the number of each word in them."""
    if not len(hashes):
        return hashes, np.zeros(0, dtype=np.int64)
    # The upper bits of a hash and its place in one number: a plain sort is several times faster than an argsort.
    keys = np.sort((hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64))
    order = (keys & _PLACES).astype(np.int64)
    ordered = hashes[order]
    if (ordered[1:] < ordered[:-1]).any():  # two hashes differ in the lower bits only
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    numbers = np.empty(len(hashes), dtype=np.int64)
    numbers[order] = np.cumsum(new) - 1
    return ordered[new], numbers


def _group_starts(key: np.ndarray) -> np.ndarray:
    """For every place of a sorted array, where its group of equal values starts."""
    start = np.zeros(len(key), dtype=np.int64)
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    start[edge] = edge
    return np.maximum.accumulate(start)


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of every suffix; 0 ends a text, and an earlier end is smaller than a later one.

    The last symbol must be 0.
    """
    n = len(symbols)
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(len(ends))
    open_ = np.flatnonzero((counts[symbols] > 1) & (symbols != 0))
    step = 1
    while len(open_):
        # A suffix not yet told apart has no end within the next ``step`` places, so place + step is in the shard.
        packed = np.sort((rank[open_].astype(np.uint64) << _TWICE) | (rank[open_ + step].astype(np.uint64) << _SHIFT) | open_.astype(np.uint64))
        at, old = (packed & _PLACES).astype(np.int64), (packed >> _TWICE).astype(np.int64)
        first, of_old = _group_starts(packed >> _SHIFT), _group_starts(old)
        rank[at] = old + first - of_old
        size = np.bincount(first, minlength=len(first))[first]
        open_ = at[size > 1]
        step *= 2
    return rank


class WaveletMatrix:
    """Rank and access over numbers of ``levels`` bits."""

    def __init__(self, values: np.ndarray, levels: int):
        self.size, self.levels = len(values), levels
        self.words, self.ones, self.zeros = [], [], []
        current = values.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bits = (current >> np.uint32(level)) & np.uint32(1) == 1
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.bitwise_count(words)
            self.words.append(words)
            self.ones.append(np.cumsum(counts, dtype=np.int64) - counts)
            self.zeros.append(len(bits) - int(bits.sum()))
            current = np.concatenate((current[~bits], current[bits]))

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin, end = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for level in range(self.levels):
            one = (symbols >> (self.levels - 1 - level)) & 1 == 1
            b, e = self._ones_before(level, begin), self._ones_before(level, end)
            begin = np.where(one, self.zeros[level] + b, begin - b)
            end = np.where(one, self.zeros[level] + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        at, begin = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        symbol = np.zeros(len(at), dtype=np.int64)
        for level in range(self.levels):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            b, e = self._ones_before(level, begin), self._ones_before(level, at)
            begin = np.where(one, self.zeros[level] + b, begin - b)
            at = np.where(one, self.zeros[level] + e, at - e)
            symbol = symbol << 1 | one
        return symbol, at - begin


class FMIndex:
    """Index of texts in a row; ``symbols`` are word numbers from 1, each text ends with 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        rank = suffix_ranks(symbols)
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        counts = np.bincount(symbols)
        self.before = np.append(np.cumsum(counts) - counts, n)
        self.wavelet = WaveletMatrix(symbols[order - 1], max(1, int(symbols.max()).bit_length()))
        sampled = (order % sample == 0) | (symbols[order - 1] == 0)
        self.places = order[sampled]
        self.sampled = WaveletMatrix(sampled, 1)

    def search(self, phrases: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows that begin with each phrase ``phrases[start:start + length]``."""
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.wavelet.size)
        live = np.arange(len(starts))
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k)]
            if not len(live):
                break
            symbol = phrases[starts[live] + lengths[live] - 1 - k]
            if k == 0:
                low[live], high[live] = self.before[symbol], self.before[symbol + 1]
            else:
                met = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
                low[live], high[live] = self.before[symbol] + met[:len(live)], self.before[symbol] + met[len(live):]
            # A phrase without rows is settled.
            live = live[high[live] > low[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the shard of the suffix in each row."""
        out, walked, rows, live = np.zeros(len(rows), dtype=np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(live):
            mark, nth = self.sampled.access(rows[live])
            hit = mark == 1
            out[live[hit]] = self.places[nth[hit]] + walked
            live = live[~hit]
            symbol, met = self.wavelet.access(rows[live])
            rows[live] = self.before[symbol] + met
            walked += 1
        return out

    def occurrences(self, low: np.ndarray, high: np.ndarray):
        """Blocks of (number of the range, place) for all rows of the ranges."""
        sizes = high - low
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, LOCATED_AT_ONCE):
            at = np.arange(begin, min(begin + LOCATED_AT_ONCE, total))
            which = np.searchsorted(ends, at, side="right")
            yield which, self.locate(low[which] + at - (ends[which] - sizes[which]))
