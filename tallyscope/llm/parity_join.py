"""N-gram Jaccard join over XOR (parity) sketches.

Every document is the set of its distinct word shingles.  Sets are sketched per
size band: the hash space is cut into blocks and each block holds the XOR of
the hashes that fall into it, so a shingle on one side only flips its block.
The number of differing blocks is at most the symmetric difference, which for
Jaccard >= 3/4 is at most (|A| + |B|) / 7.  By the pigeonhole principle two
linked sets, which differ in at most D blocks, share one of their D + 1 first
filled blocks under any common order; blocks made of frequent shingles alone
are ordered last.  Sets that share such a block are compared: dense bit
sketches first (their Hamming distance also is a lower bound), then the sets.

Inside a block shared by many sets not all pairs are made.  Round 0 compares
each set with the smallest one.  Later rounds compare with the next 7, 56, ...
sets, and only sets not yet in one component, until no such pair is left, so
no link between components is lost.  There, two sets that also share a smaller
open block wait for that one: a pair is made under the first block of each run
of shared blocks, not under all of them.

Equal sets are one set from the start.  Ids of sets and shingles are 64-bit
hashes.  Null texts and texts without words give empty sets, linked with
nothing.  Extra columns are ignored.  Repeated rows and ids are handled as
rows; a component is named by its smallest id (null ids last).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize, name_of
from tallyscope.llm.common import Rows, chosen_runs, mix, set_ids, shingle_sets, stored_runs, text_parts, texts_of, unpacked
from tallyscope.llm.components import components

#: Shingles remembered as frequent, for the order of blocks only: any choice gives the same links.
FREQUENT_SHINGLES = 65_536
#: Up to so many set ids are broadcast to filter texts; more are joined.
BROADCAST_IDS = 1_000_000
#: Shingles counted at a time when looking for frequent ones.
COUNTED_AT_ONCE = 1_000_000
FIRST_LEADERS, LEADER_GROWTH = 1, 8
#: Pairs of a block, and bytes of their sketches, compared at a time.
PAIRS_AT_ONCE, SKETCHES_AT_ONCE = 100_000, 4_000_000


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, for sorted distinct hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 4 * common >= 3 * (len(a) + len(b) - common)


def _blocks(band: int) -> int:
    size = 1 << (band + 1)
    return 1 << 40 if band < 5 else size if band < 8 else size // 2


def block_keys(values: np.ndarray, bounds: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """For the set between every two bounds, the keys of the filled sketch blocks that it must show in each of its bands.

    Gives the keys and the place of the set of each.  Bands of a set of n shingles are its own and, where it has smaller
    partners there, the one below; a set shows one key more than it may have differences with a partner of that band.
    """
    n = np.diff(bounds)
    own = np.frexp(n)[1].astype(np.int64) - 1
    keyed = (mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D)), frequent.has(values))
    lower = -(-3 * n // 4) < 1 << np.maximum(own, 0)
    out = []
    for chosen, band, differences in ((n > 0, own, (n + 4 * n // 3) // 7), ((n > 0) & lower, own - 1, (n + (1 << np.maximum(own, 0)) - 1) // 7)):
        if chosen.any():
            of_band = [chosen_runs(x, bounds, chosen)[0] for x in keyed]
            keys, counts = _band_keys(*of_band, n[chosen], band[chosen], differences[chosen])
            out.append((keys, np.repeat(np.flatnonzero(chosen), counts)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _band_keys(place: np.ndarray, code: np.ndarray, common: np.ndarray, n: np.ndarray, band: np.ndarray, differences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest keys of every set in one band, one more than its differences, and their numbers."""
    bounds = np.concatenate(([0], np.cumsum(n)))
    blocks = np.array([_blocks(x) for x in range(int(band.max()) + 1)], dtype=np.uint64)[band]
    # Block and place of a shingle in one number: several sets have below 2^18 shingles together and at most 2^40 blocks.
    shift = np.uint64(int(bounds[-1]).bit_length())
    both = (place & np.repeat(blocks - np.uint64(1), n)) << shift | np.arange(len(place), dtype=np.uint64)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        both[begin:end].sort()
    block, at = both >> shift, (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    first = np.ones(len(block), dtype=bool)
    first[1:] = block[1:] != block[:-1]
    first[bounds[:-1]] = True
    starts = np.flatnonzero(first)
    filled = np.searchsorted(starts, bounds)
    if (np.diff(filled) <= differences).any():
        raise ValueError("a set fills too few sketch blocks")  # odds below 1e-20 by the choice of blocks
    parity = np.bitwise_xor.reduceat(code[at], starts)
    last = np.logical_and.reduceat(common[at], starts)
    of_band = np.repeat(band.astype(np.uint64), np.diff(filled))
    key = (mix(parity ^ mix(block[starts] * np.uint64(64) + of_band)) >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63))
    for begin, end, most in zip(filled[:-1].tolist(), filled[1:].tolist(), differences.tolist()):
        key[begin:end].partition(most)
    wanted = np.arange(len(key)) - np.repeat(filled[:-1], np.diff(filled)) <= np.repeat(differences, np.diff(filled))
    return key[wanted], differences + 1


class Frequent:
    """Sorted frequent shingles; a table of their low bits settles nearly all others."""

    def __init__(self, values: np.ndarray):
        self.values, self.table = values, np.zeros(1 << 20, dtype=bool)
        self.table[self._bits(values)] = True

    @staticmethod
    def _bits(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << 20) - 1)).astype(np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.table[self._bits(values)]
        maybe = values[out]
        if len(maybe):
            out[out] = self.values[np.minimum(np.searchsorted(self.values, maybe), len(self.values) - 1)] == maybe
        return out


def bit_sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set, parity of the shingles per bit, for a power of two of bits: at least two for each shingle, one in large sets.

    Sets of 512 shingles and more that have nothing in common differ in about half of their bits, far over the
    two in seven of a link, also with one bit a shingle; sketches move with the blocks, so they are kept short.
    """
    n = np.diff(bounds)
    bits = np.array([1 << ((2 if x < 512 else 1) * x - 1).bit_length() if x > 4 else 8 for x in n.tolist()], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(bits)))
    place = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.repeat((bits - 1).astype(np.uint64), n)).astype(np.int64) + np.repeat(begin[:-1], n)
    packed = np.packbits(np.bincount(place, minlength=begin[-1]).astype(np.uint8) & 1, bitorder="little").tobytes()
    ends = (begin // 8).tolist()
    return [packed[x:y] for x, y in zip(ends[:-1], ends[1:])]


def bit_sketch(values: np.ndarray) -> bytes:
    """The sketch of one set."""
    return bit_sketches(values, np.array([0, len(values)]))[0]


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer one folded: at most the symmetric difference of the sets."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of facts per document, and rows of (shingle, count) for locally frequent shingles."""
    held, documents = [], 0

    def frequent(last: bool):
        nonlocal held, documents
        if held and (last or sum(map(len, held)) >= COUNTED_AT_ONCE):
            found, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(16, documents // 200)
            held, documents = [], 0
            if often.any():
                k = int(often.sum())
                nothing = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(k, pa.binary()), pa.array(found[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=names)

    names, seen = ["doc_id", "text_hash", "n", "set_id", "sketch", "shingle", "documents"], set()
    for batch in batches:
        for begin, texts in text_parts(batch.column("text")):
            values, bounds = shingle_sets(texts)
            ids, ns = set_ids(values, bounds), np.diff(bounds)
            new = _unseen(ids, ns, seen)
            own, own_bounds = chosen_runs(values, bounds, new)
            sketches = np.full(len(texts), None, dtype=object)
            sketches[new] = bit_sketches(own, own_bounds)
            if len(own):
                held.append(own)
                documents += int(new.sum())
                yield from frequent(False)
            part, nothing = batch.slice(begin, len(texts)), pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(ns), pa.array(ids), pa.array(sketches, pa.binary()), nothing, nothing], names=names)
    yield from frequent(True)


def _unseen(ids: np.ndarray, ns: np.ndarray, seen: set[int]) -> np.ndarray:
    """Marks the sets with shingles that come for the first time, and remembers them."""
    out = np.zeros(len(ids), dtype=bool)
    for i, own in enumerate(ids.tolist()):
        if ns[i] and own not in seen:
            seen.add(own)
            out[i] = True
    return out


def _emit(frequent):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen, rows = Frequent(frequent.value), set(), Rows(["key", "set_id", "n"])
        for batch in batches:
            for _, texts in text_parts(batch.column("text")):
                values, bounds = shingle_sets(texts)
                ids, ns = set_ids(values, bounds), np.diff(bounds)
                new = _unseen(ids, ns, seen)  # copies within a task send their keys once
                found, of = block_keys(*chosen_runs(values, bounds, new), often)
                rows.add(found.view(np.int64), ids[new][of], ns[new][of].astype(np.int32))
                yield from rows.ready()
        yield from rows.ready(True)
    return keys


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(n, m).astype(np.int64) >= 3 * np.maximum(n, m).astype(np.int64)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and set: pairs with the first set of a key, and all rows of keys with three sets or more."""
    names = ["key", "a", "b", "n"]
    tail = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))  # first and second row of the open key
    seen = 0  # distinct sets of the open key so far
    last_key = last_set = None
    for batch in batches:
        key, sets, n = (batch.column(c).to_numpy() for c in ("key", "set_id", "n"))
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])
        if len(key) and last_key is not None:
            keep[0] = key[0] != last_key or sets[0] != last_set
        key, sets, n = key[keep], sets[keep], n[keep]
        if not len(key):
            continue
        carried = len(tail[0]) if last_key == key[0] else 0
        before = seen if carried else 0
        key, sets, n = np.concatenate((tail[0][:carried], key)), np.concatenate((tail[1][:carried], sets)), np.concatenate((tail[2][:carried], n))
        starts = stored_runs(key)
        first = np.repeat(starts, np.diff(np.append(starts, len(key))))
        rank = np.arange(len(key)) - first
        fresh = np.arange(len(key)) >= carried
        pair = (rank > 0) & fresh & _fits(n, n[first])
        a, b = sets[first][pair], sets[pair]
        # In the open key of the last batch, ranks go on from what was seen.
        true_rank = rank + np.where(first == 0, max(0, before - carried), 0)
        many = (true_rank >= 2) & fresh
        opened = np.flatnonzero((true_rank == 2) & fresh)
        more = np.unique(np.concatenate((np.flatnonzero(many), opened - 1, opened - 2)))
        if len(a):
            both = np.unique(np.stack((a, b), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int32())], names=names)
        if len(more):
            yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(sets[more]), pa.nulls(len(more), pa.int64()), pa.array(n[more].astype(np.int32))], names=names)
        last_key, last_set = key[-1], sets[-1]
        begin = starts[-1]
        seen = int(true_rank[-1]) + 1
        tail = (key[begin:begin + 2], sets[begin:begin + 2], n[begin:begin + 2])


def _distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """``hamming`` of pairs of sketches, those of equal lengths together."""
    out = np.zeros(len(left), dtype=np.int64)
    sizes = np.array([list(map(len, left)), list(map(len, right))], dtype=np.int64)
    for x, y in np.unique(sizes, axis=1).T.tolist():
        at = np.flatnonzero((sizes[0] == x) & (sizes[1] == y))
        step = max(1, SKETCHES_AT_ONCE // (x + y))
        for part in (at[i:i + step] for i in range(0, len(at), step)):
            a, b = (np.frombuffer(b"".join([side[i] for i in part]), dtype=np.uint8).reshape(len(part), -1) for side in (left, right))
            while a.shape[1] > b.shape[1]:
                a = a[:, :a.shape[1] // 2] ^ a[:, a.shape[1] // 2:]
            while b.shape[1] > a.shape[1]:
                b = b[:, :b.shape[1] // 2] ^ b[:, b.shape[1] // 2:]
            out[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _later_round(low: int, high: int):
    """Pairs of the sets at ranks low..high-1 of each key with all later ones, where components differ and sketches allow a link.

    Sketches are compared where the sets of a key meet, so unlike sets that share a block make no rows.
    ``before`` and ``before2`` are the next smaller open keys of a set (0: none).  Two sets that have one of
    them in common meet there as well, in this round, an earlier or a later one, so they are passed over here.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = Rows(["a", "b"]), ["a", "n", "label", "before", "before2"]
        open_key, rank, held = None, 0, None  # of the key that may go on: its rows so far, and its leaders with their sketches

        def meet(x: list[np.ndarray], x_sketches: list[bytes], i: np.ndarray, y: list[np.ndarray], y_sketches: list[bytes], j: np.ndarray):
            ok = (x[2][i] != y[2][j]) & _fits(x[1][i], y[1][j])
            for p in (x[3], x[4]):
                ok &= (p[i] == 0) | (p[i] != y[3][j]) & (p[i] != y[4][j])
            i, j = i[ok], j[ok]
            if len(i):
                near = _distances([x_sketches[k] for k in i.tolist()], [y_sketches[k] for k in j.tolist()])
                ok = 7 * near <= x[1][i].astype(np.int64) + y[1][j]
                rows.add(x[0][i[ok]], y[0][j[ok]])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, sketches = batch.column("key").to_numpy(), batch.column("sketch").to_pylist()
            # Without the last two columns every shared block makes its pairs.
            own = [batch.column(c).to_numpy() if c in batch.schema.names else np.zeros(len(key), np.int64) for c in columns]
            starts = stored_runs(key)
            ends = np.append(starts[1:], len(key))
            if key[0] != open_key:
                rank, held = 0, None
            if held:
                # Leaders of earlier batches with the rows of their key that follow in this one.
                step = max(1, PAIRS_AT_ONCE // int(ends[0]))
                for begin in range(0, len(held[1]), step):
                    lead = np.arange(begin, min(begin + step, len(held[1])))
                    meet(*held, np.repeat(lead, ends[0]), own, sketches, np.tile(np.arange(ends[0]), len(lead)))
                    yield from rows.ready()
            place = np.arange(len(key)) - np.repeat(starts, ends - starts)
            place[:ends[0]] += rank
            leaders = np.flatnonzero((place >= low) & (place < high))
            later = np.repeat(ends, ends - starts)[leaders] - leaders - 1
            cuts = np.searchsorted(np.cumsum(later), np.arange(0, int(later.sum()), PAIRS_AT_ONCE), side="right")
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaders)]):
                lead, count = leaders[begin:end], later[begin:end]
                i = np.repeat(lead, count)
                meet(own, sketches, i, own, sketches, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count))
                yield from rows.ready()
            if len(starts) > 1:
                rank, held = 0, None
            open_key, rank = key[-1], rank + int(ends[-1] - starts[-1])
            last = leaders[leaders >= starts[-1]]
            if len(last):
                more = [x[last] for x in own], [sketches[i] for i in last.tolist()]
                held = more if held is None else ([np.concatenate(x) for x in zip(held[0], more[0])], held[1] + more[1])
        yield from rows.ready(True)
    return pairs


def _kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link."""
    for batch in batches:
        yield _kept(batch, [7 * hamming(x, y) <= n + m for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")))])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, first = None, None
    for batch in batches:
        keep = []
        for begin, others in text_parts(batch.column("text_b")):
            found, bounds = shingle_sets(others)
            for i, one in enumerate(texts_of(batch.column("text_a").slice(begin, len(others)))):
                if one != last:
                    last, first = one, shingle_sets([one])[0]
                keep.append(linked(first, found[bounds[i]:bounds[i + 1]]))
        yield _kept(batch, keep)


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, component_id, keeper`` per row of ``docs(doc_id, text)``.

    ``keeper`` marks rows equal in id and text to the first row of their
    component (by id, then text hash); rows without shingles are all keepers.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    facts = materialize(docs.mapInArrow(_describe, "doc_id bigint, text_hash bigint, n bigint, set_id bigint, sketch binary, shingle bigint, documents bigint"), "facts")
    often = facts.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("documents").alias("documents")).orderBy(F.desc("documents"), "shingle").limit(FREQUENT_SHINGLES)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.select("shingle").collect()], dtype=np.int64).view(np.uint64)))
    rows = facts.where("n IS NOT NULL").select("doc_id", "text_hash", "n", "set_id")
    sets = materialize(facts.where("n > 0").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.max("sketch").alias("sketch"), F.max("n").alias("n")).select(
        "set_id", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "sketch", "n"), "sets")

    keyed = docs.select("text").mapInArrow(_emit(frequent), "key bigint, set_id bigint, n int")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_first_round, "key bigint, a bigint, b bigint, n int"), "found")
    # A row per set with its blocks, so that labels and sketches are joined per set; a set has at most as many blocks as its text has shingles.
    members = found.where("key IS NOT NULL").groupBy("a").agg(F.collect_set("key").alias("keys"))
    members = materialize(members.join(sets.select(F.col("set_id").alias("a"), "n", "sketch"), "a"), "members")

    def texts(pairs: DataFrame) -> DataFrame:
        """The text of one document of every set in the pairs."""
        wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(sets, "set_id").select("set_id", "doc_id", "text_hash")
        wanted = materialize(wanted, "wanted")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        side = side.select("set_id", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        return docs.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("set_id", "text")

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs that their sketches do not rule out."""
        side = lambda x: sets.select(F.col("set_id").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_close, "a bigint, b bigint")

    def verified(pairs: DataFrame) -> DataFrame:
        # A text with many rows is that of repeated rows: one is enough.  Both joins read the one exchange of this step.
        text = texts(pairs).dropDuplicates(["set_id"])
        both = pairs.join(text.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b").join(text.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint")

    tested = materialize(found.where("key IS NULL").select("a", "b").distinct(), "pairs")
    links = materialize(verified(materialize(close(tested), "close")), "verified")
    labels = components(links)
    low = FIRST_LEADERS
    while True:
        named = members.select("a", "keys").join(labels.select(F.col("node").alias("a"), "label"), "a", "left").select("a", "keys", F.coalesce("label", "a").alias("label"))
        in_block = named.select("a", "label", F.explode("keys").alias("key"))
        open_keys = in_block.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where(F.expr(f"x <> y AND size > {low}")).select("key")
        opened = in_block.join(open_keys, "key", "left_semi").groupBy("a", "label").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        # Only sets of the round before are open in this one, so their sketches are taken from it.
        members = materialize(opened.join(members.select("a", "n", "sketch"), "a"), "open")
        if not members.take(1):
            break
        high = low * LEADER_GROWTH
        smaller = lambda i, by: f"coalesce(get(keys, {i} - {by}), 0L)"
        in_block = members.select("a", "n", "label", "sketch", F.expr(f"inline(transform(keys, (k, i) -> struct(k AS key, {smaller('i', 1)} AS before, {smaller('i', 2)} AS before2)))"))
        pairs = in_block.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_later_round(low, high), "a bigint, b bigint").distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        low = high
        if not pairs.take(1):
            continue
        tested = tested.unionByName(pairs)
        links = links.unionByName(materialize(verified(pairs), "verified"))
        labels = components(links)
    named = sets.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").select("set_id", "doc_id", "text_hash", F.coalesce("label", "set_id").alias("label"))
    named = materialize(named, "named")
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    of_set = named.join(heads, "label").select("set_id", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("head_hash"))
    out = rows.join(of_set, "set_id", "left")
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_id", F.expr("CASE WHEN n = 0 THEN doc_id ELSE component_id END").alias("component_id"),
        F.expr("n = 0 OR (doc_id <=> component_id AND text_hash = head_hash)").alias("keeper"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group left: that with the smallest id.

    Rows that repeat both id and text count as copies; rows without words stay.
    """
    groups = jaccard_groups(docs).where("keeper").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("n_shingles") == 0).alias("_empty")).distinct()
    own = docs.select(F.struct(*[F.col(name_of(c)) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = own.join(groups, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    filled = kept.where("NOT _empty").dropDuplicates(["doc_id", "text_hash"])
    return filled.unionByName(kept.where("_empty")).select(*unpacked(docs.columns))
