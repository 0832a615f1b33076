"""Benchmark decontamination: test phrases are searched in an FM-index of each shard of the corpus.

A window is ``width`` consecutive words of an item; an item of fewer words is
one window.  Each task cuts its texts into shards of about ``SHARD_BYTES``,
indexes a shard's words (``fm_index``), searches all windows in it and locates
what it finds; the places are merged to spans per document.  Texts are not
shuffled, and a longer text is several pieces of a shard that share ``width - 1`` words.

Words are compared by 64-bit hashes, ``width`` of them in a row.  The windows
are a stated query set and go out in blocks of about ``BLOCK_WORDS`` words of
items, which bounds what is collected and broadcast; where there are several
blocks, spans are merged by a number that each row gets first, and every word
hit and every item found counts, whatever the block.

Null and empty texts have no words.  An item without words has no window.  Null
ids of items count as an empty text; items count by id, so rows that repeat an
id are one item with the windows of all.  Repeated documents get equal results.
Extra columns are ignored, but for those that ``decontaminated`` keeps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.llm.common import hashed_words, mix, packed, texts_of, unpacked
from tallyscope.llm.fm_index import FMIndex, numbered

WIDTH = 10
#: Half of it, in words and pieces, must stay below 2**21 places.
SHARD_BYTES = 4_000_000
BLOCK_WORDS = 2_000_000
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Letters in lower case, all that is no part of a word as a blank.
_FOLD = bytes(b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPANS = "array<struct<begin:bigint,end:bigint>>"


def _pieces(text: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a folded text with the words that follow each, and the number of these."""
    begin, size, after = 0, len(text), re.compile(rb" *(?:[^ ]+ *){0,%d}" % overlap)
    while size - begin > SHARD_BYTES // 2:
        cut = text.rfind(b" ", begin, begin + SHARD_BYTES // 2) + 1 or text.find(b" ", begin + SHARD_BYTES // 2) + 1
        if not cut:
            break
        end = after.match(text, cut).end()
        yield text[begin:end], len(text[cut:end].split())
        begin = cut
    yield text[begin:], 0


class Phrases:
    """Distinct windows of items: their words in a row, where each starts, its length and the items it stands in."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int = WIDTH):
        self.width = width
        self.words, self.of_word = np.unique(np.concatenate([h for _, h in items]), return_inverse=True) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(names)}
        size = np.array([len(h) for _, h in items], dtype=np.int64)
        length = np.minimum(size, width)
        windows = np.where(size > 0, size - length + 1, 0)
        owner = np.repeat(np.arange(len(items)), windows)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + (np.cumsum(size) - size)[owner]
        length = length[owner]
        # Equal windows by a hash of their words.
        key = mix(length.astype(np.uint64))
        for k in range(int(length.max(initial=0))):
            on = length > k
            key[on] = mix(key[on] ^ self.words[self.of_word[start[on] + k]])
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        self.starts, self.lengths = start[first], length[first]
        pairs = np.unique(np.stack((same, np.array([number[i] for i, _ in items], dtype=np.int64)[owner])), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
        self.items, self.bounds, self.names = pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1)), names
        #: Windows that stand in the same items share a set; a set is shown by one window of it.
        size, total = np.diff(self.bounds), np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.items.astype(np.uint64)), dtype=np.uint64)))
        _, shown, self.set_of = np.unique(np.stack((total[self.bounds[1:]] - total[self.bounds[:-1]], size.astype(np.uint64))), axis=1, return_index=True, return_inverse=True)
        self.shown = shown

    def items_of(self, sets: set[int]) -> list[str]:
        """The items of some sets, in order."""
        at = {k for s in sets for k in self.items[self.bounds[self.shown[s]]:self.bounds[self.shown[s] + 1]].tolist()}
        return [self.names[k] for k in sorted(at)]


def _found(pieces: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: words of each piece; (piece, first word, word after the last) of each span; (piece, set of items) of what is found."""
    text = b"  ".join(pieces) + b" "
    hashes, starts = hashed_words(text, lower=False)
    ends = np.cumsum([len(p) + 2 for p in pieces])
    stops = np.searchsorted(starts, ends)
    counts = np.diff(stops, prepend=0)
    known, numbers = numbered(hashes)
    nothing = np.zeros(0, dtype=np.int64)
    none = (counts, nothing, nothing, nothing, nothing, nothing)
    if not len(known) or not len(phrases.starts):
        return none
    own = np.minimum(np.searchsorted(known, phrases.words), len(known) - 1)
    words = np.where(known[own] == phrases.words, own + 1, 0)[phrases.of_word]
    # A window with a word that the shard lacks can't occur.
    lacking = np.concatenate(([0], np.cumsum(words == 0)))
    possible = np.flatnonzero(lacking[phrases.starts + phrases.lengths] == lacking[phrases.starts])
    if not len(possible):
        return none
    # Word k of piece p stands at k plus the p ends before it.
    symbols = np.zeros(len(numbers) + len(pieces), dtype=np.int64)
    symbols[np.arange(len(numbers)) + np.repeat(np.arange(len(pieces)), counts)] = numbers + 1
    begins = stops - counts + np.arange(len(pieces))
    index = FMIndex(symbols)
    low, high = index.search(words, phrases.starts[possible], phrases.lengths[possible])
    hit = high > low
    possible, low, high = possible[hit], low[hit], high[hit]
    change, pairs = np.zeros(len(symbols) + 1, dtype=np.int64), [nothing]
    for which, place in index.occurrences(low, high):
        window = possible[which]
        change += np.bincount(place, minlength=len(change)) - np.bincount(place + phrases.lengths[window], minlength=len(change))
        piece = np.searchsorted(begins, place, side="right") - 1
        pairs.append(np.unique(piece * len(phrases.starts) + phrases.set_of[window]))
    covered = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(covered, prepend=False))
    first, end = edges[0::2], edges[1::2]
    piece = np.searchsorted(begins, first, side="right") - 1
    met = np.unique(np.concatenate(pairs))
    return counts, piece, first - begins[piece], end - begins[piece], *np.divmod(met, len(phrases.starts))


def _search(shared):
    """Per row its key, id, words, merged spans and items."""
    names = ["key", "doc_id", "n_words", "spans", "items"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
        held: list[tuple[int, bytes, int]] = []  # row, piece and the words of it that the next one repeats
        rows: dict[int, list] = {}               # key, id, words so far, spans, sets of items

        def done():
            counts, piece, first, end, of, sets = _found([p for _, p, _ in held], phrases)
            offset = []
            for (row, _, more), n in zip(held, counts.tolist()):
                offset.append(rows[row][2])
                rows[row][2] += n - more
            for i, a, b in zip(piece.tolist(), first.tolist(), end.tolist()):
                rows[held[i][0]][3].append((a + offset[i], b + offset[i]))
            for i, k in zip(of.tolist(), sets.tolist()):
                rows[held[i][0]][4].add(k)
            held.clear()

        def ready(open_: int | None = None):
            out = [rows.pop(r) for r in list(rows) if r != open_]
            if out:
                columns = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [merged(r[3]) for r in out], [phrases.items_of(r[4]) for r in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        number, size = 0, 0
        for batch in batches:
            for key, doc, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                rows[number] = [key, doc, 0, [], set()]
                text = (text.as_py() or b"").translate(_FOLD)
                for piece, more in _pieces(text, phrases.width - 1):
                    if held and size + len(piece) + 4 > SHARD_BYTES:
                        done()
                        size = 0
                        yield from ready(number)
                    held.append((number, piece, more))
                    size += len(piece) + 4
                number += 1
        if held:
            done()
        yield from ready()
    return search


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, those that touch or overlap as one."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"begin": a, "end": b})
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [hashed_words(t.translate(_FOLD), lower=False)[0] for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array([len(h) for h in hashes], pa.int64())], names=["item", "hashes", "n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, doc_id, n_words, spans, items`` per row: spans are (first word, word after the last), items are sorted as texts.

    ``key`` is a column of ``docs`` where it has one, else null.
    """
    spark = docs.sparkSession
    key = F.col("key").cast("bigint") if "key" in docs.columns else F.lit(None).cast("bigint")
    texts = docs.select(key.alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = f"key bigint, doc_id bigint, n_words bigint, spans {SPANS}, items array<string>"
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(_items, "item string, hashes binary, n bigint").where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    if blocks > 1:
        items = materialize(items, "items")
        if "key" not in docs.columns:
            texts = materialize(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
    parts = []
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(blocks)) == block)
        phrases = Phrases([(r.item, np.frombuffer(r.hashes, dtype=np.uint64)) for r in own.select("item", "hashes").collect()], width)  # about block_words words
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(phrases)), schema)
        parts.append(found if blocks == 1 else materialize(found, "found"))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part.where("size(items) > 0"))
    met = every.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr("""aggregate(spans, cast(array() AS array<struct<begin:bigint,end:bigint>>), (a, x) ->
        if(size(a) > 0 AND x.begin <= element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, x.end)))),
           concat(a, array(x))))""")
    return met.withColumn("spans", joined).select("key", "doc_id", "n_words", "spans", "items")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at:words[begin][0]])
        at = words[end - 1][1]
    return "".join(out) + text[at:]


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs``, the words of benchmark windows removed from ``text``."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not s else without(t, [(x["begin"], x["end"]) for x in s]) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("_row")], names=["text", "_row"])

    rows = materialize(packed(docs, "doc_id", "text").withColumn("key", F.monotonically_increasing_id()), "rows")
    spans = contamination(rows, benchmark, width).where("size(spans) > 0").select("key", "spans")
    plain = rows.join(spans.select("key"), "key", "left_anti").select("doc_id", "text", "_row")
    cut = rows.join(spans, "key").select("text", F.struct("doc_id", "_row").alias("_row"), "spans")
    row = cut.schema["_row"].dataType.simpleString()
    cut = cut.mapInArrow(remove, f"text string, _row {row}").select("_row.doc_id", "text", "_row._row")
    return plain.unionByName(cut).select(*unpacked(docs.columns, "doc_id", "text"))
