"""Substring dedup by sliding sentence spans.

From every sentence a span runs forward, and to every sentence one runs back,
until it has ``LEAST_WORDS`` words: one sentence if it has that many by itself,
else at least ``RUN`` sentences and as many more as needed.  So every sentence
of a repeated passage with that many words lies in a span of the passage.
Spans are hashed (letters lower-cased, blanks collapsed) and joined over all
documents.  A span's first place is in the document with the smallest id, at
its first occurrence there; sentences covered by any other occurrence are
removed, but for those an overlapping occurrence shares with the first one.
Sentences end after ``.``, ``!`` or ``?`` before a blank, after their full-width
forms and at line breaks; each Chinese or Japanese character counts as a word.
Sentences of over ``LONG`` words are cut further, into pieces that end where a
word has the smallest hash of ``NEAR`` neighbours (the rightmost of equal ones),
so passages within long sentences that differ elsewhere meet as well.  Any 51
words that two documents share in a row, with the same blanks, hold a common span.

A document counts by id and text: rows that repeat both are one document, so
they get the same result.  Null ids come last; null and empty texts are returned
as they are.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.llm.common import Rows, mix

RUN, LEAST_WORDS = 2, 20
#: With 51 shared words, 2 * LONG + LEAST_WORDS and 4 * (NEAR - 1) + LEAST_WORDS must not exceed 50.
LONG, NEAR = 15, 8
_CUT = re.compile(r"[.!?]+(?=\s)\s*|[。！？｡]+[」』”’）)]*\s*|\n\s*")
_HAN = "\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED, _WORD = re.compile(f"[{_HAN}]"), re.compile(r"\s*\S+\s*")
_HAN_WORD = re.compile(f"\\s*(?:[{_HAN}]|[^\\s{_HAN}]+)\\s*")


def sentences(text: str) -> list[str]:
    """Sentences with what follows them up to the next one; together the text."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.end() > at:
            out.append(text[at:m.end()])
            at = m.end()
    return out + [text[at:]] if at < len(text) else out


def pieces(text: str) -> tuple[list[str], list[int], np.ndarray, list[str]]:
    """Sentences, long ones in pieces; the sentence of each, its number of words, and its words in the form that is hashed."""
    word = _HAN_WORD if _UNSPACED.search(text) else _WORD
    whole = sentences(text)
    plain = [w.lower().split() for w in whole]
    count = [len(w) for w in plain] if word is _WORD else [len(word.findall(w)) for w in whole]
    long = {i: word.findall(whole[i]) for i, n in enumerate(count) if n > LONG}
    cuts = iter(())
    if long:
        lower = [w for i in long for w in (plain[i] if word is _WORD else [w.strip().lower() for w in long[i]])]
        h = mix(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in lower], dtype=np.uint64))
        lengths = np.array([len(words) for words in long.values()])
        own = np.repeat(np.arange(len(long)), lengths)
        # The rightmost minimum of each window within one sentence: from the right, the first.
        windows = np.lib.stride_tricks.sliding_window_view(h[::-1], NEAR)
        last = len(h) - 1 - np.arange(len(windows))
        ends = (last - windows.argmin(axis=1))[own[last] == own[last - NEAR + 1]] + 1
        stops = np.cumsum(lengths)
        ends = np.unique(np.append(ends, stops))
        sentence = np.searchsorted(stops, ends)
        cuts = iter(np.split(ends - (stops - lengths)[sentence], np.flatnonzero(np.diff(sentence)) + 1))
    parts, owners, size, forms = [], [], [], []
    for i, (part, n, words) in enumerate(zip(whole, count, plain)):
        if n <= LONG:
            parts.append(part)
            owners.append(i)
            size.append(n)
            forms.append(" ".join(words))
            continue
        begin = 0
        for end in next(cuts).tolist():
            part = "".join(long[i][begin:end])
            parts.append(part)
            owners.append(i)
            size.append(end - begin)
            forms.append(" ".join(words[begin:end] if word is _WORD else part.lower().split()))
            begin = end
    return parts, owners, np.array(size, dtype=np.int64), forms


def spans(text: str, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[list[str], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences or pieces of them, the sentence of each, places of those with words, and the first, the end and the hash of each span (by first and end)."""
    parts, owners, size, forms = pieces(text)
    places = np.flatnonzero(size)
    n, size = len(places), size[places]
    h = np.array([xxhash.xxh64_intdigest(forms[i].encode("utf-8", "surrogatepass")) for i in places.tolist()], dtype=np.uint64)
    before = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(n)
    alone = size >= least_words
    ahead = np.where(alone, at + 1, np.maximum(np.searchsorted(before, before[:-1] + least_words), at + run))
    back = np.where(alone, at, np.minimum(np.searchsorted(before, before[1:] - least_words, side="right") - 1, at + 1 - run))
    pairs = np.concatenate((at * (n + 1) + ahead, back * (n + 1) + at + 1))[np.concatenate((ahead <= n, back >= 0))]
    first, end = np.divmod(np.unique(pairs), n + 1)
    total, length = np.zeros(len(first), dtype=np.uint64), end - first
    for j in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > j)
        total[on] = mix(total[on] ^ h[first[on] + j])
    return parts, owners, places, first, end, total


def _emit(run: int, least: int):
    """A row per distinct span of a text, and one without a span: its number of sentences and whether a span is in it twice."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["span", "doc_id", "text_hash", "n_sentences", "twice"]
        rows = Rows(names[:3])
        nulls = Rows(["span", "text_hash"])

        def widened(part: pa.RecordBatch, doc: pa.Array, mark: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), doc, mark, pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.bool_())], names=names)

        for batch in batches:
            counts, twice = [], []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                _, owners, places, _, _, every = spans(text or "", run, least)
                found = np.unique(every).view(np.int64)
                counts.append(len({owners[i] for i in places.tolist()}))
                twice.append(len(found) < len(every))
                if doc is None:
                    nulls.add(found, np.full(len(found), mark))
                else:
                    rows.add(found, np.full(len(found), doc), np.full(len(found), mark))
                for part in rows.ready():
                    yield widened(part, part.column(1), part.column(2))
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(twice, pa.bool_())], names=names)
        for part in rows.ready(True):
            yield widened(part, part.column(1), part.column(2))
        for part in nulls.ready(True):
            yield widened(part, pa.nulls(part.num_rows, pa.int64()), part.column(1))
    return emit


def _remove(run: int, least: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "n_sentences", "n_removed"]
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
                parts, owners, places, first, end, found = spans(text or "", run, least)
                lost, seen, drop = set(lost or ()), {}, set()
                for i, j, h in zip(first.tolist(), end.tolist(), found.view(np.int64).tolist()):
                    start = i if h in lost else max(i, seen.setdefault(h, j))
                    drop.update(places[start:j].tolist())
                texts.append(text if not drop else "".join([p for i, p in enumerate(parts) if i not in drop]))
                totals.append(len({owners[i] for i in places.tolist()}))
                gone.append(len({owners[i] for i in drop}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=names)
    return remove


def deduplicated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` per row: the text without repeated spans; sentences removed in part count as removed."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    emitted = materialize(docs.mapInArrow(_emit(run, least_words), "span bigint, doc_id bigint, text_hash bigint, n_sentences bigint, twice boolean"), "spans")
    rows = emitted.where("span IS NOT NULL").select("span", "doc_id", "text_hash")
    # Spans of one row leave by a count, combined per task before its shuffle; only spans of several documents stay.
    repeated = rows.groupBy("span").count().where("count > 1").select("span")
    rows = materialize(rows.join(repeated, "span", "left_semi"), "repeated")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    several = rows.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("span", "first")
    lost = rows.join(several, "span").where(place != F.col("first")).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "lost")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.coalesce("text_hash", F.lit(0)) == F.coalesce("_hash", F.lit(0)))
    facts = emitted.where("span IS NULL").groupBy("doc_id", "text_hash").agg(F.max("n_sentences").alias("n_sentences"), F.max("twice").alias("twice"))
    facts = materialize(facts.join(lost, same, "left").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_sentences", "twice", "lost"), "lost")
    # Texts that lose nothing stay in the JVM; both branches read one shuffle of the texts.
    touched = F.col("twice") | F.col("lost").isNotNull()
    plain = docs.join(facts.where(~touched), same).select("doc_id", "text", "n_sentences", F.lit(0).cast("bigint").alias("n_removed"))
    cut = docs.join(facts.where(touched), same).select("doc_id", "text", "lost")
    return plain.unionByName(cut.mapInArrow(_remove(run, least_words), "doc_id bigint, text string, n_sentences bigint, n_removed bigint"))
