"""LM scoring with a probabilistic suffix tree over words.

A text is a start mark, its words and one end.  Words with at least
``OWN_LEAST`` x sqrt(N) of the N trained tokens are symbols of their own; all
others are the symbol RARE, within which a trained word has its discounted
share and all unknown words together have what the discounts free (as in the
base score, unknown words are one type).

Contexts are runs of 1 to ``depth`` symbols.  A context is a candidate if at
least ``CONTEXT_LEAST`` x sqrt(N) trained tokens follow it; it is retained if the
log-likelihood that its own next-symbol distribution gains over that of its
suffix exceeds half the log of the number of tokens for each of its symbols.
Suffixes of retained contexts are retained too.  Distributions are blended with
that of the next shorter context by the number of distinct symbols (Witten-Bell).
Each symbol is scored in the longest retained context before it.

The least counts grow as the root of the corpus, so the tree does too: with four
times the text, twice as many words, contexts and next symbols at most may enter,
and each of them rests on twice the evidence.  That also bounds what is broadcast
and what the driver holds as arrays: sqrt(N) / OWN_LEAST words, depth x sqrt(N) /
CONTEXT_LEAST contexts and (depth + 1) x sqrt(N) / SYMBOL_LEAST entries.  Counts
cover all rows: word counts and context counts are combined before their shuffles.
Words not in the table meet their counts in a join on the word's 64-bit hash; words
frequent in held-out texts only are in the table as well, so no key of the join is hot.

Null texts are empty: only the end is scored.  A null id counts as text '' for
the choice of training rows.  Rows equal in id and text get the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.llm.common import Rows, hashed_words, mix, texts_of

#: Least counts in units of the root of the number of trained tokens, and never below 2: of a word that
#: is a symbol of its own, of a context, and of a next symbol (rarer ones are left to the shorter context).
OWN_LEAST = 0.006
CONTEXT_LEAST = 0.04
SYMBOL_LEAST = 0.003
DEPTH = 3
RARE, START, END, FIRST_WORD = 0, 1, 2, 3
BYTES_AT_ONCE, WORDS_AT_ONCE = 500_000, 2_000_000


def least(unit: float, tokens: int) -> float:
    """The least count of a corpus of this many tokens."""
    return max(2.0, unit * tokens ** 0.5)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of the words of rows begin..end-1 of a batch, and the number of words of each row."""
    texts = texts_of(batch.column("text"))
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BYTES_AT_ONCE):
            size += len(texts[end])
            end += 1
        words, starts = hashed_words(b" ".join(texts[begin:end]))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[begin:end]), dtype=np.int64, count=end - begin))
        yield begin, end, words, np.diff(np.searchsorted(starts, ends), prepend=0)
        begin = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their number in training and in all texts, combined over many texts."""
    def out():
        words, train = np.concatenate(held), np.concatenate(marks)
        found, inverse = np.unique(words, return_inverse=True)
        yield pa.RecordBatch.from_arrays([
            pa.array(found.view(np.int64)), pa.array(np.bincount(inverse, weights=train, minlength=len(found)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(found)).astype(np.int64))], names=["hash", "n", "m"])

    held, marks, size = [], [], 0
    for batch in batches:
        train = ~np.array(batch.column("held_out").to_pylist(), dtype=bool)
        for begin, end, words, counts in _pieces(batch):
            held.append(words)
            marks.append(np.repeat(train[begin:end], counts))
            size += len(words)
            if size >= WORDS_AT_ONCE:
                yield from out()
                held, marks, size = [], [], 0
    if held:
        yield from out()


@dataclass
class Vocabulary:
    """The bounded table of words: sorted hashes, symbol, and parts of the scores."""

    keys: np.ndarray
    symbols: np.ndarray
    known: np.ndarray
    base: np.ndarray
    rare: np.ndarray  # log10 share within RARE; 0 for symbols of their own

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the table, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return at, self.keys[at] == words

    def sequence(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of texts in a row with start and end, place in the text, text of each; place in the table and hit of each word."""
        at, hit = self.find(words)
        lengths = counts + 2
        begins = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), dtype=np.int64)
        inner = np.ones(len(flat), dtype=bool)
        inner[begins] = inner[begins + lengths - 1] = False
        flat[begins], flat[begins + lengths - 1] = START, END
        if len(self.keys):
            flat[inner] = np.where(hit, self.symbols[at], RARE)
        text = np.repeat(np.arange(len(counts)), lengths)
        return flat, np.arange(len(flat)) - begins[text], text, at, hit


def _deeper(h: np.ndarray, symbol: np.ndarray, d: int) -> np.ndarray:
    return mix(h ^ mix(symbol.astype(np.uint64) + np.uint64((d + 1) << 40)))


def context_hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every context (a row of symbols, oldest first) and of its suffix; 0 for the empty one."""
    h = suffix = np.zeros(len(symbols), dtype=np.uint64)
    for d in range(symbols.shape[1]):
        suffix, h = h, _deeper(h, symbols[:, -1 - d], d)
    return h, suffix


def _contexts(flat: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth: hashes of the contexts before the symbols at ``at`` (all but starts)."""
    at = np.flatnonzero(place > 0)
    h = np.zeros(len(at), dtype=np.uint64)
    for d in range(depth + 1):
        yield d, at, h
        if d < depth:
            deeper = place[at] > d
            at = at[deeper]
            h = _deeper(h[deeper], flat[at - d - 1], d)


def _count(shared, depth: int):
    """Counts of (candidate context of this depth, next symbol), combined over many texts."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, candidates = shared.value

        def out():
            h, s = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
            # Candidates are numbered, so context and symbol fit one number.
            found, n = np.unique((h << 32) | s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(candidates[found >> 32].view(np.int64)), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["context", "symbol", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, words, number in _pieces(batch):
                flat, place, *_ = vocabulary.sequence(words, number)
                *_, (_, at, h) = _contexts(flat, place, depth)
                i = np.minimum(np.searchsorted(candidates, h), len(candidates) - 1)
                hit = candidates[i] == h
                held.append((i[hit], flat[at[hit]]))
                size += int(hit.sum())
                if size >= WORDS_AT_ONCE:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
    return counts


def _entry(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Key of a symbol after a context."""
    return mix(context ^ mix(symbol.astype(np.uint64)))


@dataclass
class Level:
    """Candidate contexts of one depth, sorted by hash, and the counts of the symbols after them."""

    symbols: np.ndarray    # a row per context, oldest symbol first
    hashes: np.ndarray
    suffixes: np.ndarray   # hash of the next shorter context
    sizes: np.ndarray      # tokens that follow
    owner: np.ndarray      # place of the context of each entry
    symbol: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray) -> Level:
        """Contexts without counts."""
        hashes, suffixes = context_hashes(symbols)
        sort, none = np.argsort(hashes), np.zeros(0, dtype=np.int64)
        return Level(symbols[sort], hashes[sort], suffixes[sort], np.zeros(len(hashes)), none, none, none)

    def following(self, least_count: float) -> Level:
        """The contexts made longer by a symbol that often follows."""
        often = (self.n >= least_count) & (self.symbol != END)
        return Level.of(np.column_stack([self.symbols[self.owner[often]], self.symbol[often]]))

    def gain(self, shorter: Level) -> np.ndarray:
        """Log-likelihood that the contexts' own distributions gain over those of their suffixes."""
        keys = _entry(shorter.hashes[shorter.owner], shorter.symbol)
        sort = np.argsort(keys)
        i = np.minimum(np.searchsorted(keys, wanted := _entry(self.suffixes[self.owner], self.symbol), sorter=sort), max(0, len(keys) - 1))
        above = np.where(keys[sort[i]] == wanted, shorter.n[sort[i]], 0).astype(np.float64)
        whole = np.maximum(1.0, shorter.sizes[np.searchsorted(shorter.hashes, self.suffixes)])
        size = np.maximum(1.0, self.sizes)
        total = lambda v: np.bincount(self.owner, weights=v, minlength=len(size))
        out = total(self.n * np.log(self.n / size[self.owner] * whole[self.owner] / np.maximum(self.n, above)))
        rest = self.sizes - total(self.n)
        return out + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / size * whole / np.maximum(np.maximum(rest, 1), whole - total(above))), 0.0)


@dataclass
class Tree:
    """Retained contexts and their smoothed distributions as sorted arrays."""

    depth: int             # of the longest retained context
    contexts: np.ndarray   # sorted hashes; the root has hash 0
    parents: np.ndarray    # index of the next shorter context
    escapes: np.ndarray    # weight of the shorter context
    entries: np.ndarray    # sorted keys of (context, symbol)
    shares: np.ndarray     # the context's own share for the symbol

    @staticmethod
    def build(levels: list[Level]) -> Tree:
        """From the levels of all depths, the root first."""
        cost = 0.5 * np.log(max(1.0, levels[0].sizes[0]))
        kept = [np.ones(1, dtype=bool)]
        for shorter, level in zip(levels, levels[1:]):
            types = np.bincount(level.owner, minlength=len(level.hashes))
            kept.append((types > 0) & (level.gain(shorter) > cost * types))
        for d in range(len(levels) - 1, 0, -1):
            kept[d - 1][np.searchsorted(levels[d - 1].hashes, levels[d].suffixes[kept[d]])] = True
        hashes, suffixes, escapes, keys, shares = [], [], [], [], []
        for d, (level, keep) in enumerate(zip(levels, kept)):
            types = np.bincount(level.owner, minlength=len(level.hashes))
            # The root knows all symbols, so its share is not discounted.
            whole = np.maximum(1.0, level.sizes + (types + 1 if d else 0))
            own = keep[level.owner]
            hashes.append(level.hashes[keep])
            suffixes.append(level.suffixes[keep])
            escapes.append(np.maximum(0.0, 1 - np.bincount(level.owner, weights=level.n, minlength=len(whole)) / whole)[keep])
            keys.append(_entry(level.hashes[level.owner[own]], level.symbol[own]))
            shares.append(level.n[own] / whole[level.owner[own]])
        deepest = max(d for d, keep in enumerate(kept) if keep.any())
        hashes, suffixes, escapes, keys, shares = map(np.concatenate, (hashes, suffixes, escapes, keys, shares))
        order, sort = np.argsort(hashes), np.argsort(keys)
        return Tree(deepest, hashes[order], np.searchsorted(hashes[order], suffixes[order]), escapes[order], keys[sort], shares[sort])

    def log10(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        total, weight, at, node = np.zeros(len(node)), np.ones(len(node)), np.arange(len(node)), node.copy()
        code = mix(symbol.astype(np.uint64))
        root = int(np.searchsorted(self.contexts, np.uint64(0)))
        while len(at):
            here = node[at]
            key = mix(self.contexts[here] ^ code[at])
            i = np.minimum(np.searchsorted(self.entries, key), len(self.entries) - 1)
            total[at] += weight[at] * np.where(self.entries[i] == key, self.shares[i], 0.0)
            weight[at] *= self.escapes[here]
            at = at[here != root]
            node[at] = self.parents[node[at]]
        return np.log10(total)

    def score(self, flat: np.ndarray, place: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """log10 probability of each text's symbols."""
        node = np.zeros(len(flat), dtype=np.int64)
        live = place > 0
        for _, at, h in _contexts(flat, place, self.depth):
            # The suffixes of a retained context are retained, so a miss ends the search of a symbol.
            h, at = h[live[at]], at[live[at]]
            i = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
            hit = self.contexts[i] == h
            node[at[hit]] = i[hit]
            live = np.zeros(len(flat), dtype=bool)
            live[at[hit]] = True
        scored = np.flatnonzero(place > 0)
        return np.bincount(text[scored], weights=self.log10(node[scored], flat[scored]), minlength=texts)


def _score_texts(shared):
    """Per text a row with the sums over known places, and a row for every other distinct word."""
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tree, end = shared.value
        names = ["hash", "n", "doc", "facts"]
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            rows, facts = Rows(names[:3], 1), []
            for begin, last, words, counts in _pieces(batch):
                flat, place, text, at, hit = vocabulary.sequence(words, counts)
                own, texts = np.repeat(np.arange(last - begin), counts), last - begin
                total = lambda v: np.bincount(own[hit], weights=v[at[hit]], minlength=texts) if hit.any() else np.zeros(texts)  # noqa: E731,B023
                facts.append(np.stack([np.ones(texts), counts + 1.0, total(vocabulary.known) + end[0], total(vocabulary.base) + end[1], total(vocabulary.rare) + tree.score(flat, place, text, texts)], axis=1))
                other, owner = words[~hit], own[~hit]
                if len(other):
                    sort = np.lexsort((other, owner))
                    other, owner = other[sort], owner[sort]
                    starts = np.flatnonzero(np.concatenate(([True], (other[1:] != other[:-1]) | (owner[1:] != owner[:-1]))))
                    rows.add(other[starts].view(np.int64), np.diff(np.append(starts, len(other))).astype(np.int32), docs[begin:last][owner[starts]])
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.nulls(len(docs), pa.int32()), pa.array(docs), pa.array(list(np.concatenate(facts)), pa.list_(pa.float64()))], names=names)
            for part in rows.ready(True):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.list_(pa.float64()))], names=names)
    return scores


def _log10_rare(n: Column, discount: float, types: int, tokens: int) -> Column:
    """log10 share within RARE of a word seen n times; unknown words are one type with the freed mass."""
    return F.when(n > 0, F.log10((n - F.lit(discount)) / float(tokens + 1))).otherwise(F.lit(float(np.log10((discount * types + 1) / (tokens + 1)))))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


@dataclass
class Model:
    """What is learned: the arrays that are broadcast, and the table of all words."""

    vocabulary: Vocabulary
    tree: Tree
    rest: DataFrame   # hash, known, base, rare: words that are not in the vocabulary
    tokens: int       # trained tokens with ends
    types: int        # distinct ones
    texts: int        # trained texts


def learned(docs: DataFrame, depth: int = DEPTH) -> Model:
    """The model of the rows of ``docs(text, held_out)`` that are not held out."""
    spark = docs.sparkSession
    words = docs.select("text", "held_out").mapInArrow(_tally, "hash bigint, n bigint, m bigint").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    words = materialize(words, "words")
    totals = words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum("m"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tokens, types, m, once, twice = (v or 0 for v in totals)
    texts = docs.where("NOT held_out").count()
    n, v = tokens + texts, types + (texts > 0)

    own = F.col("n") >= least(OWN_LEAST, n)
    in_table = own | (F.col("m") >= least(OWN_LEAST, m))
    keys, count, own_symbol = _arrays(words.where(in_table).select("hash", F.col("n").cast("double"), own))
    sort = np.argsort(keys.view(np.uint64))
    keys, count, own_symbol = keys.view(np.uint64)[sort], count[sort], own_symbol[sort].astype(bool)
    symbols = np.where(own_symbol, FIRST_WORD + np.arange(len(keys)), RARE)
    rare_tokens, rare_types = tokens - int(count[own_symbol].sum()), types - int(own_symbol.sum())
    discount = once / (once + 2 * twice) if once else 0.5  # the usual estimate from words seen once and twice
    free = np.log10((discount * rare_types + 1) / (rare_tokens + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        within = np.where(own_symbol, 0.0, np.where(count > 0, np.log10((count - discount) / (rare_tokens + 1)), free))
    vocabulary = Vocabulary(keys, symbols, (count > 0).astype(np.float64), np.log10(count + 1), within)

    # One token is added to RARE and one to END, so unknown words and the end always have a share.
    root = Level.of(np.zeros((1, 0), dtype=np.int64))
    root.symbol = np.concatenate(([RARE, END], symbols[own_symbol]))
    root.n = np.concatenate(([rare_tokens + 1.0, texts + 1.0], count[own_symbol]))
    root.owner, root.sizes = np.zeros(len(root.n), dtype=np.int64), np.array([n + 2.0])
    levels, training = [root], docs.where("NOT held_out").select("text")
    for d in range(1, depth + 1):
        level = levels[-1].following(least(CONTEXT_LEAST, n))
        if d == 1:
            level = Level.of(np.concatenate((level.symbols, [[START]])))
        if not n or not len(level.hashes):
            break
        shared = spark.sparkContext.broadcast((vocabulary, level.hashes))
        counts = materialize(training.mapInArrow(_count(shared, d), "context bigint, symbol int, n bigint").groupBy("context", "symbol").agg(F.sum("n").alias("n")), "contexts")
        at = lambda h: np.searchsorted(level.hashes, h.view(np.uint64))  # noqa: E731,B023
        context, size = _arrays(counts.groupBy("context").agg(F.sum("n")))
        level.sizes[at(context)] = size
        context, symbol, k = _arrays(counts.where(F.col("n") >= least(SYMBOL_LEAST, n)))
        level.owner, level.symbol, level.n = at(context), symbol.astype(np.int64), k.astype(np.float64)
        levels.append(level)
        shared.unpersist()

    rest = words.where(~in_table).select("hash", (F.col("n") > 0).cast("double").alias("known"), F.log10(F.col("n") + 1).alias("base"), _log10_rare(F.col("n"), discount, rare_types, rare_tokens).alias("rare"))
    return Model(vocabulary, Tree.build(levels), rest, n, v, texts)


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"), held_out(F.col("doc_id")).alias("held_out"))
    model = learned(docs, depth)
    sent = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.tree, (float(model.texts > 0), float(np.log10(model.texts + 1)))))
    parts = docs.select("doc", "text").mapInArrow(_score_texts(sent), "hash bigint, n int, doc bigint, facts array<double>")
    met = parts.join(model.rest, "hash", "left")
    facts = [F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0.0)) for i in range(5)]
    sums = met.groupBy("doc").agg(
        facts[0].alias("rows"), facts[1].alias("tokens"),
        *[(facts[i] + F.coalesce(F.sum(F.expr(f"CASE WHEN facts IS NULL THEN n * {c} END")), F.lit(0.0))).alias(c) for i, c in ((2, "known"), (3, "base"), (4, "rare"))])
    per = lambda c: F.col(c) / F.col("rows")  # noqa: E731  equal rows give equal parts
    return docs.select("doc_id", "held_out", "doc").join(sums, "doc").select(
        "doc_id", "held_out", F.round(per("tokens")).cast("bigint").alias("n_tokens"), F.round(per("known")).cast("bigint").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (per("base") - per("tokens") * F.log10(F.lit(float(model.tokens + model.types + 1)))).alias("base_score"), per("rare").alias("score"))
