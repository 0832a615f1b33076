"""Quality rules: a decision list learned from labelled statistics.

Statistics of a text are column expressions.  A bounded sample of labelled
rows is brought to the driver as plain numbers, and sequential covering learns
an ordered list of threshold conjunctions for bad texts: each rule is grown by
information gain on two thirds of the rows, pruned on the other third, and
ends the list if its precision there is too low.  The list becomes ordered
``CASE WHEN`` branches, so scoring a corpus is one native projection.

Null and empty texts have zero statistics.  Without labels no rule is learned.
Rows are judged one by one, so repeated rows get equal results; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import WORD, packed, unpacked, words_of

#: Bound of the labelled rows that a list is fitted on, taken by hash of the id.
FIT_ROWS = 20_000
MAX_RULES, MAX_TERMS, CUTS = 12, 4, 24
#: A rule must be right on this share of the pruning rows it covers.
PRECISION = 0.95
FEATURES = ("n_words", "word_length", "symbol_share", "line_repeats", "window_repeats", "capital_share", "bang_share", "digit_share")
Term = tuple[str, str, float]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of the rules."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = packed(docs, text).withColumns({"_text": t, "_words": words_of(F.col(text))})
    two = one.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)),
        "_windows": F.expr("transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))"),
        "_capitals": F.regexp_count("_text", F.lit(r"\p{Lu}")),
        "_bangs": F.regexp_count("_text", F.lit("!")),
        "_digits": F.regexp_count("_text", F.lit("[0-9]")),
    })
    # Positions are sorted by window only where a window occurs twice at all.
    three = two.withColumns({
        "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) AS bigint)"),
        "_sorted": F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) END"),
    })
    four = three.withColumn("_places", F.expr("filter(transform(_sorted, (x, k) -> CASE WHEN get(_sorted, k - 1).h <=> x.h OR get(_sorted, k + 1).h <=> x.h THEN x.i END), i -> i IS NOT NULL)"))
    five = four.withColumn("n_repeat_words", F.expr("cast(CASE WHEN _places IS NULL THEN 0 ELSE size(array_distinct(flatten(transform(_places, i -> array(i, i + 1, i + 2))))) END AS bigint)"))
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    facts = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
        "word_length": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / chars,
        "line_repeats": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)), "window_repeats": F.col("n_repeat_words") / n,
        "capital_share": F.col("_capitals") / chars, "bang_share": F.col("_bangs") / chars, "digit_share": F.col("_digits") / chars,
    }
    # One generated row per text: a filter on the facts would otherwise be pushed below and repeat every expression.
    return five.select(*unpacked([c for c in docs.columns if c not in facts], text), F.inline(F.array(F.struct(*[e.alias(c) for c, e in facts.items()]))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _mask(x: np.ndarray, terms: list[Term]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, sign, cut in terms:
        v = x[:, FEATURES.index(name)]
        out &= v >= cut if sign == ">=" else v <= cut
    return out


def _grow(x: np.ndarray, bad: np.ndarray, pure: bool) -> list[Term]:
    """Add the best threshold until no good row is covered: by information gain, or by purity alone."""
    terms: list[Term] = []
    inside = np.ones(len(x), dtype=bool)
    while len(terms) < MAX_TERMS and (inside & ~bad).any() and (inside & bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, choice = 1e-9, None
        for j, name in enumerate(FEATURES):
            v = x[:, j]
            for cut in np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, CUTS))):
                for sign, hit in ((">=", inside & (v >= cut)), ("<=", inside & (v <= cut))):
                    p1 = (hit & bad).sum()
                    if p1:
                        gain = (p1 + 1) / (hit.sum() + 2) - p / (p + n) if pure else p1 * (np.log2(p1 / hit.sum()) - np.log2(p / (p + n)))
                        if gain > best:
                            best, choice = gain, (name, sign, float(cut))
        if choice is None:
            break
        terms.append(choice)
        inside &= _mask(x, [choice])
    return terms


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray) -> list[list[Term]]:
    """Ordered rules for bad rows; ``fold`` marks the rows kept for pruning."""
    rules: list[list[Term]] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MAX_RULES and (left & bad & ~fold).sum() >= 3:
        px, pb = x[left & fold], bad[left & fold]
        best, choice = (-1.0, 0), None
        for pure in (False, True):
            grown = _grow(x[left & ~fold], bad[left & ~fold], pure)
            for k in range(1, len(grown) + 1):
                hit = _mask(px, grown[:k])
                p, n = int((hit & pb).sum()), int((hit & ~pb).sum())
                worth = ((p - n) / max(1, p + n), p)
                if p and worth > best and p >= PRECISION * (p + n):
                    best, choice = worth, grown[:k]
        if choice is None:
            break
        rules.append(choice)
        left &= ~_mask(x, choice)
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[list[Term]]:
    """Rules from at most ``rows`` labelled documents (``labels(doc_id, quality)``, 0 is bad).

    An id with several labels counts as bad if any says so.
    """
    wanted = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # bounded by ``rows``
    found = with_statistics(known).select("_quality", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("fold"), *[F.col(c).cast("double") for c in FEATURES], "doc_id").dropDuplicates(["doc_id"]).drop("doc_id").collect()
    if not found:
        return []
    x = np.array([r[2:] for r in found], dtype=np.float64)
    return learn(x, np.array([r[0] == 0 for r in found]), np.array([r[1] for r in found]))


def verdict(rules: list[list[Term]]) -> Column:
    """True for good: ordered branches over the feature columns."""
    out = None
    for terms in rules:
        test = F.lit(True)
        for name, sign, cut in terms:
            test = test & ((F.col(name) >= cut) if sign == ">=" else (F.col(name) <= cut))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``."""
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
