"""Batch annotation of a table of questions: metrics, periods, entity, intent.

Everything but the memory of a conversation is a map-only column expression.
The expressions are generated from the fixed word lists, as SQL text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.registry import METRICS, Metric, excluded_phrases, question_phrases
from tallyscope.functions.rows import name_of, quoted
from tallyscope.operators.metrics import longest_word, match_length_sql, unless_excluded_sql
from tallyscope.operators.ordered import RANGE, Ranges, in_ranges

PERIOD_TYPE = "struct<kind:string,label:string,year:int,quarter:int,start_year:int,end_year:int>"


# --- metrics ------------------------------------------------------------------
def _words(metrics: Sequence[Metric]) -> list[str]:
    """The longest word of every phrase, each once."""
    return sorted({longest_word(phrase) for m in metrics for phrase, _ in question_phrases(m) + excluded_phrases(m)})


def words_found(text: str, metrics: Sequence[Metric] = METRICS) -> Column:
    """Array of booleans: which of the phrases' longest words occur in a text in lower case."""
    return F.expr("array(" + ", ".join(f"contains({name_of(text)}, {quoted(w)})" for w in _words(metrics)) + ")")


def mentioned_metrics(text: str, metrics: Sequence[Metric] = METRICS, words: str | None = None) -> Column:
    """Array of (metric_id, length) named in the text, longest match first.

    ``words`` may name a column of ``words_found``: phrases share their words, so each is looked for once.
    """
    found = {w: f"{name_of(words)}[{i}]" for i, w in enumerate(_words(metrics))} if words else None
    items = []
    for m in metrics:
        phrases = question_phrases(m)
        if not phrases:
            continue
        lengths = [match_length_sql(text, phrase, pattern, found) for phrase, pattern in phrases]
        longest = f"greatest({', '.join(lengths)})" if len(lengths) > 1 else lengths[0]
        item = f"named_struct('shortness', -{unless_excluded_sql(text, m, longest, found)}, 'ord', {m.ord}, 'metric_id', {quoted(m.metric_id)})"
        some = " OR ".join(dict.fromkeys(found[longest_word(phrase)] for phrase, _ in phrases)) if found else ""
        items.append(f"CASE WHEN {some} THEN {item} END" if some else item)
    found_ = f"array_sort(filter(array({', '.join(items)}), s -> s.shortness IS NOT NULL))"
    return F.expr(f"transform({found_}, s -> named_struct('metric_id', s.metric_id, 'length', -s.shortness))")


def mention_confidence(length: Column) -> Column:
    return F.least(F.lit(1.0), F.round(0.6 + length * 0.03, 4))


# --- periods ------------------------------------------------------------------
def _extract(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, {group})"


def mentioned_periods(text: str) -> Column:
    """Array of period structs: pairs of years, spans, quarters, years, relative phrases."""
    t = f"lower({name_of(text)})"
    none = f"CAST(array() AS ARRAY<{PERIOD_TYPE}>)"

    def period(kind: str, label: str, year="NULL", quarter="NULL", start="NULL", end="NULL") -> str:
        return (f"named_struct('kind', '{kind}', 'label', {label}, 'year', CAST({year} AS INT), 'quarter', CAST({quarter} AS INT), "
                f"'start_year', CAST({start} AS INT), 'end_year', CAST({end} AS INT))")

    def zipped(pattern: str) -> str:
        return f"arrays_zip({_extract(t, pattern, 1)} AS a, {_extract(t, pattern, 2)} AS b)"

    valid = "y -> y BETWEEN 1970 AND 2100"
    pairs = (f"array_distinct(filter(flatten(zip_with({_extract(t, vocab.YEAR_PAIR_PATTERN, 1)}, "
             f"{_extract(t, vocab.YEAR_PAIR_PATTERN, 2)}, (a, b) -> array(CAST(a AS INT), CAST(b AS INT)))), {valid}))")
    spans = (f"zip_with({_extract(t, vocab.YEAR_RANGE_PATTERN, 1)}, {_extract(t, vocab.YEAR_RANGE_PATTERN, 2)}, "
             "(a, b) -> named_struct('a', least(CAST(a AS INT), CAST(b AS INT)), 'b', greatest(CAST(a AS INT), CAST(b AS INT))))")
    # A span whose two years were both seen before is not repeated.
    taken = (f"aggregate({spans}, named_struct('seen', pair_years, 'spans', CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>)), "
             "(acc, s) -> CASE WHEN array_contains(acc.seen, s.a) AND array_contains(acc.seen, s.b) THEN acc "
             "ELSE named_struct('seen', array_union(acc.seen, array(s.a, s.b)), 'spans', array_append(acc.spans, s)) END)")
    quarter_label = "concat('Q', q, CASE WHEN y <> '' THEN concat(' ', y) ELSE '' END)"
    numeric = (f"zip_with({_extract(t, vocab.QUARTER_PATTERN, 1)}, {_extract(t, vocab.QUARTER_PATTERN, 2)}, (q, y) -> "
               + period("quarter", quarter_label, "nullif(y, '')", "q") + ")")
    ordinal_number = "CAST(CASE WHEN o IN ('first', '1st') THEN 1 WHEN o IN ('second', '2nd') THEN 2 WHEN o IN ('third', '3rd') THEN 3 ELSE 4 END AS STRING)"
    ordinals = f"transform({_extract(t, vocab.ORDINAL_QUARTER_PATTERN, 1)}, o -> {ordinal_number})"
    ordinal = (f"zip_with({ordinals}, {_extract(t, vocab.ORDINAL_QUARTER_PATTERN, 2)}, (q, y) -> "
               + period("quarter", quarter_label, "nullif(y, '')", "q") + ")")
    bare = (f"array_except(array_distinct(filter(transform({_extract(t, vocab.YEAR_PATTERN, 1)}, y -> CAST(y AS INT)), {valid})), state.seen)")
    relative = ", ".join(
        f"CASE WHEN contains({t}, {quoted(phrase)}) THEN {period(kind, quoted(phrase))} END" for phrase, kind in vocab.RELATIVE_PERIODS)
    year = period("year", "concat('FY', CAST(y AS STRING))", "y")
    span = period("range", "concat(CAST(s.a AS STRING), '-', CAST(s.b AS STRING))", start="s.a", end="s.b")
    parts = [
        f"transform(pair_years, y -> {year})", f"transform(state.spans, s -> {span})", numeric, ordinal,
        f"transform({bare}, y -> {year})", f"array_compact(array({relative}))",
    ]
    # Nested one-element transforms name the intermediate results.
    with_state = f"flatten(transform(array({taken}), state -> concat({', '.join(parts)})))"
    every = f"flatten(transform(array({pairs}), pair_years -> {with_state}))"
    worth = f"{t} RLIKE {quoted('[0-9]|year|quarter|most recent')}"
    return F.expr(f"CASE WHEN {worth} THEN CAST({every} AS ARRAY<{PERIOD_TYPE}>) ELSE {none} END")


# --- entity -------------------------------------------------------------------
def _phrase_hit(text: str, phrases: Sequence[str], end: str = "[ .?,]") -> str:
    return f"concat(' ', lower({name_of(text)}), ' ') RLIKE {quoted(' (?:' + '|'.join(p for p in phrases) + ')' + end)}"


def mentioned_entity(text: str, default: str = "primary") -> Column:
    return F.expr(
        f"CASE WHEN {_phrase_hit(text, vocab.COMBINED_PHRASES)} THEN 'combined' "
        f"WHEN {_phrase_hit(text, vocab.MARKET_PHRASES)} THEN 'market' "
        f"WHEN {_phrase_hit(text, vocab.SECONDARY_PHRASES)} THEN 'secondary' "
        f"WHEN {_phrase_hit(text, vocab.PRIMARY_PHRASES)} THEN 'primary' ELSE {quoted(default)} END")


def has_entity_hint(text: str) -> Column:
    return F.expr(_phrase_hit(text, vocab.ENTITY_HINT_WORDS, " "))


# --- scope --------------------------------------------------------------------
def term_pattern(terms: Sequence[str]) -> str:
    """Words at word boundaries; terms with a blank, - or / anywhere."""
    free = [t for t in terms if set(t) & set(" -/")]
    words = [t for t in terms if not set(t) & set(" -/")]
    parts = ([rf"\b(?:{'|'.join(words)})\b"] if words else []) + free
    return "|".join(parts)


def stripped_sql(text: str) -> str:
    """The text without white space at its ends; empty for NULL."""
    space = scalars.ANY_SPACE
    return f"regexp_replace(coalesce({name_of(text)}, ''), {quoted(f'^{space}|{space}$')}, '')"


def scope_parts(text: str, stripped: str | None = None, low: str | None = None) -> Column:
    """Like ``scope_category``, but ``followup`` or ``followup_greeting`` where earlier messages decide.

    ``stripped`` and ``low`` may name columns with the stripped text and that in lower case, which many rules read.
    """
    stripped = name_of(stripped) if stripped else stripped_sql(text)
    low = name_of(low) if low else f"lower({stripped})"
    padded = f"concat(' ', {low}, ' ')"
    bare = f"trim(BOTH ' .!?' FROM {low})"
    greeting = (f"({bare} IN ({', '.join(quoted(p) for p in vocab.PLEASANTRIES)}) OR (length({bare}) <= 12 AND ("
                + " OR ".join(f"startswith({bare}, {quoted(p)})" for p in vocab.PLEASANTRY_PREFIXES) + ")))")
    followup = " OR ".join(f"{stripped} RLIKE {quoted(p)}" for p in vocab.SCOPE_FOLLOWUP_PATTERNS)

    def mentions(terms: Sequence[str]) -> str:
        return f"{padded} RLIKE {quoted(term_pattern(terms))}"

    return F.expr(
        f"CASE WHEN length({stripped}) < {vocab.QUESTION_MIN_LENGTH} THEN 'empty' "
        f"WHEN length({stripped}) > {vocab.QUESTION_MAX_LENGTH} THEN 'too_long' "
        f"WHEN {mentions(vocab.ADVICE_TERMS)} THEN 'advice' "
        f"WHEN {mentions(vocab.OFF_TOPIC_TERMS)} THEN 'off_topic' "
        f"WHEN {mentions(vocab.FINANCE_TERMS)} OR {mentions(vocab.DATASET_HINTS)} THEN 'allowed' "
        f"WHEN {followup} THEN CASE WHEN {greeting} THEN 'followup_greeting' ELSE 'followup' END "
        f"WHEN {greeting} THEN 'allowed' ELSE 'off_topic' END")


def scope_with(parts: Column, history: Column) -> Column:
    """The category once it is known whether earlier messages exist."""
    return F.when((parts == "followup_greeting") | ((parts == "followup") & history), "allowed").when(parts == "followup", "off_topic").otherwise(parts)


def scope_category(text: str, history: str) -> Column:
    """allowed, or why not: empty, too_long, advice, off_topic.

    ``history`` is a boolean column: earlier messages exist in the conversation.
    """
    return scope_with(scope_parts(text), F.col(name_of(history)))


# --- intent and hints ---------------------------------------------------------
def own_intent(text: str, metric: str, is_ratio: str, periods: str, entity: str) -> Column:
    """Intent by the first rule that fits; NULL where a follow-up inherits the last intent.

    ``metric`` is the leading metric (own or remembered), ``is_ratio`` whether
    it is derived, ``periods`` the number of periods, ``entity`` the entity.
    """
    t = name_of(text)

    def hit(pattern: str) -> str:
        return f"{t} RLIKE {quoted(pattern)}"

    has_metric = f"{name_of(metric)} IS NOT NULL"
    market = f"({hit(vocab.MARKET_PATTERN)} OR {name_of(entity)} = 'market')"
    # --- fixed order of the rules ---
    rules = [
        (hit(vocab.GREETING_PATTERN), "greeting"), (hit(vocab.HELP_PATTERN), "help"),
        (hit(vocab.ROWS_PATTERN), "dataset_overview"), (hit(vocab.COLUMNS_PATTERN), "column_lookup"),
        (hit(vocab.DATA_QUALITY_PATTERN), "data_quality"), (hit(vocab.PERIOD_RANGE_PATTERN), "period_range"),
        (hit(vocab.OVERVIEW_PATTERN), "dataset_overview"), (hit(vocab.ROADMAP_PATTERN), "roadmap"),
        (hit(vocab.GAP_PATTERN), "gap_analysis"), (hit(vocab.SYNERGY_PATTERN), "merger_synergy"),
        (hit(vocab.MERGER_RISK_PATTERN), "merger_risk"), (hit(vocab.COMPATIBILITY_PATTERN), "merger_compatibility"),
        (f"({hit(vocab.MERGER_PATTERN)} OR {name_of(entity)} = 'combined') AND ({has_metric} OR contains({t}, 'revenue') OR contains({t}, 'profit'))",
         "merger_metric"),
        (f"{hit(vocab.MERGER_PATTERN)} OR {name_of(entity)} = 'combined'", "merger_overview"),
        (f"({hit(vocab.COMPETITOR_PATTERN)} OR {name_of(entity)} = 'secondary') AND NOT {market}", "competitor_comparison"),
        (market, "market_benchmark"),
        (hit(vocab.RECOMMEND_PATTERN), "recommendation"),
        (f"{hit(vocab.RISK_PATTERN)} AND NOT contains({t}, 'weakness')", "risk_analysis"),
        (hit(vocab.STRENGTH_PATTERN), "strength_analysis"), (hit(vocab.OPPORTUNITY_PATTERN), "opportunity_analysis"),
        (f"contains({t}, 'weakness')", "weakness_analysis"), (hit(vocab.HEALTH_PATTERN), "financial_health"),
        (f"{has_metric} AND {name_of(periods)} >= 2", "period_comparison"),
        (f"{has_metric} AND {hit(vocab.TREND_PATTERN)}", "trend_analysis"),
        (f"{has_metric} AND {hit(vocab.COMPARISON_PATTERN)}", "period_comparison"),
        (f"{has_metric} AND {name_of(is_ratio)}", "ratio_lookup"), (has_metric, "metric_lookup"),
        (hit(vocab.EXPLANATION_PATTERN), "explanation"),
    ]
    cases = " ".join(f"WHEN {c} THEN '{i}'" for c, i in rules)
    return F.expr(f"CASE {cases} WHEN NOT {hit(vocab.FOLLOWUP_PATTERN)} THEN 'unsupported' END")


def aggregation_hint(text: str, periods: str) -> Column:
    t = name_of(text)
    return F.expr(
        f"CASE WHEN {t} RLIKE {quoted(vocab.TREND_PATTERN)} THEN 'trend' WHEN contains({t}, 'growth') THEN 'growth' "
        f"WHEN {t} RLIKE {quoted(vocab.COMPARISON_PATTERN)} AND {name_of(periods)} >= 2 THEN 'delta' "
        f"WHEN contains({t}, 'average') OR contains({t}, 'avg') OR contains({t}, 'mean') THEN 'mean' "
        f"WHEN contains({t}, 'sum') OR contains({t}, 'total') THEN 'sum' END")


def comparison_hint(text: str) -> Column:
    t = name_of(text)
    return F.expr(f"CASE WHEN {t} RLIKE {quoted(vocab.GAP_PATTERN)} THEN 'gap' WHEN {t} RLIKE {quoted(vocab.COMPARISON_PATTERN)} THEN 'vs' END")


def subject_hints(text: str) -> Column:
    t = name_of(text)
    subjects = [("health", vocab.HEALTH_PATTERN), ("risk", vocab.RISK_PATTERN), ("strength", vocab.STRENGTH_PATTERN),
                ("opportunity", vocab.OPPORTUNITY_PATTERN), ("recommendation", vocab.RECOMMEND_PATTERN)]
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {t} RLIKE {quoted(p)} THEN '{s}' END" for s, p in subjects) + "))")


# --- whole tables -------------------------------------------------------------
def resolve_slots(questions: DataFrame, text: str = "text") -> DataFrame:
    """Question rows plus normalized text and the slots found in the text itself."""
    clean = questions.withColumn("normalized", scalars.collapse_spaces(F.col(text))).withColumn("_low", F.lower("normalized")).withColumn("_words", words_found("_low"))
    found = clean.withColumns({
        "metrics": mentioned_metrics("normalized", words="_words"), "periods": mentioned_periods("normalized"),
        "entity": mentioned_entity("normalized"), "entity_hinted": has_entity_hint("normalized"),
        "is_followup": F.expr(f"normalized RLIKE {quoted(vocab.FOLLOWUP_PATTERN)}"),
    })
    return found.withColumns({
        "own_metric": F.get("metrics", F.lit(0))["metric_id"],
        "own_period": F.get("periods", F.lit(0)),
    }).drop("_low", "_words")


def annotate(questions: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Every user turn with slots, carried-over slots, scope category and intent.

    ``questions`` holds the user turns; an optional boolean ``has_history``
    column says that other messages came before (otherwise earlier user turns
    decide).  Turns are unique within a conversation and may have any gaps.

    Turns lie in ranges of (conversation, turn); slots are found there and
    written once.  Memory is one scan: all windows share the ranges' order, and
    what enters a range is a row of slots and an intent.
    """
    given = "has_history" in questions.columns

    def slots(rows: DataFrame) -> DataFrame:
        bare = rows.withColumn("_stripped", F.expr(stripped_sql(text))).withColumn("_stripped_low", F.lower("_stripped"))
        found = resolve_slots(bare, text).withColumn("scope_parts", scope_parts(text, "_stripped", "_stripped_low")).drop("_stripped", "_stripped_low")
        return found.withColumn("named_entity", F.when((F.col("entity") != "primary") | F.col("entity_hinted"), F.col("entity")))

    placed = Ranges.of(in_ranges(questions, [conversation], [turn], ranges, slots, "question-slots"), [conversation], [turn])

    def judged(part: Ranges) -> DataFrame:
        rows = part.rows if given else part.with_earlier("has_history")
        return rows.withColumn("scope", scope_with(F.col("scope_parts"), F.col("has_history"))).withColumn("allowed", F.col("scope") == "allowed")

    def when_allowed(name: str) -> Column:
        return F.when(F.col("allowed"), F.col(name))

    remembered = {"last_metric": when_allowed("own_metric"), "last_period": when_allowed("own_period"), "last_entity": when_allowed("named_entity")}
    known, entering = placed.carried(judged, remembered)
    ratio_ids = [m.metric_id for m in METRICS if m.is_derived]

    def decided(part: Ranges) -> DataFrame:
        rows = known if part is placed else part.remembering(judged, remembered, entering)
        filled = rows.withColumns({
            "metric_id": F.coalesce("own_metric", "last_metric"),
            "period": F.when(F.size("periods") > 0, F.col("own_period")).when(F.col("is_followup"), F.col("last_period")),
            "period_count": F.when(F.size("periods") > 0, F.size("periods")).when(
                F.col("is_followup") & F.col("last_period").isNotNull(), 1).otherwise(0),
            "entity": F.coalesce("named_entity", "last_entity", F.lit("primary")),
        }).withColumn("is_ratio", F.coalesce(F.col("metric_id").isin(ratio_ids), F.lit(False)))
        return filled.withColumn("own_intent", F.when(
            F.col("allowed"), own_intent("normalized", "metric_id", "is_ratio", "period_count", "entity")).otherwise("unrelated"))

    final, _ = placed.carried(decided, {"last_intent": F.col("own_intent")})
    return final.withColumns({
        "intent": F.coalesce("own_intent", "last_intent", F.lit("unsupported")),
        "used_context": (F.col("own_metric").isNull() & F.col("last_metric").isNotNull())
        | ((F.size("periods") == 0) & F.col("is_followup") & F.col("last_period").isNotNull())
        | (F.col("named_entity").isNull() & F.coalesce(F.col("last_entity") != "primary", F.lit(False))),
        "aggregation": aggregation_hint("normalized", "period_count"),
        "comparison": comparison_hint("normalized"),
        "subjects": subject_hints("normalized"),
    }).drop("own_intent", "last_intent", "entity_hinted", "named_entity", "is_ratio", "scope_parts", RANGE)


# --- derived question table ---------------------------------------------------
# Wordings that together reach every rule; {y} year, {p} the year before, {q} quarter.
WORDINGS = [
    "What was our revenue in {y}?", "And in {p}?", "How did net profit change, {y} vs {p}?", "What about Q{q} {y}?",
    "Show the net margin trend over time", "Is our debt-to-equity ratio healthy?", "What is the ROE for the third quarter of {y}?",
    "Compare our operating expenses with the competitor", "Where are we behind the market average?", "Give me the roadmap to close the gap",
    "What synergies could a merger bring?", "How compatible are the two companies?", "What would combined revenue be from {p} to {y}?",
    "How many rows are in this dataset?", "Which columns do we have?", "Are there missing values or duplicates?",
    "What date range does the data cover?", "Summarize the dataset", "What are our main risks?", "What are our strengths and weaknesses?",
    "Where is the upside for sales growth?", "What should we improve next? Recommend priorities", "Why is cash declining?",
    "Should I buy this stock?", "What's the weather in {y}?", "hello there", "help", "Same for deposits", "what about last year?",
    "and the total assets in FY{y}?", "What is the average cost to income over {p}-{y}?", "Tell me a joke about cats",
    "How much did customers grow this quarter?", "What is the industry benchmark for the current ratio?", "Explain the driver behind EBITDA",
    "Loan approval odds please", "How is the   gross\tmargin  of the combined company?", "Integration risk for the deal?", "more",
    "What does the other company earn in net interest income?", "Is the interest coverage ok compared to {p}?",
]


def derived_questions(orders: DataFrame) -> DataFrame:
    """One question per order: the customer is the conversation, the order key the turn."""
    texts = "array(" + ", ".join(quoted(w) for w in WORDINGS) + ")"
    # A multiplier spreads the wordings over the turns of a conversation.
    pick = f"CAST((o_orderkey * 7 + o_custkey * 3) % {len(WORDINGS)} AS INT)"
    year = "CAST(year(o_orderdate) AS STRING)"
    return orders.selectExpr(
        "o_custkey AS conv_id", "o_orderkey AS turn",
        f"replace(replace(replace({texts}[{pick}], '{{y}}', {year}), '{{p}}', CAST(year(o_orderdate) - 1 AS STRING)), "
        "'{q}', CAST(quarter(o_orderdate) AS STRING)) AS text")
