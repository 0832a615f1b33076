"""Question and name-matching queries with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.registry import METRICS, question_phrases
from tallyscope.operators import metrics, questions
from tallyscope.plans.statements import read
from workload import finance_sql
from workload.catalog import query, rows, step, text, texts, with_steps

# --- name matching over whole columns of text ---------------------------------------
step("part_names", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat(p_type, ' sales') WHEN 1 THEN concat('total_assets_', p_size) WHEN 2 THEN concat('Net-Income ', p_brand) "
     "WHEN 3 THEN concat('operating_income_', p_type) WHEN 4 THEN concat('stock of ', p_name) WHEN 5 THEN concat('revenue growth ', p_size) WHEN 6 THEN concat('net interest income ', p_brand) ELSE p_name END AS name FROM part")
_NAME = ("CASE p_partkey % 8 WHEN 0 THEN concat(p_type, ' sales') WHEN 1 THEN concat('total_assets_', p_size) WHEN 2 THEN concat('Net-Income ', p_brand) "
         "WHEN 3 THEN concat('operating_income_', p_type) WHEN 4 THEN concat('stock of ', p_name) WHEN 5 THEN concat('revenue growth ', p_size) WHEN 6 THEN concat('net interest income ', p_brand) ELSE p_name END")
step("part_matches", finance_sql.name_match("part_names", "name"), "part_names", "patterns")


@query("name_matching", with_steps("SELECT p_partkey, p.name, metric_id, specificity::INT AS specificity, match_confidence FROM part_names p LEFT JOIN part_matches m ON p.name = m.name", "part_names", "part_matches"))
def name_matching(spark, folder):
    names = read(spark, folder, "part").selectExpr("p_partkey", f"{_NAME} AS name")
    return metrics.match_names(names, "name").select("p_partkey", "name", "metric_id", "specificity", "match_confidence")


# --- questions derived from the orders ------------------------------------------------
step("questions", "SELECT o_custkey AS conv_id, o_orderkey AS turn, replace(replace(replace(wording, '{y}', CAST(year(o_orderdate) AS VARCHAR)), '{p}', CAST(year(o_orderdate) - 1 AS VARCHAR)), '{q}', CAST(quarter(o_orderdate) AS VARCHAR)) AS text "
     f"FROM orders JOIN (SELECT unnest(range({len(questions.WORDINGS)})) AS i, unnest([{texts(questions.WORDINGS)}]) AS wording) ON i = (o_orderkey * 7 + o_custkey * 3) % {len(questions.WORDINGS)}")
_space = text(scalars.ANY_SPACE)
step("asked", f"SELECT *, trim(regexp_replace(text, {_space}, ' ', 'g')) AS t FROM questions", "questions")
# Each wording repeats: the SQL works on distinct texts and joins back.
step("chat", f"SELECT conv_id, turn, trim(regexp_replace(text, {_space}, ' ', 'g')) AS t, turn > min(turn) FILTER (role <> 'system') OVER (PARTITION BY conv_id) AS h, role FROM conversations")
step("uniq", "SELECT t FROM asked UNION SELECT t FROM chat WHERE role = 'user'", "asked", "chat")
step("spoken", "SELECT * FROM (VALUES " + rows((m.metric_id, m.ord, p) for m in METRICS for _, p in question_phrases(m)) + ") AS v(metric_id, mord, regex)")
step("mentions", "SELECT t, s.metric_id, s.mord, max(length(regexp_extract(concat(' ', t, ' '), s.regex))) AS len FROM uniq JOIN spoken s ON regexp_matches(concat(' ', t, ' '), s.regex) "
     "WHERE NOT EXISTS (SELECT 1 FROM patterns x WHERE x.role = 'excluded' AND x.metric_id = s.metric_id AND regexp_matches(concat(' ', t, ' '), x.regex)) GROUP BY ALL", "uniq", "spoken", "patterns")


def asked(spark, folder):
    return questions.derived_questions(read(spark, folder, "orders"))


def clean(spark, folder):
    return asked(spark, folder).withColumn("t", scalars.collapse_spaces(F.col("text")))


@query("question_metrics", with_steps(
    "SELECT conv_id, turn, metric_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len DESC, mord) AS rank, CAST(least(1.0, round(0.6 + len * 0.03, 4)) AS DOUBLE) AS confidence FROM asked JOIN mentions USING (t)", "asked", "mentions"))
def question_metrics(spark, folder):
    spoken = clean(spark, folder).withColumn("low", F.lower("t")).withColumn("words", questions.words_found("low"))
    found = spoken.withColumn("m", questions.mentioned_metrics("t", words="words"))
    # The outer form: the inner one would evaluate the array again to drop empty rows.
    return found.select("conv_id", "turn", F.posexplode_outer("m").alias("pos", "m")).where("m IS NOT NULL").select(
        "conv_id", "turn", "m.metric_id", (F.col("pos") + 1).cast("bigint").alias("rank"), questions.mention_confidence(F.col("m.length")).alias("confidence"))


def _all(pattern: str, group: int, t: str = "lower(t)") -> str:
    return f"regexp_extract_all({t}, {text(pattern)}, {group})"


step("pair_years", f"SELECT DISTINCT t, CAST(y AS INT) AS y FROM (SELECT t, unnest(list_concat({_all(vocab.YEAR_PAIR_PATTERN, 1)}, {_all(vocab.YEAR_PAIR_PATTERN, 2)})) AS y FROM uniq) WHERE CAST(y AS INT) BETWEEN 1970 AND 2100", "uniq")
step("spans", f"SELECT t, least(CAST(a AS INT), CAST(b AS INT)) AS a, greatest(CAST(a AS INT), CAST(b AS INT)) AS b FROM (SELECT t, unnest({_all(vocab.YEAR_RANGE_PATTERN, 1)}) AS a, unnest({_all(vocab.YEAR_RANGE_PATTERN, 2)}) AS b FROM uniq)", "uniq")
_quarter = "concat('Q', q, CASE WHEN y <> '' THEN concat(' ', y) ELSE '' END)"
step("period_list", f"""SELECT t, 'year' AS kind, concat('FY', y) AS label FROM pair_years
  UNION ALL SELECT t, 'range', concat(a, '-', b) FROM spans s WHERE NOT (EXISTS (SELECT 1 FROM pair_years p WHERE p.t = s.t AND p.y = s.a) AND EXISTS (SELECT 1 FROM pair_years p WHERE p.t = s.t AND p.y = s.b))
  UNION ALL SELECT t, 'quarter', {_quarter} FROM (SELECT t, unnest({_all(vocab.QUARTER_PATTERN, 1)}) AS q, unnest({_all(vocab.QUARTER_PATTERN, 2)}) AS y FROM uniq)
  UNION ALL SELECT t, 'quarter', {_quarter} FROM (SELECT t, CASE WHEN o IN ('first', '1st') THEN 1 WHEN o IN ('second', '2nd') THEN 2 WHEN o IN ('third', '3rd') THEN 3 ELSE 4 END AS q, y
    FROM (SELECT t, unnest({_all(vocab.ORDINAL_QUARTER_PATTERN, 1)}) AS o, unnest({_all(vocab.ORDINAL_QUARTER_PATTERN, 2)}) AS y FROM uniq))
  UNION ALL SELECT t, 'year', concat('FY', y) FROM (SELECT DISTINCT t, CAST(y AS INT) AS y FROM (SELECT t, unnest({_all(vocab.YEAR_PATTERN, 1)}) AS y FROM uniq)) b WHERE y BETWEEN 1970 AND 2100
    AND NOT EXISTS (SELECT 1 FROM pair_years p WHERE p.t = b.t AND p.y = b.y) AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.t = b.t AND b.y IN (s.a, s.b))
  UNION ALL SELECT t, k.kind, k.phrase FROM uniq JOIN (SELECT * FROM (VALUES {rows(vocab.RELATIVE_PERIODS)}) AS v(phrase, kind)) k ON contains(lower(t), k.phrase)""", "uniq", "pair_years", "spans")


@query("question_periods", with_steps("SELECT conv_id, turn, kind, label FROM asked JOIN period_list USING (t)", "asked", "period_list"))
def question_periods(spark, folder):
    found = clean(spark, folder).withColumn("p", questions.mentioned_periods("t"))
    return found.select("conv_id", "turn", F.explode_outer("p").alias("p")).where("p IS NOT NULL").select("conv_id", "turn", "p.kind", "p.label")


def _phrases(values, end: str = "[ .?,]", t: str = "t") -> str:
    return f"regexp_matches(concat(' ', lower({t}), ' '), {text(' (?:' + '|'.join(values) + ')' + end)})"


_entity = (f"CASE WHEN {_phrases(vocab.COMBINED_PHRASES)} THEN 'combined' WHEN {_phrases(vocab.MARKET_PHRASES)} THEN 'market' WHEN {_phrases(vocab.SECONDARY_PHRASES)} THEN 'secondary' ELSE 'primary' END")


@query("question_entities", with_steps(f"SELECT {_entity} AS entity, {_phrases(vocab.ENTITY_HINT_WORDS, ' ')} AS hinted, count(*) AS n FROM asked GROUP BY 1, 2", "asked"))
def question_entities(spark, folder):
    found = clean(spark, folder).select(questions.mentioned_entity("t").alias("entity"), questions.has_entity_hint("t").alias("hinted"))
    return found.groupBy("entity", "hinted").agg(F.count(F.lit(1)).alias("n"))


def _hit(pattern: str, t: str = "t") -> str:
    return f"regexp_matches({t}, {text(pattern)})"


def _terms(values, t: str) -> str:
    """Single words at word boundaries, other terms anywhere, one test per term."""
    tests = [f"contains(concat(' ', {t}, ' '), {text(v)})" if set(v) & set(" -/") else f"regexp_matches({t}, {text(chr(92) + 'b' + v + chr(92) + 'b')})" for v in values]
    return "(" + " OR ".join(tests) + ")"


def scope_sql(t: str, history: str) -> str:
    low = f"lower({t})"
    bare = f"trim({low}, ' .!?')"
    greet = f"({bare} IN ({texts(vocab.PLEASANTRIES)}) OR (length({bare}) <= 12 AND (" + " OR ".join(f"starts_with({bare}, {text(p)})" for p in vocab.PLEASANTRY_PREFIXES) + ")))"
    follow = " OR ".join(_hit(p, t) for p in vocab.SCOPE_FOLLOWUP_PATTERNS)
    return (f"CASE WHEN length({t}) < 2 THEN 'empty' WHEN length({t}) > 2000 THEN 'too_long' WHEN {_terms(vocab.ADVICE_TERMS, low)} THEN 'advice' WHEN {_terms(vocab.OFF_TOPIC_TERMS, low)} THEN 'off_topic' "
            f"WHEN {_terms(vocab.FINANCE_TERMS, low)} OR {_terms(vocab.DATASET_HINTS, low)} THEN 'allowed' WHEN {history} AND ({follow}) THEN 'allowed' WHEN {greet} THEN 'allowed' ELSE 'off_topic' END")


step("scoped", f"SELECT t, h, {scope_sql('t', 'h')} AS scope FROM uniq CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS h)", "uniq")
step("turns", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS h FROM asked", "asked")


@query("question_scope", with_steps("SELECT conv_id, turn, scope FROM turns JOIN scoped USING (t, h)", "turns", "scoped"))
def question_scope(spark, folder):
    from tallyscope.operators.ordered import carry_forward

    marked = carry_forward(asked(spark, folder), ["conv_id"], "turn", {"seen": F.lit(1)}).withColumn("h", F.col("seen").isNotNull())
    return marked.select("conv_id", "turn", questions.scope_category("text", "h").alias("scope"))


_v = vocab
_has = "metric_id IS NOT NULL"
_mk = f"({_hit(_v.MARKET_PATTERN)} OR entity = 'market')"
_derived = texts(m.metric_id for m in METRICS if m.is_derived)
_INTENT = (
    f"CASE WHEN {_hit(_v.GREETING_PATTERN)} THEN 'greeting' WHEN {_hit(_v.HELP_PATTERN)} THEN 'help' WHEN {_hit(_v.ROWS_PATTERN)} THEN 'dataset_overview' WHEN {_hit(_v.COLUMNS_PATTERN)} THEN 'column_lookup' "
    f"WHEN {_hit(_v.DATA_QUALITY_PATTERN)} THEN 'data_quality' WHEN {_hit(_v.PERIOD_RANGE_PATTERN)} THEN 'period_range' WHEN {_hit(_v.OVERVIEW_PATTERN)} THEN 'dataset_overview' WHEN {_hit(_v.ROADMAP_PATTERN)} THEN 'roadmap' "
    f"WHEN {_hit(_v.GAP_PATTERN)} THEN 'gap_analysis' WHEN {_hit(_v.SYNERGY_PATTERN)} THEN 'merger_synergy' WHEN {_hit(_v.MERGER_RISK_PATTERN)} THEN 'merger_risk' WHEN {_hit(_v.COMPATIBILITY_PATTERN)} THEN 'merger_compatibility' "
    f"WHEN {_hit(_v.MERGER_PATTERN)} OR entity = 'combined' THEN CASE WHEN {_has} OR contains(t, 'revenue') OR contains(t, 'profit') THEN 'merger_metric' ELSE 'merger_overview' END "
    f"WHEN {_hit(_v.COMPETITOR_PATTERN)} OR entity = 'secondary' THEN CASE WHEN {_mk} THEN 'market_benchmark' ELSE 'competitor_comparison' END WHEN {_mk} THEN 'market_benchmark' "
    f"WHEN {_hit(_v.RECOMMEND_PATTERN)} THEN 'recommendation' WHEN {_hit(_v.RISK_PATTERN)} AND NOT contains(t, 'weakness') THEN 'risk_analysis' WHEN {_hit(_v.STRENGTH_PATTERN)} THEN 'strength_analysis' "
    f"WHEN {_hit(_v.OPPORTUNITY_PATTERN)} THEN 'opportunity_analysis' WHEN contains(t, 'weakness') THEN 'weakness_analysis' WHEN {_hit(_v.HEALTH_PATTERN)} THEN 'financial_health' "
    f"WHEN {_has} AND periods >= 2 THEN 'period_comparison' WHEN {_has} AND {_hit(_v.TREND_PATTERN)} THEN 'trend_analysis' WHEN {_has} AND {_hit(_v.COMPARISON_PATTERN)} THEN 'period_comparison' "
    f"WHEN metric_id IN ({_derived}) THEN 'ratio_lookup' WHEN {_has} THEN 'metric_lookup' WHEN {_hit(_v.EXPLANATION_PATTERN)} THEN 'explanation' WHEN NOT follow THEN 'unsupported' END")


def _memory(p: str, turns: str) -> None:
    """Steps of the memory over a table of turns; their names start with ``p``."""
    step(f"{p}own", f"""SELECT conv_id, turn, t, scope, scope = 'allowed' AS ok, {_hit(vocab.FOLLOWUP_PATTERN)} AS follow,
  (SELECT arg_max(metric_id, len * 1000 - mord) FROM mentions m WHERE m.t = q.t) AS own_metric, (SELECT count(*) FROM period_list p WHERE p.t = q.t) AS own_periods,
  CASE WHEN {_entity} <> 'primary' OR {_phrases(vocab.ENTITY_HINT_WORDS, ' ')} THEN {_entity} END AS own_entity FROM {turns} q JOIN scoped USING (t, h)""", turns, "scoped", "mentions", "period_list")
    step(f"{p}kept", f"""SELECT *, last_value(CASE WHEN ok THEN own_metric END IGNORE NULLS) OVER w AS last_metric, last_value(CASE WHEN ok AND own_periods > 0 THEN 1 END IGNORE NULLS) OVER w AS last_period,
  last_value(CASE WHEN ok THEN own_entity END IGNORE NULLS) OVER w AS last_entity FROM {p}own WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", f"{p}own")
    step(f"{p}filled", f"""SELECT *, coalesce(own_metric, last_metric) AS metric_id, CASE WHEN own_periods > 0 THEN own_periods WHEN follow AND last_period = 1 THEN 1 ELSE 0 END AS periods, coalesce(own_entity, last_entity, 'primary') AS entity FROM {p}kept""", f"{p}kept")
    step(f"{p}decided", f"SELECT *, CASE WHEN NOT ok THEN 'unrelated' ELSE {_INTENT} END AS own_intent FROM {p}filled", f"{p}filled")
    step(f"{p}intents", f"SELECT *, coalesce(own_intent, last_value(own_intent IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unsupported') AS intent FROM {p}decided", f"{p}decided")


_memory("", "turns")
step("chat_turns", "SELECT * FROM chat WHERE role = 'user'", "chat")
_memory("chat_", "chat_turns")


@query("question_intents", with_steps("SELECT conv_id, turn, scope, intent FROM intents", "intents"))
def question_intents(spark, folder):
    return questions.annotate(asked(spark, folder)).select("conv_id", "turn", "scope", "intent")


@query("question_memory", with_steps(
    "SELECT conv_id, turn, metric_id, entity, periods::INT AS periods, (own_metric IS NULL AND last_metric IS NOT NULL) OR (own_periods = 0 AND coalesce(follow AND last_period = 1, FALSE)) "
    "OR (own_entity IS NULL AND coalesce(last_entity <> 'primary', FALSE)) AS used_context FROM filled", "filled"))
def question_memory(spark, folder):
    # Many ranges: conversations are cut by them, as a hot one would be.
    found = questions.annotate(asked(spark, folder), ranges=40)
    return found.select("conv_id", "turn", "metric_id", "entity", F.col("period_count").alias("periods"), "used_context")


@query("question_hints", with_steps(
    f"SELECT aggregation, comparison, subjects, count(*) AS n FROM (SELECT CASE WHEN {_hit(_v.TREND_PATTERN)} THEN 'trend' WHEN contains(t, 'growth') THEN 'growth' WHEN {_hit(_v.COMPARISON_PATTERN)} AND p >= 2 THEN 'delta' "
    f"WHEN contains(t, 'average') OR contains(t, 'avg') OR contains(t, 'mean') THEN 'mean' WHEN contains(t, 'sum') OR contains(t, 'total') THEN 'sum' END AS aggregation, "
    f"CASE WHEN {_hit(_v.GAP_PATTERN)} THEN 'gap' WHEN {_hit(_v.COMPARISON_PATTERN)} THEN 'vs' END AS comparison, "
    f"concat_ws(',', CASE WHEN {_hit(_v.HEALTH_PATTERN)} THEN 'health' END, CASE WHEN {_hit(_v.RISK_PATTERN)} THEN 'risk' END, CASE WHEN {_hit(_v.STRENGTH_PATTERN)} THEN 'strength' END, "
    f"CASE WHEN {_hit(_v.OPPORTUNITY_PATTERN)} THEN 'opportunity' END, CASE WHEN {_hit(_v.RECOMMEND_PATTERN)} THEN 'recommendation' END) AS subjects "
    "FROM (SELECT a.t, (SELECT count(*) FROM period_list l WHERE l.t = a.t) AS p FROM asked a)) GROUP BY 1, 2, 3", "asked", "period_list"))
def question_hints(spark, folder):
    found = clean(spark, folder).withColumn("p", F.size(questions.mentioned_periods("t")))
    shown = found.select(questions.aggregation_hint("t", "p").alias("aggregation"), questions.comparison_hint("t").alias("comparison"),
                         F.array_join(questions.subject_hints("t"), ",").alias("subjects"))
    return shown.groupBy("aggregation", "comparison", "subjects").agg(F.count(F.lit(1)).alias("n"))


# --- the given conversations ------------------------------------------------------------


@query("conversation_scope", with_steps(f"SELECT conv_id, turn, {scope_sql('t', 'h')} AS scope, {_entity} AS entity FROM chat WHERE role = 'user'", "chat"))
def conversation_scope(spark, folder):
    spoken = read(spark, folder, "conversations").where("role <> 'system'")
    # The first message of a conversation has no history: one row per conversation.
    starts = spoken.groupBy("conv_id").agg(F.min("turn").alias("start"))
    turns = spoken.where("role = 'user'").join(starts, "conv_id").withColumn("has_history", F.col("turn") > F.col("start"))
    clean_ = turns.withColumn("t", scalars.collapse_spaces(F.col("text")))
    return clean_.select("conv_id", "turn", questions.scope_category("t", "has_history").alias("scope"), questions.mentioned_entity("t").alias("entity"))


@query("conversation_annotation", with_steps("SELECT conv_id, turn, scope, intent, metric_id, entity, periods::INT AS period_count FROM chat_intents", "chat_intents"))
def conversation_annotation(spark, folder):
    spoken = read(spark, folder, "conversations").where("role <> 'system'")
    starts = spoken.groupBy("conv_id").agg(F.min("turn").alias("start"))
    turns = spoken.where("role = 'user'").join(starts, "conv_id").withColumn("has_history", F.col("turn") > F.col("start")).drop("start")
    return questions.annotate(turns).select("conv_id", "turn", "scope", "intent", "metric_id", "entity", "period_count")


@query("question_answers", with_steps(
    "SELECT conv_id, turn, i.metric_id, display_name, 'FY' || regexp_extract(label, '\\d+') AS period FROM intents i JOIN registry USING (metric_id) JOIN (SELECT t, min(label) AS label FROM period_list WHERE kind = 'year' GROUP BY 1 HAVING count(*) = 1) USING (t) WHERE intent = 'metric_lookup'", "intents", "registry", "period_list"))
def question_answers(spark, folder):
    """Metric lookups with one year: the annotated questions joined with the registry."""
    from tallyscope.functions.registry import with_metric

    found = questions.annotate(asked(spark, folder)).where("intent = 'metric_lookup' AND size(filter(periods, p -> p.kind = 'year')) = 1")
    year = F.get(F.filter("periods", lambda p: p["kind"] == "year"), F.lit(0))
    return with_metric(found.withColumn("period_label", year["label"]), "display_name").select("conv_id", "turn", "metric_id", "display_name", F.col("period_label").alias("period"))


