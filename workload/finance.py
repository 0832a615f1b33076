"""Financial queries with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.registry import BY_ID
from tallyscope.operators import benchmark, classes, health, insights, metrics, periods, ratios, scenario, trends
from tallyscope.plans import statements as st
from tallyscope.plans.analysis import BenchmarkAnalysis, MergerAnalysis, SelfAnalysis
from tallyscope.plans.statements import STATEMENT_COLUMNS, read
from workload.catalog import query, rounded, step, text, texts, with_steps
from workload.finance_sql import DIMS, health_sql, shown

PAIR = ["primary_id", "secondary_id"]


def analysis(spark, folder) -> SelfAnalysis:
    return SelfAnalysis(st.statements(spark, folder), columns=STATEMENT_COLUMNS)


def merger(spark, folder) -> MergerAnalysis:
    return MergerAnalysis(analysis(spark, folder), st.comparison_groups(spark, folder))


def compared(spark, folder) -> BenchmarkAnalysis:
    return BenchmarkAnalysis(analysis(spark, folder), st.comparison_groups(spark, folder))


# --- statements and extraction ----------------------------------------------------
@query("nation_statements", with_steps("SELECT entity_id, strftime(period_date, '%Y-%m-%d') AS period, " + ", ".join(
    f"round({c}, 0) AS {c}" for c in STATEMENT_COLUMNS) + " FROM nations", "nations"))
def nation_statements(spark, folder):
    wide = st.nation_statements(spark, folder)
    return wide.select("entity_id", scalars.period_label(F.col("period_date")).alias("period"), *[F.round(c, 0).alias(c) for c in STATEMENT_COLUMNS])


@query("market_statements", with_steps("SELECT entity_id, strftime(period_date, '%Y-%m-%d') AS period, round(revenue, 0) AS revenue, round(debt, 0) AS debt, round(customers, 4) AS customers FROM st WHERE starts_with(entity_id, 'MARKET_')", "st"))
def market_statements(spark, folder):
    return st.statements(spark, folder).where("startswith(entity_id, 'MARKET_')").select(
        "entity_id", scalars.period_label(F.col("period_date")).alias("period"), F.round("revenue", 0).alias("revenue"), F.round("debt", 0).alias("debt"), F.round("customers", 4).alias("customers"))


@query("metric_matches", with_steps(
    "SELECT entity_id, metric_id, max(column_name) FILTER (rank = 1) AS picked, round(max(match_confidence) FILTER (rank = 1), 4) AS confidence, coalesce(string_agg(column_name, ',' ORDER BY rank) FILTER (rank > 1), '') AS others FROM cand GROUP BY 1, 2", "cand"))
def metric_matches(spark, folder):
    wide = st.statements(spark, folder)
    named = metrics.named_columns(wide, STATEMENT_COLUMNS)
    candidates = metrics.ranked_candidates(metrics.column_totals(wide, "entity_id", "period_date", STATEMENT_COLUMNS), named)
    return metrics.match_summary(candidates).select("entity_id", "metric_id", F.col("picked_column").alias("picked"), F.round("confidence", 4).alias("confidence"), F.array_join("other_candidates", ",").alias("others"))


@query("entity_shapes", with_steps("SELECT entity_id, row_count, strftime(period_start, '%Y-%m-%d') AS first, strftime(period_end, '%Y-%m-%d') AS last, shape FROM summary", "summary"))
def entity_shapes(spark, folder):
    found = metrics.entity_summary(st.statements(spark, folder))
    return found.select("entity_id", F.col("rows").alias("row_count"), scalars.period_label(F.col("period_start")).alias("first"), scalars.period_label(F.col("period_end")).alias("last"), "shape")


@query("extracted_metrics", with_steps(
    "SELECT entity_id, metric_id, display_name, unit, direction, category, source_column, round(confidence, 4) AS confidence, shape, note, 'reported' AS status, round(value, 0) AS value FROM metrics", "metrics"))
def extracted_metrics(spark, folder):
    found = metrics.in_display_order(analysis(spark, folder).metrics)
    return found.select("entity_id", "metric_id", "display_name", "unit", "direction", "category", "source_column", F.round("confidence", 4).alias("confidence"), "shape", "note", "status", F.round("value", 0).alias("value"))


@query("extracted_metrics_profiled", with_steps(
    "SELECT metric_id, count(*) AS entities FROM metrics JOIN (" + " UNION ALL ".join(
        f"SELECT '{c}' AS source_column, count(DISTINCT {c}) AS u, count(*) AS n FROM st" for c in STATEMENT_COLUMNS)
    + ") USING (source_column) WHERE NOT (u <= 10 AND u / n <= 0.05 AND n >= 20) GROUP BY 1", "metrics", "st"))
def extracted_metrics_profiled(spark, folder):
    wide = st.statements(spark, folder)
    profile = classes.column_classes(wide, STATEMENT_COLUMNS)
    return metrics.extract_metrics(wide, columns=STATEMENT_COLUMNS, profile=profile).groupBy("metric_id").agg(F.count(F.lit(1)).alias("entities"))


@query("extracted_metrics_transactional",
       "SELECT concat('SEGMENT_', c_mktsegment) AS entity_id, 'revenue' AS metric_id, 'transactional' AS shape, count(*) AS row_count, round(sum(o_totalprice), 0) AS value, 'Aggregated across all rows.' AS note FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 "
       "UNION ALL SELECT concat('SEGMENT_', c_mktsegment), 'cash', 'transactional', count(*), round(sum(c_acctbal), 0), 'Aggregated across all rows.' FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def extracted_metrics_transactional(spark, folder):
    # Orders per customer first: a hot customer joins as one row.
    rows = read(spark, folder, "orders").join(read(spark, folder, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "concat('SEGMENT_', c_mktsegment) AS entity_id", "o_orderdate AS period_date", "o_totalprice AS total_sales", "c_acctbal AS cash_balance")
    found = metrics.extract_metrics(rows, columns=["total_sales", "cash_balance"])
    return found.select("entity_id", "metric_id", "shape", F.col("rows").alias("row_count"), F.round("value", 0).alias("value"), "note")


@query("extracted_metrics_single_period",
       "SELECT p_partkey AS entity_id, 'revenue' AS metric_id, p_retailprice AS value, 'single_period' AS shape FROM part UNION ALL SELECT p_partkey, 'inventory', p_size::DOUBLE, 'single_period' FROM part")
def extracted_metrics_single_period(spark, folder):
    rows = read(spark, folder, "part").selectExpr("p_partkey AS entity_id", "p_retailprice AS `Net Sales`", "p_size AS stock")
    return metrics.extract_metrics(rows, date=None, columns=["Net Sales", "stock"]).select("entity_id", "metric_id", "value", "shape")


_kpi = "CASE metric_id " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(vocab.KPI_ORDER)) + " ELSE 999 END"


@query("kpi_ranking", with_steps(
    f"SELECT entity_id, metric_id, row_number() OVER (PARTITION BY entity_id ORDER BY {_kpi}, category, metric_id) AS kpi_rank FROM metrics WHERE value IS NOT NULL QUALIFY kpi_rank <= 6", "metrics"))
def kpi_ranking(spark, folder):
    return metrics.kpi_ranking(analysis(spark, folder).metrics).selectExpr("entity_id", "metric_id", "CAST(kpi_rank AS BIGINT) AS kpi_rank")


# --- ratios -------------------------------------------------------------------------
RATIO_GROUPS = {
    "ratios_margins": ["gross_margin", "operating_margin", "net_margin", "fcf_margin"],
    "ratios_returns": ["roa", "roe"],
    "ratios_solvency": ["debt_to_equity", "current_ratio", "quick_ratio", "interest_coverage"],
    "ratios_turnover": ["asset_turnover", "receivables_turnover", "inventory_turnover"],
    "ratios_banking": ["cost_to_income", "nim", "credit_deposit_ratio", "provision_coverage", "casa_ratio"],
}
for _name, _ids in RATIO_GROUPS.items():
    def _make(name=_name, ids=_ids):
        @query(name, with_steps(f"SELECT entity_id, metric_id, round(value, 4) AS value, status, note FROM ratios WHERE metric_id IN ({texts(ids)})", "ratios"))
        def run(spark, folder):
            found = analysis(spark, folder).ratios.where(F.col("metric_id").isin(ids))
            return found.select("entity_id", "metric_id", F.round("value", 4).alias("value"), "status", "note")
    _make()

step("needs", "SELECT * FROM (VALUES " + ", ".join(
    f"('{f[0]}', {i}, '{m}', {text(BY_ID[m].display_name)})" for f in vocab.RATIO_FORMULAS for i, m in enumerate(f[1:3])) + ") AS t(ratio_id, pos, metric_id, display_name)")


@query("missing_ratio_reasons", with_steps(
    "SELECT e.entity_id, n.ratio_id, count(*) FILTER (v.value IS NULL)::INT AS missing_inputs, CASE WHEN count(*) FILTER (v.value IS NULL) > 0 "
    "THEN concat('Missing input(s): ', string_agg(n.display_name, ', ' ORDER BY pos) FILTER (v.value IS NULL), '.') ELSE 'The dataset has the inputs but the denominator is zero — ratio undefined.' END AS reason "
    "FROM (SELECT DISTINCT entity_id FROM vals) e CROSS JOIN needs n LEFT JOIN vals v ON v.entity_id = e.entity_id AND v.metric_id = n.metric_id "
    "WHERE NOT EXISTS (SELECT 1 FROM ratios r WHERE r.entity_id = e.entity_id AND r.metric_id = n.ratio_id AND r.status = 'calculated') GROUP BY 1, 2", "vals", "ratios", "needs"))
def missing_ratio_reasons(spark, folder):
    a = analysis(spark, folder)
    return ratios.missing_ratio_reasons(a.entities, a.values)


# --- trends -------------------------------------------------------------------------
_trend = "entity_id, metric_id, round(growth_rate, 4) AS growth_rate, round(avg_period_growth, 4) AS avg_period_growth, direction, period_count"


def _trend_out(df):
    return df.select("entity_id", "metric_id", F.round("growth_rate", 4).alias("growth_rate"), F.round("avg_period_growth", 4).alias("avg_period_growth"), "direction", "period_count")


@query("trends", with_steps(f"SELECT {_trend} FROM trends", "trends"))
def trend_table(spark, folder):
    rows = trends.metric_rows(st.statements(spark, folder), STATEMENT_COLUMNS, only=vocab.TREND_METRICS)
    return _trend_out(trends.analyze_trends(rows))


@query("trends_any_metric", with_steps("SELECT entity_id, metric_id, round(growth_rate, 4) AS growth_rate, direction, period_count AS distinct_periods FROM alltrends", "alltrends"))
def trends_any_metric(spark, folder):
    rows = trends.metric_rows(st.statements(spark, folder), STATEMENT_COLUMNS)
    return trends.analyze_trends(rows).select("entity_id", "metric_id", F.round("growth_rate", 4).alias("growth_rate"), "direction", "distinct_periods")


@query("trends_of_transactions",
       """SELECT concat('SEGMENT_', c_mktsegment) AS entity_id, count(*) AS period_count, round((arg_max(v, o) - arg_min(v, o)) / abs(arg_min(v, o)) * 100, 4) AS growth_rate, round(avg(v / p - 1) * 100, 2) AS avg_period_growth
       FROM (SELECT c_mktsegment, o_totalprice AS v, row_number() OVER w AS o, lag(o_totalprice) OVER w AS p FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey)) GROUP BY 1""")
def trends_of_transactions(spark, folder):
    rows = read(spark, folder, "orders").join(read(spark, folder, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "concat('SEGMENT_', c_mktsegment) AS entity_id", "o_orderdate AS period_date", "o_totalprice AS sales", "o_orderkey")
    found = trends.analyze_trends(trends.metric_rows(rows, ["sales"], order="o_orderkey"))
    return found.select("entity_id", "period_count", F.round("growth_rate", 4).alias("growth_rate"), F.round("avg_period_growth", 2).alias("avg_period_growth"))


@query("period_series", with_steps("SELECT entity_id, metric_id, period, round(value, 0) AS value FROM series", "series"))
def period_series(spark, folder):
    return trends.period_series(trends.metric_rows(st.statements(spark, folder), STATEMENT_COLUMNS)).select("entity_id", "metric_id", "period", F.round("value", 0).alias("value"))


@query("latest_change", with_steps(
    "SELECT entity_id, metric_id, period, prev_period AS previous_period, round((value - prev) / CASE WHEN prev = 0 THEN 1 ELSE abs(prev) END * 100, 4) AS change_pct FROM steps WHERE back = 1 AND prev IS NOT NULL", "steps"))
def latest_change(spark, folder):
    series = trends.period_series(trends.metric_rows(st.statements(spark, folder), STATEMENT_COLUMNS))
    return trends.latest_change(series).select("entity_id", "metric_id", "period", "previous_period", F.round("change_pct", 4).alias("change_pct"))


@query("metrics_with_trends", with_steps(
    "SELECT m.entity_id, m.metric_id, concat('Total change across observed periods: ', printf('%+.1f', growth_rate), '%.') AS trend_note, t.period_count::INT AS points FROM metrics m LEFT JOIN trends t USING (entity_id, metric_id)", "metrics", "trends"))
def metrics_with_trends(spark, folder):
    a = analysis(spark, folder)
    both = trends.attach_trends(a.metrics, a.trends, a.series)
    # NULL concat: the check's concat skips NULLs, so an absent trend is spelled out alike.
    none = F.lit("Total change across observed periods: %.")
    return both.select("entity_id", "metric_id", F.coalesce("trend_note", none).alias("trend_note"), F.when(F.col("period_series").isNotNull(), F.size("period_series")).alias("points"))


# --- health -------------------------------------------------------------------------
@query("health_dimensions", with_steps("SELECT entity_id, dimension, round(score, 3) AS score FROM dims", "dims"))
def health_dimensions(spark, folder):
    return health.dimension_rows(analysis(spark, folder).health).select("entity_id", "dimension", F.round("score", 3).alias("score"))


@query("health_scores", with_steps("SELECT entity_id, round(overall_score, 4) AS overall_score, grade FROM health", "health"))
def health_scores(spark, folder):
    return analysis(spark, folder).health.select("entity_id", F.round("overall_score", 4).alias("overall_score"), "grade")


@query("health_weakest", with_steps("SELECT entity_id, dimension, round(score, 3) AS score FROM dims QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score, ord) = 1", "dims"))
def health_weakest(spark, folder):
    return rounded(health.weakest_dimension(analysis(spark, folder).health), 3)


@query("health_top_dimensions", with_steps("SELECT entity_id, dimension, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, ord) AS rank FROM dims QUALIFY rank <= 3", "dims"))
def health_top_dimensions(spark, folder):
    return health.top_dimensions(analysis(spark, folder).health).selectExpr("entity_id", "dimension", "CAST(rank AS BIGINT) AS rank")


_missing_dims = "concat_ws(', ', " + ", ".join(f"CASE WHEN {d} IS NULL THEN '{d}' END" for d in DIMS) + ")"


@query("health_notes", with_steps(
    f"SELECT entity_id, concat('Dimensions not scored (missing data): ', {_missing_dims}, '.') AS note FROM health WHERE {_missing_dims} <> '' "
    "UNION ALL SELECT entity_id, 'Net margin is negative — the company is loss-making on aggregate.' FROM health WHERE net_margin < 0 "
    "UNION ALL SELECT entity_id, 'Debt-to-equity above 2.0 signals elevated leverage.' FROM health WHERE debt_to_equity > 2 "
    "UNION ALL SELECT entity_id, 'Current ratio below 1.0 — short-term liabilities exceed short-term assets.' FROM health WHERE current_ratio < 1 "
    "UNION ALL SELECT entity_id, concat('Revenue is declining across observed periods (', printf('%.1f', revenue_growth), '% total change).') FROM health WHERE revenue_direction = 'declining'", "health"))
def health_notes(spark, folder):
    return health.health_notes(analysis(spark, folder).health).select("entity_id", "note")


@query("self_confidence", with_steps(
    f"SELECT entity_id, round(c, 4) AS metric_coverage, round(p, 4) AS period_coverage, round(0.6 * c + 0.4 * p, 4) AS overall, CASE WHEN 0.6 * c + 0.4 * p >= 0.75 THEN 'high' WHEN 0.6 * c + 0.4 * p >= 0.4 THEN 'medium' WHEN 0.6 * c + 0.4 * p > 0 THEN 'low' ELSE 'none' END AS level "
    f"FROM (SELECT s.entity_id, (SELECT count(*) FROM vals v WHERE v.entity_id = s.entity_id AND metric_id IN ({texts(vocab.CORE_METRICS)})) / 7 AS c, least(1.0, row_count / 12) AS p FROM summary s)", "vals", "summary"))
def self_confidence(spark, folder):
    return rounded(analysis(spark, folder).confidence)


# --- combined scenario ----------------------------------------------------------------
@query("combined_scenario", with_steps("SELECT primary_id, secondary_id, metric_id, round(primary_value, 0) AS primary_value, round(secondary_value, 0) AS secondary_value, round(value, 0) AS value, confidence FROM combined", "combined"))
def combined_scenario(spark, folder):
    return rounded(merger(spark, folder).combined.select(*PAIR, "metric_id", "primary_value", "secondary_value", "value", "confidence"), 0, "primary_value", "secondary_value", "value")


@query("combined_ratios", with_steps("SELECT primary_id, secondary_id, metric_id, round(value, 4) AS value FROM cratios", "cratios"))
def combined_ratios(spark, folder):
    return rounded(merger(spark, folder).ratios.select(*PAIR, "metric_id", "value"))


@query("combined_health", with_steps("SELECT primary_id, secondary_id, round(overall_score, 4) AS overall_score, grade FROM chealth", "chealth"))
def combined_health(spark, folder):
    return rounded(merger(spark, folder).health.select(*PAIR, "overall_score", "grade"), 4)


_place = "CASE metric_id " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(vocab.SCENARIO_ORDER)) + " END"


@query("scenario_table", with_steps(
    f"SELECT primary_id, secondary_id, metric_id, {_place} AS position, round(primary_value, 1) AS primary_value, round(secondary_value, 1) AS secondary_value, round(c.value, 1) AS combined_value FROM ("
    f"SELECT d.primary_id, d.secondary_id, m.metric_id, (SELECT any_value(value) FROM allvals v WHERE v.entity_id = d.primary_id AND v.metric_id = m.metric_id) AS primary_value, "
    f"(SELECT any_value(value) FROM allvals v WHERE v.entity_id = d.secondary_id AND v.metric_id = m.metric_id) AS secondary_value FROM duos d CROSS JOIN (SELECT unnest([{texts(vocab.SCENARIO_ORDER)}]) AS metric_id) m) "
    "LEFT JOIN (SELECT primary_id, secondary_id, metric_id, value FROM combined UNION ALL SELECT primary_id, secondary_id, metric_id, value FROM cratios) c USING (primary_id, secondary_id, metric_id) "
    "WHERE primary_value IS NOT NULL OR secondary_value IS NOT NULL OR c.metric_id IS NOT NULL", "duos", "allvals", "combined", "cratios"))
def scenario_table(spark, folder):
    return rounded(merger(spark, folder).table, 1)


@query("metric_overlap", with_steps(
    "SELECT primary_id, secondary_id, count(*) FILTER (primary_value IS NOT NULL AND secondary_value IS NOT NULL) AS overlap, count(*) FILTER (secondary_value IS NULL) AS only_primary, "
    "count(*) FILTER (primary_value IS NULL) AS only_secondary, count(*) AS union_size, round(count(*) FILTER (primary_value IS NOT NULL AND secondary_value IS NOT NULL) / count(*), 4) AS metric_coverage FROM sides GROUP BY 1, 2", "sides"))
def metric_overlap(spark, folder):
    return rounded(merger(spark, folder).overlap)


@query("synergies", with_steps("SELECT primary_id, secondary_id, rule, kind, title, magnitude FROM syn", "syn"))
def synergies(spark, folder):
    return merger(spark, folder).synergies.select(*PAIR, "rule", "kind", "title", "magnitude")


@query("merger_risks", with_steps("SELECT primary_id, secondary_id, rule, severity, title FROM rsk", "rsk"))
def merger_risks(spark, folder):
    return merger(spark, folder).risks.select(*PAIR, "rule", "severity", "title")


step("attract", """SELECT *, greatest(0, least(100, 50 + (h - 50) * 0.4 + CASE WHEN a > 0 AND b <> 0 THEN least(15, b / a * 100 * 0.12) ELSE 0 END - 8 * losses + least(10, 3 * material) - least(20, 6 * high))) AS score FROM (
  SELECT primary_id, secondary_id, overall_score AS h, a_revenue AS a, b_revenue AS b, CASE WHEN a_net_profit < 0 THEN 1 ELSE 0 END + CASE WHEN b_net_profit < 0 THEN 1 ELSE 0 END AS losses,
  (SELECT count(*) FROM syn s WHERE s.primary_id = w.primary_id AND s.secondary_id = w.secondary_id AND magnitude = 'material') AS material,
  (SELECT count(*) FROM rsk r WHERE r.primary_id = w.primary_id AND r.secondary_id = w.secondary_id AND severity = 'high') AS high FROM duo_wide w JOIN chealth USING (primary_id, secondary_id))""", "duo_wide", "chealth", "syn", "rsk")


@query("attractiveness", with_steps(
    "SELECT primary_id, secondary_id, material, high AS high_risks, round(score, 3) AS attractiveness, CASE WHEN score >= 70 THEN 'Strong' WHEN score >= 50 THEN 'Moderate' ELSE 'Weak' END AS label FROM attract", "attract"))
def attractiveness(spark, folder):
    return rounded(merger(spark, folder).attractiveness.drop("health"), 3)


@query("merger_warnings", with_steps(
    "SELECT primary_id, secondary_id, concat('Datasets differ by ~', printf('%.0f', greatest(a.n, b.n) / least(a.n, b.n)), 'x in row count — they may represent very different granularities (e.g. quarterly vs transactional).') AS warning "
    "FROM (SELECT entity_id AS primary_id, 'ALL' AS secondary_id, row_count::DOUBLE AS n FROM summary) a, (SELECT count(*)::DOUBLE AS n FROM lineitem) b WHERE greatest(a.n, b.n) / least(a.n, b.n) > 100 "
    "UNION ALL SELECT entity_id, 'ALL', concat('Only 1 overlapping metric(s) between the datasets — combined figures should be interpreted cautiously.') FROM summary WHERE entity_id IN (SELECT entity_id FROM vals WHERE metric_id = 'revenue') "
    "UNION ALL SELECT entity_id, 'ALL', concat('Period start differs (primary begins ', strftime(period_start, '%Y-%m-%d'), ', secondary begins ', strftime(s, '%Y-%m-%d'), ') — combined figures may mix different reporting periods.') FROM summary, (SELECT min(l_shipdate) AS s FROM lineitem) WHERE year(period_start) <> year(s) "
    "UNION ALL SELECT entity_id, 'ALL', 'Unrecognised deal_type ''raid'' — defaulting to a generic combination.' FROM summary", "summary", "vals"))
def merger_warnings(spark, folder):
    a = analysis(spark, folder)
    lines = read(spark, folder, "lineitem").selectExpr("'ALL' AS entity_id", "CAST(l_shipdate AS DATE) AS period_date", "l_extendedprice AS sales")
    other = metrics.extract_metrics(lines, columns=["sales"])
    values = a.values.unionByName(metrics.value_map(other))
    facts = a.summary.select("entity_id", "rows", "period_start").unionByName(metrics.entity_summary(lines).select("entity_id", "rows", "period_start"))
    pairs = a.entities.select(F.col("entity_id").alias("primary_id"), F.lit("ALL").alias("secondary_id"))
    return scenario.merger_warnings(pairs, values, facts, "raid").select(*PAIR, "warning")


# --- benchmark ------------------------------------------------------------------------
@query("comparisons", with_steps(
    "SELECT primary_id, secondary_id, metric_id, round(primary_value, 2) AS primary_value, round(secondary_value, 2) AS secondary_value, round(market_value, 2) AS market_value, round(percentage_gap, 3) AS percentage_gap, status FROM cmp", "cmp"))
def comparisons(spark, folder):
    found = compared(spark, folder).comparisons.select(*PAIR, "metric_id", "primary_value", "secondary_value", "market_value", "percentage_gap", "status")
    return rounded(rounded(found, 2, "primary_value", "secondary_value", "market_value"), 3, "percentage_gap")


_status_place = "row_number() OVER (PARTITION BY primary_id, secondary_id ORDER BY CASE status WHEN 'behind' THEN 0 WHEN 'ahead' THEN 1 WHEN 'level' THEN 2 ELSE 3 END, metric_id)"


@query("comparison_order", with_steps(f"SELECT primary_id, secondary_id, metric_id, status, {_status_place} AS place FROM cmp", "cmp"))
def comparison_order(spark, folder):
    return benchmark.numbered(compared(spark, folder).comparisons).selectExpr(*PAIR, "metric_id", "status", "CAST(place AS BIGINT) AS place")


@query("values_with_ratios", with_steps("SELECT entity_id, metric_id, round(value, 1) AS value FROM allvals", "allvals"))
def values_with_ratios(spark, folder):
    return rounded(analysis(spark, folder).all_values, 1)


_suffix = "CASE unit WHEN 'percent' THEN ' pp' WHEN 'ratio' THEN 'x' ELSE '' END"


@query("gaps", with_steps(
    f"SELECT primary_id, secondary_id, metric_id, place, importance, priority, round(percentage_gap, 3) AS percentage_gap, round(near_term_target, 1) AS near_term_target, round(secondary_value, 1) AS long_term_target, "
    f"concat(printf('%+.2f', near_term_target - primary_value), {_suffix}, ' to reach near-term target, ', printf('%+.2f', secondary_value - primary_value), {_suffix}, ' to match benchmark.') AS required_improvement FROM gapped", "gapped"))
def gaps(spark, folder):
    found = compared(spark, folder).gaps.selectExpr(*PAIR, "metric_id", "CAST(place AS BIGINT) AS place", "importance", "priority", "percentage_gap", "near_term_target", "long_term_target", "required_improvement")
    return rounded(rounded(found, 3, "percentage_gap"), 1, "near_term_target", "long_term_target")


@query("top_gaps", with_steps("SELECT primary_id, secondary_id, metric_id, priority, place FROM gapped WHERE place <= 3", "gapped"))
def top_gaps(spark, folder):
    return benchmark.top_gaps(compared(spark, folder).gaps, 3).selectExpr(*PAIR, "metric_id", "priority", "CAST(place AS BIGINT) AS place")


@query("priority_matrix", with_steps(
    "SELECT primary_id, secondary_id, metric_id, priority, round(least(1.0, abs(percentage_gap) / greatest(coalesce(max(abs(percentage_gap)) FILTER (priority <> 'low') OVER (PARTITION BY primary_id, secondary_id), 0), 1)), 4) AS x, "
    "CASE priority WHEN 'high' THEN 0.85::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS y FROM gapped WHERE percentage_gap IS NOT NULL", "gapped"))
def priority_matrix(spark, folder):
    return rounded(benchmark.priority_matrix(compared(spark, folder).gaps))


@query("priority_counts", with_steps("SELECT primary_id, secondary_id, priority, count(*) AS gaps FROM gapped GROUP BY 1, 2, 3", "gapped"))
def priority_counts(spark, folder):
    return benchmark.priority_counts(compared(spark, folder).gaps)


@query("head_to_head", with_steps("SELECT primary_id, secondary_id, count(*) FILTER (status = 'ahead') AS ahead, count(*) FILTER (status = 'behind') AS behind, count(*) FILTER (status = 'level') AS level, count(*) AS compared FROM cmp GROUP BY 1, 2", "cmp"))
def head_to_head(spark, folder):
    return benchmark.head_to_head(compared(spark, folder).comparisons)


@query("benchmark_confidence", with_steps("SELECT primary_id, secondary_id, round(count(*) / 24, 4) AS metric_coverage, round(least(1.0, count(*) / 24), 4) AS overall FROM cmp GROUP BY 1, 2", "cmp"))
def benchmark_confidence(spark, folder):
    return rounded(compared(spark, folder).confidence)


@query("benchmark_warnings", with_steps(
    "SELECT primary_id, secondary_id, 'Market dataset does not share any metrics with the primary — market column will remain blank across comparisons.' AS warning FROM duos "
    "UNION ALL SELECT d.primary_id, d.secondary_id, 'Datasets appear to cover different reporting periods — comparisons should be interpreted with that in mind.' FROM duos d JOIN summary a ON a.entity_id = d.primary_id JOIN summary b ON b.entity_id = d.secondary_id WHERE year(a.period_start) <> year(b.period_start)", "duos", "summary"))
def benchmark_warnings(spark, folder):
    b = compared(spark, folder)
    unknown = b.groups.withColumn("market_id", F.lit("NOWHERE"))
    return benchmark.benchmark_warnings(unknown, b.base.values, b.base.summary).select(*PAIR, "warning")


@query("benchmark_health", with_steps(
    "SELECT entity_id, round(overall_score, 4) AS overall_score, grade FROM (" + health_sql(
        "(SELECT * EXCLUDE (revenue_growth), CAST(NULL AS DOUBLE) AS revenue_growth FROM hwide)", "entity_id") + ") WHERE entity_id IN (SELECT primary_id FROM duos)", "hwide", "duos"))
def benchmark_health(spark, folder):
    return rounded(compared(spark, folder).health.select("entity_id", "overall_score", "grade"), 4)


# --- insights ---------------------------------------------------------------------------
step("ins_in", "SELECT h.*, r.gross_margin, r.cost_to_income, r.credit_deposit_ratio, v.deposits, v.loans, v.net_interest_income, v.gross_npa, t.growth_rate AS rg, t.direction AS rd, t.period_count AS rn, p.growth_rate AS pg, p.direction AS pd, w.dimension AS weak, w.score AS weak_score "
     "FROM health h LEFT JOIN (SELECT entity_id, max(value) FILTER (metric_id = 'gross_margin') AS gross_margin, max(value) FILTER (metric_id = 'cost_to_income') AS cost_to_income, max(value) FILTER (metric_id = 'credit_deposit_ratio') AS credit_deposit_ratio FROM ratios GROUP BY 1) r USING (entity_id) "
     "LEFT JOIN (SELECT entity_id, max(value) FILTER (metric_id = 'deposits') AS deposits, max(value) FILTER (metric_id = 'loans') AS loans, max(value) FILTER (metric_id = 'net_interest_income') AS net_interest_income, max(value) FILTER (metric_id = 'gross_npa') AS gross_npa FROM vals GROUP BY 1) v USING (entity_id) "
     "LEFT JOIN (SELECT * FROM trends WHERE metric_id = 'revenue') t USING (entity_id) LEFT JOIN (SELECT * FROM trends WHERE metric_id = 'net_profit') p USING (entity_id) "
     "LEFT JOIN (SELECT * FROM dims QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score, ord) = 1) w USING (entity_id)", "health", "ratios", "vals", "trends", "dims")
# number, kind, condition, shown text, priority
_SELF_RULES = [
    (0, "observation", "net_margin IS NOT NULL", "concat('Net profit margin is ', printf('%.2f', net_margin), '%.')", None),
    (1, "analysis", "net_margin < 0", "'Company is loss-making in aggregate over the observed data.'", "high"),
    (2, "weakness", "net_margin < 0", "'Negative net margin'", None),
    (3, "risk", "net_margin < 0", "'Sustained losses may erode equity and liquidity buffers'", None),
    (4, "recommendation", "net_margin < 0", "'Investigate cost structure and revenue mix to identify margin improvement opportunities.'", "high"),
    (5, "strength", "net_margin >= 15", "concat('Healthy net margin at ', printf('%.1f', net_margin), '%')", None),
    (6, "weakness", "net_margin >= 0 AND net_margin < 5", "concat('Thin net margin at ', printf('%.1f', net_margin), '%')", None),
    (7, "analysis", "gross_margin - net_margin > 25", "concat('Gross-to-net margin gap of ', printf('%.1f', gross_margin - net_margin), ' pp suggests significant operating and non-operating cost drag between top line and bottom line.')", "medium"),
    (8, "recommendation", "gross_margin - net_margin > 25", "'Break down operating expenses, interest, and tax to find the largest margin leaks.'", "medium"),
    (9, "observation", "debt_to_equity IS NOT NULL", "concat('Debt-to-equity ratio is ', printf('%.2f', debt_to_equity), '.')", None),
    (10, "analysis", "debt_to_equity > 2", "'Leverage is high — debt is more than 2x equity.'", "high"),
    (11, "risk", "debt_to_equity > 2", "'High leverage exposes earnings to interest-rate and refinancing risk'", None),
    (12, "recommendation", "debt_to_equity > 2", "'Consider debt reduction or equity strengthening to improve balance-sheet resilience.'", "high"),
    (13, "strength", "debt_to_equity < 0.3", "concat('Conservative capital structure (D/E = ', printf('%.2f', debt_to_equity), ')')", None),
    (14, "observation", "current_ratio IS NOT NULL", "concat('Current ratio is ', printf('%.2f', current_ratio), '.')", None),
    (15, "analysis", "current_ratio < 1", "'Short-term liabilities exceed short-term assets — potential liquidity pressure.'", "high"),
    (16, "risk", "current_ratio < 1", "'Liquidity pressure — current ratio below 1.0'", None),
    (17, "recommendation", "current_ratio < 1", "'Review working capital management and short-term financing to improve liquidity.'", "high"),
    (18, "strength", "current_ratio >= 1.5", "'Comfortable liquidity buffer'", None),
    (19, "observation", "rg IS NOT NULL", "concat('Revenue changed by ', printf('%+.1f', rg), '% across ', rn, ' periods.')", None),
    (20, "strength", "rd = 'improving'", "concat('Revenue trending up (', printf('%+.1f', rg), '%)')", None),
    (21, "opportunity", "rd = 'improving'", "'Growth momentum may support expansion / new investments'", None),
    (22, "weakness", "rd = 'declining'", "concat('Revenue trending down (', printf('%+.1f', rg), '%)')", None),
    (23, "analysis", "rd = 'declining'", "'Revenue is declining across observed periods.'", "high"),
    (24, "recommendation", "rd = 'declining'", "'Investigate demand, pricing, churn, and competitive positioning behind the revenue decline.'", "high"),
    (25, "weakness", "pd = 'declining'", "concat('Net profit trending down (', printf('%+.1f', pg), '%)')", None),
    (26, "analysis", "pd = 'declining'", "'Bottom-line profit is trending down while revenue may still be growing — cost or interest / tax dynamics warrant attention.'", "high"),
    (27, "observation", "cost_to_income IS NOT NULL AND bank", "concat('Cost-to-income ratio is ', printf('%.2f', cost_to_income), '%.')", None),
    (28, "weakness", "cost_to_income > 60 AND bank", "concat('Cost-to-income at ', printf('%.1f', cost_to_income), '% — above efficient-bank benchmark')", None),
    (29, "recommendation", "cost_to_income > 60 AND bank", "'Review operating cost base against a peer bank benchmark to identify efficiency opportunities.'", "medium"),
    (30, "observation", "credit_deposit_ratio IS NOT NULL AND bank", "concat('Credit-to-deposit ratio is ', printf('%.2f', credit_deposit_ratio), '%.')", None),
    (31, "analysis", "credit_deposit_ratio > 85 AND bank", "'Credit-to-deposit ratio is elevated — further loan growth may require additional funding.'", "medium"),
    (32, "observation", "gross_npa <> 0 AND loans <> 0 AND bank", "concat('Gross NPA represents ', printf('%.2f', gross_npa / loans * 100), '% of the loan book (calculated).')", None),
    (33, "risk", "gross_npa / nullif(loans, 0) * 100 > 6 AND bank", "concat('Elevated gross NPA ratio at ', printf('%.1f', gross_npa / loans * 100), '%')", None),
    (34, "observation", "TRUE", "concat('Overall financial health score is ', printf('%.1f', overall_score), '/100 (grade ', grade, ').')", None),
    (35, "strength", "grade IN ('A', 'B')", "concat('Strong overall financial health (grade ', grade, ')')", None),
    (36, "weakness", "grade IN ('D', 'F')", "concat('Overall financial health weak (grade ', grade, ')')", None),
    (37, "recommendation", "grade IN ('D', 'F')", "'Focus improvement effort on the lowest-scoring health dimension first.'", "medium"),
    (38, "opportunity", "weak_score < 60", "concat(upper(weak[1]), weak[2:], ' scored only ', printf('%.0f', weak_score), '/100 — largest single lever for headline health improvement.')", None),
]
step("self_ins", " UNION ALL ".join(
    f"SELECT entity_id, {n} AS rule, '{k}' AS kind, {t} AS text, {text(p) if p else 'NULL'} AS priority FROM (SELECT *, coalesce(deposits, loans, net_interest_income) IS NOT NULL AS bank FROM ins_in) WHERE {c}"
    for n, k, c, t, p in _SELF_RULES), "ins_in")


@query("self_insights", with_steps("SELECT * FROM self_ins", "self_ins"))
def self_insights(spark, folder):
    return analysis(spark, folder).insights.select("entity_id", "rule", "kind", "text", "priority")


@query("insights_by_kind", with_steps(
    "SELECT entity_id, kind, text, row_number() OVER (PARTITION BY entity_id ORDER BY rule) AS place FROM self_ins WHERE kind = 'strength' QUALIFY place <= 6 UNION ALL "
    "SELECT entity_id, kind, text, row_number() OVER (PARTITION BY entity_id ORDER BY rule) AS place FROM self_ins WHERE kind = 'recommendation' QUALIFY place <= 6", "self_ins"))
def insights_by_kind(spark, folder):
    found = analysis(spark, folder).insights
    both = insights.of_kind(found, "strength").unionByName(insights.of_kind(found, "recommendation"))
    return both.selectExpr("entity_id", "kind", "text", "CAST(place AS BIGINT) AS place")


@query("insights_mentioning", with_steps(
    "SELECT entity_id, text, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN kind = 'recommendation' THEN 1 ELSE 0 END, rule) AS place FROM self_ins WHERE rule IN (0, 1, 7) QUALIFY place <= 6", "self_ins"))
def insights_mentioning(spark, folder):
    return insights.mentioning(analysis(spark, folder).insights, "net_margin").selectExpr("entity_id", "text", "CAST(place AS BIGINT) AS place")


@query("merger_insights", with_steps(
    "SELECT primary_id, secondary_id, kind, concat('Combined revenue is ', format('{:,.0f}', c_revenue), ', up ', printf('%+.1f', (c_revenue - a_revenue) / a_revenue * 100), '% vs. primary company''s standalone revenue.') AS text FROM (SELECT *, 'observation' AS kind FROM duo_wide) WHERE a_revenue <> 0 AND c_revenue <> 0 "
    "UNION ALL SELECT primary_id, secondary_id, 'analysis', 'Combination could materially increase revenue scale.' FROM duo_wide WHERE (c_revenue - a_revenue) / a_revenue * 100 >= 25 "
    "UNION ALL SELECT primary_id, secondary_id, 'opportunity', concat('Revenue scale uplift of ~', printf('%.0f', (c_revenue - a_revenue) / a_revenue * 100), '% under the combined scenario') FROM duo_wide WHERE (c_revenue - a_revenue) / a_revenue * 100 >= 25 "
    "UNION ALL SELECT primary_id, secondary_id, 'analysis', concat('Combined debt-to-equity of ', printf('%.2f', c_debt_to_equity), ' is elevated.') FROM duo_wide WHERE c_debt_to_equity > 2 "
    "UNION ALL SELECT primary_id, secondary_id, 'risk', 'Combined balance sheet is highly leveraged' FROM duo_wide WHERE c_debt_to_equity > 2 "
    "UNION ALL SELECT primary_id, secondary_id, 'observation', concat('Combined customer base could reach ', format('{:,.0f}', c_customers), ' (subject to overlap).') FROM duo_wide WHERE a_customers <> 0 AND b_customers IS NOT NULL AND c_customers <> 0 "
    "UNION ALL SELECT primary_id, secondary_id, 'opportunity', 'Meaningful cross-sell opportunity given comparable customer bases' FROM duo_wide WHERE a_customers <> 0 AND b_customers <> 0 AND c_customers <> 0 AND b_customers >= a_customers * 0.3 "
    "UNION ALL SELECT primary_id, secondary_id, 'opportunity', concat(upper(kind[1]), kind[2:], ' synergy: ', title) FROM syn UNION ALL SELECT primary_id, secondary_id, 'risk', title FROM rsk", "duo_wide", "syn", "rsk"))
def merger_insights(spark, folder):
    return merger(spark, folder).insights.select(*PAIR, "kind", "text")


step("shown_gaps", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_id, secondary_id, priority ORDER BY place) AS t FROM gapped) WHERE (priority = 'high' AND t <= 5) OR (priority = 'medium' AND t <= 3)", "gapped")


@query("benchmark_insights", with_steps(
    f"SELECT primary_id, secondary_id, 'observation' AS kind, NULL AS priority, concat(display_name, ': you behind the benchmark by ', printf('%.2f', abs(absolute_gap)), {_suffix}, ' (', printf('%+.1f', coalesce(percentage_gap, 0)), '%).') AS text FROM shown_gaps "
    f"UNION ALL SELECT primary_id, secondary_id, 'analysis', priority, concat(display_name, ' sits below the benchmark — closing the gap could materially strengthen competitive positioning.') FROM shown_gaps "
    f"UNION ALL SELECT primary_id, secondary_id, 'recommendation', priority, concat('Investigate the drivers behind ', lower(display_name), '. Near-term target: ', printf('%.2f', near_term_target), {_suffix}, '.') FROM shown_gaps "
    f"UNION ALL SELECT primary_id, secondary_id, 'opportunity', NULL, concat(display_name, ' improvement to match benchmark (', printf('%.2f', secondary_value), {_suffix}, ')') FROM shown_gaps "
    "UNION ALL SELECT primary_id, secondary_id, 'recommendation', 'high', 'Focus on the high-priority gaps first — these have the largest impact on competitive parity.' FROM gapped WHERE priority = 'high' GROUP BY 1, 2 "
    "UNION ALL SELECT primary_id, secondary_id, 'weakness', NULL, concat('Behind the benchmark on ', count(*), ' metric(s)') FROM gapped GROUP BY 1, 2 "
    "UNION ALL SELECT primary_id, secondary_id, 'observation', NULL, 'No comparable metrics were found across the two datasets.' FROM duos WHERE (primary_id, secondary_id) NOT IN (SELECT (primary_id, secondary_id) FROM gapped)", "shown_gaps", "gapped", "duos"))
def benchmark_insights(spark, folder):
    return compared(spark, folder).insights.select(*PAIR, "kind", "priority", "text")


# --- periods ------------------------------------------------------------------------------
def _agg(keys: str, where: str = "TRUE") -> str:
    return (f"SELECT {keys}, CASE kind WHEN 'mean' THEN avg(value) WHEN 'stock' THEN arg_max(value, period_date) ELSE sum(value) END AS value FROM series JOIN registry USING (metric_id) WHERE {where} GROUP BY {keys}, kind")


_SK = ("series", "registry")
step("by_year", _agg("entity_id, metric_id, year(period_date)").replace("year(period_date),", "year(period_date) AS year,", 1), *_SK)
step("ranked_years", "SELECT *, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY year DESC) AS recency FROM by_year", "by_year")


def metric_rows(spark, folder):
    return trends.metric_rows(st.statements(spark, folder), STATEMENT_COLUMNS)


@query("period_year", with_steps(
    f"SELECT entity_id, metric_id, 'FY1998' AS period, round(value, 0) AS value, NULL AS note FROM ({_agg('entity_id, metric_id', 'year(period_date) = 1998')}) UNION ALL SELECT entity_id, metric_id, 'FY2010', NULL, concat('No data for FY2010. Available years: [', string_agg(DISTINCT CAST(year(period_date) AS VARCHAR), ', ' ORDER BY CAST(year(period_date) AS VARCHAR)), '].') FROM series GROUP BY 1, 2", *_SK))
def period_year(spark, folder):
    rows = metric_rows(spark, folder)
    return rounded(periods.in_year(rows, 1998).unionByName(periods.in_year(rows, 2010)), 0)


@query("period_quarter", with_steps(
    f"SELECT entity_id, metric_id, 'Q2 1999' AS period, round(value, 0) AS value FROM ({_agg('entity_id, metric_id', 'year(period_date) = 1999 AND quarter(period_date) = 2')}) UNION ALL "
    f"SELECT entity_id, metric_id, 'Q3', round(value, 0) FROM ({_agg('entity_id, metric_id', 'quarter(period_date) = 3')})", *_SK))
def period_quarter(spark, folder):
    rows = metric_rows(spark, folder)
    return rounded(periods.in_quarter(rows, 2, 1999).unionByName(periods.in_quarter(rows, 3)), 0)


@query("period_range", with_steps(f"SELECT entity_id, metric_id, '1996-1998' AS period, round(value, 0) AS value FROM ({_agg('entity_id, metric_id', 'year(period_date) BETWEEN 1996 AND 1998')})", *_SK))
def period_range(spark, folder):
    return rounded(periods.in_years(metric_rows(spark, folder), 1996, 1998), 0)


@query("period_latest", with_steps("SELECT entity_id, metric_id, concat('FY', year, ' (latest)') AS period, round(value, 0) AS value FROM ranked_years WHERE recency = 1", "ranked_years"))
def period_latest(spark, folder):
    return rounded(periods.latest_year(metric_rows(spark, folder)), 0)


@query("period_previous", with_steps("SELECT entity_id, metric_id, concat('FY', year, ' (previous)') AS period, round(value, 0) AS value FROM ranked_years WHERE recency = 2", "ranked_years"))
def period_previous(spark, folder):
    return rounded(periods.previous_year(metric_rows(spark, folder)), 0)


@query("period_comparison", with_steps(
    f"SELECT entity_id, metric_id, concat('FY', a.year, ' (latest)') AS period_a, concat('FY', b.year, ' (previous)') AS period_b, round(a.value - b.value, 0) AS delta, round(CASE WHEN b.value <> 0 THEN (a.value - b.value) / abs(b.value) * 100 END, 3) AS pct, "
    f"{shown('(a.value - b.value)')} AS delta_text FROM (SELECT * FROM ranked_years WHERE recency = 1) a JOIN (SELECT * FROM ranked_years WHERE recency = 2) b USING (entity_id, metric_id) JOIN registry USING (metric_id)", "ranked_years", "registry"))
def period_comparison(spark, folder):
    rows = metric_rows(spark, folder)
    found = periods.compare(periods.latest_year(rows), periods.previous_year(rows)).select("entity_id", "metric_id", "period_a", "period_b", "delta", "pct", "delta_text")
    return rounded(rounded(found, 0, "delta"), 3, "pct")


@query("available_years", with_steps("SELECT entity_id, metric_id, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM by_year GROUP BY 1, 2", "by_year"))
def available_years(spark, folder):
    return periods.available_years(metric_rows(spark, folder)).select("entity_id", "metric_id", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query("metric_lookup", with_steps(
    f"SELECT entity_id, metric_id, concat(display_name, ' (', entity_id, ')') AS label, {shown('value')} AS display_value, concat(strftime(period_start, '%Y-%m-%d'), ' to ', strftime(period_end, '%Y-%m-%d')) AS period, 'high' AS confidence FROM metrics", "metrics"))
def metric_lookup(spark, folder):
    return periods.metric_lookup(analysis(spark, folder).metrics).select("entity_id", "metric_id", "label", "display_value", "period", "confidence")


@query("metric_without_series", with_steps("SELECT entity_id, metric_id, round(value, 0) AS value, 'Aggregate value; per-period breakdown unavailable.' AS note FROM metrics", "metrics"))
def metric_without_series(spark, folder):
    return rounded(periods.aggregate_period(analysis(spark, folder).metrics, "latest").select("entity_id", "metric_id", "value", "note"), 0)


@query("ratio_lookup", with_steps(f"SELECT entity_id, r.metric_id, concat(display_name, ' (', entity_id, ')') AS label, {shown('value')} AS display_value, note AS formula, CASE status WHEN 'calculated' THEN 'high' ELSE 'medium' END AS confidence FROM ratios r JOIN registry USING (metric_id)", "ratios", "registry"))
def ratio_lookup(spark, folder):
    return periods.ratio_lookup(analysis(spark, folder).ratios).select("entity_id", "metric_id", "label", "display_value", "formula", "confidence")


@query("trend_evidence", with_steps(f"SELECT entity_id, metric_id, pos AS position, concat(display_name, ' — ', period) AS label, {shown('value')} AS display_value FROM steps JOIN registry USING (metric_id) WHERE pos <= 8", "steps", "registry"))
def trend_evidence(spark, folder):
    return periods.trend_evidence(trends.period_series(metric_rows(spark, folder))).selectExpr("entity_id", "metric_id", "CAST(position AS BIGINT) AS position", "label", "display_value")


@query("health_evidence", with_steps(
    "SELECT entity_id, 'Overall health score' AS label, round(overall_score, 3) AS value FROM health UNION ALL SELECT entity_id, concat('Dimension: ', dimension), round(score, 3) FROM dims", "health", "dims"))
def health_evidence(spark, folder):
    found = analysis(spark, folder).health
    return periods.health_evidence(found, health.dimension_rows(found)).select("entity_id", "label", F.round("value", 3).alias("value"))


@query("merger_risk_evidence", with_steps("SELECT primary_id, secondary_id, title, row_number() OVER (PARTITION BY primary_id, secondary_id ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, rule) AS place FROM rsk QUALIFY place <= 6", "rsk"))
def merger_risk_evidence(spark, folder):
    return periods.first_risks(merger(spark, folder).risks, tuple(PAIR)).selectExpr(*PAIR, "title", "CAST(place AS BIGINT) AS place")


_add = "CASE metric_id " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(vocab.ADDITIVE_METRICS)) + " END"


@query("merger_overview", with_steps(f"SELECT primary_id, secondary_id, metric_id, row_number() OVER (PARTITION BY primary_id, secondary_id ORDER BY {_add}) AS place, {shown('value')} AS display_value FROM combined JOIN registry USING (metric_id) QUALIFY place <= 8", "combined", "registry"))
def merger_overview(spark, folder):
    return periods.merger_overview(merger(spark, folder).combined).selectExpr(*PAIR, "metric_id", "CAST(place AS BIGINT) AS place", "display_value")


def _evidence_sql(k: int, market: bool) -> str:
    source = f"(SELECT *, row_number() OVER (PARTITION BY primary_id, secondary_id ORDER BY place) AS shown_at FROM (SELECT *, {_status_place} AS place FROM cmp) WHERE {'market_value IS NOT NULL' if market else 'TRUE'})"
    parts = [(0, "primary_value", "concat(display_name, ' (', primary_id, ')')"), (1, "secondary_value", "concat(display_name, ' (', secondary_id, ')')")]
    if market:
        parts.append((2, "market_value", "concat(display_name, ' (Market)')"))
    sql = [f"SELECT primary_id, secondary_id, metric_id, {i} AS position, {label} AS label, {shown(v)} AS display_value FROM {source} WHERE shown_at <= {k} AND {v} IS NOT NULL" for i, v, label in parts]
    sql.append(f"SELECT primary_id, secondary_id, metric_id, 3, concat(display_name, ' — gap'), concat(printf('%+.2f', percentage_gap), '% (', status, ')') FROM {source} WHERE shown_at <= {k} AND percentage_gap IS NOT NULL")
    return " UNION ALL ".join(sql)


for _name, _k, _market in (("competitor_evidence", 5, False), ("market_evidence", 6, True)):
    def _make2(name=_name, k=_k, market=_market):
        @query(name, with_steps(_evidence_sql(k, market), "cmp"))
        def run(spark, folder):
            return periods.comparison_evidence(benchmark.numbered(compared(spark, folder).comparisons), k, market).select(*PAIR, "metric_id", "position", "label", "display_value")
    _make2()


@query("gap_evidence", with_steps(
    f"SELECT primary_id, secondary_id, place, concat(display_name, ' (', priority, ' priority)') AS label, concat('You: ', {shown('primary_value')}, ', benchmark: ', {shown('secondary_value')}, CASE WHEN percentage_gap IS NOT NULL THEN concat(', gap: ', printf('%+.2f', percentage_gap), '%') ELSE '' END) AS display_value FROM gapped WHERE place <= 6", "gapped"))
def gap_evidence(spark, folder):
    return periods.gap_evidence(compared(spark, folder).gaps).selectExpr(*PAIR, "CAST(place AS BIGINT) AS place", "label", "display_value")


@query("roadmap", with_steps(
    f"SELECT primary_id, secondary_id, place, display_name AS label, concat('Current ', {shown('primary_value')}, ' → near-term ', {shown('near_term_target')}, ' → long-term ', {shown('secondary_value')}, ' (priority ', priority, ')') AS display_value FROM gapped WHERE place <= 6", "gapped"))
def roadmap(spark, folder):
    return periods.roadmap(compared(spark, folder).gaps).selectExpr(*PAIR, "CAST(place AS BIGINT) AS place", "label", "display_value")


@query("confidence_badges", with_steps(
    "SELECT primary_id, secondary_id, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.4 THEN 'medium' WHEN c > 0 THEN 'low' ELSE 'none' END AS level, CASE WHEN c >= 0.75 THEN 'High' WHEN c >= 0.5 THEN 'Medium' ELSE 'Low' END AS badge FROM (SELECT primary_id, secondary_id, least(1.0, count(*) / 24) AS c FROM cmp GROUP BY 1, 2)", "cmp"))
def confidence_badges(spark, folder):
    overall = F.col("overall")
    return compared(spark, folder).confidence.select(*PAIR, scalars.coverage_level(overall).alias("level"), scalars.coverage_badge(overall).alias("badge"))


