"""Rule-based insights: every rule of an entity or pair is judged in one pass.

Result rows are (keys, rule, kind, text, related, priority); ``kind`` is one
of observation, analysis, recommendation, strength, weakness, opportunity and
risk, and ``rule`` gives the order of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.operators.health import weakest_dimension
from tallyscope.operators.metrics import pivot_values
from tallyscope.operators.scenario import PAIR, rule_rows

KINDS = ["observation", "analysis", "recommendation", "strength", "weakness", "opportunity", "risk"]


def rule(kind: str, applies: Column, *text: Column | str, related: str = "", priority: str | None = "medium"):
    parts = [t if isinstance(t, Column) else F.lit(t) for t in text]
    keeps_priority = kind in ("analysis", "recommendation")
    return applies, {
        "kind": kind, "text": F.concat(*parts), "related": related,
        "priority": priority if keeps_priority else F.lit(None).cast("string"),
    }


def self_inputs(entities: DataFrame, values: DataFrame, ratios: DataFrame, trends: DataFrame, health: DataFrame,
                entity: str = "entity_id") -> DataFrame:
    """One row per entity holding everything the self rules read."""
    r_ids = ["net_margin", "gross_margin", "debt_to_equity", "current_ratio", "cost_to_income", "credit_deposit_ratio"]
    v_ids = ["deposits", "loans", "net_interest_income", "gross_npa"]
    r = pivot_values(ratios.where("value IS NOT NULL"), r_ids, entity)
    v = pivot_values(values, v_ids, entity)
    t = trends.where(F.col("metric_id").isin("revenue", "net_profit")).groupBy(entity).agg(*[
        F.max(F.when(F.col("metric_id") == m, F.col(c))).alias(f"{m}_{c}")
        for m in ("revenue", "net_profit") for c in ("growth_rate", "direction", "period_count")])
    weakest = weakest_dimension(health, (entity,)).select(entity, F.col("dimension").alias("weakest"), F.col("score").alias("weakest_score"))
    out = entities.select(entity)
    for part in (r, v, t, health.select(entity, "overall_score", "grade"), weakest):
        out = out.join(part, entity, "left")
    return out


def self_insights(wide: DataFrame, entity: str = "entity_id") -> DataFrame:
    net, gross, de, cr = (F.col(c) for c in ("net_margin", "gross_margin", "debt_to_equity", "current_ratio"))
    growth, periods = F.col("revenue_growth_rate"), F.col("revenue_period_count")
    trend = F.when(growth.isNotNull(), F.col("revenue_direction"))
    profit_growth = F.col("net_profit_growth_rate")
    bank = F.coalesce(*[F.col(m) for m in vocab.BANK_MARKER_METRICS]).isNotNull()
    cti = F.when(bank, F.col("cost_to_income"))
    cdr = F.when(bank, F.col("credit_deposit_ratio"))
    npa_known = bank & (F.col("gross_npa") != 0) & (F.col("loans") != 0)
    npa = F.when(npa_known, F.try_divide(F.col("gross_npa"), F.col("loans")) * 100.0)
    grade, weakest = F.col("grade"), F.col("weakest_score")
    f = scalars.fixed
    # --- fixed values: rule thresholds and message texts ---
    rules = [
        rule("observation", net.isNotNull(), "Net profit margin is ", f(net, 2), "%.", related="net_margin"),
        rule("analysis", net < 0, "Company is loss-making in aggregate over the observed data.", related="net_margin,net_profit", priority="high"),
        rule("weakness", net < 0, "Negative net margin"),
        rule("risk", net < 0, "Sustained losses may erode equity and liquidity buffers"),
        rule("recommendation", net < 0, "Investigate cost structure and revenue mix to identify margin improvement opportunities.",
             related="operating_expenses,revenue", priority="high"),
        rule("strength", net >= 15, "Healthy net margin at ", f(net, 1), "%"),
        rule("weakness", (net >= 0) & (net < 5), "Thin net margin at ", f(net, 1), "%"),
        rule("analysis", gross - net > 25, "Gross-to-net margin gap of ", f(gross - net, 1),
             " pp suggests significant operating and non-operating cost drag between top line and bottom line.",
             related="gross_margin,net_margin"),
        rule("recommendation", gross - net > 25, "Break down operating expenses, interest, and tax to find the largest margin leaks.",
             related="operating_expenses"),
        rule("observation", de.isNotNull(), "Debt-to-equity ratio is ", f(de, 2), ".", related="debt_to_equity"),
        rule("analysis", de > 2.0, "Leverage is high — debt is more than 2x equity.", related="debt_to_equity", priority="high"),
        rule("risk", de > 2.0, "High leverage exposes earnings to interest-rate and refinancing risk"),
        rule("recommendation", de > 2.0, "Consider debt reduction or equity strengthening to improve balance-sheet resilience.", priority="high"),
        rule("strength", de < 0.3, "Conservative capital structure (D/E = ", f(de, 2), ")"),
        rule("observation", cr.isNotNull(), "Current ratio is ", f(cr, 2), ".", related="current_ratio"),
        rule("analysis", cr < 1.0, "Short-term liabilities exceed short-term assets — potential liquidity pressure.",
             related="current_ratio", priority="high"),
        rule("risk", cr < 1.0, "Liquidity pressure — current ratio below 1.0"),
        rule("recommendation", cr < 1.0, "Review working capital management and short-term financing to improve liquidity.", priority="high"),
        rule("strength", cr >= 1.5, "Comfortable liquidity buffer"),
        rule("observation", growth.isNotNull(), "Revenue changed by ", scalars.signed(growth, 1), "% across ",
             periods.cast("string"), " periods.", related="revenue"),
        rule("strength", trend == "improving", "Revenue trending up (", scalars.signed(growth, 1), "%)"),
        rule("opportunity", trend == "improving", "Growth momentum may support expansion / new investments"),
        rule("weakness", trend == "declining", "Revenue trending down (", scalars.signed(growth, 1), "%)"),
        rule("analysis", trend == "declining", "Revenue is declining across observed periods.", related="revenue", priority="high"),
        rule("recommendation", trend == "declining",
             "Investigate demand, pricing, churn, and competitive positioning behind the revenue decline.",
             related="revenue", priority="high"),
        rule("weakness", F.col("net_profit_direction") == "declining", "Net profit trending down (", scalars.signed(profit_growth, 1), "%)"),
        rule("analysis", F.col("net_profit_direction") == "declining",
             "Bottom-line profit is trending down while revenue may still be growing — cost or interest / tax dynamics "
             "warrant attention.", related="net_profit", priority="high"),
        rule("observation", cti.isNotNull(), "Cost-to-income ratio is ", f(cti, 2), "%.", related="cost_to_income"),
        rule("weakness", cti > 60, "Cost-to-income at ", f(cti, 1), "% — above efficient-bank benchmark"),
        rule("recommendation", cti > 60,
             "Review operating cost base against a peer bank benchmark to identify efficiency opportunities.",
             related="operating_expenses"),
        rule("observation", cdr.isNotNull(), "Credit-to-deposit ratio is ", f(cdr, 2), "%.", related="credit_deposit_ratio"),
        rule("analysis", cdr > 85, "Credit-to-deposit ratio is elevated — further loan growth may require additional funding.",
             related="credit_deposit_ratio"),
        rule("observation", npa.isNotNull(), "Gross NPA represents ", f(npa, 2), "% of the loan book (calculated).",
             related="gross_npa,loans"),
        rule("risk", npa > 6, "Elevated gross NPA ratio at ", f(npa, 1), "%"),
        rule("observation", grade.isNotNull(), "Overall financial health score is ", f(F.col("overall_score"), 1),
             "/100 (grade ", grade, ")."),
        rule("strength", grade.isin("A", "B"), "Strong overall financial health (grade ", grade, ")"),
        rule("weakness", grade.isin("D", "F"), "Overall financial health weak (grade ", grade, ")"),
        rule("recommendation", grade.isin("D", "F"), "Focus improvement effort on the lowest-scoring health dimension first."),
        rule("opportunity", weakest < 60, F.initcap("weakest"), " scored only ", f(weakest, 0),
             "/100 — largest single lever for headline health improvement."),
    ]
    return rule_rows(wide, (entity,), rules)


def merger_insights(wide: DataFrame, synergies: DataFrame, risks: DataFrame) -> DataFrame:
    """Insights of each pair; synergies and risks are echoed after the rules."""
    a, c = F.col("a_revenue"), F.col("c_revenue")
    uplift = F.when((a != 0) & (c != 0), F.try_divide(c - a, a) * 100.0)
    de = F.col("c_debt_to_equity")
    ca, cb, cc = F.col("a_customers"), F.col("b_customers"), F.col("c_customers")
    reach = cb.isNotNull() & (ca != 0) & (cc != 0)
    # --- fixed values: rule thresholds and message texts ---
    rules = rule_rows(wide, PAIR, [
        rule("observation", uplift.isNotNull(), "Combined revenue is ", scalars.grouped(c, 0), ", up ", scalars.signed(uplift, 1),
             "% vs. primary company's standalone revenue.", related="revenue"),
        rule("analysis", uplift >= 25, "Combination could materially increase revenue scale.", related="revenue"),
        rule("opportunity", uplift >= 25, "Revenue scale uplift of ~", scalars.fixed(uplift, 0), "% under the combined scenario"),
        rule("analysis", de > 2.0, "Combined debt-to-equity of ", scalars.fixed(de, 2), " is elevated.", related="debt_to_equity", priority="high"),
        rule("risk", de > 2.0, "Combined balance sheet is highly leveraged"),
        rule("observation", reach, "Combined customer base could reach ", scalars.grouped(cc, 0), " (subject to overlap).", related="customers"),
        rule("opportunity", reach & (cb != 0) & (cb >= ca * 0.3), "Meaningful cross-sell opportunity given comparable customer bases"),
    ])
    nothing = F.lit(None).cast("string")
    echo_s = synergies.select(*PAIR, (F.col("rule") + 100).alias("rule"), F.lit("opportunity").alias("kind"),
                              F.concat(F.initcap("kind"), F.lit(" synergy: "), F.col("title")).alias("text"),
                              F.lit("").alias("related"), nothing.alias("priority"))
    echo_r = risks.select(*PAIR, (F.col("rule") + 200).alias("rule"), F.lit("risk").alias("kind"),
                          F.col("title").alias("text"), F.lit("").alias("related"), nothing.alias("priority"))
    none_found = wide.join(synergies.select(*PAIR), list(PAIR), "left_anti").select(
        *PAIR, F.lit(300).alias("rule"), F.lit("observation").alias("kind"),
        F.lit("No quantifiable synergies could be identified from the available data.").alias("text"),
        F.lit("").alias("related"), nothing.alias("priority"))
    return rules.unionByName(echo_s).unionByName(echo_r).unionByName(none_found)


def benchmark_insights(groups: DataFrame, gaps: DataFrame, high: int = 5, medium: int = 3) -> DataFrame:
    """Insights of each group from its first high and medium gaps.

    Gaps are behind rows only, so nothing is ever reported as ahead; a group
    without gaps gets the sentence about missing comparable metrics.
    """
    tier = Window.partitionBy(*PAIR, "priority").orderBy("place")
    shown = gaps.withColumn("in_tier", F.row_number().over(tier)).where(
        ((F.col("priority") == "high") & (F.col("in_tier") <= high)) | ((F.col("priority") == "medium") & (F.col("in_tier") <= medium)))
    suffix, name = scalars.unit_suffix(F.col("unit")), F.col("display_name")
    f = scalars.fixed
    yes = F.lit(True)
    # --- fixed values: message texts ---
    per_gap = rule_rows(shown, (*PAIR, "metric_id", "priority", "place"), [
        rule("observation", yes, name, ": you behind the benchmark by ", f(F.abs("absolute_gap"), 2), suffix, " (",
             scalars.signed(F.coalesce("percentage_gap", F.lit(0.0)), 1), "%)."),
        rule("analysis", yes, name, " sits below the benchmark — closing the gap could materially strengthen competitive positioning."),
        rule("recommendation", yes, "Investigate the drivers behind ", F.lower(name), ". Near-term target: ",
             f(F.col("near_term_target"), 2), suffix, "."),
        rule("opportunity", yes, name, " improvement to match benchmark (", f(F.col("benchmark_value"), 2), suffix, ")"),
    ])
    # ``priority`` of the gap replaces the rule's own default.
    own = per_gap.toDF(*PAIR, "metric_id", "gap_priority", "place", "rule", "kind", "text", "related", "rule_priority").select(
        *PAIR, (F.col("place") * 10 + F.col("rule")).alias("rule"), "kind", "text",
        F.when(F.col("kind") == "opportunity", "").otherwise(F.col("metric_id")).alias("related"),
        F.when(F.col("kind").isin("analysis", "recommendation"), F.col("gap_priority")).alias("priority"))
    totals = groups.select(*PAIR).join(gaps.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("behind"), F.count_if(F.col("priority") == "high").alias("high")), list(PAIR), "left").fillna(0)
    whole = rule_rows(totals, PAIR, [
        rule("observation", F.col("behind") == 0, "No comparable metrics were found across the two datasets."),
        rule("recommendation", F.col("high") > 0,
             "Focus on the high-priority gaps first — these have the largest impact on competitive parity.", priority="high"),
        rule("weakness", F.col("behind") > 0, "Behind the benchmark on ", F.col("behind").cast("string"), " metric(s)"),
    ]).withColumn("rule", F.col("rule") + 1000)
    return own.unionByName(whole)


def of_kind(insights: DataFrame, kind: str, keys: Sequence[str] = ("entity_id",), k: int = 6) -> DataFrame:
    """The first k rows of one kind per entity or pair."""
    place = Window.partitionBy(*keys).orderBy("rule")
    return insights.where(F.col("kind") == kind).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def mentioning(insights: DataFrame, metric_id: str, keys: Sequence[str] = ("entity_id",), k: int = 6) -> DataFrame:
    """Insights and recommendations related to a metric, the first k."""
    place = Window.partitionBy(*keys).orderBy((F.col("kind") == "recommendation").cast("int"), "rule")
    hit = F.array_contains(F.split("related", ","), metric_id)
    kinds = F.col("kind").isin("observation", "analysis", "recommendation")
    return insights.where(kinds & hit).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


__all__ = ["self_inputs", "self_insights", "merger_insights", "benchmark_insights", "of_kind", "mentioning"]
