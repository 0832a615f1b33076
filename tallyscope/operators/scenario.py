"""Two entities taken together: combined values, synergies, risks, attractiveness.

All functions work on many pairs at once.  A pair is (primary_id,
secondary_id); values are (entity_id, metric_id, value).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.functions.registry import with_metric
from tallyscope.operators.metrics import pivot_values
from tallyscope.operators.ratios import ratio_rows

PAIR = ("primary_id", "secondary_id")
DEAL_TYPES = ("merger", "acquisition", "partnership")


class SameEntityError(ValueError):
    """An entity cannot be compared with itself."""


def checked_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that fail the job when an entity is paired with itself."""
    different = F.col("primary_id") != F.col("secondary_id")
    ok = F.assert_true(different, F.lit("Primary and secondary entities must be different.")).isNull()
    return pairs.where(ok)


def side_values(pairs: DataFrame, values: DataFrame, side: str, name: str) -> DataFrame:
    """(pair, metric_id, <name>) of one side of every pair."""
    held = values.select(F.col("entity_id").alias(side), "metric_id", F.col("value").alias(name))
    return pairs.select(*PAIR).join(held, side)


def paired_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Full outer join of both sides on (pair, metric)."""
    a = side_values(pairs, values, "primary_id", "primary_value")
    b = side_values(pairs, values, "secondary_id", "secondary_value")
    return a.join(b, [*PAIR, "metric_id"], "full_outer")


def combined_scenario(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Sum of both sides for additive metrics; a missing side counts as 0."""
    both = paired_values(pairs, values.where(F.col("metric_id").isin(vocab.ADDITIVE_METRICS)))
    a, b = F.col("primary_value"), F.col("secondary_value")
    complete = a.isNotNull() & b.isNotNull()
    note = F.concat_ws(
        "; ",
        F.when(a.isNull(), "primary company value unavailable — treated as 0"),
        F.when(b.isNull(), "secondary company value unavailable — treated as 0"),
        F.when(complete, F.concat(F.lit("primary + secondary = "), scalars.grouped(a, 2), F.lit(" + "), scalars.grouped(b, 2))),
    )
    rows = both.select(
        *PAIR, "metric_id", "primary_value", "secondary_value",
        (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))).alias("value"),
        F.lit("scenario").alias("status"), F.when(complete, 0.85).otherwise(0.55).alias("confidence"), note.alias("note"))
    return with_metric(rows, "ord", "display_name", "unit", "direction")


def combined_ratios(combined: DataFrame) -> DataFrame:
    """Ratios recomputed from the combined base values, never averaged."""
    ratios = ratio_rows(combined.select(*PAIR, "metric_id", "value"), PAIR)
    return with_metric(ratios, "display_name", "unit", "direction").withColumn("status", F.lit("scenario"))


def scenario_table(pairs: DataFrame, values: DataFrame, combined: DataFrame, ratios: DataFrame) -> DataFrame:
    """Primary, secondary and combined value of each metric in the fixed order.

    ``values`` holds base and ratio values of single entities.
    """
    place = F.create_map(*[x for i, m in enumerate(vocab.SCENARIO_ORDER) for x in (F.lit(m), F.lit(i))])
    listed = F.col("metric_id").isin(vocab.SCENARIO_ORDER)
    together = combined.select(*PAIR, "metric_id", F.col("value").alias("combined_value")).unionByName(
        ratios.select(*PAIR, "metric_id", F.col("value").alias("combined_value")))
    rows = paired_values(pairs, values.where(listed)).join(together.where(listed), [*PAIR, "metric_id"], "full_outer")
    return rows.withColumn("position", place[F.col("metric_id")])


def metric_overlap(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Shared, one-sided and all metrics of every pair, and the share of shared ones."""
    both = paired_values(pairs, values)
    a, b = F.col("primary_value").isNotNull(), F.col("secondary_value").isNotNull()
    counted = both.groupBy(*PAIR).agg(
        F.count_if(a & b).alias("overlap"), F.count_if(a & ~b).alias("only_primary"),
        F.count_if(~a & b).alias("only_secondary"), F.count(F.lit(1)).alias("union_size"))
    return counted.withColumn("metric_coverage", F.col("overlap") / F.greatest(F.lit(1), F.col("union_size")))


def pair_wide(pairs: DataFrame, values: DataFrame, combined: DataFrame, ratios: DataFrame) -> DataFrame:
    """One row per pair: the inputs of the synergy, risk and insight rules.

    a_* and b_* are the sides, c_* the combined values and ratios.
    """
    ids = ["customers", "revenue", "operating_expenses", "employees", "deposits", "net_profit"]
    tagged = paired_values(pairs, values.where(F.col("metric_id").isin(ids)))
    sides = tagged.groupBy(*PAIR).agg(
        *[F.max(F.when(F.col("metric_id") == i, F.col("primary_value"))).alias(f"a_{i}") for i in ids],
        *[F.max(F.when(F.col("metric_id") == i, F.col("secondary_value"))).alias(f"b_{i}") for i in ids])
    both = combined.select(*PAIR, "metric_id", "value").unionByName(ratios.select(*PAIR, "metric_id", "value"))
    totals = ["revenue", "customers", "deposits", "liabilities", "equity", "loans", "gross_npa", "debt_to_equity", "net_margin"]
    c = pivot_values(both, totals, *PAIR)
    c = c.select(*PAIR, *[F.col(t).alias(f"c_{t}") for t in totals])
    return pairs.select(*PAIR).join(sides, list(PAIR), "left").join(c, list(PAIR), "left")


def rule_rows(wide: DataFrame, keys: tuple[str, ...], rules: list[tuple[Column, dict[str, Column | str]]]) -> DataFrame:
    """One row per rule that applies: every rule is judged in one pass over ``wide``."""
    names = list(rules[0][1])
    items = []
    for i, (applies, content) in enumerate(rules):
        fields = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in content.items()]
        items.append(F.when(applies, F.struct(F.lit(i).alias("rule"), *fields)))
    return wide.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("r")).select(
        *keys, "r.rule", *[f"r.{n}" for n in names])


def synergies(wide: DataFrame) -> DataFrame:
    """What both sides of a pair hold and could share."""
    def both(metric: str) -> Column:
        return F.col(f"a_{metric}").isNotNull() & F.col(f"b_{metric}").isNotNull()

    customers = F.col("a_customers") + F.col("b_customers")
    deposits = F.col("a_deposits") + F.col("b_deposits")
    # --- fixed values: message texts ---
    return rule_rows(wide, PAIR, [
        (both("customers"), {
            "kind": "revenue", "title": "Expanded customer base", "metric_id": "customers",
            "magnitude": F.when(customers >= 1_000_000, "material").otherwise("small"),
            "description": F.concat(F.lit("Combined customer count could reach "), scalars.grouped(customers, 0), F.lit(
                " — opens cross-sell opportunities across both books, subject to overlap."))}),
        (both("revenue"), {
            "kind": "revenue", "title": "Revenue scale", "metric_id": "revenue", "magnitude": "material",
            "description": "Combining top lines could support higher fixed-cost absorption, increased bargaining power "
                           "with suppliers, and greater investment capacity."}),
        (both("operating_expenses"), {
            "kind": "cost", "title": "Overlapping operating overhead", "metric_id": "operating_expenses",
            "magnitude": "insufficient_data",
            "description": "Both companies incur operating expenses; overlap in administrative, technology, and "
                           "back-office functions may be consolidatable, though the magnitude cannot be quantified "
                           "from the data alone."}),
        (both("employees"), {
            "kind": "cost", "title": "Workforce optimization", "metric_id": "employees", "magnitude": "insufficient_data",
            "description": "Combined headcount opens the possibility of consolidating duplicated roles, particularly in "
                           "support functions. The size of savings depends on business overlap."}),
        (both("deposits"), {
            "kind": "revenue", "title": "Deposit base scale", "metric_id": "deposits", "magnitude": "material",
            "description": F.concat(F.lit("Combined deposit base of "), scalars.grouped(deposits, 0), F.lit(
                " increases funding capacity and stability, potentially enabling further loan growth."))}),
    ])


def risks(wide: DataFrame) -> DataFrame:
    """Risks of a combination; the data-limitation risk always applies."""
    de, margin = F.col("c_debt_to_equity"), F.col("c_net_margin")
    gearing = F.try_divide(F.col("c_liabilities"), F.col("c_equity"))
    npa = F.try_divide(F.col("c_gross_npa"), F.col("c_loans")) * 100.0

    def loss(side: str, name: str) -> tuple[Column, dict]:
        profit = F.col(f"{side}_net_profit")
        return profit < 0, {
            "severity": "high", "title": f"{name.capitalize()} company is loss-making", "related": "net_profit",
            "description": F.concat(F.lit(f"The {name} company shows negative net profit ("), scalars.grouped(profit, 0),
                                    F.lit(") — combined profitability inherits this drag."))}

    # --- fixed values: message texts ---
    return rule_rows(wide, PAIR, [
        (de > 2.0, {
            "severity": "high", "title": "High combined leverage", "related": "debt_to_equity,debt",
            "description": F.concat(F.lit("Combined debt-to-equity of "), scalars.fixed(de, 2), F.lit(
                " exceeds 2.0, indicating the merged balance sheet would carry significant refinancing and "
                "interest-rate risk."))}),
        (margin < 5, {
            "severity": "medium", "title": "Thin combined profitability", "related": "net_margin",
            "description": F.concat(F.lit("Combined net margin of "), scalars.fixed(margin, 2), F.lit(
                "% leaves little cushion for integration costs, market shocks, or one-off impairments."))}),
        loss("a", "primary"),
        loss("b", "secondary"),
        ((F.col("c_equity") > 0) & (gearing > 3.0), {
            "severity": "high", "title": "Elevated combined liabilities", "related": "liabilities,equity",
            "description": F.concat(F.lit("Combined liabilities are "), scalars.fixed(gearing, 1), F.lit(
                "x combined equity — the consolidated capital structure would be aggressive."))}),
        ((F.col("c_loans") > 0) & (F.col("c_gross_npa") != 0) & (npa > 6), {
            "severity": "high", "title": "Elevated combined NPA ratio", "related": "gross_npa,loans",
            "description": F.concat(F.lit("Combined gross NPA would be "), scalars.fixed(npa, 2), F.lit(
                "% of the loan book — asset-quality integration will require close attention."))}),
        (F.lit(True), {
            "severity": "low", "title": "Data-limitation risk", "related": "",
            "description": "Combined figures assume no overlap in customers, products, or geographies. Real-world "
                           "integration adjustments, one-off costs, and regulatory considerations are not modelled."}),
    ])


def attractiveness(wide: DataFrame, health: DataFrame, found_synergies: DataFrame, found_risks: DataFrame,
                   weights: Mapping[str, float] = vocab.ATTRACTIVENESS_WEIGHTS) -> DataFrame:
    """Score 0..100 of every pair from combined health, scale, losses, synergies and risks."""
    w = weights
    material = found_synergies.groupBy(*PAIR).agg(F.count_if(F.col("magnitude") == "material").alias("material"))
    high = found_risks.groupBy(*PAIR).agg(F.count_if(F.col("severity") == "high").alias("high_risks"))
    row = (
        wide.join(health.select(*PAIR, F.col("overall_score").alias("health")), list(PAIR), "left")
        .join(material, list(PAIR), "left").join(high, list(PAIR), "left")
        .fillna(0, ["material", "high_risks"])
    )
    a, b = F.col("a_revenue"), F.col("b_revenue")
    uplift = F.when((a > 0) & (b != 0), F.least(
        F.lit(w["revenue_uplift_cap"]), F.try_divide(b, a) * 100.0 * w["revenue_uplift_multiplier"])).otherwise(0.0)
    losses = F.coalesce((F.col("a_net_profit") < 0).cast("int"), F.lit(0)) + F.coalesce(
        (F.col("b_net_profit") < 0).cast("int"), F.lit(0))
    score = (
        w["base_score"] + (F.coalesce("health", F.lit(0.0)) - 50.0) * w["health_delta_weight"] + uplift
        - losses * w["loss_making_penalty"]
        + F.least(F.lit(w["material_synergy_cap"]), F.col("material") * w["material_synergy_weight"])
        - F.least(F.lit(w["high_risk_cap"]), F.col("high_risks") * w["high_risk_penalty"])
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    label = F.when(clamped >= 70, "Strong").when(clamped >= 50, "Moderate").otherwise("Weak")
    return row.select(*PAIR, "health", "material", "high_risks", clamped.alias("attractiveness"), label.alias("label"))


def merger_warnings(pairs: DataFrame, values: DataFrame, summary: DataFrame, deal_type: str | None = None) -> DataFrame:
    """Compatibility warnings of each pair.

    ``summary`` is (entity_id, rows, period_start) with an optional unit_hint.
    """
    hint = F.col("unit_hint") if "unit_hint" in summary.columns else F.lit(None).cast("string")
    facts = summary.select("entity_id", F.col("rows").cast("double").alias("rows"),
                           F.date_format("period_start", "yyyy-MM-dd").alias("start"), hint.alias("unit"))

    def side(key: str, tag: str) -> DataFrame:
        return facts.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{tag}_{c}") for c in ("rows", "start", "unit")])

    wide = metric_overlap(pairs, values).join(side("primary_id", "a"), "primary_id", "left").join(
        side("secondary_id", "b"), "secondary_id", "left")
    scale = F.greatest("a_rows", "b_rows") / F.greatest(F.lit(1.0), F.least("a_rows", "b_rows"))
    odd_deal = deal_type is not None and deal_type != "" and deal_type.lower() not in DEAL_TYPES
    # --- fixed values: message texts ---
    return rule_rows(wide, PAIR, [
        (F.col("overlap") == 0, {"warning": "No overlapping financial metrics between the two datasets — combined view will be very limited."}),
        (F.col("overlap").between(1, 2), {"warning": F.concat(F.lit("Only "), F.col("overlap").cast("string"), F.lit(
            " overlapping metric(s) between the datasets — combined figures should be interpreted cautiously."))}),
        (F.substring("a_start", 1, 4) != F.substring("b_start", 1, 4), {"warning": F.concat(
            F.lit("Period start differs (primary begins "), F.col("a_start"), F.lit(", secondary begins "), F.col("b_start"),
            F.lit(") — combined figures may mix different reporting periods."))}),
        ((F.col("a_rows") > 0) & (F.col("b_rows") > 0) & (scale > 100), {"warning": F.concat(
            F.lit("Datasets differ by ~"), scalars.fixed(scale, 0), F.lit(
                "x in row count — they may represent very different granularities (e.g. quarterly vs transactional)."))}),
        ((F.col("a_unit") != "") & (F.col("b_unit") != "") & (F.col("a_unit") != F.col("b_unit")), {"warning": F.concat(
            F.lit("Declared unit hint differs (primary: "), F.col("a_unit"), F.lit(", secondary: "), F.col("b_unit"), F.lit(
                ") — verify that both datasets use the same currency / scale before trusting combined figures."))}),
        (F.lit(odd_deal), {"warning": f"Unrecognised deal_type '{deal_type}' — defaulting to a generic combination."}),
    ])


def pair_health_inputs(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Health inputs of the combined scenario (no trends)."""
    from tallyscope.operators.health import health_inputs

    return health_inputs(pairs, ratios.withColumn("status", F.lit("scenario")), None, PAIR)


def first_per_pair(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    place = Window.partitionBy(*PAIR).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
