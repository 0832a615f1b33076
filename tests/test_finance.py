import pytest
from pyspark.sql import functions as F

from tallyscope.operators import benchmark, health, insights, metrics, periods, ratios, scenario, trends
from tallyscope.plans.analysis import BenchmarkAnalysis, MergerAnalysis, SelfAnalysis


def values_of(df, entity):
    return {r.metric_id: r.value for r in df.where(F.col("entity_id") == entity).collect()}


@pytest.fixture(scope="module")
def base(companies):
    return SelfAnalysis(companies)


def test_extracted_values(base):
    corp = values_of(base.metrics, "corp")
    assert corp["revenue"] == 460 and corp["net_profit"] == 79 and corp["assets"] == 450
    assert corp["equity"] == 255 and corp["debt"] == 88 and corp["cash"] == 72
    rival = values_of(base.metrics, "rival")
    assert rival["revenue"] == 627 and rival["net_profit"] == 139 and rival["assets"] == 560 and rival["equity"] == 345


def test_ratios(base):
    found = values_of(base.ratios, "corp")
    assert found["net_margin"] == pytest.approx(79 / 460 * 100)
    assert found["roa"] == pytest.approx(79 / 450 * 100)
    assert found["roe"] == pytest.approx(79 / 255 * 100)
    assert found["debt_to_equity"] == pytest.approx(88 / 255)


def test_revenue_growth(base):
    row = base.trends.where("entity_id = 'corp' AND metric_id = 'revenue'").first()
    assert row.growth_rate == pytest.approx(30) and row.direction == "improving" and row.period_count == 4
    assert row.avg_period_growth == pytest.approx((10 / 100 + 10 / 110 + 10 / 120) / 3 * 100)


def test_bank_values_and_ratios(bank):
    analysis = SelfAnalysis(bank)
    assert values_of(analysis.metrics, "bank")["deposits"] == 11500
    assert values_of(analysis.ratios, "bank")["casa_ratio"] == pytest.approx(5100 / 11500 * 100)
    kinds = {r.kind for r in analysis.insights.collect()}
    assert {"observation"} <= kinds
    assert any("Credit-to-deposit" in r.text for r in analysis.insights.collect())


@pytest.mark.parametrize("given, expected", [
    ({"revenue": 1000.0, "net_profit": 100.0, "assets": 5000.0, "equity": 2000.0, "debt": 1500.0},
     {"net_margin": 10, "roa": 2, "roe": 5, "debt_to_equity": 0.75, "asset_turnover": 0.2}),
    ({"revenue": 1000.0, "cogs": 600.0}, {"gross_margin": 40}),
    ({"net_profit": 50.0, "equity": 0.0}, {"roe": None}),
    ({"operating_expenses": 50.0, "non_interest_income": 100.0}, {"cost_to_income": 50}),
    ({"ebit": 10.0, "operating_profit": 99.0, "interest_expense": 5.0}, {"interest_coverage": 2}),
])
def test_ratio_formulas(spark, given, expected):
    values = spark.createDataFrame([("e", k, v) for k, v in given.items()], "entity_id string, metric_id string, value double")
    found = {r.metric_id: (r.value, r.status) for r in ratios.ratio_rows(values).collect()}
    assert set(found) == set(expected)
    for k, v in expected.items():
        assert found[k][0] == (None if v is None else pytest.approx(v))
        assert found[k][1] == ("unavailable" if v is None else "calculated")


def test_name_matching(spark):
    names = ["Total Revenue", "net_income", "revenue_growth", "cost of sales", "customer_id", "operating_income", "irrelevant_venue", "ebitda", "ROE", "sales-tax"]
    rows = {r.name: r.metric_id for r in metrics.match_names(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert rows["Total Revenue"] == "revenue" and rows["net_income"] == "net_profit" and rows["cost of sales"] == "cogs"
    assert rows["operating_income"] == "revenue" and rows["ebitda"] == "ebitda"
    assert rows["revenue_growth"] is None and rows["customer_id"] is None and rows["irrelevant_venue"] is None and rows["ROE"] is None
    assert rows["sales-tax"] == "tax"


def test_latest_ties_and_single_period(spark):
    one = spark.createDataFrame([("x", 5.0, 0.0)], "entity_id string, cash double, revenue double")
    found = values_of(metrics.extract_metrics(one, date=None), "x")
    assert found == {"cash": 5.0, "revenue": 0.0}


def test_health_weights_move_the_score(base):
    inputs = health.health_inputs(base.entities, base.ratios, base.trends)
    default = health.score_health(inputs).where("entity_id = 'corp'").first()
    only_profit = health.score_health(inputs, {"profitability": 1.0, "liquidity": 0.0, "leverage": 0.0, "efficiency": 0.0, "growth": 0.0}).where("entity_id = 'corp'").first()
    assert only_profit.overall_score == pytest.approx(default.profitability)
    assert default.growth == 100 and default.liquidity is None
    empty = health.score_health(inputs.select("entity_id", *[F.lit(None).cast("double").alias(c) for c in health.INPUTS], F.lit(None).cast("double").alias("revenue_growth"), F.lit(None).cast("string").alias("revenue_direction"))).first()
    assert empty.overall_score == 0 and empty.grade == "F"


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([("corp", "rival")], "primary_id string, secondary_id string")


def test_merger(base, pair):
    m = MergerAnalysis(base, pair)
    combined = {r.metric_id: r.value for r in m.combined.collect()}
    assert combined["revenue"] == 1087 and combined["net_profit"] == 218
    ratio = {r.metric_id: r.value for r in m.ratios.collect()}
    assert ratio["net_margin"] == pytest.approx(218 / 1087 * 100)
    score = m.attractiveness.first().attractiveness
    assert 0 <= score <= 100
    assert [r.title for r in m.risks.collect()][-1] == "Data-limitation risk"
    assert {r.title for r in m.synergies.collect()} >= {"Revenue scale", "Overlapping operating overhead"}
    assert m.warnings.count() == 0
    assert m.overlap.first().metric_coverage == 1.0


def test_self_pair_is_rejected(spark, base):
    same = spark.createDataFrame([("corp", "corp")], "primary_id string, secondary_id string")
    with pytest.raises(Exception, match="must be different"):
        MergerAnalysis(base, same).combined.collect()


def test_benchmark(base, pair):
    b = BenchmarkAnalysis(base, pair)
    rows = {r.metric_id: r for r in b.comparisons.collect()}
    assert rows["revenue"].status == "behind" and rows["revenue"].percentage_gap == pytest.approx((460 - 627) / 627 * 100)
    assert rows["debt_to_equity"].status == "behind"  # lower is better
    gaps = b.gaps.orderBy("place").collect()
    order = {"high": 0, "medium": 1, "low": 2}
    assert [order[g.priority] for g in gaps] == sorted(order[g.priority] for g in gaps)
    for g in gaps:
        assert min(g.current_value, g.benchmark_value) <= g.near_term_target <= max(g.current_value, g.benchmark_value)
    assert {g.metric_id for g in gaps} == {k for k, r in rows.items() if r.status == "behind"}
    reverse = BenchmarkAnalysis(base, pair.selectExpr("secondary_id AS primary_id", "primary_id AS secondary_id"))
    assert reverse.comparisons.where("metric_id = 'revenue'").first().status == "ahead"
    assert any(r.text.startswith("Behind the benchmark on") for r in b.insights.collect())


def test_gap_priority(spark):
    cases = [("high", -10.0, "high"), ("high", 3.0, "medium"), ("medium", 15.0, "high"), ("medium", 5.0, "medium"), ("low", 25.0, "medium"), ("low", 24.0, "low"), ("high", None, "low")]
    df = spark.createDataFrame(cases, "importance string, gap double, expected string")
    assert df.where(benchmark.gap_priority(F.col("importance"), F.col("gap")) != F.col("expected")).count() == 0


def test_periods(base):
    rows = base.metric_rows.where("entity_id = 'corp'")
    got = {r.metric_id: (r.value, r.note) for r in periods.in_year(rows, 2024).collect()}
    assert got["revenue"] == (460, None) and got["equity"] == (255, None)
    missing = periods.in_year(rows, 2019).where("metric_id = 'revenue'").first()
    assert missing.value is None and missing.note == "No data for FY2019. Available years: [2024]."
    assert periods.in_quarter(rows, 1).where("metric_id = 'revenue'").first().value == 210  # 1 January and 31 March
    assert periods.previous_year(rows).count() == 0
    assert periods.latest_year(rows).where("metric_id = 'debt'").first().value == 88


def test_trend_counts_rows_of_one_date(spark):
    rows = spark.createDataFrame([("e", "2024-01-01", 10.0, 1), ("e", "2024-01-01", 20.0, 2), ("e", "2024-02-01", 30.0, 3)], "entity_id string, d string, revenue double, n int").selectExpr(
        "entity_id", "CAST(d AS DATE) AS period_date", "revenue", "n")
    found = trends.analyze_trends(trends.metric_rows(rows, ["revenue"], order="n")).first()
    assert (found.period_count, found.distinct_periods, found.growth_rate) == (3, 2, 200.0)
    assert found.avg_period_growth == pytest.approx((1.0 + 0.5) / 2 * 100)
    series = trends.period_series(trends.metric_rows(rows, ["revenue"], order="n")).orderBy("period").collect()
    assert [r.value for r in series] == [20.0, 30.0]


def test_change_from_zero_has_no_mean(spark):
    rows = spark.createDataFrame([("e", "2024-01-01", 0.0), ("e", "2024-02-01", 5.0), ("e", "2024-03-01", 6.0)], "entity_id string, d string, revenue double").selectExpr("entity_id", "CAST(d AS DATE) AS period_date", "revenue")
    found = trends.analyze_trends(trends.metric_rows(rows, ["revenue"])).first()
    assert found.growth_rate is None and found.avg_period_growth is None and found.direction == "insufficient_data"


def test_missing_inputs_are_named(base):
    reasons = {r.ratio_id: r.reason for r in ratios.missing_ratio_reasons(base.entities, base.values).where("entity_id = 'corp'").collect()}
    assert reasons["inventory_turnover"] == "Missing input(s): Inventory."
    assert reasons["current_ratio"] == "Missing input(s): Current Assets, Current Liabilities."
    assert "net_margin" not in reasons


def test_insights_of_a_kind(base):
    strengths = [r.text for r in insights.of_kind(base.insights, "strength").where("entity_id = 'corp'").orderBy("place").collect()]
    assert strengths[0] == "Healthy net margin at 17.2%"
    assert insights.mentioning(base.insights, "net_margin").where("entity_id = 'corp'").count() == 2


def test_overlap_counts(spark):
    values = spark.createDataFrame([("a", "revenue", 1.0), ("a", "cash", 2.0), ("b", "cash", 3.0), ("b", "debt", 1.0), ("b", "tax", 1.0)], "entity_id string, metric_id string, value double")
    row = scenario.metric_overlap(spark.createDataFrame([("a", "b")], "primary_id string, secondary_id string"), values).first()
    assert (row.overlap, row.only_primary, row.only_secondary, row.union_size) == (1, 1, 2, 4)


def test_trends_of_hot_entities_are_spread(spark):
    """Many timestamps, many rows of one date and repeated rows of one entity, against a plain loop."""
    import datetime as dt
    import random

    from tallyscope.operators.ordered import RANGE, in_ranges

    r = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(seconds=r.randint(0, 900)), float(r.choice([0, 1, 2, 5, 8])), i % 50) for i in range(3000)]
    rows += [("hot", start, 4.0, 7)] * 500 + [("cold", start, 2.0, 1), ("cold", start + dt.timedelta(days=40), 3.0, 1), ("one", start, 1.0, 1)]
    rows = [(e, t, v if e != "hot" else v + 1, n) for e, t, v, n in rows]
    df = spark.createDataFrame(rows, "entity_id string, period_date timestamp, value double, seq int").selectExpr("entity_id", "'revenue' AS metric_id", "period_date", "CAST(seq AS DOUBLE) AS seq", "value")
    for ranges in (1, 7):
        got = {x.entity_id: x for x in trends.analyze_trends(df, ranges=ranges).collect()}
        assert set(got) == {"hot", "cold"}
        for e in got:
            own = sorted((t, n, v) for k, t, v, n in rows if k == e)
            steps = [b[2] / a[2] - 1 for a, b in zip(own, own[1:])]
            assert (got[e].period_count, got[e].distinct_periods) == (len(own), len({x[0] for x in own}))
            assert (got[e].first_value, got[e].last_value) == (own[0][2], own[-1][2])
            assert got[e].avg_period_growth == pytest.approx(sum(steps) / len(steps) * 100)
    sizes = [x[1] for x in in_ranges(df.distinct(), ["entity_id"], ["period_date", "seq", "value"], 7).groupBy(RANGE).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * min(sizes)


def test_merger_plans_read_few_tables(spark, base):
    found = MergerAnalysis(base, spark.createDataFrame([("corp", "rival")], "primary_id string, secondary_id string"))
    for part in (found.attractiveness, found.insights):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 15
        assert part.count() > 0
