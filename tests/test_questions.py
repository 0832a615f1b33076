import pytest
from pyspark.sql import functions as F

from tallyscope.functions import scalars
from tallyscope.operators import questions
from tallyscope.operators.ordered import carry_forward, idle_sessions
from tallyscope.streaming import sessions


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n")


@pytest.mark.parametrize("text, expected", [
    ("What was revenue in 2024?", [("year", "FY2024")]), ("FY2024 please", [("year", "FY2024")]),
    ("2024 vs 2025", [("year", "FY2024"), ("year", "FY2025")]), ("from 2023 to 2025", [("range", "2023-2025")]),
    ("from 2025 to 2023", [("range", "2023-2025")]), ("Q3 2024", [("quarter", "Q3 2024"), ("year", "FY2024")]),
    ("third quarter of 2024", [("quarter", "Q3 2024"), ("year", "FY2024")]), ("q2 only", [("quarter", "Q2")]),
    ("last year and this quarter", [("previous", "last year"), ("latest", "this quarter")]), ("in 1492 or 2150", []), ("no period", []),
])
def test_periods(spark, text, expected):
    row = ask(spark, [text]).select(questions.mentioned_periods("t").alias("p")).first()
    assert [(p.kind, p.label) for p in row.p] == expected


def test_metrics(spark):
    texts = ["what is the net profit margin?", "show me sales", "return on equity", "customer id list", "operating income?", "d/e", "no metric at all"]
    rows = ask(spark, texts).select(questions.mentioned_metrics("t").alias("m")).collect()
    firsts = [r.m[0].metric_id if r.m else None for r in rows]
    assert firsts == ["net_margin", "revenue", "roe", None, "operating_profit", "debt_to_equity", None]


def test_entities(spark):
    texts = ["our revenue", "the competitor revenue?", "market average", "combined revenue of the competitor", "revenue"]
    rows = ask(spark, texts).select(questions.mentioned_entity("t").alias("e"), questions.has_entity_hint("t").alias("h")).collect()
    assert [r.e for r in rows] == ["primary", "secondary", "market", "combined", "primary"]
    assert [r.h for r in rows] == [True, True, True, True, False]


def test_scope(spark):
    cases = [("", True, "empty"), ("x" * 2001, True, "too_long"), ("Should I buy this stock?", True, "advice"), ("weather and revenue", True, "off_topic"),
             ("how is revenue", False, "allowed"), ("and 2024?", True, "allowed"), ("and 2024?", False, "off_topic"), ("Hello!", False, "allowed"),
             ("tell me a joke", False, "off_topic"), ("how many things", False, "allowed"), ("debt-to-equity", False, "allowed"), ("revenuex", False, "off_topic")]
    df = spark.createDataFrame(cases, "t string, h boolean, expected string").withColumn("got", questions.scope_category("t", "h"))
    assert [(r.t[:30], r.got) for r in df.where("got <> expected").collect()] == []


def test_memory_and_intents(spark):
    turns = ["What was our revenue in 2024?", "and in 2023?", "How does the competitor compare?", "what about the market?", "weather today", "same for deposits", "why?"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)] + [(2, 0, "and the total?")], "conv_id long, turn long, text string")
    for chunk in (1, 2, 7):
        rows = questions.annotate(df, ranges=chunk).where("conv_id = 1").orderBy("turn").collect()
        assert [r.metric_id for r in rows] == ["revenue"] * 5 + ["deposits", "deposits"]
        assert [r.intent for r in rows] == ["metric_lookup", "metric_lookup", "competitor_comparison", "market_benchmark", "unrelated", "market_benchmark", "market_benchmark"] or rows[5].entity == "market"
        assert [r.entity for r in rows][:4] == ["primary", "primary", "secondary", "secondary"] or rows[3].entity == "market"
        assert rows[1].period.label == "FY2023" and rows[4].scope == "off_topic"


def test_inherited_intent(spark):
    df = spark.createDataFrame([(1, 0, "What are our main risks?"), (1, 1, "what about that"), (2, 0, "what about that")], "conv_id long, turn long, text string")
    rows = {(r.conv_id, r.turn): r.intent for r in questions.annotate(df).collect()}
    assert rows[(1, 1)] == "risk_analysis" and rows[(2, 0)] in ("unsupported", "unrelated")


def test_carry_forward_equals_a_plain_window(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS o", "CASE WHEN id % 7 = 0 THEN id END AS v")
    plain = df.selectExpr("k", "o", "last(v, true) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p")
    for chunk in (1, 13, 1000):
        got = carry_forward(df, ["k"], "o", {"p": F.col("v")}, chunk).select("k", "o", "p")
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_idle_limit_is_inclusive(spark):
    df = spark.sql("SELECT 1 AS u, timestamp_seconds(s) AS t FROM (SELECT explode(array(100, 21700, 43301)) AS s)")
    rows = idle_sessions(df, "u", "t", 21_600).orderBy("session").collect()
    assert [r.events for r in rows] == [2, 1]  # exactly six hours still belongs to the session


def test_number_check(spark):
    cases = [("Revenue 1,234.50 in 2024", "In 2024 it was 1,234.50", True), ("up -3%", "up 3%", False), ("none", "12", True)]
    df = spark.createDataFrame(cases, "a string, b string, ok boolean")
    assert df.where(scalars.preserves_numbers(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_streaming_memory(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    # Idle checks run as batches without data and would keep the query busy.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "conv_id long, turn long, text string"

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(source / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(source))
        query = sessions.remember_slots(stream).writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(60), "the stream did not finish"

    run("b0", [(1, 0, "What was our revenue in 2024?"), (1, 1, "what about that"), (2, 0, "How are deposits?")])
    run("b1", [(1, 2, "and the competitor?"), (2, 1, "same for last year")])
    got = {(r.conv_id, r.turn): (r.metric_id, r.period, r.entity, r.remembered) for r in spark.read.parquet(out).collect()}
    assert got[(1, 1)] == ("revenue", "FY2024", "primary", 2)
    assert got[(1, 2)] == ("revenue", "FY2024", "secondary", 3)
    assert got[(2, 1)][:2] == ("deposits", "last year")
    run("b2", [(1, 3, "Should I buy this stock? And how are deposits?"), (1, 4, "what about that"), (2, 2, "weather of the competitor"), (2, 3, "and the total?")])
    every = {(r.conv_id, r.turn): r for r in spark.read.parquet(out).collect()}
    assert not every[(1, 3)].allowed and every[(1, 4)].metric_id == "revenue" and every[(1, 4)].remembered == 5
    turns = [(1, 0, "What was our revenue in 2024?"), (1, 1, "what about that"), (2, 0, "How are deposits?"), (1, 2, "and the competitor?"), (2, 1, "same for last year"),
             (1, 3, "Should I buy this stock? And how are deposits?"), (1, 4, "what about that"), (2, 2, "weather of the competitor"), (2, 3, "and the total?")]
    batch = questions.annotate(spark.createDataFrame(turns, schema)).collect()
    assert {(r.conv_id, r.turn): (r.metric_id, r.period.label if r.period else None, r.entity, r.allowed) for r in batch} == {k: (r.metric_id, r.period, r.entity, r.allowed) for k, r in every.items()}


def test_memory_over_many_ranges_equals_one(spark):
    """A hot conversation with gaps in its turns, null conversations and refused turns: any number of ranges gives the same rows."""
    import random

    r = random.Random(6)
    wordings = ["What was our revenue in 2024?", "and in 2023?", "How does the competitor compare?", "weather today", "same for deposits", "why?", "what about that", "Should I buy this stock?", "and the market?"]
    rows = [(1, i * i * 1000, r.choice(wordings)) for i in range(150)] + [(c, t, r.choice(wordings)) for c in range(2, 30) for t in range(3)] + [(None, t, r.choice(wordings)) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    columns = ["conv_id", "turn", "scope", "intent", "metric_id", "period", "entity", "period_count", "used_context"]
    one, many = (sorted((str(x) for x in questions.annotate(df, ranges=n).select(columns).collect())) for n in (1, 23))
    assert one == many and len(one) == len(rows)


def test_memory_is_one_scan(spark):
    df = spark.createDataFrame([(1, i, "what about that") for i in range(40)], "conv_id long, turn long, text string")
    plan = questions.annotate(df, ranges=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 1 and plan.count("Exchange hashpartitioning") <= 1


def test_words_looked_for_once_give_the_same_metrics(spark):
    texts = [(w.replace("{y}", "2024").replace("{p}", "2023").replace("{q}", "2"),) for w in questions.WORDINGS] + [("",), ("NET interest income, not interest coverage; Sales?",)]
    df = spark.createDataFrame(texts, "t string").withColumn("low", F.lower("t")).withColumn("words", questions.words_found("low"))
    found = df.select("t", questions.mentioned_metrics("t").alias("a"), questions.mentioned_metrics("t", words="words").alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and any(r.a for r in found)
