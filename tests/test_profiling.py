import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import scalars
from tallyscope.operators import checks, classes, correlation, distributions, quality, summaries
from tallyscope.operators.quantiles import exact_quantiles
from tallyscope.plans.profile import TableProfile


def one_column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_statistics_of_one_to_ten(spark):
    row = summaries.numeric_stats(one_column(spark, [float(i) for i in range(1, 11)])).first()
    assert (row["median"], row.q1, row.q3, row["count"], row["sum"]) == (5.5, 3.25, 7.75, 10, 55.0)
    assert row["std"] == pytest.approx(np.std(range(1, 11), ddof=1), abs=1e-6)


@pytest.mark.parametrize("name", ["uniform", "one_hot_value", "two_values", "heavy_tail", "single"])
def test_quantiles_match_numpy(spark, name):
    r = random.Random(5)
    values = {
        "uniform": [r.random() for _ in range(3001)],
        "one_hot_value": [7.0] * 1000 + [r.random() * 10 for _ in range(2000)],
        "two_values": [0.0] * 999 + [1.0] * 1001,
        "heavy_tail": [r.paretovariate(0.7) for _ in range(2500)],
        "single": [3.0],
    }[name]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    long = spark.createDataFrame([("c", v) for v in values], "column_name string, value double").repartition(4)
    # Few numbers a key make more rounds; the result must not change.
    for small in (1, 50, 100_000):
        got = {row.probability: row.quantile for row in exact_quantiles(long, probs, small=small).collect()}
        for p in probs:
            assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_histogram_counts_match_numpy(spark):
    r = random.Random(3)
    values = [r.choice([0.1 * k for k in range(50)]) + r.choice([0, 1e-9]) for _ in range(2000)]
    rows = distributions.histogram(one_column(spark, values)).orderBy("bin").collect()
    counts, _ = np.histogram(values, bins=20)
    assert [row["count"] for row in rows] == counts.tolist()
    assert sum(row["count"] for row in rows) == 2000


def test_degenerate_histogram_and_shape(spark):
    rows = distributions.histogram(one_column(spark, [4.0] * 5)).collect()
    assert [(r.bin, r.lower, r.upper, r["count"]) for r in rows] == [(0, 4.0, 4.0, 5)]
    assert distributions.shape(one_column(spark, [1.0] * 20 + [100.0] * 3)).first()["shape"] == "right_skewed"


def test_outliers(spark):
    found = distributions.outliers(one_column(spark, [10.0, 11.0, 12.0, 13.0, 14.0, 500.0])).first()
    assert found["count"] == 1 and found.reason is None
    assert distributions.outliers(one_column(spark, [1.0, 2.0, 900.0])).first().reason == "insufficient_data"
    assert distributions.outliers(one_column(spark, [5.0] * 10 + [9.0])).first().reason == "zero_iqr"


def test_duplicates(spark):
    rows = [(1, 10), (2, 20), (1, 10), (3, 30), (2, 20), (4, 40), (5, 50)]
    df = spark.createDataFrame(rows, "customer_id long, amount long")
    found = summaries.duplicate_rows(df).first()
    assert (found.duplicate_rows, found.unique_rows) == (2, 5)
    ids = summaries.id_duplicates(df, ["customer_id"]).first()
    assert (ids.duplicate_value_count, ids.duplicate_row_count) == (2, 2)
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "x int, y string")
    assert summaries.duplicate_rows(nulls).first().duplicate_rows == 1
    long_text = spark.createDataFrame([("z" * 500,), ("z" * 500,), ("z" * 499,)], "t string")
    assert summaries.duplicate_rows(long_text).first().duplicate_rows == 1
    arrays = spark.createDataFrame([([1, 2],), ([1, 2],), ([2],)], "a array<int>")
    assert summaries.duplicate_rows(arrays).first().duplicate_rows == 1


def test_missing_tokens(spark):
    tokens = ["", " ", "NA", "n/a", "N.A", "none", "NULL", "nil", "NaN", "-", "--", "?", " Unknown ", "missing", " "]
    df = spark.createDataFrame([(t,) for t in tokens] + [("value",), ("n-a",)], "x string")
    assert [r.x for r in scalars.normalize_missing(df).where("x IS NOT NULL").collect()] == ["value", "n-a"]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert summaries.missing_by_column(scalars.normalize_missing(nan)).first().missing_count == 1


def class_of(spark, name, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    row = classes.column_classes(df).first()
    return row.column_class, row.inferred_type, row.cardinality_class


def test_classes(spark):
    assert class_of(spark, "customer_id", list(range(100)), "long")[:2] == ("id", "identifier")
    assert class_of(spark, "active", ["Yes", "no", "YES"] * 10)[0] == "boolean"
    assert class_of(spark, "is_new", [0, 1] * 20, "int")[0] == "boolean"
    assert class_of(spark, "rating", [i % 5 for i in range(200)], "int")[0] == "categorical"
    assert class_of(spark, "amount", [i / 7 for i in range(200)], "double")[:2] == ("numerical", "float")
    assert class_of(spark, "whole", [float(i) for i in range(200)], "double")[1] == "integer"
    assert class_of(spark, "when", [f"2024-01-{d:02d}" for d in range(1, 29)])[:2] == ("datetime", "datetime")
    assert class_of(spark, "digits", [f"2024{d:04d}" for d in range(1, 60)])[0] == "id"
    assert class_of(spark, "note", ["a long feedback text that goes on and on %d" % (i % 90) for i in range(200)])[0] == "text"
    assert class_of(spark, "region", ["north", "south"] * 30)[0] == "categorical"
    assert class_of(spark, "customer_name", ["n%d" % (i % 150) for i in range(200)])[0] == "text"
    assert class_of(spark, "nothing", [None] * 5) == ("unknown", "unknown", "low")
    uuid = "123e4567-e89b-12d3-a456-42661417%04d"
    assert class_of(spark, "ref", [uuid % (i % 20) for i in range(100)])[0] == "id"
    assert class_of(spark, "six_of_ten", list("abcdefaaaa"))[2] == "high"


def test_dates_and_midnight(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS d, timestamp'2024-01-01 10:00:00' AS t UNION ALL SELECT timestamp'2024-01-03 00:00:00', timestamp'2024-01-03 09:59:59'")
    got = {r.column_name: r.column_class for r in classes.column_classes(df).collect()}
    assert got == {"d": "date", "t": "datetime"}
    days = {r.column_name: r.range_days for r in summaries.datetime_stats(df, ["d", "t"]).collect()}
    assert days == {"d": 2, "t": 1}  # elapsed days, not calendar days
    parsed = spark.sql("SELECT explode(array('2024-02-30','2024/03/01','31-12-2023','2024-01-02T03:04:05','20240101','x')) AS s").select(scalars.to_timestamp_lenient(F.col("s")).alias("p")).collect()
    assert [r.p is not None for r in parsed] == [False, True, True, True, False, False]


def test_correlations(spark):
    rows = [(float(i), 2.0 * i, float(-i), 1.0, float(i) if i < 5 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, rare double")
    pairs = correlation.labelled_pairs(correlation.correlation_pairs(df))
    got = {(r.column_a, r.column_b): (round(r.coefficient, 6), r.strength, r.direction) for r in pairs.collect()}
    assert got == {("a", "b"): (1.0, "very_strong", "positive"), ("a", "c"): (-1.0, "very_strong", "negative"), ("b", "c"): (-1.0, "very_strong", "negative")}
    assert correlation.strong_negative(pairs).count() == 2


def test_correlation_blocks_agree(spark, monkeypatch):
    r = random.Random(1)
    df = spark.createDataFrame([tuple(r.random() for _ in range(6)) for _ in range(60)], ", ".join(f"c{i} double" for i in range(6)))
    whole = {(x.i, x.j): x.coefficient for x in correlation.correlation_pairs(df).collect()}
    monkeypatch.setattr(correlation, "PAIRS_PER_PASS", 4)
    assert whole == {(x.i, x.j): x.coefficient for x in correlation.correlation_pairs(df).collect()}


def test_moments_of_blocks_merge(spark):
    r = np.random.default_rng(2)
    values = r.normal(size=(500, 4)) + [0, 1e9, -5, 3]
    values[r.random(values.shape) < 0.3] = np.nan
    total = correlation.block_moments(values[:1])
    for begin, end in ((1, 7), (7, 300), (300, 500)):
        total = correlation.merged_moments(total, correlation.block_moments(values[begin:end]))
    for a in range(4):
        for b in range(4):
            both = ~np.isnan(values[:, a]) & ~np.isnan(values[:, b])
            x, y = values[both, a], values[both, b]
            assert total[0, a, b] == both.sum()
            assert np.allclose([total[1, a, b], total[2, a, b]], [x.mean(), y.mean()], rtol=1e-12)
            assert np.allclose(total[5, a, b] / np.sqrt(total[3, a, b] * total[4, a, b]), np.corrcoef(x, y)[0, 1], atol=1e-6)


def test_wide_correlations_in_one_scan(spark, monkeypatch):
    # 200 columns: gaps, a flat one, one of NaN, one with too few numbers.
    r = np.random.default_rng(3)
    base = r.normal(size=(120, 1))
    values = base * r.normal(size=(1, 200)) + r.normal(size=(120, 200))
    values[:, 5], values[:, 6] = 1.0, np.nan
    values[9:, 7] = np.nan
    cells = [[None if i % 11 == j % 11 else float(v) for j, v in enumerate(row)] for i, row in enumerate(values)]
    df = spark.createDataFrame(cells, ", ".join(f"`c {j}` double" for j in range(200))).repartition(7)
    wide = correlation.correlation_pairs(df)
    assert "MapInArrow" not in wide._jdf.queryExecution().optimizedPlan().toString()  # the merged table is read, not the rows
    got = {(x.column_a, x.column_b): x.coefficient for x in wide.collect()}
    assert len(got) == 197 * 198 // 2 and not any({"c 5", "c 6", "c 7"} & set(k) for k in got)
    some = [f"c {j}" for j in range(20)]
    narrow = {(x.column_a, x.column_b): x.coefficient for x in correlation.correlation_pairs(df, some).collect()}
    assert len(narrow) == 17 * 18 // 2 and all(abs(got[k] - v) < 1e-12 for k, v in narrow.items())
    monkeypatch.setattr(correlation, "WIDE", 1)
    assert correlation.correlation_pairs(df.limit(0), some).count() == 0
    assert correlation.correlation_pairs(df.select("c 5", "c 6"), ["c 5", "c 6"]).count() == 0


def test_quality_weights_and_consistency(spark):
    df = spark.createDataFrame([("UPI",), ("upi",), (" UPI",), ("card",)] * 10, "method string")
    row = quality.inconsistency(df, ["method"]).first()
    assert (row["values"], row.padded, row.varied) == (40, 10, 29)
    profile = TableProfile(df, {"completeness": 1.0, "uniqueness": 0.0, "validity": 0.0, "consistency": 0.0})
    assert profile.quality.first().overall_score == 100.0
    assert TableProfile(df).quality.first().consistency == pytest.approx(100 - 39 / 40 * 100)
    assert TableProfile(df, {k: 0.0 for k in ("completeness", "uniqueness", "validity", "consistency")}).quality.first().overall_score == 0


def test_validation_messages(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS gone, id AS n FROM range(4)")
    got = {r.check: r.message for r in checks.validate(df, ["gone", "gone", " "]).collect()}
    assert got["column_names"] and got["empty_columns"] == "1 column(s) are entirely null: gone" and got["missing_ratio"] == "Column 'gone' has 100.0% missing values"
    assert checks.column_name_warnings(["a", "a", " ", "x\ty"]) == ["Duplicate column names detected: ['a']", "1 column(s) have empty/whitespace-only names", "1 column name(s) contain whitespace/control characters"]
    assert checks.validate(spark.sql("SELECT 1 AS x WHERE FALSE")).first().message == "Dataset has 0 rows"
    with pytest.raises(checks.InvalidTable):
        checks.validate(spark.range(1).select())


def test_latest_value_takes_first_row_of_last_day(spark):
    df = spark.sql("SELECT * FROM VALUES (1, date'2024-01-01', 5D), (2, date'2024-01-02', 7D), (3, date'2024-01-02', 9D), (4, date'2024-01-03', CAST(NULL AS DOUBLE)) AS t(n, d, v)")
    assert summaries.numeric_stats(df, ["v"], "d", ["n"]).first().latest_value == 7.0


def test_top_values_prefilter_in_plan(spark):
    plan = summaries.top_values(spark.range(100).selectExpr("CAST(id AS STRING) AS x"), ["x"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_text_and_the_text_of_its_digest_are_two_values(spark):
    import hashlib

    from tallyscope.operators.summaries import top_values
    long = "x" * 80
    df = spark.createDataFrame([(long,), (hashlib.sha256(long.encode()).hexdigest(),), (long[:70],)], "t string")
    rows = top_values(df).collect()
    assert len(rows) == 3 and {r["value"] for r in rows} >= {long, long[:70]}


def test_small_negatives_keep_their_sign(spark):
    from pyspark.sql import functions as F

    from tallyscope.functions import scalars
    df = spark.createDataFrame([(-0.004,), (-0.005,), (0.004,), (-1.25,)], "v double")
    assert [r[0] for r in df.select(scalars.signed(F.col("v"), 2)).collect()] == ["-0.00", "-0.00", "+0.00", "-1.25"]


def test_radix_keys_keep_the_order(spark):
    from tallyscope.operators.quantiles import ROUNDS, exponents, radix_key

    near = [f(2.0 ** k) for k in range(-1000, 1023, 13) for f in (lambda x: x, lambda x: float(np.nextafter(x, 0)), lambda x: float(np.nextafter(x, 9e308)))]
    some = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), *near, *[random.Random(1).lognormvariate(0, 30) for _ in range(50)]]
    df = spark.createDataFrame([(v,) for x in some for v in (x, -x + 0.0)], "value double")
    for bits in ROUNDS:
        rows = exponents(df, "value").select("value", F.expr(radix_key("value", bits)).alias("k")).orderBy("value").collect()
        assert all(a.k <= b.k for a, b in zip(rows, rows[1:]))
    assert len({r.k for r in rows}) == len({r.value for r in rows})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_read_the_table_twice(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "rand(1) AS b", "concat('t', id % 9) AS t").write.parquet(str(tmp_path / "n"))
    df = spark.read.parquet(str(tmp_path / "n"))
    plan = plan_of(summaries.numeric_stats(df))
    assert plan.count("FileScan parquet") <= 2 and "ObjectHashAggregate" not in plan  # and one scan before, for the keys
    facts = plan_of(classes.column_classes(df))
    assert facts.count("FileScan parquet") == 1 and "ObjectHashAggregate" not in facts and "SortAggregate" not in facts


def test_forms_of_padded_values(spark):
    pad = " " * 90
    df = spark.createDataFrame([("yes" + pad, pad + "2024-01-05"), ("NO", "2024-01-06" + pad), ("yes", "2024-01-07")], "b string, d string")
    got = {r.column_name: (r.inferred_type, r.unique_count) for r in classes.column_classes(df).collect()}
    assert got == {"b": ("boolean", 3), "d": ("datetime", 3)}


def test_shapes_of_dates(spark):
    cases = {"2024-01-05": "2024-01-05 00:00:00", " 2024/1/5 ": "2024-01-05 00:00:00", "05-01-2024": "2024-01-05 00:00:00", "1/5/2024 13:04": "2024-01-05 13:04:00", "Jan 5, 2024": "2024-01-05 00:00:00", "5 September 2023": "2023-09-05 00:00:00",
             "Sept. 5 2023 12:00 AM": "2023-09-05 00:00:00", "Mon, 5-May-2023 1:02:03 p.m.": "2023-05-05 13:02:03", "2024-01-05T01:02:03.5+0530": "2024-01-04 19:32:03.5", "2024-01-05 01:02-02": "2024-01-05 03:02:00", "2024-01-05T01:02:03Z": "2024-01-05 01:02:03",
             "March 2024": "2024-03-01 00:00:00", "2024-02-30": None, "2024-01-05 13:00 pm": None, "20240105": None, "Jan 32, 2024": None, "5 Foo 2024": None, "2024-01-05x": None, "12:30": None, "": None, "may": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string").select("s", F.col("want").cast("timestamp").alias("want"), scalars.to_timestamp_lenient(F.col("s")).alias("got"))
    assert [r.s for r in df.where("NOT (want <=> got)").collect()] == []


def test_rounding_of_halves(spark):
    got = spark.sql("SELECT explode(array(0.5D, 1.5D, 2.5D, -0.5D, double('NaN'), double('infinity'))) AS x").select(scalars.safe_round(F.col("x"), 0).alias("r")).collect()
    assert [r.r for r in got] == [0.0, 2.0, 2.0, 0.0, None, None]


def test_latest_values_need_no_sort_of_the_cells(spark):
    rows = [(1.0, None, dt.date(2024, 1, 2), 1), (2.0, 5.0, dt.date(2024, 1, 3), 2), (3.0, None, dt.date(2024, 1, 3), 1), (9.0, 9.0, None, 0)]
    df = spark.createDataFrame(rows, "v double, w double, d date, n int")
    found = summaries.latest_values(df, ["v", "w"], "d", ["n"])
    assert {r.column_name: r.latest_value for r in found.collect()} == {"v": 3.0, "w": 5.0}
    plan = summaries.numeric_stats(df, ["v", "w"], "d", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "max_by" in plan and "SortAggregate(key=[column_name" not in plan
    assert {r.column_name: (r["count"], r.latest_value) for r in summaries.numeric_stats(df, ["v", "w"], "d", ["n"]).collect()} == {"v": (4, 3.0), "w": (2, 5.0)}
