"""Financial statements derived from the order tables.

One row per (nation, quarter), the column names chosen so that name matching
recognises them.  Shares vary with the nation key so that entities differ in
margin, leverage and liquidity; some columns exist only in some regions, which
exercises the missing-input rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize


STATEMENT_COLUMNS = (
    "revenue gross_sales cogs operating_expenses operating_profit tax net_profit interest_expense "
    "total_assets current_assets cash inventory receivables total_liabilities current_liabilities "
    "debt equity free_cash_flow customers orders headcount deposits casa loans net_interest_income "
    "non_interest_income gross_npa provisions capital_ratio"
).split()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def customer_quarters(spark: SparkSession, folder: str) -> DataFrame:
    """Order sums per (customer, quarter).

    Line items collapse per order before the join, on the join key itself, so
    the table of line items is shuffled once.  Orders then collapse per
    (customer, quarter) before the customer join: a customer holding a large
    part of all orders reaches that join as one row per quarter.
    """
    kept = "l_extendedprice * (1 - l_discount)"
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.expr("sum(l_extendedprice) AS gross"), F.expr(f"sum({kept}) AS net"), F.expr(f"sum({kept} * l_tax) AS tax"),
        F.expr("sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0D END) AS returned"),
    )
    orders = read(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        "CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_date")
    conditions = {
        "open": "o_orderstatus = 'O'", "partial": "o_orderstatus = 'P'", "filled": "o_orderstatus = 'F'",
        "pressing": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    }
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_custkey", "period_date").agg(
        *[F.expr(f"sum({c}) AS {c}") for c in ("gross", "net", "tax", "returned")],
        F.expr("count(1) AS orders"), F.expr("sum(o_totalprice) AS billed"),
        *[F.expr(f"sum(CASE WHEN {when} THEN o_totalprice ELSE 0D END) AS {name}") for name, when in conditions.items()],
    )


MONEY = ["gross", "net", "tax", "returned", "billed", "open", "partial", "filled", "pressing"]


def nation_quarters(spark: SparkSession, folder: str) -> DataFrame:
    customers = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    by_nation = (
        customer_quarters(spark, folder).join(customers, F.expr("o_custkey = c_custkey"))
        .groupBy("c_nationkey", "period_date")
        .agg(*[F.expr(f"sum({c}) AS {c}") for c in [*MONEY, "orders"]], F.expr("count(1) AS customers"))
    )
    places = read(spark, folder, "nation").join(read(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    # An assumed price index per nation, so that some nations grow.
    index = "(1.0013707D + 0.2517D * (n_nationkey % 5) * (year(period_date) - 1995))"
    return by_nation.join(places, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "n_nationkey", "n_name", "r_name", "period_date", "orders", "customers", *[f"{c} * {index} AS {c}" for c in MONEY])


def nation_statements(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_id, region, period_date, statement columns), absent columns NULL."""
    base = nation_quarters(spark, folder).selectExpr(
        "n_name AS entity_id", "r_name AS region", "period_date", "n_nationkey AS k", "customers", "orders",
        "net AS revenue", "gross AS gross_sales", "tax", "billed", "open", "pressing",
        "gross * (0.45D + 0.025D * (n_nationkey % 13)) AS cogs",
        "gross * 0.2D AS operating_expenses",
        "open AS receivables",
        "returned * 12D AS inventory",
        "partial * 20D * (n_nationkey % 5) AS debt",
        "net * (12D + 3D * (n_nationkey % 9)) AS equity",
        "net * (18D + 6D * (n_nationkey % 7)) AS total_liabilities",
        "filled * (2D + 1.2D * (n_nationkey % 6)) AS current_liabilities",
    ).selectExpr(
        "*",
        "revenue - cogs - operating_expenses - tax AS net_profit",
        "region IN ('AFRICA', 'EUROPE') AS bank",
        "operating_expenses * (1.2D + 0.1D * (k % 7)) AS nii",
        "billed * (1.2D + 0.1D * (k % 8)) AS lent",
    ).selectExpr(
        "*",
        # One row per quarter of a nation: the running sum is over its calendar.
        "sum(net_profit) OVER (PARTITION BY entity_id ORDER BY period_date ROWS UNBOUNDED PRECEDING) AS cash",
        "CASE WHEN region <> 'ASIA' THEN revenue - cogs - operating_expenses END AS operating_profit",
        "debt * 0.002D AS interest_expense",
        "total_liabilities + equity AS total_assets",
        "receivables * 3D + inventory * 0.1D AS current_assets",
        "customers * 3 AS headcount",
        "CASE WHEN region = 'AMERICA' THEN net_profit - 0.1D * revenue END AS free_cash_flow",
        "CASE WHEN bank THEN billed * 2D END AS deposits",
        "CASE WHEN bank THEN pressing * 2D END AS casa",
        "CASE WHEN bank THEN lent END AS loans",
        "CASE WHEN bank THEN nii END AS net_interest_income",
        "CASE WHEN bank THEN nii * 0.1D END AS non_interest_income",
        "CASE WHEN bank THEN lent * 0.01D * (k % 10) END AS gross_npa",
        "CASE WHEN bank THEN lent * 0.006D * (k % 10) END AS provisions",
        "CASE WHEN bank THEN open / billed * 100D END AS capital_ratio",
    )
    return base.selectExpr("entity_id", "region", "period_date", *[f"CAST({c} AS DOUBLE) AS {c}" for c in STATEMENT_COLUMNS])


def with_markets(nations: DataFrame) -> DataFrame:
    """Nations plus, per region, their average statement as an entity MARKET_<region>.

    Every row counts towards itself and towards its market, so one aggregation
    gives both (the mean of a single row is the row).
    """
    members = nations.withColumn("entity_id", F.explode(F.array("entity_id", F.concat(F.lit("MARKET_"), F.col("region")))))
    return members.groupBy("entity_id", "region", "period_date").agg(*[F.expr(f"avg({c}) AS {c}") for c in STATEMENT_COLUMNS])


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Nations and regional markets together.

    Every analysis reads this small table in several branches, so it is
    written once and the order tables are read once.
    """
    return materialize(with_markets(nation_statements(spark, folder)), "statements")


def comparison_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(primary_id, secondary_id, market_id): each nation with the next one of its region."""
    nations = read(spark, folder, "nation").join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ring = Window.partitionBy("r_name").orderBy("n_nationkey")
    whole = Window.partitionBy("r_name").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("n_name").over(ring), F.first("n_name").over(whole))
    return nations.select(
        F.col("n_name").alias("primary_id"), following.alias("secondary_id"),
        F.concat(F.lit("MARKET_"), F.col("r_name")).alias("market_id"),
    ).where("primary_id <> secondary_id")
