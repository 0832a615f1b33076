"""The financial steps in plain SQL, written independently of the DataFrame code."""

from __future__ import annotations

from tallyscope.functions import vocab
from tallyscope.functions.registry import METRICS, excluded_phrases, column_phrases
from tallyscope.plans.statements import STATEMENT_COLUMNS
from workload.catalog import rows, step, text, texts

step("lines", "SELECT l_orderkey, sum(l_extendedprice) AS gross, sum(l_extendedprice * (1 - l_discount)) AS net, "
     "sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS returned FROM lineitem GROUP BY 1")
step("sums", """SELECT n_nationkey AS k, n_name AS entity_id, r_name AS region, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_date,
  1.0013707::DOUBLE + 0.2517::DOUBLE * (n_nationkey % 5) * (year(date_trunc('quarter', o_orderdate)) - 1995) AS price_index,
  sum(gross) AS g, sum(net) AS n, sum(tax) AS t, sum(returned) AS r, sum(o_totalprice) AS b, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS op, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS pa,
  sum(o_totalprice) FILTER (o_orderstatus = 'F') AS fi, sum(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS pr, count(*) AS orders, count(DISTINCT o_custkey) AS customers
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""", "lines")
step("money", "SELECT k, entity_id, region, period_date, orders, customers, g * price_index AS gross, n * price_index AS net, t * price_index AS tax, r * price_index AS returned, b * price_index AS billed, "
     "coalesce(op, 0) * price_index AS open, coalesce(pa, 0) * price_index AS partial, coalesce(fi, 0) * price_index AS filled, coalesce(pr, 0) * price_index AS pressing FROM sums", "sums")
step("nations", """SELECT entity_id, region, period_date, net AS revenue, gross AS gross_sales, gross * (0.45 + 0.025 * (k % 13)) AS cogs, gross * 0.2 AS operating_expenses,
  CASE WHEN region <> 'ASIA' THEN net - gross * (0.45 + 0.025 * (k % 13)) - gross * 0.2 END AS operating_profit, tax,
  net - gross * (0.45 + 0.025 * (k % 13)) - gross * 0.2 - tax AS net_profit, partial * 20 * (k % 5) * 0.002 AS interest_expense,
  net * (18 + 6 * (k % 7)) + net * (12 + 3 * (k % 9)) AS total_assets, open * 3 + returned * 12 * 0.1 AS current_assets,
  sum(net - gross * (0.45 + 0.025 * (k % 13)) - gross * 0.2 - tax) OVER (PARTITION BY entity_id ORDER BY period_date) AS cash,
  returned * 12.0 AS inventory, open AS receivables, net * (18 + 6 * (k % 7)) AS total_liabilities, filled * (2 + 1.2 * (k % 6)) AS current_liabilities, partial * 20 * (k % 5) AS debt,
  net * (12 + 3 * (k % 9)) AS equity, CASE WHEN region = 'AMERICA' THEN net - gross * (0.45 + 0.025 * (k % 13)) - gross * 0.2 - tax - 0.1 * net END AS free_cash_flow,
  customers::DOUBLE AS customers, orders::DOUBLE AS orders, customers * 3.0::DOUBLE AS headcount,
  CASE WHEN bank THEN billed * 2 END AS deposits, CASE WHEN bank THEN pressing * 2 END AS casa, CASE WHEN bank THEN billed * (1.2 + 0.1 * (k % 8)) END AS loans,
  CASE WHEN bank THEN gross * 0.2 * (1.2 + 0.1 * (k % 7)) END AS net_interest_income, CASE WHEN bank THEN gross * 0.2 * (1.2 + 0.1 * (k % 7)) * 0.1 END AS non_interest_income,
  CASE WHEN bank THEN billed * (1.2 + 0.1 * (k % 8)) * 0.01 * (k % 10) END AS gross_npa, CASE WHEN bank THEN billed * (1.2 + 0.1 * (k % 8)) * 0.006 * (k % 10) END AS provisions,
  CASE WHEN bank THEN open / billed * 100 END AS capital_ratio
  FROM (SELECT *, region IN ('AFRICA', 'EUROPE') AS bank FROM money)""", "money")
step("st", "SELECT entity_id, region, period_date, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in STATEMENT_COLUMNS) + " FROM nations UNION ALL SELECT concat('MARKET_', region), region, period_date, "
     + ", ".join(f"avg({c})" for c in STATEMENT_COLUMNS) + " FROM nations GROUP BY region, period_date", "nations")
step("long", " UNION ALL ".join(f"SELECT entity_id, period_date, {i} AS ord, '{c}' AS column_name, {c} AS value FROM st WHERE {c} IS NOT NULL" for i, c in enumerate(STATEMENT_COLUMNS)), "st")

step("registry", "SELECT * FROM (VALUES " + rows(
    (m.metric_id, m.ord, m.display_name, m.unit, m.direction, m.category, m.importance, m.kind) for m in METRICS)
    + ") AS t(metric_id, mord, display_name, unit, direction, category, importance, kind)")
_patterns = [(m.metric_id, m.ord, i, "alias", p) for m in METRICS for i, (_, p) in enumerate(column_phrases(m))]
_patterns += [(m.metric_id, m.ord, i, "excluded", p) for m in METRICS for i, (_, p) in enumerate(excluded_phrases(m))]
step("patterns", "SELECT * FROM (VALUES " + rows(_patterns) + ") AS t(metric_id, mord, pord, role, regex)")


def name_match(source: str, column: str) -> str:
    """Best metric of each distinct text in ``column`` of a step."""
    return (
        f"SELECT name, metric_id, len AS specificity, CAST(least(1.0, round(0.65 + len * 0.04, 4)) AS DOUBLE) AS match_confidence FROM ("
        f"SELECT n.name, p.metric_id, p.mord, p.pord, length(regexp_extract(concat(' ', n.name, ' '), p.regex)) AS len FROM (SELECT DISTINCT {column} AS name FROM {source}) n "
        f"JOIN patterns p ON p.role = 'alias' AND regexp_matches(concat(' ', n.name, ' '), p.regex) "
        f"WHERE NOT EXISTS (SELECT 1 FROM patterns x WHERE x.role = 'excluded' AND x.metric_id = p.metric_id AND regexp_matches(concat(' ', n.name, ' '), x.regex)) "
        f"QUALIFY row_number() OVER (PARTITION BY n.name, p.metric_id ORDER BY p.pord) = 1) "
        f"QUALIFY row_number() OVER (PARTITION BY name ORDER BY len DESC, mord) = 1")


step("named", name_match("long", "column_name"), "long", "patterns")
step("totals", "SELECT entity_id, ord, column_name, count(*) AS n, sum(value) AS s, avg(value) AS a, max(value) AS mx, arg_max(value, period_date) AS latest FROM long GROUP BY ALL", "long")
step("cand", "SELECT t.*, metric_id, match_confidence, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY match_confidence DESC, ord) AS rank FROM totals t JOIN named ON column_name = name", "totals", "named")
step("summary", "SELECT entity_id, count(*) AS row_count, min(period_date) AS period_start, max(period_date) AS period_end, CASE WHEN count(*) = 1 THEN 'single_period' WHEN count(*) <= 60 THEN 'periodic' ELSE 'transactional' END AS shape FROM st GROUP BY 1", "st")
step("metrics", """SELECT entity_id, metric_id, display_name, unit, direction, category, kind, column_name AS source_column, match_confidence AS confidence, shape, row_count, period_start, period_end,
  CASE WHEN unit = 'percent' THEN a WHEN kind = 'stock' AND shape = 'periodic' THEN latest WHEN shape = 'periodic' AND kind = 'flow' THEN s WHEN shape = 'single_period' THEN a ELSE s END AS value,
  CASE WHEN unit = 'percent' THEN 'Aggregated as mean of column values (percentage metric).' WHEN kind = 'stock' AND shape = 'periodic' THEN 'Latest value across periods.'
       WHEN shape = 'periodic' AND kind = 'flow' THEN 'Summed across periods.' WHEN shape = 'single_period' THEN 'Single-period value.' ELSE 'Aggregated across all rows.' END AS note
  FROM cand JOIN registry USING (metric_id) JOIN summary USING (entity_id) WHERE rank = 1""", "cand", "registry", "summary")
step("vals", "SELECT entity_id, metric_id, value FROM metrics", "metrics")


def pivot(source: str, keys: str, ids) -> str:
    return f"SELECT {keys}, " + ", ".join(f"max(value) FILTER (metric_id = '{i}') AS {i}" for i in ids) + f" FROM {source} GROUP BY ALL"


INPUTS = ("gross_profit revenue cogs operating_profit operating_expenses net_profit free_cash_flow assets equity debt current_assets current_liabilities "
          "receivables inventory ebit interest_expense net_interest_income non_interest_income loans deposits provisions gross_npa casa").split()
# ratio, numerator, denominator, times, shown formula
FORMULAS = [
    ("gross_margin", "coalesce(gross_profit, revenue - cogs)", "revenue", 100, "gross_profit / revenue"),
    ("operating_margin", "coalesce(operating_profit, revenue - operating_expenses)", "revenue", 100, "operating_profit / revenue"),
    ("net_margin", "net_profit", "revenue", 100, "net_profit / revenue"), ("fcf_margin", "free_cash_flow", "revenue", 100, "free_cash_flow / revenue"),
    ("roa", "net_profit", "assets", 100, "net_profit / assets"), ("roe", "net_profit", "equity", 100, "net_profit / equity"),
    ("debt_to_equity", "debt", "equity", 1, "debt / equity"), ("current_ratio", "current_assets", "current_liabilities", 1, "current_assets / current_liabilities"),
    ("quick_ratio", "current_assets", "current_liabilities", 1, "current_assets / current_liabilities"), ("asset_turnover", "revenue", "assets", 1, "revenue / assets"),
    ("receivables_turnover", "revenue", "receivables", 1, "revenue / receivables"), ("inventory_turnover", "cogs", "inventory", 1, "cogs / inventory"),
    ("interest_coverage", "coalesce(ebit, operating_profit)", "interest_expense", 1, "ebit / interest_expense"),
    ("cost_to_income", "operating_expenses", "coalesce(net_interest_income, non_interest_income)", 100, "operating_expenses / net_interest_income"),
    ("nim", "net_interest_income", "assets", 100, "net_interest_income / assets"), ("credit_deposit_ratio", "loans", "deposits", 100, "loans / deposits"),
    ("provision_coverage", "provisions", "gross_npa", 100, "provisions / gross_npa"), ("casa_ratio", "casa", "deposits", 100, "casa / deposits"),
]


def ratio_sql(source: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{r}' AS metric_id, CASE WHEN {d} <> 0 THEN {n} / {d} * {t} END AS value, CASE WHEN {d} = 0 THEN 'unavailable' ELSE 'calculated' END AS status, "
        f"CASE WHEN {d} = 0 THEN concat('Denominator ({shown.split(' / ')[1]}) is zero — ratio undefined.') ELSE {text(shown + ('  × 100' if t == 100 else ''))} END AS note "
        f"FROM {source} WHERE {n} IS NOT NULL AND {d} IS NOT NULL" for r, n, d, t, shown in FORMULAS)


step("wide", pivot("vals", "entity_id", INPUTS), "vals")
step("ratios", ratio_sql("wide", "entity_id"), "wide")
step("allvals", "SELECT * FROM vals UNION ALL SELECT entity_id, metric_id, value FROM ratios WHERE status = 'calculated'", "vals", "ratios")

# --- trends
step("series", "SELECT l.entity_id, metric_id, period_date, strftime(period_date, '%Y-%m-%d') AS period, value FROM long l JOIN cand c ON l.entity_id = c.entity_id AND l.column_name = c.column_name AND rank = 1", "long", "cand")
step("steps", "SELECT *, lag(value) OVER w AS prev, lag(period) OVER w AS prev_period, row_number() OVER w AS pos, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY period_date DESC) AS back "
     "FROM series WINDOW w AS (PARTITION BY entity_id, metric_id ORDER BY period_date)", "series")
step("growth", "SELECT entity_id, metric_id, count(*) AS period_count, max(value) FILTER (pos = 1) AS first_value, max(value) FILTER (back = 1) AS last_value, "
     "CASE WHEN count(*) FILTER (prev = 0 AND value <> 0) = 0 THEN avg(CASE WHEN prev <> 0 THEN value / prev - 1 END) * 100 END AS avg_period_growth FROM steps GROUP BY 1, 2 HAVING count(*) >= 2", "steps")
step("alltrends", "SELECT *, CASE WHEN growth_rate IS NULL THEN 'insufficient_data' WHEN growth_rate > 2.5 THEN 'improving' WHEN growth_rate < -2.5 THEN 'declining' ELSE 'stable' END AS direction "
     "FROM (SELECT *, CASE WHEN first_value <> 0 THEN (last_value - first_value) / abs(first_value) * 100 END AS growth_rate FROM growth)", "growth")
step("trends", f"SELECT * FROM alltrends WHERE metric_id IN ({texts(vocab.TREND_METRICS)})", "alltrends")


# --- health
def score(value: str, zero: float, full: float) -> str:
    low, high = (zero, full) if zero < full else (full, zero)
    first, last = (0, 100) if zero < full else (100, 0)
    inside = f"round(({value} - {zero}) / ({full} - {zero}) * 100, 2)" if zero < full else f"round(({zero} - {value}) / ({zero} - {full}) * 100, 2)"
    return f"CASE WHEN {value} <= {low} THEN {first} WHEN {value} >= {high} THEN {last} WHEN {value} IS NOT NULL THEN {inside} END"


def health_sql(source: str, keys: str) -> str:
    """``source`` has the ratio columns and revenue_growth."""
    m = "list_avg([{}])"
    dims = {
        "profitability": m.format(", ".join([score("net_margin", 0, 20), score("roe", 0, 20), score("roa", 0, 10)])),
        "liquidity": m.format(", ".join([score("current_ratio", 1, 2), score("quick_ratio", 0.5, 1.5)])),
        "leverage": score("debt_to_equity", 2.5, 0.5),
        "efficiency": m.format(", ".join([score("asset_turnover", 0.1, 1.5), score("inventory_turnover", 1, 8)])),
        "growth": score("revenue_growth", -10, 15),
    }
    w = {"profitability": 0.3, "liquidity": 0.2, "leverage": 0.2, "efficiency": 0.15, "growth": 0.15}
    up = " + ".join(f"coalesce({d} * {w[d]}, 0)" for d in dims)
    down = " + ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE {w[d]} END" for d in dims)
    return (f"SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade "
            f"FROM (SELECT *, coalesce(({up}) / nullif({down}, 0), 0) AS overall_score FROM (SELECT *, " + ", ".join(f"CAST({e} AS DOUBLE) AS {d}" for d, e in dims.items()) + f" FROM {source}))")


HEALTH_INPUTS = "net_margin roe roa current_ratio quick_ratio debt_to_equity asset_turnover inventory_turnover".split()
step("hwide", "SELECT e.entity_id, " + ", ".join(HEALTH_INPUTS) + ", t.growth_rate AS revenue_growth, t.direction AS revenue_direction FROM (SELECT DISTINCT entity_id FROM metrics) e LEFT JOIN ("
     + pivot("ratios", "entity_id", HEALTH_INPUTS) + ") r USING (entity_id) LEFT JOIN (SELECT * FROM trends WHERE metric_id = 'revenue') t USING (entity_id)", "metrics", "ratios", "trends")
step("health", health_sql("hwide", "entity_id"), "hwide")
DIMS = ["profitability", "liquidity", "leverage", "efficiency", "growth"]
step("dims", " UNION ALL ".join(f"SELECT entity_id, {i} AS ord, '{d}' AS dimension, {d} AS score FROM health WHERE {d} IS NOT NULL" for i, d in enumerate(DIMS)), "health")

# --- pairs
step("duos", "SELECT * FROM (SELECT n_name AS primary_id, coalesce(lead(n_name) OVER w, first_value(n_name) OVER w) AS secondary_id, concat('MARKET_', r_name) AS market_id "
     "FROM nation JOIN region ON n_regionkey = r_regionkey WINDOW w AS (PARTITION BY r_name ORDER BY n_nationkey)) WHERE primary_id <> secondary_id")


def both_sides(source: str) -> str:
    return (f"SELECT primary_id, secondary_id, metric_id, a.value AS primary_value, b.value AS secondary_value FROM (SELECT d.primary_id, d.secondary_id, v.metric_id, v.value FROM duos d JOIN {source} v ON v.entity_id = d.primary_id) a "
            f"FULL JOIN (SELECT d.primary_id, d.secondary_id, v.metric_id, v.value FROM duos d JOIN {source} v ON v.entity_id = d.secondary_id) b USING (primary_id, secondary_id, metric_id)")


step("sides", both_sides("vals"), "duos", "vals")
step("combined", f"SELECT primary_id, secondary_id, metric_id, primary_value, secondary_value, coalesce(primary_value, 0) + coalesce(secondary_value, 0) AS value, "
     f"CASE WHEN primary_value IS NOT NULL AND secondary_value IS NOT NULL THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM sides WHERE metric_id IN ({texts(vocab.ADDITIVE_METRICS)})", "sides")
step("cwide", pivot("combined", "primary_id, secondary_id", INPUTS), "combined")
step("cratios", ratio_sql("cwide", "primary_id, secondary_id"), "cwide")
step("chwide", "SELECT d.primary_id, d.secondary_id, " + ", ".join(HEALTH_INPUTS) + ", CAST(NULL AS DOUBLE) AS revenue_growth FROM duos d LEFT JOIN (" + pivot("cratios", "primary_id, secondary_id", HEALTH_INPUTS) + ") r USING (primary_id, secondary_id)", "duos", "cratios")
step("chealth", health_sql("chwide", "primary_id, secondary_id"), "chwide")
_SIDE = ["customers", "revenue", "operating_expenses", "employees", "deposits", "net_profit"]
_TOTAL = ["revenue", "customers", "deposits", "liabilities", "equity", "loans", "gross_npa"]
step("duo_wide", "SELECT * FROM (SELECT primary_id, secondary_id, " + ", ".join(f"max(primary_value) FILTER (metric_id = '{i}') AS a_{i}, max(secondary_value) FILTER (metric_id = '{i}') AS b_{i}" for i in _SIDE)
     + " FROM sides GROUP BY 1, 2) JOIN (SELECT primary_id, secondary_id, " + ", ".join(f"max(value) FILTER (metric_id = '{i}') AS c_{i}" for i in _TOTAL)
     + " FROM combined GROUP BY 1, 2) USING (primary_id, secondary_id) JOIN (SELECT primary_id, secondary_id, max(value) FILTER (metric_id = 'debt_to_equity') AS c_debt_to_equity, max(value) FILTER (metric_id = 'net_margin') AS c_net_margin FROM cratios GROUP BY 1, 2) USING (primary_id, secondary_id)",
     "sides", "combined", "cratios")
step("syn", """SELECT primary_id, secondary_id, 0 AS rule, 'revenue' AS kind, 'Expanded customer base' AS title, CASE WHEN a_customers + b_customers >= 1000000 THEN 'material' ELSE 'small' END AS magnitude FROM duo_wide WHERE a_customers IS NOT NULL AND b_customers IS NOT NULL
  UNION ALL SELECT primary_id, secondary_id, 1, 'revenue', 'Revenue scale', 'material' FROM duo_wide WHERE a_revenue IS NOT NULL AND b_revenue IS NOT NULL
  UNION ALL SELECT primary_id, secondary_id, 2, 'cost', 'Overlapping operating overhead', 'insufficient_data' FROM duo_wide WHERE a_operating_expenses IS NOT NULL AND b_operating_expenses IS NOT NULL
  UNION ALL SELECT primary_id, secondary_id, 3, 'cost', 'Workforce optimization', 'insufficient_data' FROM duo_wide WHERE a_employees IS NOT NULL AND b_employees IS NOT NULL
  UNION ALL SELECT primary_id, secondary_id, 4, 'revenue', 'Deposit base scale', 'material' FROM duo_wide WHERE a_deposits IS NOT NULL AND b_deposits IS NOT NULL""", "duo_wide")
step("rsk", """SELECT primary_id, secondary_id, 0 AS rule, 'high' AS severity, 'High combined leverage' AS title FROM duo_wide WHERE c_debt_to_equity > 2
  UNION ALL SELECT primary_id, secondary_id, 1, 'medium', 'Thin combined profitability' FROM duo_wide WHERE c_net_margin < 5
  UNION ALL SELECT primary_id, secondary_id, 2, 'high', 'Primary company is loss-making' FROM duo_wide WHERE a_net_profit < 0
  UNION ALL SELECT primary_id, secondary_id, 3, 'high', 'Secondary company is loss-making' FROM duo_wide WHERE b_net_profit < 0
  UNION ALL SELECT primary_id, secondary_id, 4, 'high', 'Elevated combined liabilities' FROM duo_wide WHERE c_equity > 0 AND c_liabilities / c_equity > 3
  UNION ALL SELECT primary_id, secondary_id, 5, 'high', 'Elevated combined NPA ratio' FROM duo_wide WHERE c_loans > 0 AND c_gross_npa / c_loans * 100 > 6
  UNION ALL SELECT primary_id, secondary_id, 6, 'low', 'Data-limitation risk' FROM duo_wide""", "duo_wide")

# --- benchmark
step("cmp", f"""SELECT *, CASE WHEN primary_value IS NULL OR secondary_value IS NULL THEN 'na' WHEN primary_value = secondary_value OR direction = 'neutral' THEN 'level'
  WHEN (direction = 'higher_better') = (primary_value > secondary_value) THEN 'ahead' ELSE 'behind' END AS status FROM (
  SELECT s.primary_id, s.secondary_id, s.metric_id, display_name, unit, direction, importance, primary_value, secondary_value, m.value AS market_value, primary_value - secondary_value AS absolute_gap,
  CASE WHEN secondary_value <> 0 THEN (primary_value - secondary_value) / abs(secondary_value) * 100 END AS percentage_gap
  FROM ({both_sides('allvals')}) s JOIN registry USING (metric_id) JOIN duos d ON d.primary_id = s.primary_id AND d.secondary_id = s.secondary_id
  LEFT JOIN allvals m ON m.entity_id = d.market_id AND m.metric_id = s.metric_id WHERE s.metric_id IN ({texts(vocab.COMPARED_METRICS)}))""", "allvals", "registry", "duos")
step("gapped", """SELECT *, (primary_value + secondary_value) / 2 AS near_term_target, row_number() OVER (PARTITION BY primary_id, secondary_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, size DESC, metric_id) AS place FROM (
  SELECT *, CASE WHEN importance = 'high' AND size >= 10 THEN 'high' WHEN importance = 'high' AND size >= 3 THEN 'medium' WHEN importance = 'medium' AND size >= 15 THEN 'high'
  WHEN importance = 'medium' AND size >= 5 THEN 'medium' WHEN importance = 'low' AND size >= 25 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT *, abs(coalesce(percentage_gap, 0)) AS size FROM cmp WHERE status = 'behind'))""", "cmp")


def shown(value: str, unit: str = "unit") -> str:
    """Display text of a value in SQL."""
    return (f"CASE WHEN {value} IS NULL THEN '—' WHEN {unit} = 'percent' THEN printf('%.2f%%', {value}) WHEN {unit} = 'ratio' THEN printf('%.2fx', {value}) "
            f"WHEN {unit} = 'count' THEN format('{{:,.0f}}', {value}) ELSE format('{{:,.2f}}', {value}) END")
