"""Profiling queries with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions import scalars, vocab
from tallyscope.operators import checks, classes, correlation, distributions, quality, summaries
from tallyscope.operators.ordered import idle_sessions
from tallyscope.plans.profile import TableProfile
from tallyscope.functions.rows import spread
from tallyscope.plans.statements import nation_statements
from tallyscope.plans.statements import read as scan
from workload.catalog import query, rounded, step, text, texts, with_steps
from workload import finance_sql  # noqa: F401  (registers the statement steps)



def read(spark, folder, table):
    """A given table, spread over the cores where it is one small file."""
    return spread(scan(spark, folder, table))


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Orders with gaps, tokens and uneven spellings: there are no gaps in the tables as given.
DIRTY = {
    "order_key": "o_orderkey",
    "customer_id": "o_custkey",
    "priority": "CASE WHEN o_orderpriority = '5-LOW' THEN ' N/A ' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '--' ELSE o_orderpriority END",
    "status": "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END",
    "price": "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END",
    "spelling": "CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END",
    "nothing": "CASE WHEN o_orderkey < 0 THEN o_orderpriority END",
    "is_paid": "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END",
    "mostly_gone": "CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END",
    "ordered_on": "o_orderdate",
}
DIRTY_KINDS = {
    "order_key": "integer", "customer_id": "integer", "priority": "string", "status": "string", "price": "float",
    "spelling": "string", "nothing": "string", "is_paid": "string", "mostly_gone": "integer", "ordered_on": "timestamp",
}
step("dirty", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIRTY.items()) + " FROM orders")
_tokens = texts(vocab.MISSING_TOKENS)


def _null_token(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN ({_tokens}) THEN {c} END"


step("clean", "SELECT " + ", ".join(
    f"{_null_token(n)} AS {n}" if k == "string" else n for n, k in DIRTY_KINDS.items()) + " FROM dirty", "dirty")


def dirty(spark, folder):
    return read(spark, folder, "orders").selectExpr(*[f"{e} AS {n}" for n, e in DIRTY.items()])


KINDS = {
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"},
    "events": {"event_id": "integer", "ts": "timestamp", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "float"},
    "clean": DIRTY_KINDS,
    "dirty": DIRTY_KINDS,
}
_words = texts(vocab.TRUE_TOKENS + vocab.FALSE_TOKENS)


def facts_sql(table: str) -> str:
    """Per-column counts and shares, one SELECT per column."""
    parts = []
    for i, (c, kind) in enumerate(KINDS[table].items()):
        is_text = kind == "string"
        number = kind in ("integer", "float")
        parts.append(
            f"SELECT {i} AS ord, '{c}' AS column_name, '{kind}' AS kind, count(*) AS row_count, count({c}) AS non_null, "
            f"count(DISTINCT {c}) AS unique_count, "
            + (f"avg(length({c})) AS avg_length, bool_and(lower(trim({c})) IN ({_words})) AND count(DISTINCT lower(trim({c}))) <= 4 AS all_words, "
               f"avg(CASE WHEN regexp_matches({c}, '^\\s*\\d{{1,4}}[-/]\\d{{1,2}}[-/]\\d{{1,4}}') THEN 1 ELSE 0 END) AS date_ratio, "
               f"avg(CASE WHEN regexp_matches(trim({c}), {text(vocab.UUID_VALUE)}) THEN 1 ELSE 0 END) AS uuid_ratio, "
               if is_text else "CAST(NULL AS DOUBLE) AS avg_length, FALSE AS all_words, 0.0 AS date_ratio, 0.0 AS uuid_ratio, ")
            + (f"bool_and({c} % 1 = 0) AS all_whole, " if number else "NULL AS all_whole, ")
            + (f"bool_and({c} = date_trunc('day', {c})) AS all_midnight " if kind == "timestamp" else "NULL AS all_midnight ")
            + f"FROM {table}")
    return " UNION ALL ".join(parts)


CLASSIFY = """
SELECT *, CASE WHEN column_class = 'id' AND base_type IN ('string', 'integer') THEN 'identifier' ELSE base_type END AS inferred_type,
  CASE WHEN row_count = 0 OR unique_count = 0 THEN 'low' WHEN unique_ratio >= 0.999 AND unique_count > 1 THEN 'unique'
       WHEN unique_ratio > 0.5 THEN 'high' WHEN unique_ratio <= 0.05 OR unique_count <= 10 THEN 'low' ELSE 'medium' END AS cardinality_class
FROM (SELECT *, CASE
    WHEN base_type = 'unknown' THEN 'unknown' WHEN base_type = 'boolean' THEN 'boolean'
    WHEN regexp_matches(column_name, {boolean}) AND unique_count <= 2 THEN 'boolean'
    WHEN base_type = 'datetime' THEN CASE WHEN all_midnight THEN 'date' ELSE 'datetime' END
    WHEN base_type = 'string' AND uuid_ratio >= 0.9 THEN 'id'
    WHEN regexp_matches(column_name, {ident}) AND base_type IN ('integer', 'string') AND unique_count >= 5 THEN 'id'
    WHEN base_type = 'string' AND unique_count = non_null AND unique_count > 1 AND unique_ratio >= 0.9 THEN 'id'
    WHEN base_type IN ('integer', 'float') THEN CASE WHEN unique_count <= 10 AND unique_ratio <= 0.05 AND row_count >= 20 THEN 'categorical' ELSE 'numerical' END
    WHEN avg_length >= 40 THEN 'text' WHEN unique_ratio <= 0.05 OR unique_count <= 50 THEN 'categorical' ELSE 'text' END AS column_class
  FROM (SELECT *, unique_count / row_count AS unique_ratio, row_count - non_null AS missing_count, (row_count - non_null) / row_count AS missing_ratio,
    CASE WHEN non_null = 0 THEN 'unknown' WHEN kind = 'integer' THEN 'integer'
         WHEN kind = 'float' THEN CASE WHEN all_whole THEN 'integer' ELSE 'float' END
         WHEN kind = 'timestamp' THEN 'datetime' WHEN all_words THEN 'boolean' WHEN date_ratio >= 0.9 THEN 'datetime' ELSE 'string' END AS base_type
    FROM {facts}))
""".replace("{boolean}", text(vocab.BOOLEAN_NAME)).replace("{ident}", text(vocab.IDENTIFIER_NAME))
for _t in KINDS:
    step(f"facts_{_t}", facts_sql(_t), *([_t] if _t in ("clean", "dirty") else []))
    step(f"classes_{_t}", CLASSIFY.replace("{facts}", f"facts_{_t}"), f"facts_{_t}")

CLASS_COLUMNS = ["column_name", "inferred_type", "column_class", "cardinality_class", "non_null", "unique_count", "missing_count"]


def _class_query(name, table, load):
    @query(name, with_steps(f"SELECT {', '.join(CLASS_COLUMNS)}, round(unique_ratio, 6) AS unique_ratio FROM classes_{table}", f"classes_{table}"))
    def run(spark, folder):
        return classes.column_classes(load(spark, folder)).select(*CLASS_COLUMNS, F.round("unique_ratio", 6).alias("unique_ratio"))


for _name, _table in (("column_classes_lineitem", "lineitem"), ("column_classes_customer", "customer"), ("column_classes_events", "events"),
                      ("column_classes_documents", "documents"), ("column_classes_part", "part")):
    _class_query(_name, _table, lambda spark, folder, t=_table: read(spark, folder, t))
_class_query("column_classes_with_gaps", "clean", dirty)


@query("parquet_projection", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def parquet_projection(spark, folder):
    from tallyscope.sources.files import read_parquet

    lines = read_parquet(spark, f"{folder}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return lines.where("l_quantity > 25").groupBy("l_returnflag").agg(F.expr("count(1) AS n"), F.expr("round(sum(l_quantity), 2) AS quantity"))


@query("normalize_missing", with_steps(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM clean" for c in DIRTY_KINDS), "clean"))
def normalize_missing(spark, folder):
    by_column = summaries.missing_by_column(scalars.normalize_missing(dirty(spark, folder)))
    return by_column.selectExpr("column_name", "rows - missing_count AS non_null")


@query("empty_columns", with_steps("SELECT 6 AS ord, 'nothing' AS column_name FROM dirty HAVING count(nothing) = 0 AND count(*) > 0", "dirty"))
def empty_columns(spark, folder):
    return checks.empty_columns(checks.null_counts(dirty(spark, folder)))


GAPPED = ["status", "price", "nothing", "mostly_gone"]


@query("empty_rows", with_steps(
    "SELECT count(*) AS row_count, sum(CASE WHEN e THEN 1 ELSE 0 END)::BIGINT AS empty_rows, round(100.0 * sum(CASE WHEN e THEN 1 ELSE 0 END) / count(*), 2) AS empty_pct "
    "FROM (SELECT status IS NULL AND price IS NULL AND nothing IS NULL AND mostly_gone IS NULL AS e FROM dirty)", "dirty"))
def empty_rows(spark, folder):
    return checks.empty_rows(checks.null_counts(dirty(spark, folder).select(*GAPPED))).withColumnRenamed("rows", "row_count")


@query("missing_warnings", with_steps(
    "SELECT ord, column_name, round(r, 6) AS ratio, CASE WHEN r >= 0.5 THEN 'high' ELSE 'warn' END AS level, "
    "concat('Column ''', column_name, ''' ', CASE WHEN r >= 0.5 THEN 'has' ELSE 'contains' END, ' ', printf('%.1f', round(r * 100, 1)), '% missing values') AS message "
    "FROM (SELECT ord, column_name, (row_count - non_null) / row_count AS r FROM facts_dirty) WHERE r >= 0.05", "facts_dirty"))
def missing_warnings(spark, folder):
    return rounded(checks.missing_warnings(checks.null_counts(dirty(spark, folder))), 6)


@query("table_warnings", with_steps(
    "SELECT 'empty_columns' AS kind, CAST(1 AS BIGINT) AS n FROM facts_dirty WHERE non_null = 0 HAVING count(*) > 0 "
    "UNION ALL SELECT 'missing_ratio', count(*) FROM facts_dirty WHERE (row_count - non_null) / row_count >= 0.05", "facts_dirty"))
def table_warnings(spark, folder):
    found = checks.validate(dirty(spark, folder))
    return found.groupBy(F.col("check").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_ingest = f"""
SELECT column_name, CASE WHEN is_id AND base = 'string' THEN 'identifier' ELSE base END AS inferred_type, row_count > non_null AS nullable, unique_count,
  row_count - non_null AS missing_count, round((row_count - non_null) / row_count, 6) AS missing_ratio, is_id AS is_identifier,
  (base = 'string' AND NOT is_id AND NOT coalesce(avg_length >= 40, FALSE) AND (unique_count / row_count <= 0.05 OR unique_count <= 50) AND unique_count > 0)
    OR (base = 'integer' AND NOT is_id AND unique_count <= 10 AND unique_count / row_count <= 0.5) AS is_categorical,
  base IN ('integer', 'float') AS is_numerical, base = 'datetime' AS is_datetime, base = 'string' AND NOT is_id AND coalesce(avg_length >= 40, FALSE) AS is_text
FROM (SELECT *, unique_count = non_null AND unique_count > 1 AND (regexp_matches(column_name, {text(vocab.INGEST_IDENTIFIER_NAME)}) OR base IN ('integer', 'string')) AS is_id
  FROM (SELECT *, CASE WHEN non_null = 0 THEN 'unknown' WHEN kind = 'integer' THEN 'integer' WHEN kind = 'float' THEN CASE WHEN all_whole THEN 'integer' ELSE 'float' END
    WHEN kind = 'timestamp' THEN 'datetime' WHEN date_ratio >= 0.9 THEN 'datetime' ELSE 'string' END AS base FROM FACTS))"""
for _name, _table in (("ingest_schema_events", "events"), ("ingest_schema_documents", "documents"), ("ingest_schema_with_gaps", "dirty")):
    def _make(name=_name, table=_table):
        @query(name, with_steps(_ingest.replace("FACTS", f"facts_{table}"), f"facts_{table}"))
        def run(spark, folder):
            df = dirty(spark, folder) if table == "dirty" else read(spark, folder, table)
            return checks.ingest_schema(df).drop("ord", "dtype")
    _make()


@query("sample_values", " UNION ALL ".join(
    f"SELECT column_name, position, value FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY event_id) AS position, CAST({c} AS VARCHAR) AS value FROM events "
    f"WHERE {c} IS NOT NULL QUALIFY position <= 5)" for c in ("event_id", "user_id", "event_type", "props")))
def sample_values(spark, folder):
    return summaries.sample_values(read(spark, folder, "events"), ["event_id"], ["event_id", "user_id", "event_type", "props"]).selectExpr(
        "column_name", "CAST(position AS BIGINT) AS position", "value")


@query("first_date_column", "SELECT 'ordered_on' AS column_name, 'timestamp' AS kind FROM orders HAVING count(o_orderdate) > 0")
def first_date_column(spark, folder):
    return classes.first_date_column(classes.column_classes(dirty(spark, folder)))


@query("cardinality_lists", with_steps(
    "SELECT cardinality_class, count(*) AS n, string_agg(column_name, ',' ORDER BY ord) AS names FROM classes_clean GROUP BY 1", "classes_clean"))
def cardinality_lists(spark, folder):
    return classes.cardinality_lists(classes.column_classes(dirty(spark, folder))).selectExpr(
        "cardinality_class", "columns AS n", "array_join(column_names, ',') AS names")


@query("profile_filter", with_steps(
    "SELECT column_name, column_class, missing_count FROM classes_clean WHERE column_class IN ('categorical', 'numerical') AND contains(lower(column_name), 'p')", "classes_clean"))
def profile_filter(spark, folder):
    found = classes.filter_profile(classes.column_classes(dirty(spark, folder)), ["categorical", "numerical"], " P ", "missing_ratio", True)
    return found.select("column_name", "column_class", "missing_count")


# --- column statistics ----------------------------------------------------------
def _stats_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
        f"round(sum({c}), 2) AS sum, round(quantile_cont({c}, 0.1), 4) AS p10, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, "
        f"round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.9), 4) AS p90, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM {table}"
        for c in columns)


def _stats_out(df, *more):
    names = ["mean", "std", "min", "max", "p10", "q1", "median", "q3", "p90", "iqr", *more]
    return df.select("column_name", F.col("count").alias("n"), F.round("sum", 2).alias("sum"), *[F.round(c, 4).alias(c) for c in names])


@query("numeric_stats", _stats_sql("lineitem", LINE_NUMBERS))
def numeric_stats(spark, folder):
    return _stats_out(summaries.numeric_stats(read(spark, folder, "lineitem"), LINE_NUMBERS))


@query("numeric_stats_with_gaps", with_steps(_stats_sql("clean", ["price", "mostly_gone"]), "clean"))
def numeric_stats_with_gaps(spark, folder):
    return _stats_out(summaries.numeric_stats(scalars.normalize_missing(dirty(spark, folder)), ["price", "mostly_gone"]))


@query("latest_value", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round((SELECT {c} FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1), 4) AS latest_value FROM lineitem GROUP BY 1"
    for c in LINE_NUMBERS))
def latest_value(spark, folder):
    found = summaries.numeric_stats(read(spark, folder, "lineitem"), LINE_NUMBERS, "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return found.select("column_name", F.round("latest_value", 4).alias("latest_value"))


def _counts_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS unique_count, "
        f"row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)


CATEGORIES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query("categorical_stats", "SELECT column_name, total::BIGINT AS n, unique_count, value AS mode, n AS mode_frequency, round(n / total, 6) AS mode_ratio FROM ("
       + _counts_sql("lineitem", CATEGORIES) + ") WHERE rank = 1")
def categorical_stats(spark, folder):
    return summaries.categorical_stats(read(spark, folder, "lineitem"), CATEGORIES).withColumnRenamed("count", "n")


@query("text_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS unique_count, round(avg(length({c})), 6) AS avg_length, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length FROM documents"
    for c in ("text", "lang", "source")))
def text_stats(spark, folder):
    return summaries.text_stats(read(spark, folder, "documents"), ["text", "lang", "source"]).withColumnRenamed("count", "n")


@query("datetime_stats",
       "SELECT 'ts' AS column_name, count(ts) AS n, count(DISTINCT ts) AS unique_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, "
       "CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS INT) AS range_days FROM events")
def datetime_stats(spark, folder):
    return summaries.datetime_stats(read(spark, folder, "events"), ["ts"]).select(
        "column_name", F.col("count").alias("n"), "unique_count", F.date_format("min", "yyyy-MM-dd HH:mm:ss").alias("first"),
        F.date_format("max", "yyyy-MM-dd HH:mm:ss").alias("last"), "range_days")


@query("boolean_stats", with_steps(
    "SELECT 'is_paid' AS column_name, count(is_paid) AS n, count(*) FILTER (lower(trim(is_paid)) IN ('true','t','yes','y','1')) AS true_count, "
    "count(*) FILTER (lower(trim(is_paid)) NOT IN ('true','t','yes','y','1')) AS false_count, "
    "round(avg(CASE WHEN lower(trim(is_paid)) IN ('true','t','yes','y','1') THEN 1.0 ELSE 0.0 END), 6) AS true_ratio FROM clean", "clean"))
def boolean_stats(spark, folder):
    return summaries.boolean_stats(dirty(spark, folder), ["is_paid"]).withColumnRenamed("count", "n")


@query("id_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS unique_count, count({c}) - count(DISTINCT {c}) AS duplicate_count, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness_ratio FROM events"
    for c in ("event_id", "user_id")))
def id_stats(spark, folder):
    return summaries.id_stats(read(spark, folder, "events"), ["event_id", "user_id"]).withColumnRenamed("count", "n")


@query("missing_by_column", with_steps(
    "SELECT column_name, row_count - non_null AS missing_count, round((row_count - non_null) / row_count, 6) AS missing_ratio FROM facts_clean", "facts_clean"))
def missing_by_column(spark, folder):
    return summaries.missing_by_column(scalars.normalize_missing(dirty(spark, folder))).select("column_name", "missing_count", "missing_ratio")


step("missing_totals", "SELECT sum(row_count)::BIGINT AS total_cells, sum(row_count - non_null)::BIGINT AS total_missing, count(*) FILTER (row_count > non_null) AS columns_with_missing, "
     "round(sum(row_count - non_null) / sum(row_count), 6) AS missing_ratio FROM facts_clean", "facts_clean")


@query("missing_totals", with_steps("SELECT * FROM missing_totals", "missing_totals"))
def missing_totals(spark, folder):
    return summaries.missing_totals(summaries.missing_by_column(scalars.normalize_missing(dirty(spark, folder))))


@query("top_missing", with_steps(
    "SELECT column_name, row_count - non_null AS missing_count FROM facts_clean WHERE row_count > non_null ORDER BY missing_count DESC, ord LIMIT 3", "facts_clean"))
def top_missing(spark, folder):
    return summaries.top_missing(summaries.missing_by_column(scalars.normalize_missing(dirty(spark, folder))), 3).select("column_name", "missing_count")


def _dup_sql(table: str, columns: str) -> str:
    return (f"SELECT t AS total_rows, u AS unique_rows, t - u AS duplicate_rows, round((t - u) / t, 6) AS duplicate_ratio FROM "
            f"(SELECT (SELECT count(*) FROM {table}) AS t, (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table})) AS u)")


@query("duplicate_texts", _dup_sql("documents", "text, lang"))
def duplicate_texts(spark, folder):
    return summaries.duplicate_rows(read(spark, folder, "documents"), ["text", "lang"])


@query("duplicate_rows", _dup_sql("lineitem", "*"))
def duplicate_rows(spark, folder):
    return summaries.duplicate_rows(read(spark, folder, "lineitem"))


@query("duplicate_rows_with_gaps", with_steps(_dup_sql("clean", "customer_id, priority, status, nothing, is_paid"), "clean"))
def duplicate_rows_with_gaps(spark, folder):
    return summaries.duplicate_rows(scalars.normalize_missing(dirty(spark, folder)), ["customer_id", "priority", "status", "nothing", "is_paid"])


def _id_dup(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count(*) FILTER (n > 1) AS duplicate_value_count, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicate_row_count, sum(n)::BIGINT AS non_null "
            f"FROM (SELECT {c}, count(*) AS n FROM events WHERE {c} IS NOT NULL GROUP BY 1)")


@query("id_duplicates", _id_dup("event_id") + " UNION ALL " + _id_dup("user_id"))
def id_duplicates(spark, folder):
    return summaries.id_duplicates(read(spark, folder, "events"), ["event_id", "user_id"])


@query("id_duplicate_examples", "SELECT column_name, rank, value, n FROM (" + _counts_sql("events", ["event_id", "user_id"]) + ") WHERE rank <= 5 AND n > 1")
def id_duplicate_examples(spark, folder):
    return summaries.id_duplicate_examples(read(spark, folder, "events"), ["event_id", "user_id"]).selectExpr(
        "column_name", "CAST(rank AS BIGINT) AS rank", "value", "count AS n")


@query("table_overview", with_steps(
    "SELECT max(row_count) AS row_count, count(*) AS columns, " + ", ".join(f"count(*) FILTER (column_class = '{c}') AS {c}_columns" for c in
    ("numerical", "categorical", "text", "date", "datetime", "id", "boolean", "unknown")) + " FROM classes_clean", "classes_clean"))
def table_overview(spark, folder):
    return classes_overview(dirty(spark, folder))


def classes_overview(df):
    return summaries.overview(classes.column_classes(df)).withColumnRenamed("rows", "row_count")


# --- distributions --------------------------------------------------------------
def _hist_sql(table: str, c: str) -> str:
    return (f"SELECT '{c}' AS column_name, b.bin AS bin, round(lo + b.bin * (hi - lo) / 20, 4) AS lower, round(CASE WHEN b.bin = 19 THEN hi ELSE lo + (b.bin + 1) * (hi - lo) / 20 END, 4) AS upper, "
            f"(SELECT count(*) FROM {table} v WHERE v.{c} >= lo + b.bin * ((hi - lo) / 20) AND (v.{c} < lo + (b.bin + 1) * ((hi - lo) / 20) OR b.bin = 19)) AS n "
            f"FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}), (SELECT unnest(range(20))::INT AS bin) b")


@query("histogram", _hist_sql("lineitem", "l_extendedprice") + " UNION ALL " + _hist_sql("lineitem", "l_quantity"))
def histogram(spark, folder):
    return rounded(distributions.histogram(read(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])).withColumnRenamed("count", "n")


@query("distribution_shape", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_pop({c}), 4) AS std, "
    f"CASE WHEN min({c}) = max({c}) THEN 'degenerate' WHEN stddev_pop({c}) = 0 THEN 'constant' WHEN (avg({c}) - median({c})) / stddev_pop({c}) > 0.3 THEN 'right_skewed' "
    f"WHEN (avg({c}) - median({c})) / stddev_pop({c}) < -0.3 THEN 'left_skewed' ELSE 'approximately_symmetric' END AS shape FROM {t}"
    for t, c in (("events", "value"), ("events", "user_id"))))
def distribution_shape(spark, folder):
    return rounded(distributions.shape(read(spark, folder, "events"), ["value", "user_id"]))


@query("top_values", "SELECT column_name, rank, value, n, round(n / total, 6) AS ratio FROM (" + _counts_sql("events", ["user_id", "event_type", "props"]) + ") WHERE rank <= 10")
def top_values(spark, folder):
    return summaries.top_values(read(spark, folder, "events"), ["user_id", "event_type", "props"]).selectExpr(
        "column_name", "CAST(rank AS BIGINT) AS rank", "value", "count AS n", "ratio")


@query("top_texts", "SELECT row_number() OVER (ORDER BY n DESC, shown, digest) AS rank, shown AS value, digest AS value_key, n FROM ("
       "SELECT text AS shown, CASE WHEN octet_length(encode(text)) > 64 THEN concat('sha256:', sha256(text)) ELSE text END AS digest, count(*) AS n FROM documents GROUP BY 1, 2) QUALIFY rank <= 5")
def top_texts(spark, folder):
    return summaries.top_values(read(spark, folder, "documents"), ["text"], 5).selectExpr("CAST(rank AS BIGINT) AS rank", "value", "key AS value_key", "count AS n")


@query("categorical_distribution", "SELECT column_name, rank, value, n, round(n / total, 6) AS ratio, unique_count FROM (" + _counts_sql("documents", ["source", "lang"]) + ") WHERE rank <= 10 "
       "UNION ALL SELECT column_name, 11, NULL, (any_value(total) - sum(n) FILTER (rank <= 10))::BIGINT, round((any_value(total) - sum(n) FILTER (rank <= 10)) / any_value(total), 6), any_value(unique_count) "
       "FROM (" + _counts_sql("documents", ["source", "lang"]) + ") GROUP BY column_name")
def categorical_distribution(spark, folder):
    return distributions.categorical_distribution(read(spark, folder, "documents"), ["source", "lang"]).selectExpr(
        "column_name", "CAST(rank AS BIGINT) AS rank", "value", "count AS n", "ratio", "unique_count")


def _outlier_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, n, CASE WHEN n < 4 OR q3 = q1 THEN 0 ELSE (SELECT count(*) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) END AS outlier_count, "
        f"CASE WHEN n < 4 THEN 'insufficient_data' WHEN q3 = q1 THEN 'zero_iqr' END AS reason, round(q1, 4) AS q1, round(q3, 4) AS q3, "
        f"round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound "
        f"FROM (SELECT count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})" for c in columns)


@query("outliers", _outlier_sql("lineitem", LINE_NUMBERS) + " UNION ALL " + _outlier_sql("events", ["value"]))
def outliers(spark, folder):
    found = distributions.outliers(read(spark, folder, "lineitem"), LINE_NUMBERS).unionByName(distributions.outliers(read(spark, folder, "events"), ["value"]))
    return rounded(found.select("column_name", "n", F.col("count").alias("outlier_count"), "reason", "q1", "q3", "lower_bound", "upper_bound"))


@query("outlier_ranking", "SELECT row_number() OVER (ORDER BY outlier_count DESC, column_name) AS place, column_name, outlier_count FROM (" + _outlier_sql("customer", ["c_acctbal", "c_nationkey"]) + ")")
def outlier_ranking(spark, folder):
    from pyspark.sql import Window

    found = distributions.outliers(read(spark, folder, "customer"), ["c_acctbal", "c_nationkey"])
    place = F.row_number().over(Window.orderBy(F.desc("count"), "column_name"))  # one row per column of the table
    return distributions.outlier_ranking(found).select(place.cast("bigint").alias("place"), "column_name", F.col("count").alias("outlier_count"))


# --- correlations ---------------------------------------------------------------
CORRELATED = ["revenue", "gross_sales", "cogs", "tax", "net_profit", "debt", "equity", "customers", "orders", "deposits", "free_cash_flow", "capital_ratio"]


def _corr_sql() -> str:
    pairs = []
    for i, a in enumerate(CORRELATED):
        for j in range(i, len(CORRELATED)):
            b = CORRELATED[j]
            pairs.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS column_a, '{b}' AS column_b, CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= 10 THEN corr({a}, {b}) END AS coefficient FROM nations")
    return " UNION ALL ".join(pairs)


step("pairs", _corr_sql(), "nations")
_strength = "CASE WHEN abs(coefficient) >= 0.8 THEN 'very_strong' WHEN abs(coefficient) >= 0.6 THEN 'strong' WHEN abs(coefficient) >= 0.4 THEN 'moderate' WHEN abs(coefficient) >= 0.2 THEN 'weak' ELSE 'very_weak' END"


def _pairs(spark, folder):
    return correlation.correlation_pairs(nation_statements(spark, folder), CORRELATED)


@query("correlation_matrix", with_steps(
    "SELECT column_a, column_b, coalesce(round(coefficient, 4), 0.0) AS coefficient FROM pairs UNION ALL SELECT column_b, column_a, coalesce(round(coefficient, 4), 0.0) FROM pairs WHERE i <> j", "pairs"))
def correlation_matrix(spark, folder):
    return correlation.correlation_matrix(_pairs(spark, folder))


@query("correlation_pairs", with_steps(
    f"SELECT column_a, column_b, round(coefficient, 4) AS coefficient, {_strength} AS strength, CASE WHEN coefficient >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM pairs WHERE i < j AND coefficient IS NOT NULL", "pairs"))
def correlation_pairs(spark, folder):
    return rounded(correlation.labelled_pairs(_pairs(spark, folder)).drop("i", "j"))


@query("correlation_strong", with_steps(
    "SELECT CASE WHEN coefficient > 0 THEN 'positive' ELSE 'negative' END AS side, column_a, column_b, round(coefficient, 4) AS coefficient FROM pairs WHERE i < j AND abs(coefficient) >= 0.6", "pairs"))
def correlation_strong(spark, folder):
    pairs = correlation.labelled_pairs(_pairs(spark, folder))
    both = correlation.strong_positive(pairs).unionByName(correlation.strong_negative(pairs))
    return rounded(both.select(F.col("direction").alias("side"), "column_a", "column_b", "coefficient"))


@query("correlation_top", with_steps(
    "SELECT column_a, column_b, round(coefficient, 4) AS coefficient FROM pairs WHERE i < j AND coefficient IS NOT NULL ORDER BY abs(coefficient) DESC, i, j LIMIT 10", "pairs"))
def correlation_top(spark, folder):
    return rounded(correlation.top_pairs(correlation.labelled_pairs(_pairs(spark, folder))).select("column_a", "column_b", "coefficient"))


@query("correlation_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS coefficient FROM lineitem" for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]))
def correlation_lineitem(spark, folder):
    pairs = correlation.labelled_pairs(correlation.correlation_pairs(read(spark, folder, "lineitem"), LINE_NUMBERS))
    return rounded(pairs.select("column_a", "column_b", "coefficient"))


# --- quality --------------------------------------------------------------------
_strings = [c for c, k in DIRTY_KINDS.items() if k == "string"]
step("spelled", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, lower(trim({c})) AS folded, count(*) AS n, count(DISTINCT trim({c})) AS variants, count(*) FILTER (trim({c}) <> {c}) AS padded FROM clean WHERE {c} IS NOT NULL GROUP BY 2"
    for c in _strings), "clean")
step("uneven", "SELECT column_name, sum(n)::BIGINT AS n, sum(padded)::BIGINT AS padded, sum(CASE WHEN variants > 1 THEN n - 1 ELSE 0 END)::BIGINT AS varied, "
     "least(1.0, (sum(padded) + sum(CASE WHEN variants > 1 THEN n - 1 ELSE 0 END)) / sum(n)) AS inconsistency FROM spelled GROUP BY 1", "spelled")
step("dup_all", _dup_sql("clean", "*"), "clean")
step("dup_ids", "SELECT sum(n - 1) / sum(n) AS share FROM (SELECT customer_id, count(*) AS n FROM clean GROUP BY 1)", "clean")
step("quality", """SELECT 100.0 * (1 - missing_ratio) AS completeness, greatest(0.0, 100.0 - duplicate_ratio * 100.0 - least(1.0, share) * 10.0) AS uniqueness,
  (SELECT 100.0 - 100.0 * avg(CASE WHEN column_class = 'unknown' THEN 1.0 ELSE 0.0 END) FROM classes_clean) AS validity,
  (SELECT greatest(0.0, 100.0 - 100.0 * avg(coalesce(inconsistency, 0))) FROM classes_clean c LEFT JOIN uneven u USING (column_name) WHERE column_class IN ('categorical', 'text') AND kind = 'string') AS consistency
  FROM missing_totals, dup_all, dup_ids""",
     "missing_totals", "dup_all", "dup_ids", "classes_clean", "uneven")
_overall = "(0.35 * completeness + 0.20 * uniqueness + 0.25 * validity + 0.20 * consistency)"


@query("text_inconsistency", with_steps("SELECT column_name, n, padded, varied, round(inconsistency, 6) AS inconsistency FROM uneven", "uneven"))
def text_inconsistency(spark, folder):
    return rounded(quality.inconsistency(scalars.normalize_missing(dirty(spark, folder)), _strings), 6).withColumnRenamed("values", "n")


@query("quality_score", with_steps(
    f"SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, round(validity, 4) AS validity, round(consistency, 4) AS consistency, round({_overall}, 4) AS overall_score, "
    f"CASE WHEN {_overall} >= 90 THEN 'A' WHEN {_overall} >= 80 THEN 'B' WHEN {_overall} >= 70 THEN 'C' WHEN {_overall} >= 60 THEN 'D' ELSE 'F' END AS grade FROM quality", "quality"))
def quality_score(spark, folder):
    # order_key is no identifier by name, so customer_id is the only id column.
    return rounded(TableProfile(dirty(spark, folder)).quality)


@query("column_quality", with_steps(
    "SELECT column_name, column_class, round(100 - 40 * missing_ratio - CASE WHEN column_class = 'numerical' THEN 15 * least(coalesce(o.ratio, 0), 0.5) ELSE 0 END "
    "- CASE WHEN column_class = 'id' THEN 25 * least((non_null - unique_count) / non_null, 1.0) ELSE 0 END - CASE WHEN column_class = 'unknown' THEN 25 ELSE 0 END, 4) AS quality_score "
    "FROM classes_clean LEFT JOIN (SELECT column_name, outlier_count / n AS ratio FROM (" + _outlier_sql("clean", ["order_key", "price", "mostly_gone"]) + ")) o USING (column_name)", "classes_clean"))
def column_quality(spark, folder):
    return rounded(TableProfile(dirty(spark, folder)).column_quality.select("column_name", "column_class", "quality_score"))


@query("profile_evidence", with_steps(
    f"""SELECT position, label, round(value, 4) AS value, display_value FROM (
    SELECT 0 AS position, 'Rows' AS label, total_rows::DOUBLE AS value, format('{{:,}}', total_rows) AS display_value FROM dup_all
    UNION ALL SELECT 1, 'Columns', {len(DIRTY)}, '{len(DIRTY)}' FROM dup_all
    UNION ALL SELECT 2, 'Overall quality', {_overall}, concat(printf('%.1f', {_overall}), '/100 (grade ', CASE WHEN {_overall} >= 90 THEN 'A' WHEN {_overall} >= 80 THEN 'B' WHEN {_overall} >= 70 THEN 'C' WHEN {_overall} >= 60 THEN 'D' ELSE 'F' END, ')') FROM quality
    UNION ALL SELECT 3, 'Missing values', total_missing, concat(format('{{:,}}', total_missing), ' cells (', printf('%.2f', missing_ratio * 100), '% of the data)') FROM missing_totals
    UNION ALL SELECT 4, 'Duplicate rows', duplicate_rows, concat(format('{{:,}}', duplicate_rows), ' rows (', printf('%.2f', duplicate_ratio * 100), '%)') FROM dup_all)""",
    "quality", "dup_all", "missing_totals"))
def profile_evidence(spark, folder):
    return rounded(TableProfile(dirty(spark, folder)).evidence)


@query("column_evidence", with_steps("SELECT ord, concat(column_name, ' (', column_class, ')') AS display_value FROM classes_clean ORDER BY ord LIMIT 50", "classes_clean"))
def column_evidence(spark, folder):
    return TableProfile(dirty(spark, folder)).column_evidence


# --- scalar functions over whole tables -----------------------------------------
@query("coerce_numbers",
       "SELECT count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL) AS numbers, round(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 2) AS total, "
       "count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NOT NULL) AS words FROM events")
def coerce_numbers(spark, folder):
    events = read(spark, folder, "events")
    number = scalars.to_number(F.get_json_object("props", "$.k"))
    return events.agg(F.count(number).alias("numbers"), F.round(F.sum(number), 2).alias("total"), F.count(scalars.to_number(F.col("event_type"))).alias("words"))


@query("coerce_dates",
       "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def coerce_dates(spark, folder):
    shapes = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd') "
                    "WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") END")
    at = scalars.to_timestamp_lenient(F.col("shape"))
    return read(spark, folder, "orders").withColumn("shape", shapes).groupBy(F.year(at).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("date_forms",
       "SELECT o_orderkey % 9 AS form, count(*) AS n, sum(epoch(o_orderdate) + CASE o_orderkey % 9 WHEN 2 THEN 46921 WHEN 3 THEN 1380 WHEN 4 THEN 46800 WHEN 5 THEN 46920 - 19800 WHEN 6 THEN 46921 + 7200 ELSE 0 END)::BIGINT AS seconds FROM orders GROUP BY 1")
def date_forms(spark, folder):
    """Dates of all orders in nine shapes: month names, 12-hour clocks, offsets without colon."""
    shown = ["MMM d, yyyy", "dd MMMM yyyy", "MMM d, yyyy", "d-MMM-yyyy", "yyyy/MM/dd", "yyyy-MM-dd", "yyyy-MM-dd", "EEE, d MMM yyyy", "M/d/yyyy"]
    added = ["", "", " 1:02:01 PM", " 12:23 am", " 1:00 pm", "T13:02+0530", " 13:02:01.0-02", "", ""]
    text = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN concat(date_format(o_orderdate, '{s}'), '{a}')" for i, (s, a) in enumerate(zip(shown, added))) + " END"
    at = scalars.to_timestamp_lenient(F.expr(text))
    return read(spark, folder, "orders").select((F.col("o_orderkey") % 9).alias("form"), at.alias("at")).groupBy("form").agg(F.count("at").alias("n"), F.sum(F.unix_seconds("at")).alias("seconds"))


@query("period_parts",
       "SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, count(*) AS n FROM orders GROUP BY 1, 2")
def period_parts(spark, folder):
    return read(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        scalars.period_label(F.min("o_orderdate")).alias("first_day"), F.count(F.lit(1)).alias("n")).selectExpr(
        "CAST(year AS BIGINT) AS year", "CAST(quarter AS BIGINT) AS quarter", "first_day", "n")


@query("format_values",
       "SELECT s_suppkey, printf('%.2f%%', s_acctbal / 7) AS as_percent, printf('%.2fx', s_acctbal / 7000) AS as_ratio, format('{:,.2f}', s_acctbal) AS as_currency, "
       "concat(format('{:,}', s_suppkey * 1000), ' days') AS as_days, format('{:,}', s_suppkey * 1000) AS as_count, CASE WHEN s_suppkey % 7 = 0 THEN '—' ELSE format('{:,.2f}', s_acctbal) END AS maybe FROM supplier")
def format_values(spark, folder):
    def shown(value, unit):
        return scalars.format_value(F.expr(value).cast("double"), F.lit(unit))

    return read(spark, folder, "supplier").select(
        "s_suppkey", shown("s_acctbal / 7", "percent").alias("as_percent"), shown("s_acctbal / 7000", "ratio").alias("as_ratio"),
        shown("s_acctbal", "currency").alias("as_currency"), shown("s_suppkey * 1000", "days").alias("as_days"), shown("s_suppkey * 1000", "count").alias("as_count"),
        shown("CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END", "unknown").alias("maybe"))


@query("score_curves",
       "SELECT grade, count(*) AS n, round(avg(rising), 1) AS rising, round(avg(falling), 1) AS falling FROM (SELECT *, CASE WHEN rising >= 90 THEN 'A' WHEN rising >= 80 THEN 'B' WHEN rising >= 70 THEN 'C' WHEN rising >= 60 THEN 'D' ELSE 'F' END AS grade FROM ("
       "SELECT CASE WHEN c_acctbal <= 0 THEN 0 WHEN c_acctbal >= 8000 THEN 100 ELSE round(c_acctbal / 8000 * 100, 2) END AS rising, "
       "CASE WHEN c_acctbal <= 500 THEN 100 WHEN c_acctbal >= 9000 THEN 0 ELSE round((9000 - c_acctbal) / 8500 * 100, 2) END AS falling FROM customer)) GROUP BY 1")
def score_curves(spark, folder):
    balance = F.col("c_acctbal")
    scored = read(spark, folder, "customer").select(
        scalars.rising_score(balance, 0.0, 8000.0).alias("rising"), scalars.falling_score(balance, 500.0, 9000.0).alias("falling"))
    return rounded(scored.groupBy(scalars.grade(F.col("rising")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.avg("rising").alias("rising"), F.avg("falling").alias("falling")), 1)


@query("number_check",
       "SELECT same, count(*) AS n FROM (SELECT list_has_all(regexp_extract_all(b, '(-?\\d[\\d,]*(?:\\.\\d+)?)', 1), regexp_extract_all(a, '(-?\\d[\\d,]*(?:\\.\\d+)?)', 1)) AS same FROM ("
       "SELECT concat('Order ', o_orderkey, ' of customer ', o_custkey, ' in ', year(o_orderdate)) AS a, concat('Customer ', o_custkey, ' placed order ', o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, ' during ', year(o_orderdate)) AS b FROM orders)) GROUP BY 1")
def number_check(spark, folder):
    texts_ = read(spark, folder, "orders").selectExpr(
        "concat('Order ', o_orderkey, ' of customer ', o_custkey, ' in ', year(o_orderdate)) AS a",
        "concat('Customer ', o_custkey, ' placed order ', o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, ' during ', year(o_orderdate)) AS b")
    return texts_.groupBy(scalars.preserves_numbers(F.col("a"), F.col("b")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("collapse_spaces",
       r"SELECT lang, sum(length(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))))::BIGINT AS chars FROM documents GROUP BY 1")
def collapse_spaces(spark, folder):
    return read(spark, folder, "documents").groupBy("lang").agg(F.sum(F.length(scalars.collapse_spaces(F.col("text")))).alias("chars"))


# --- sessions and catalog -------------------------------------------------------
@query("idle_sessions", """SELECT user_id, session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""")
def sessions(spark, folder):
    found = idle_sessions(read(spark, folder, "events"), "user_id", "ts", vocab.SESSION_IDLE_SECONDS)
    return found.select("user_id", "session", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("last"), F.col("events").alias("n"))


_catalog = "SELECT o_orderkey AS dataset_id, o_custkey AS user_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status FROM orders"
step("datasets", _catalog)


def datasets(spark, folder):
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey AS dataset_id", "o_custkey AS user_id", "o_orderdate AS created_at",
        "CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status")


@query("catalog_listing", with_steps("SELECT dataset_id, status FROM datasets WHERE user_id = 7 ORDER BY created_at DESC, dataset_id LIMIT 5 OFFSET 2", "datasets"))
def catalog_listing(spark, folder):
    from tallyscope.sources import catalog

    return catalog.list_datasets(datasets(spark, folder), limit=5, offset=2, user_id=7).select("dataset_id", "status")


@query("catalog_status_counts", with_steps("SELECT status, count(*) AS n FROM datasets GROUP BY 1", "datasets"))
def catalog_status_counts(spark, folder):
    from tallyscope.sources import catalog

    return catalog.status_counts(datasets(spark, folder)).withColumnRenamed("count", "n")


@query("catalog_choices", with_steps("SELECT dataset_id, user_id FROM datasets WHERE status = 'validated' AND dataset_id <> 1", "datasets"))
def catalog_choices(spark, folder):
    from tallyscope.sources import catalog

    return catalog.choices(datasets(spark, folder), exclude_id=1).select("dataset_id", "user_id")


@query("catalog_get", with_steps("SELECT dataset_id, user_id, status FROM datasets WHERE dataset_id = 1 AND user_id = (SELECT user_id FROM datasets WHERE dataset_id = 1)", "datasets"))
def catalog_get(spark, folder):
    from tallyscope.sources import catalog

    every = datasets(spark, folder)
    owner = every.where("dataset_id = 1").select(F.col("user_id").alias("owner"))
    return catalog.get_dataset(every, 1).join(owner, F.col("user_id") == F.col("owner")).select("dataset_id", "user_id", "status")


@query("catalog_delete", with_steps("SELECT status, count(*) AS n FROM datasets WHERE NOT (dataset_id IN (SELECT s_suppkey FROM supplier)) GROUP BY 1", "datasets"))
def catalog_delete(spark, folder):
    from tallyscope.sources import catalog

    gone = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("dataset_id"))
    return catalog.without(datasets(spark, folder), gone).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_lifecycle", "SELECT dataset_id, status, n FROM (SELECT user_id AS dataset_id, event_type AS status, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def catalog_lifecycle(spark, folder):
    from tallyscope.sources import catalog

    log = read(spark, folder, "events").selectExpr("user_id AS dataset_id", "event_type AS status", "ts AS at", "event_id AS seq")
    return catalog.current_status(log).select("dataset_id", "status", F.col("changes").alias("n"))

