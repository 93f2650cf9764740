"""Registered queries: cleaning and profiling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import analysis as an
from leafmill.operators import tables as tb
from leafmill.plans.registry import query
from leafmill.session import load, spread


def with_gaps(df, column, key, every):
    return df.withColumn(column, F.when(F.col(key) % every != 0, F.col(column)))


def gap(column, key, every):
    return f"CASE WHEN {key} % {every} <> 0 THEN {column} END"


@query('SELECT c_custkey AS "customer key", c_name AS "Column_2", c_acctbal AS "account balance" FROM customer')
def clean_names(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tb.clean_names(rows.toDF(" customer\nkey ", " ", "account\r\n  balance"))


LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "double", "l_suppkey": "bigint", "l_linenumber": "bigint",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp",
}


def _line_sql(position, name):
    value = gap(name, "l_orderkey", 7) if name == "l_partkey" else name
    kind = {"bigint": "count(*)", "double": "count(try_cast({v} AS DOUBLE))", "timestamp": "count(try_cast({v} AS TIMESTAMP))",
            "string": "0"}[LINE_TYPES[name]].format(v=f"CAST({value} AS VARCHAR)")
    return f"""SELECT {position} AS position, '{name}' AS "column", count({value}) AS present, {kind} AS fitting,
                      '{LINE_TYPES[name]}' AS type FROM lineitem"""


@query(" UNION ALL ".join(_line_sql(i, n) for i, n in enumerate(LINE_TYPES)))
def infer_types(spark, sf):
    lines = with_gaps(spread(load(spark, sf, "lineitem"), "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey", 7)
    texts = lines.select(*(F.col(c).cast("string") for c in lines.columns))
    fitting = F.expr(
        "case type when 'bigint' then integers when 'double' then numbers when 'timestamp' then times else 0 end"
    )
    found = tb.inferred_types(texts)
    return found.select("position", "column", "present", fitting.alias("fitting"), "type")


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderstatus
    FROM orders
    """
)
def optimize_types(spark, sf):
    names = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"]
    texts = load(spark, sf, "orders").select(*(F.col(c).cast("string") for c in names))
    return tb.optimize_types(texts).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""
    SELECT event_id, round(coalesce(v, (SELECT quantile_cont({gap('value', 'event_id', 7)}, 0.5) FROM events)), 6) AS value
    FROM (SELECT event_id, {gap('value', 'event_id', 7)} AS v FROM events)
    """
)
def impute_median(spark, sf):
    rows = with_gaps(load(spark, sf, "events"), "value", "event_id", 7).select("event_id", "value")
    return tb.impute_median(rows, ["value"]).withColumn("value", F.round("value", 6))


@query(
    f"""
    SELECT event_id, coalesce({gap('event_type', 'event_id', 7)}, (
      SELECT t FROM (SELECT {gap('event_type', 'event_id', 7)} AS t FROM events)
      WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)) AS event_type, '未知' AS note
    FROM events
    """
)
def impute_mode(spark, sf):
    rows = with_gaps(load(spark, sf, "events"), "event_type", "event_id", 7)
    rows = rows.select("event_id", "event_type", F.lit(None).cast("string").alias("note"))
    return tb.impute_mode(rows)


EVENTS = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) - count({gap(n, 'event_id', 7) if n == 'value' else n}) AS missing FROM events"""
        for n in EVENTS
    )
)
def missing_counts(spark, sf):
    return tb.missing_counts(with_gaps(load(spark, sf, "events"), "value", "event_id", 7))


PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(
    " UNION ALL ".join(
        f"""SELECT count(*) AS rows, 6 AS columns, '{n}' AS "column", '{t}' AS type, count(*) - count({n}) AS missing FROM part"""
        for n, t in PART.items()
    )
)
def table_info(spark, sf):
    return tb.table_info(load(spark, sf, "part"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({gap(n, 'c_custkey', 5) if n == 'c_name' else n}) AS non_null, '{t}' AS type FROM customer"""
        for n, t in CUSTOMER.items()
    )
)
def column_info(spark, sf):
    return tb.column_info(with_gaps(load(spark, sf, "customer"), "c_name", "c_custkey", 5))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head_n(spark, sf):
    return tb.head(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query(
    """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, substr(p_name, 1, 20) AS p_name, substr(p_brand, 1, 20) AS p_brand,
           substr(p_type, 1, 20) AS p_type, CAST(p_size AS VARCHAR) AS p_size
    FROM part ORDER BY part.p_partkey LIMIT 3
    """
)
def table_preview(spark, sf):
    return tb.preview(load(spark, sf, "part"), "p_partkey")


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS count, round(avg({n}), 4) AS mean, round(stddev_samp({n}), 4) AS std,
                   min({n}) AS min, round(quantile_cont({n}, 0.25), 4) AS q25, round(quantile_cont({n}, 0.5), 4) AS q50,
                   round(quantile_cont({n}, 0.75), 4) AS q75, max({n}) AS max FROM lineitem"""
        for n in NUMBERS
    )
)
def describe(spark, sf):
    out = tb.describe(spread(load(spark, sf, "lineitem"), "l_orderkey", "l_linenumber"), NUMBERS)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier ORDER BY s_suppkey LIMIT 3),
    c AS (SELECT i, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b, CAST(s_nationkey AS VARCHAR) AS c, printf('%.2f', s_acctbal) AS d FROM r),
    w AS (SELECT greatest(max(length(a)), 9) AS a, greatest(max(length(b)), 6) AS b, greatest(max(length(c)), 11) AS c,
                 greatest(max(length(d)), 9) AS d FROM c),
    t AS (SELECT -1 AS i, ' ' AS n, 's_suppkey' AS a, 's_name' AS b, 's_nationkey' AS c, 's_acctbal' AS d
          UNION ALL SELECT i, CAST(i AS VARCHAR), a, b, c, d FROM c)
    SELECT 'supplier.csv' AS file_name,
           '表格文件: supplier.csv' || chr(10) || '行数: ' || (SELECT count(*) FROM supplier) || chr(10) || '列数: 4' || chr(10)
           || '列名: s_suppkey, s_name, s_nationkey, s_acctbal' || chr(10) || chr(10) || '数据预览（前3行）:' || chr(10)
           || string_agg(t.n || '  ' || lpad(t.a, CAST(w.a AS INTEGER), ' ') || '  ' || lpad(t.b, CAST(w.b AS INTEGER), ' ') || '  ' || lpad(t.c, CAST(w.c AS INTEGER), ' ')
                         || '  ' || lpad(t.d, CAST(w.d AS INTEGER), ' '), chr(10) ORDER BY t.i) AS description
    FROM t CROSS JOIN w
    """
)
def table_description(spark, sf):
    return tb.table_description(load(spark, sf, "supplier"), "supplier.csv", "s_suppkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_idx FROM orders")
def row_index(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tb.row_index(rows, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "row_idx")


@query(
    """
    WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
                      CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events)
    SELECT event_id AS "event id", round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6) AS value,
           coalesce(kind, (SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind
    FROM e
    """
)
def tidy_table(spark, sf):
    rows = load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias(" event\nid"),
        F.when(F.col("event_id") % 7 == 0, "NULL").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 5 == 0, "nan").otherwise(F.col("event_type")).alias("kind"),
    )
    return tb.tidy(rows).withColumn("value", F.round("value", 6))


GAPS = "CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END"


def _numbers_with_gaps(spark, sf):
    """Values of which one in seven is NaN and one in eleven null."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 != 0, F.col("value"))
    return load(spark, sf, "events").select("event_id", value.alias("value"))


DESCRIBED = f"""
    SELECT 'value' AS "column", count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min,
           round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75,
           max(v) AS max FROM (SELECT {GAPS} AS v FROM events)
"""


def _described(spark, sf, **options):
    out = tb.describe(_numbers_with_gaps(spark, sf), ["value"], **options)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query(DESCRIBED)
def describe_gaps(spark, sf):
    return _described(spark, sf)


@query(DESCRIBED)
def describe_bracketed(spark, sf):
    """The route for large inputs."""
    return _described(spark, sf, direct_values=0)


@query(f"SELECT event_id, round(coalesce({GAPS}, (SELECT quantile_cont({GAPS}, 0.5) FROM events)), 4) AS value FROM events")
def impute_median_gaps(spark, sf):
    return tb.impute_median(_numbers_with_gaps(spark, sf), ["value"]).select("event_id", F.round("value", 4).alias("value"))


@query(
    """
    SELECT 'fits' AS "column", count(*) AS present, count(DISTINCT o_orderkey) AS kept, 'bigint' AS type FROM orders
    UNION ALL SELECT 'beyond', count(*), count(DISTINCT o_orderkey), 'string' FROM orders
    """
)
def infer_long_ids(spark, sf):
    """Whole numbers of 19 and of 29 digits; none may merge."""
    key = F.col("o_orderkey").cast("string")
    rows = load(spark, sf, "orders").select(
        (F.lit(9_000_000_000_000_000_000) + F.col("o_orderkey")).cast("string").alias("fits"),
        F.concat(F.lit("123456789012345678"), F.lpad(key, 11, "0")).alias("beyond"),
    )
    kinds = tb.inferred_types(rows).select("column", "present", "type")
    typed = tb.optimize_types(rows)
    kept = typed.agg(*(F.count_distinct(c).alias(c) for c in typed.columns)).unpivot([], typed.columns, "column", "kept")
    return kinds.join(kept, "column").select("column", "present", "kept", "type")


@query(
    """
    WITH totals AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
    SELECT p_brand, n FROM totals WHERE n >= 10
    """
)
def analyze_with(spark, sf):
    question = "WITH totals AS (SELECT p_brand, count(*) AS n FROM df GROUP BY p_brand) SELECT p_brand, n FROM totals WHERE n >= :least"
    return an.analyze(load(spark, sf, "part"), question, least=10)
