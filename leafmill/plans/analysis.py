"""Registered queries: analysis and chart frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from leafmill.functions.text import tokens
from leafmill.operators import analysis as an
from leafmill.operators import user_functions
from leafmill.operators.charts import CHART_KEYS, chart_frame, repair_mapping
from leafmill.operators.frames import unnest
from leafmill.plans import sql
from leafmill.plans.registry import query
from leafmill.session import load, spread

def sold_parts(spark, sf):
    """Quantity, amount and profit per part, summed before the join with ``part``."""
    price = F.col("l_extendedprice")
    per_part = an.totals_by(
        spread(load(spark, sf, "lineitem"), "l_partkey"),
        ["l_partkey"],
        {
            "quantity": an.exact(F.col("l_quantity")),
            "amount": an.exact(price),
            "profit": an.exact(price * (1 - F.col("l_discount"))),
        },
    )
    return per_part.join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


@query(
    """
    WITH t AS (
      SELECT p_type AS category,
             sum(CAST(l_quantity AS DECIMAL(18,4))) AS q,
             sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS a,
             sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS p
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)
    SELECT category, round(CAST(q AS DOUBLE), 2) AS total_quantity,
           round(CAST(a AS DOUBLE), 2) AS total_amount,
           round(CAST(p AS DOUBLE), 2) AS total_profit,
           round(100 * CAST(p AS DOUBLE) / (SELECT CAST(sum(p) AS DOUBLE) FROM t), 6) AS profit_ratio
    FROM t
    """
)
def category_profit_share(spark, sf):
    sums = {f"total_{m}": F.col(m) for m in ("quantity", "amount", "profit")}
    totals = an.totals_by(sold_parts(spark, sf).withColumnRenamed("p_type", "category"), ["category"], sums)
    shared = an.with_share(totals, "total_profit", "profit_ratio")
    return shared.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in sums})


@query(
    """
    SELECT p_partkey, p_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS total_sales
    FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY p_partkey, p_name ORDER BY total_sales DESC, p_partkey LIMIT 1
    """
)
def top_product(spark, sf):
    totals = sold_parts(spark, sf).select(
        "p_partkey", "p_name", F.col("profit").cast("double").alias("total_sales")
    )
    return an.best_item(totals, "total_sales", "p_partkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top_k_rows(spark, sf):
    customers = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return an.top_k(customers, "c_acctbal", 5, "c_custkey")


@query("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf):
    return an.lookup(load(spark, sf, "customer"), F.col("c_custkey") == 42, "c_name", "c_acctbal")


@query(
    """
    SELECT o_orderpriority, count(*) AS orders, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
    FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
    """
)
def analyze_sql(spark, sf):
    return an.analyze(
        load(spark, sf, "orders"),
        """
        SELECT o_orderpriority, count(*) AS orders,
               round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
        FROM df WHERE o_orderstatus = :status GROUP BY o_orderpriority
        """,
        status="F",
    )


@query(
    """
    SELECT o_orderstatus, count(*) AS orders, max(o_totalprice) AS largest
    FROM orders GROUP BY o_orderstatus
    """
)
def analyze_function(spark, sf):
    return an.analyze(
        load(spark, sf, "orders"),
        lambda df: df.groupBy("o_orderstatus").agg(
            F.count("*").alias("orders"), F.max("o_totalprice").alias("largest")
        ),
    )


@query('SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS "结果" FROM orders')
def scalar_result(spark, sf):
    return an.analyze(
        load(spark, sf, "orders"),
        lambda df: F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2),
    )


# ---- chart frames -------------------------------------------------------------


@query(
    """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "time", CAST(count(*) AS DOUBLE) AS value
    FROM events GROUP BY date_trunc('hour', ts)
    """
)
def chart_time_value(spark, sf):
    hourly = load(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).count()
    return chart_frame(hourly, "line", {"time": "hour", "value": "count"})


@query("SELECT o_orderpriority AS category, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_orderpriority")
def chart_category_value(spark, sf):
    counts = load(spark, sf, "orders").groupBy("o_orderpriority").count()
    return chart_frame(counts, "column", {"category": "o_orderpriority", "value": "count"})


@query("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def chart_xy(spark, sf):
    return chart_frame(load(spark, sf, "lineitem"), "scatter", {"x": "l_quantity", "y": "l_extendedprice"})


@query("SELECT p_retailprice AS value FROM part")
def chart_values(spark, sf):
    return chart_frame(load(spark, sf, "part"), "histogram", {"value": "p_retailprice"})


@query("SELECT CAST(month(o_orderdate) AS DOUBLE) AS x, o_totalprice AS value FROM orders")
def chart_x_value(spark, sf):
    orders = load(spark, sf, "orders").select(F.month("o_orderdate").alias("month"), "o_totalprice")
    return chart_frame(orders, "boxplot", {"x": "month", "value": "o_totalprice"})


@query(
    """
    SELECT n_name AS name, CAST(count(*) AS DOUBLE) AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """
)
def chart_name_value(spark, sf):
    customers = load(spark, sf, "customer").groupBy("c_nationkey").count()
    named = customers.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return chart_frame(named, "treemap", {"name": "n_name", "value": "count"})


@query("SELECT event_type AS stage, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type")
def chart_stage_value(spark, sf):
    counts = load(spark, sf, "events").groupBy("event_type").count()
    return chart_frame(counts, "funnel", {"stage": "event_type", "value": "count"})


@query(
    """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS "time", CAST(count(*) AS DOUBLE) AS value1,
           round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS value2
    FROM events GROUP BY date_trunc('day', ts)
    """
)
def chart_dual(spark, sf):
    daily = (
        load(spark, sf, "events")
        .groupBy(F.date_trunc("day", "ts").alias("day"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total"),
        )
    )
    return chart_frame(daily, "dual_axes", {"time": "day", "value1": "n", "value2": "total"})


@query("SELECT round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*), 6) AS value FROM orders")
def chart_liquid(spark, sf):
    done = F.count_if(F.col("o_orderstatus") == "F") / F.count("*")
    share = load(spark, sf, "orders").agg(F.round(done, 6).alias("share"))
    return chart_frame(share, "liquid", {"value": "share"})


@query(
    f"""
    SELECT text, CAST(count(*) AS DOUBLE) AS value
    FROM (SELECT unnest({sql.tokens('text')}) AS text FROM documents) GROUP BY text
    """
)
def chart_words(spark, sf):
    words = unnest(spread(load(spark, sf, "documents"), "doc_id"), [], tokens(F.col("text")), "word")
    return chart_frame(words.groupBy("word").count(), "word_cloud", {"text": "word", "value": "count"})


@query(
    """
    SELECT o_orderstatus AS source, o_orderpriority AS target, CAST(count(*) AS DOUBLE) AS value
    FROM orders GROUP BY o_orderstatus, o_orderpriority
    """
)
def chart_edges(spark, sf):
    edges = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").count()
    mapping = {"source": "o_orderstatus", "target": "o_orderpriority", "value": "count"}
    return chart_frame(edges, "sankey", mapping)


@query(
    """
    SELECT 'r' || r_regionkey AS id, 'all' AS parent, r_name AS label FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
    """
)
def chart_tree(spark, sf):
    def nodes(table, mark, key, up_mark, up, label):
        parent = F.concat(F.lit(up_mark), F.col(up).cast("string")) if up else F.lit(up_mark)
        return load(spark, sf, table).select(
            F.concat(F.lit(mark), F.col(key).cast("string")).alias("node"),
            parent.alias("above"),
            F.col(label).alias("name"),
        )

    tree = (
        nodes("region", "r", "r_regionkey", "all", None, "r_name")
        .unionByName(nodes("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"))
        .unionByName(nodes("customer", "c", "c_custkey", "n", "c_nationkey", "c_name"))
    )
    return chart_frame(tree, "organization", {"id": "node", "parent": "above", "label": "name"})


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'customer ' || o_custkey AS "from",
           'status ' || o_orderstatus AS "to", o_orderpriority AS label FROM orders
    """
)
def chart_flow(spark, sf):
    flow = load(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("start"),
        F.concat(F.lit("status "), F.col("o_orderstatus")).alias("end"),
        "o_orderpriority",
    )
    mapping = {"id": "o_orderkey", "from": "start", "to": "end", "label": "o_orderpriority"}
    return chart_frame(flow, "flow", mapping)


@query("SELECT DISTINCT p_type AS problem, p_brand AS cause FROM part")
def chart_cause(spark, sf):
    causes = load(spark, sf, "part").select("p_type", "p_brand").distinct()
    return chart_frame(causes, "fishbone", {"problem": "p_type", "cause": "p_brand"})


@query(
    """
    SELECT round(CAST(embedding[1] AS DOUBLE) * 180, 4) AS lng,
           round(CAST(embedding[2] AS DOUBLE) * 90, 4) AS lat FROM embeddings
    """
)
def chart_points(spark, sf):
    points = load(spark, sf, "embeddings").select(
        F.round(F.get("embedding", 0).cast("double") * 180, 4).alias("a"),
        F.round(F.get("embedding", 1).cast("double") * 90, 4).alias("b"),
    )
    return chart_frame(points, "pin_map", {"lng": "a", "lat": "b"})


@query(
    """
    SELECT n_name AS district, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """
)
def chart_district(spark, sf):
    balance = F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2)
    totals = load(spark, sf, "customer").groupBy("c_nationkey").agg(balance.alias("balance"))
    named = totals.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return chart_frame(named, "district_map", {"district": "n_name", "value": "balance"})


@query(
    """
    SELECT sets, CAST(count(*) AS DOUBLE) AS size FROM (
      SELECT '[' || string_agg(event_type, ', ' ORDER BY event_type) || ']' AS sets
      FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id)
    GROUP BY sets
    """
)
def chart_venn(spark, sf):
    kinds = F.array_sort(F.collect_set("event_type"))
    users = load(spark, sf, "events").groupBy("user_id").agg(kinds.alias("kinds"))
    return chart_frame(users.groupBy("kinds").count(), "venn", {"sets": "kinds", "size": "count"})


def _keys_sql(kind: str) -> str:
    missing = "".join(f',"{k}":""' for k in CHART_KEYS[kind] if k != "value")
    return f"WHEN '{kind}' THEN '{missing}'"


@query(
    f"""
    WITH p AS (SELECT event_id AS id, [{', '.join(f"'{k}'" for k in CHART_KEYS)}][event_id % {len(CHART_KEYS)} + 1] AS kind,
                      event_type FROM events)
    SELECT id, kind, '{{"value":"' || event_type || '"' || CASE kind {' '.join(map(_keys_sql, CHART_KEYS))} END || '}}' AS mapping
    FROM p
    """
)
def chart_keys(spark, sf):
    kinds = F.array(*(F.lit(k) for k in CHART_KEYS))
    proposals = load(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.get(kinds, (F.col("event_id") % len(CHART_KEYS)).cast("int")).alias("kind"),
        F.create_map(F.lit("value"), F.col("event_type")).alias("mapping"),
    )
    fixed = repair_mapping(proposals)
    return fixed.select("id", "kind", F.to_json("mapping").alias("mapping"))


# ---- functions of the user's own -------------------------------------------------


class Sessions:
    """Events of one user in order of time; a session ends where half an hour passes without one."""

    def __init__(self):
        self.first = self.last = None
        self.events = 0

    def eval(self, row):
        if self.last is not None and (row["ts"] - self.last).total_seconds() > 1800:
            yield row["user_id"], self.first, self.events
            self.first, self.events = None, 0
        self.user, self.last, self.events = row["user_id"], row["ts"], self.events + 1
        self.first = self.first or row["ts"]

    def terminate(self):
        if self.events:
            yield self.user, self.first, self.events


@query(
    """
    WITH gaps AS (SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, true) AS opens
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(opens::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM gaps)
    SELECT user_id, min(ts) AS started, count(*) AS events FROM numbered GROUP BY user_id, n
    """
)
def user_sessions(spark, sf):
    """A table function over the rows of each user in order."""
    rows = load(spark, sf, "events").select("user_id", "ts", "event_id")
    return user_functions.ordered(rows, Sessions, "user_id long, started timestamp_ntz, events long", ["user_id"], ["ts", "event_id"])


def largest_events(key, frames):
    """The three events of a user with the largest values, from frames that need not fit together."""
    best = None
    for frame in frames:
        both = frame if best is None else pd.concat([best, frame])
        best = both.sort_values(["value", "event_id"], ascending=[False, True]).head(3)
    if best is not None:
        yield best.assign(nth=range(1, len(best) + 1))[["user_id", "nth", "event_id", "value"]]


@query(
    """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth, event_id, value
    FROM events QUALIFY nth <= 3
    """
)
def user_largest_events(spark, sf):
    """A function of the user's own over each group."""
    rows = load(spark, sf, "events").where("value IS NOT NULL").select("user_id", "event_id", "value")
    return user_functions.per_group(rows, ["user_id"], largest_events, "user_id long, nth long, event_id long, value double")


def moments(frame):
    v = frame["value"].dropna()
    return {"n": len(v), "mean": float(v.mean()) if len(v) else 0.0, "squares": float(((v - v.mean()) ** 2).sum()) if len(v) else 0.0}


def merged_moments(states):
    n = int(states["n"].sum())
    mean = float((states["n"] * states["mean"]).sum() / n) if n else 0.0
    return {"n": n, "mean": mean, "squares": float((states["squares"] + states["n"] * (states["mean"] - mean) ** 2).sum())}


def spread_of(frame):
    deviation = (frame["squares"] / frame["n"].where(frame["n"] > 0)) ** 0.5
    return frame.assign(deviation=deviation.round(6), mean=frame["mean"].round(6))[["event_type", "n", "mean", "deviation"]]


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def user_moments(spark, sf):
    """An aggregate of the user's own, by states that merge."""
    rows = load(spark, sf, "events").select("event_type", "value")
    schema = "event_type string, n long, mean double, deviation double"
    return user_functions.aggregated(rows, ["event_type"], moments, merged_moments, "n long, mean double, squares double", spread_of, schema)
