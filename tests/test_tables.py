import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import analysis as an
from leafmill.operators import tables as tb
from leafmill.operators.charts import CHART_KEYS, chart_frame, repair_mapping


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF(" x\n y ", "  ", "x y", "ok")
    assert tb.clean_names(df).columns == ["x y", "Column_2", "x y.1", "ok"]


def test_clean_names_are_free_in_any_case(spark):
    def named(*names):
        return tb.clean_names(spark.createDataFrame([tuple(range(len(names)))], [f"c{i}" for i in range(len(names))]).toDF(*names)).columns

    assert named("a", "a", "a.1") == ["a", "a.2", "a.1"]
    assert named("ID", "id", "Id") == ["ID", "id.1", "Id.2"]
    assert named("Column_2", " ") == ["Column_2", "Column_2.1"]


def test_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("1234567890123456789", "12345678901234567890"), ("1234567890123456788", "1")], "a string, b string")
    got = tb.optimize_types(df)
    assert dict(got.dtypes) == {"a": "bigint", "b": "string"}
    assert got.select("a").distinct().count() == 2


def test_nan_is_missing_on_every_route(spark):
    nan = float("nan")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, nan, nan, None)], "v double")
    for direct in (0, 10**6):
        row = tb.describe(df, direct_values=direct).first()
        assert (row["count"], row["mean"], row.q25, row.q50, row.q75, row["max"]) == (3, 2.0, 1.5, 2.0, 2.5, 3.0)
        assert sorted(r.v for r in tb.impute_median(df, direct_values=direct).collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]
    assert tb.missing_counts(df).first().missing == 3


def test_table_info_shows_first_values(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "k int, n string")
    got = {r.column: r.sample for r in tb.table_info(df, "k").collect()}
    assert got == {"k": ["0", "1", "2", "3", "4"], "n": ["n0", "n1", "n2", "n3", "n4"]}


def test_types_follow_the_values(spark):
    rows = [("1", "1.5", "2024-01-02", "x", None, "7", "1e3"), ("2", None, "2024-01-02 03:04:05", "2", None, None, "-.5")]
    df = spark.createDataFrame(rows, "i string, f string, t string, s string, n string, g string, e string")
    kinds = {r.column: r.type for r in tb.inferred_types(df).collect()}
    assert kinds == {"i": "bigint", "f": "double", "t": "timestamp", "s": "string", "n": "double", "g": "double", "e": "double"}
    assert dict(tb.optimize_types(df).dtypes) == {**kinds}


def test_float_suffixes_are_text(spark):
    df = spark.createDataFrame([("1d",), ("2f",)], "a string")
    assert tb.inferred_types(df).first().type == "string"


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=4001), "b": rng.integers(0, 4, 4001).astype(float), "c": rng.exponential(size=4001)})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[:, "h"] = np.where(rng.random(4001) < 0.4, 5.0, rng.random(4001) * 10)  # one value holds 40 %
    df = spark.createDataFrame(pdf)
    return pdf, df.select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in df.columns))


@pytest.mark.parametrize("direct", [10**6, 0])
def test_quantiles_are_exact_on_both_routes(numbers, direct):
    pdf, df = numbers
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.column, r.prob): r.value for r in tb.exact_quantiles(df, list(pdf), probs, direct).collect()}
    for c in pdf:
        for p in probs:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), abs=1e-12)


@pytest.mark.parametrize("direct", [10**6, 0])
def test_describe(numbers, direct):
    pdf, df = numbers
    want = pdf.describe()
    for r in tb.describe(df, direct_values=direct).collect():
        assert [r["count"], r.mean, r.std, r.min, r.q25, r.q50, r.q75, r.max] == pytest.approx(list(want[r.column]))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    for direct in (10, 0):
        got = {r.column: r.value for r in tb.exact_quantiles(df, ["a", "b"], [0.5], direct).collect()}
        assert got.get("a") is None and got["b"] == 2.0


def test_fill_missing(spark):
    df = spark.createDataFrame(
        [(1, 5, "b", None), (None, 6, "a", None), (4, 7, None, None), (2, 8, "b", None), (9, 9, "a", None)],
        "n int, full int, s string, e string",
    )
    out = tb.impute_mode(tb.impute_median(df))
    assert [tuple(r) for r in out.collect()][1:3] == [(3.0, 6, "a", "未知"), (4.0, 7, "a", "未知")]
    assert dict(out.dtypes)["full"] == "int"


def test_tidy(spark):
    df = spark.createDataFrame([("1", "NULL"), ("nan", "x"), ("3", "x")], ["  a ", "b\n"])
    assert [tuple(r) for r in tb.tidy(df).collect()] == [(1.0, "x"), (2.0, "x"), (3.0, "x")]


def test_row_index(spark):
    df = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("k"))
    got = tb.row_index(df, "k").collect()
    assert sorted((r.k, r.row_idx) for r in got) == [(i, i) for i in range(5000)]


def test_description_matches_pandas_layout(spark):
    pdf = pd.DataFrame({c: [1, 22, 333, 4] for c in "abcdefg"})
    pdf["a"] = ["x" * 30, "y", "z", "w"]
    text = tb.table_description(spark.createDataFrame(pdf), "t.csv", "b").first().description
    shown = pdf.sort_values("b").reset_index(drop=True).head(3).to_string(max_cols=5, max_colwidth=20)
    assert text == f"表格文件: t.csv\n行数: 4\n列数: 7\n列名: a, b, c, d, e...\n\n数据预览（前3行）:\n{shown}"


def test_share_of_the_published_table(spark):
    rows = [("Clothing", 3516, 139054, 11163), ("Electronics", 1154, 165267, 10494), ("Furniture", 945, 127181, 2298)]
    df = spark.createDataFrame(rows, "category string, q long, a long, p long")
    totals = an.totals_by(df, ["category"], {"total_profit": an.exact(F.col("p"))})
    got = {r.category: r.profit_ratio for r in an.with_share(totals, "total_profit", "profit_ratio").collect()}
    assert got == {"Clothing": 46.599875, "Electronics": 43.807138, "Furniture": 9.592987}


def test_analyze_shapes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert an.analyze(df, "select sum(v) as s from df where k = :k", k="b").first().s == 2
    assert an.analyze(df, lambda d: d.where("v > 1")).count() == 1
    assert an.analyze(df, lambda d: F.sum("v")).first()["结果"] == 3
    assert an.analyze(df, lambda d: {"type": "number", "value": 7}).first()["结果"] == 7
    assert an.analyze(df, lambda d: {"type": "dataframe", "value": d}).count() == 2
    assert an.analyze(df, lambda d: {"x": 1, "y": 2}).columns == ["index", "值"]
    assert an.analyze(df, lambda d: [1, 2, 3]).count() == 3
    assert an.analyze(df, lambda d: None).first()["结果"] is None
    assert an.analyze(df, lambda d: []).columns == ["值"] and an.analyze(df, lambda d: {}).columns == ["index", "值"]
    assert an.analyze(df, lambda d: [("x", 1), ("y", 2)]).columns == ["index", "值"]
    assert an.analyze(df, lambda d: {"type": "series", "index": "city", "value": {"x": 1}}).columns == ["city", "值"]
    named = "with t as (select k, v + 1 as w from df), u as (select max(w) as m from t) select m from u"
    assert an.analyze(df, named).first().m == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("analysis_")]


def test_chart_frame(spark):
    df = spark.createDataFrame([("2024-01-02", "3", "a"), ("bad", "4", "b"), ("2024-01-03", "x", "c"), ("2024-01-04", "5", None)], "d string, v string, s string")
    got = chart_frame(df, "line", {"time": "d", "value": "v"}).collect()
    assert [tuple(r) for r in got] == [("2024-01-02 00:00:00", 3.0), ("2024-01-04 00:00:00", 5.0)]
    assert [r.category for r in chart_frame(df, "pie", {"category": "s", "value": "v"}).collect()] == ["a", "b"]
    grouped = chart_frame(df, "line", {"time": "d", "value": "v", "group": "s"})
    assert grouped.columns == ["time", "value", "group"] and [r.group for r in grouped.collect()] == ["a", None]
    assert chart_frame(df, "pie", {"category": "s"}).count() == 0  # a missing column leaves nothing
    for kind, keys in CHART_KEYS.items():
        assert chart_frame(df, kind, {}).columns == list(keys)


def test_repair_mapping(spark):
    df = spark.createDataFrame([(1, "flow", {"id": "a", "odd": "b"}), (2, "liquid", None)], "id int, kind string, mapping map<string,string>")
    got = {r.id: (r.mapping, r.required) for r in repair_mapping(df).collect()}
    assert got[1] == ({"id": "a", "odd": "b", "from": "", "to": "", "label": ""}, ["id", "from", "to", "label"])
    assert got[2] == ({"value": ""}, ["value"])
