"""Cleaning, profiling and describing tables.

Every profile is one aggregation over all columns; results are then turned into
one row per column, so their size depends on the width of the table only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import checkpointed

# The layout of a table description.
DESCRIPTION = "表格文件: {name}\n行数: {rows}\n列数: {columns}\n列名: {names}\n\n数据预览（前3行）:\n{preview}"

# Null tokens of the reader (its own and the usual set of CSV readers),
# the filler for a text column without values, and the name of a scalar result.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
UNKNOWN = "未知"
RESULT = "结果"
VALUE = "值"

QUARTILES = (0.25, 0.5, 0.75)

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"

# Up to this many values, over all columns, the exact percentile buffers them in one
# aggregate; beyond it the ranks are bracketed first.
DIRECT_VALUES = 5_000_000


def _cols_of(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _cols_of(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return _cols_of(df, T.StringType)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _value(df: DataFrame, name: str) -> Column:
    """A column in which NaN is missing like null: the one rule for all profiles."""
    column = F.col(_q(name))
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
        return F.nanvl(column, F.lit(None))
    return column


def clean_names(df: DataFrame) -> DataFrame:
    """Trimmed single-spaced names; a blank one becomes ``Column_<position>``.

    Only the schema is touched. A name that is taken, in any case, gets the first free
    running suffix.
    """
    plain = [" ".join(name.split()) or f"Column_{position}" for position, name in enumerate(df.columns, 1)]
    taken, names = set(), []
    for name in plain:
        own, count = name, 0
        while own.lower() in taken or count and own in plain:
            count += 1
            own = f"{name}.{count}"
        taken.add(own.lower())
        names.append(own)
    return df.toDF(*names)


def map_null_tokens(df: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn null tokens in text columns into nulls."""
    texts = {c: F.when(~F.col(_q(c)).isin(*null_tokens), F.col(_q(c))) for c in text_columns(df)}
    return df.withColumns(texts) if texts else df


def inferred_types(df: DataFrame) -> DataFrame:
    """One row per text column: how many values fit each type, and the type to use.

    All values numeric: a number (``bigint`` only when all are whole, fit it and none is
    missing; whole numbers beyond it stay text, which keeps their digits); else all timestamps: ``timestamp``; else ``string``.
    """
    names = text_columns(df)
    stats = []
    for i, name in enumerate(names):
        c = F.col(_q(name))
        # only what looks whole is cast: each text that is no number would cost an exception
        whole = F.when(c.rlike(INTEGER), F.trim(c)).try_cast("bigint")
        stats += [
            F.count(F.lit(1)).alias(f"rows_{i}"),
            F.count(c).alias(f"present_{i}"),
            F.count_if(c.rlike(NUMBER)).alias(f"numbers_{i}"),
            F.count(whole).alias(f"integers_{i}"),
            F.count_if(c.rlike(INTEGER) & whole.isNull()).alias(f"beyond_{i}"),
            F.count(F.try_to_timestamp(c)).alias(f"times_{i}"),
        ]
    row = df.agg(*stats)
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                *(F.col(f"{k}_{i}").alias(k) for k in ("rows", "present", "numbers", "integers", "beyond", "times")),
            )
            for i, name in enumerate(names)
        )
    )
    number = F.when((F.col("integers") == F.col("rows")) & (F.col("rows") > 0), "bigint").otherwise("double")
    return (
        row.select(F.inline(entries))
        .withColumn(
            "type",
            F.when((F.col("numbers") == F.col("present")) & (F.col("beyond") == 0), number)
            .when(F.col("times") == F.col("present"), "timestamp")
            .otherwise("string"),
        )
    )


def optimize_types(df: DataFrame) -> DataFrame:
    """Cast text columns to their inferred types: one pass to look, one projection."""
    if not text_columns(df):
        return df
    types = {r["column"]: r["type"] for r in inferred_types(df).collect()}  # a row per column
    casts = {}
    for name, kind in types.items():
        c = F.col(_q(name))
        if kind == "timestamp":
            casts[name] = F.try_to_timestamp(c)
        elif kind != "string":
            casts[name] = F.when(c.rlike(NUMBER), F.trim(c)).try_cast(kind)
    return df.withColumns(casts) if casts else df


def _as_rows(row: DataFrame, names: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One wide row to a row per column; ``fields`` maps output name to input prefix."""
    entries = F.array(
        *(
            F.struct(F.lit(n).alias("column"), *(F.col(f"{p}_{i}").alias(o) for o, p in fields.items()))
            for i, n in enumerate(names)
        )
    )
    return row.select(F.inline(entries))


def missing_counts(df: DataFrame) -> DataFrame:
    names = df.columns
    row = df.agg(*(F.count_if(_value(df, n).isNull()).alias(f"m_{i}") for i, n in enumerate(names)))
    return _as_rows(row, names, {"missing": "m"})


def column_info(df: DataFrame) -> DataFrame:
    """Column, non-null count and type."""
    names = df.columns
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    row = df.agg(
        *(F.count(_value(df, n)).alias(f"n_{i}") for i, n in enumerate(names)),
        *(F.max(F.lit(k)).alias(f"t_{i}") for i, k in enumerate(kinds)),
    )
    return _as_rows(row, names, {"non_null": "n", "type": "t"})


def table_info(df: DataFrame, *order: str, sample: int = 5) -> DataFrame:
    """Table size, and the type and missing count of each column.

    With an order each column also has a ``sample``, its first values as text.
    """
    names = df.columns
    shown = head(df, *order, n=sample).select(*(F.col(_q(n)).cast("string").alias(n) for n in names)).collect() if order else []
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(_value(df, n).isNull()).alias(f"m_{i}") for i, n in enumerate(names)),
    )
    entries = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"m_{i}").alias("missing"),
                *([F.array(*(F.lit(r[i]) for r in shown)).cast("array<string>").alias("sample")] if order else []),
            )
            for i, f in enumerate(df.schema.fields)
        )
    )
    return row.select("rows", F.lit(len(names)).alias("columns"), F.inline(entries))


def head(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, *order: str, rows: int = 3, columns: int = 5, width: int = 20) -> DataFrame:
    """The first rows and columns as text cut to ``width`` characters."""
    shown = df.columns[:columns]
    return head(df, *order, n=rows).select(
        *(F.substring(F.col(_q(c)).cast("string"), 1, width).alias(c) for c in shown)
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], direct_values: int = DIRECT_VALUES
) -> DataFrame:
    """Exact linearly interpolated quantiles: rows ``(column, prob, value)``.

    A table of at most ``direct_values`` values goes through ``percentile``, which
    buffers the values in one aggregate. Beyond that no task may hold a column:
    approximate quantiles first bracket each wanted rank, then only the values
    inside the brackets are counted, per distinct value, and ranked.
    """
    numbers = df.select(*(F.col(_q(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    numbers = numbers.select(*(F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in numbers.columns))
    if numbers.count() * len(columns) <= direct_values:
        levels = F.array(*(F.lit(float(p)) for p in probs))
        row = numbers.agg(
            *(F.percentile(f"v{i}", levels).alias(f"q_{i}") for i in range(len(columns))),
        )
        wide = _as_rows(row, columns, {"qs": "q"})
        pairs = F.arrays_zip(levels.alias("prob"), F.col("qs").alias("value"))
        return wide.select("column", F.inline(F.coalesce(pairs, F.array().cast(
            "array<struct<prob:double,value:double>>"))))
    return _bracketed_quantiles(numbers, columns, probs)


def _bracketed_quantiles(numbers: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    spark = numbers.sparkSession
    accuracy = 10_000
    slack = 2.0 / accuracy  # twice the rank error that the accuracy allows
    edges = [e for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    first = numbers.agg(
        *(F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))),
        *(F.min(f"v{i}").alias(f"lo{i}") for i in range(len(columns))),
        *(F.max(f"v{i}").alias(f"hi{i}") for i in range(len(columns))),
        *(F.approx_percentile(f"v{i}", edges, accuracy).alias(f"e{i}") for i in range(len(columns))),
    ).first()  # one row

    targets = []  # column, prob, lower edge, upper edge, fractional rank
    for i in range(len(columns)):
        if not first[f"n{i}"]:
            continue
        for j, p in enumerate(probs):
            lo = first[f"lo{i}"] if edges[2 * j] == 0.0 else first[f"e{i}"][2 * j]
            hi = first[f"hi{i}"] if edges[2 * j + 1] == 1.0 else first[f"e{i}"][2 * j + 1]
            # the neighbouring rank must lie inside as well
            targets.append((i, j, float(lo), float(hi), p * (first[f"n{i}"] - 1)))
    below = numbers.agg(
        *(F.count_if(F.col(f"v{i}") < lo).alias(f"b{i}_{j}") for i, j, lo, _, _ in targets),
        *(F.count_if(F.col(f"v{i}") <= hi).alias(f"u{i}_{j}") for i, j, _, hi, _ in targets),
    ).first()  # one row
    rows, wanted = [], []
    for i, j, lo, hi, rank in targets:
        low, high = int(rank), min(int(rank) + 1, first[f"n{i}"] - 1)
        fits = below[f"b{i}_{j}"] <= low and high < below[f"u{i}_{j}"]
        if not fits:  # an edge missed its rank: take the whole range, still exact
            lo, hi = first[f"lo{i}"], first[f"hi{i}"]
        offset = below[f"b{i}_{j}"] if fits else 0
        rows.append((i, j, columns[i], float(probs[j]), offset, low, high, rank - low))
        wanted.append(F.when(F.col(f"v{i}").between(lo, hi), F.struct(
            F.lit(i).alias("c"), F.lit(j).alias("p"), F.col(f"v{i}").alias("v"))))
    plan = spark.createDataFrame(
        rows, "c int, p int, `column` string, prob double, offset long, low long, high long, part double"
    )  # one row per column and prob
    inside = (
        numbers.select(F.explode(F.array_compact(F.array(*wanted))).alias("x"))
        .groupBy("x.c", "x.p", "x.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    run = Window.partitionBy("c", "p").orderBy("v")
    ranked = inside.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(plan), ["c", "p"])
    first_rank = F.col("offset") + F.col("upto") - F.col("n")
    last_rank = F.col("offset") + F.col("upto") - 1

    def at(rank: str):
        return F.max(F.when((first_rank <= F.col(rank)) & (F.col(rank) <= last_rank), F.col("v")))

    return (
        ranked.groupBy("column", "prob", "part")
        .agg(at("low").alias("a"), at("high").alias("b"))
        .select("column", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))
    )


def columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Of the named columns those that hold a null, found in one pass."""
    found = missing_counts(df.select(*(F.col(_q(c)) for c in columns))).where("missing > 0")
    return [r["column"] for r in found.collect()]  # a row per column


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """Fill nulls of numeric columns with the column's median.

    NaN is filled like null. A whole-number column with nulls becomes ``double``; one without stays as it is.
    """
    gaps = columns_with_gaps(df, list(columns or numeric_columns(df)))
    if not gaps:
        return df
    medians = exact_quantiles(df, gaps, [0.5], direct_values).collect()  # a row per column
    return df.withColumns(
        {
            r["column"]: F.coalesce(_value(df, r["column"]).cast("double"), F.lit(r["value"]))
            for r in medians
            if r["value"] is not None
        }
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value per column, the smallest on ties: ``(column, mode)``.

    Values are counted per column and value before they meet, so a frequent value
    is reduced on the map side and no task holds all distinct values.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(_q(c)).alias("v")) for c in columns))
    counts = (
        df.select(F.inline(pairs))
        .where("v is not null")
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), "v"))["v"].alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None, unknown: str = UNKNOWN) -> DataFrame:
    """Fill nulls of text columns with the column's mode, else with ``unknown``."""
    columns = columns_with_gaps(df, list(columns or text_columns(df)))
    if not columns:
        return df
    modes = {r["column"]: r["mode"] for r in column_modes(df, columns).collect()}  # a row per column
    return df.withColumns(
        {c: F.coalesce(F.col(_q(c)), F.lit(modes.get(c, unknown))) for c in columns}
    )


def tidy(df: DataFrame) -> DataFrame:
    """Names, null tokens, types and missing values, in the order of a table load."""
    df = optimize_types(map_null_tokens(clean_names(df)))
    if numeric_columns(df):
        df = impute_median(df)
    if text_columns(df):
        df = impute_mode(df)
    return df


def describe(df: DataFrame, columns: Sequence[str] | None = None, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum per numeric column.

    NaN counts as missing, on every route.
    """
    columns = list(columns or numeric_columns(df))
    numbers = df.select(*(_value(df, c).cast("double").alias(c) for c in columns))
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    direct = numbers.count() * len(columns) <= direct_values
    if direct:  # one pass for all
        moments["quartiles"] = lambda c: F.percentile(c, F.array(*(F.lit(p) for p in QUARTILES)))
    row = numbers.agg(
        *(f(F.col(_q(c))).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in moments.items())
    )
    rows = _as_rows(row, columns, {k: k for k in moments})
    if direct:
        rows = rows.withColumns({f"q{i}": F.get("quartiles", i) for i in range(3)})
    else:
        ranks = exact_quantiles(numbers, columns, QUARTILES, direct_values)
        wide = ranks.groupBy("column").pivot("prob", list(QUARTILES)).agg(F.max("value"))
        rows = rows.join(wide.toDF("column", "q0", "q1", "q2"), "column", "left")
    return rows.select(
        "column", "count", "mean", "std", "min",
        F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max",
    )


def row_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Number the rows from 0 in ``order``.

    The sort is by range over all tasks. Its result is checkpointed, so the place
    of a row in its partition stays fixed while partition sizes are counted; the
    offsets are one row per partition.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_mid").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (local + F.col("_offset")).cast("long"))
        .drop("_mid", "_part", "_offset")
    )


def table_description(df: DataFrame, file_name: str, *order: str) -> DataFrame:
    """A table as a short text: name, size, first five column names, three rows."""
    names = ", ".join(df.columns[:5]) + ("..." if len(df.columns) > 5 else "")
    rows = head(df, *order, n=3).toPandas()  # three rows
    shown = rows.to_string(max_cols=5, max_colwidth=20)
    before, after = DESCRIPTION.split("{rows}")
    text = F.concat(
        F.lit(before.format(name=file_name)),
        F.col("rows").cast("string"),
        F.lit(after.format(columns=len(df.columns), names=names, preview=shown)),
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(file_name).alias("file_name"), text.alias("description")
    )
