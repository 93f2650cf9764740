"""CSV tables, also in older encodings."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.frames import broadcast_if_small
from leafmill.operators.tables import DESCRIPTION, NULL_TOKENS, map_null_tokens
from leafmill.session import checkpointed

# Encodings in the order they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin1")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    null_tokens=NULL_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV table with a header row, every column text, null tokens as nulls.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per
    file.
    """
    df = spark.read.csv(
        path, header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=multi_line
    )
    return map_null_tokens(df, null_tokens)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines ``(path, line)`` of all files, their bytes left as they are.

    ``first_block`` and ``line_no`` (rising within a task) tell where a file begins.
    """
    return spark.read.text(path).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"),
        (F.col("_metadata.file_block_start") == 0).alias("first_block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def _decodes(encoding: str):
    @F.pandas_udf("boolean")
    def check(raw: pd.Series) -> pd.Series:
        def fits(value: bytes) -> bool:
            try:
                value.decode(encoding)
            except UnicodeDecodeError:
                return False
            return True

        return raw.map(fits)

    return check


def detect_encodings(lines: DataFrame) -> DataFrame:
    """The first encoding that fits every line of a file: ``(path, encoding)``.

    Lines are judged one by one and only their verdicts meet, so a large file is
    read by many tasks. UTF-8 is checked in the JVM; Python sees other lines only.
    """
    raw = F.col("line").cast("binary")
    odd = lines.where(~F.is_valid_utf8("line")).select(
        "path", *(_decodes(e)(raw).alias(e) for e in ENCODINGS[1:-1])
    )
    verdict = odd.groupBy("path").agg(*(F.bool_and(e).alias(e) for e in ENCODINGS[1:-1]))
    choice = F.lit(ENCODINGS[-1])
    for encoding in reversed(ENCODINGS[1:-1]):
        choice = F.when(F.col(encoding), encoding).otherwise(choice)
    files = lines.select("path").distinct()
    return files.join(verdict.select("path", choice.alias("encoding")), "path", "left").select(
        "path", F.coalesce("encoding", F.lit(ENCODINGS[0])).alias("encoding")
    )


def decode_lines(lines: DataFrame, encodings: DataFrame) -> DataFrame:
    """Lines as text in the encoding of their file, which is added as ``encoding``."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([r.decode(e) for r, e in zip(raw, encoding, strict=True)], dtype=object)

    known = lines.join(broadcast_if_small(checkpointed(encodings)), "path")
    plain = known.where(F.col("encoding") == ENCODINGS[0])
    other = known.where(F.col("encoding") != ENCODINGS[0])
    return plain.unionByName(
        other.withColumn("line", decode(F.col("line").cast("binary"), F.col("encoding")))
    )


def decode_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines of the files as text, whatever their encoding."""
    lines = read_lines(spark, path)
    return decode_lines(lines, detect_encodings(lines))


def header_lines(decoded: DataFrame) -> DataFrame:
    """The first line of each file: ``(path, header_no, header)``."""
    tops = decoded.where("first_block").groupBy("path").agg(
        F.min("line_no").alias("header_no"), F.min_by("line", "line_no").alias("header")
    )
    return checkpointed(tops)  # a row per file


def body_lines(decoded: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines that are neither a header nor blank."""
    body = decoded.join(broadcast_if_small(headers), "path")
    return body.where((F.col("line_no") != F.col("header_no")) & (F.trim("line") != ""))


def describe_files(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Each CSV file as a short text: ``path, table_rows, table_columns,
    table_columns_list, text, error``. A file that can't be read has an error and no text.

    All files are described at once. Rows are counted on the map side, and a file
    brings only its first three rows together for the preview, which shows the
    values as they stand in the file.
    """
    decoded = decode_files(spark, path)
    headers = header_lines(decoded)
    body = body_lines(decoded, headers)
    counts = body.groupBy("path").agg(F.count(F.lit(1)).alias("table_rows"))
    order = Window.partitionBy("path").orderBy("line_no")
    first = body.where("first_block").withColumn("_n", F.row_number().over(order)).where("_n <= 3")
    shown = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_n", "line"))).alias("_rows"))
    files = headers.join(counts, "path", "left").join(shown, "path", "left")
    no_rows = F.array().cast("array<string>")
    described = _describe(sep)(
        "path", "header", F.coalesce("table_rows", F.lit(0)), F.coalesce("_rows.line", no_rows)
    )
    return files.where(F.trim("header") != "").select("path", described.alias("d")).select("path", "d.*")


def _describe(sep: str):
    names = ["table_rows", "table_columns", "table_columns_list", "text", "error"]

    @F.pandas_udf("table_rows long, table_columns int, table_columns_list string, text string, error string")
    def describe(path: pd.Series, header: pd.Series, rows: pd.Series, first: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, n, lines in zip(path, header, rows, first, strict=True):
            try:
                columns = next(csv.reader([h], delimiter=sep))
                shown = pd.read_csv(io.StringIO("\n".join([h, *lines])), sep=sep)
            except (ValueError, csv.Error) as error:  # of this file only; pandas' parser errors are values errors
                out.append((None, None, None, None, f"unreadable: {error}".strip()))
                continue
            text = DESCRIPTION.format(
                name=p.rsplit("/", 1)[-1],
                rows=n,
                columns=len(columns),
                names=", ".join(columns[:5]) + ("..." if len(columns) > 5 else ""),
                preview=shown.to_string(max_cols=5, max_colwidth=20),
            )
            out.append((n, len(columns), ", ".join(columns), text, None))
        return pd.DataFrame(out, columns=names)

    return describe


def read_csv_any_encoding(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Tables of one header in any of the known encodings, as one frame of text columns.

    Each file opens with the header. Records must not span lines; use
    ``read_csv(multi_line=True)`` for such files.
    """
    decoded = decode_files(spark, path)
    tops = header_lines(decoded)
    headers = [r["header"] for r in tops.select("header").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("the files do not share one header")
    body = body_lines(decoded, tops)
    header = next(csv.reader(headers, delimiter=sep))
    kinds = ", ".join(f"c{i} string" for i in range(len(header)))
    cells = F.from_csv("line", F.lit(kinds), {"sep": sep, "quote": '"', "escape": '"'})
    rows = body.select(cells.alias("cells"))
    return map_null_tokens(rows.select(*(F.col(f"cells.c{i}").alias(name) for i, name in enumerate(header))))
