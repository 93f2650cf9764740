"""Styled spans to text blocks, blocks to pages, pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import document_title, is_blank, span_markdown

# Fixed value: the heading of a page.
PAGE_HEADING = "## 第 %d 页\n"

STRETCH = 1000


def _joined(text: str, sep: str, order: str) -> Column:
    return F.expr(f"listagg({text}, '{sep}') within group (order by {order})").alias(text)


def assemble_blocks(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans to one Markdown text per text block.

    ``keys`` name a block; the other columns are ``line_no``, ``span_no``, ``text``,
    ``size``, ``flags`` and ``block_type``. Blank lines go, and so do blocks that
    are not text (type 0). One shuffle brings stretches of lines together, a second
    one the finished stretches of a block.
    """
    styled = spans.where("block_type = 0").select(
        *keys,
        F.floor(F.col("line_no") / STRETCH).alias("_stretch"),
        "line_no",
        "span_no",
        span_markdown(F.col("text"), F.col("size"), F.col("flags")).alias("text"),
    )
    stretch = [*keys, "_stretch"]
    lines = (
        styled.repartition(*stretch)
        .groupBy(*stretch, "line_no")
        .agg(_joined("text", "", "span_no"))
        .where(~is_blank(F.col("text")))
    )
    stretches = lines.groupBy(*stretch).agg(_joined("text", "\n", "line_no"))
    return stretches.groupBy(*keys).agg(_joined("text", "\n", "_stretch"))


def assemble_document(
    pages: DataFrame, doc: str, page_no: str, text: str = "text", meta_title: str | None = None
) -> DataFrame:
    """Pages (numbered from 1) to one Markdown text per document, title first.

    A page keeps its heading even where its text is blank.
    """
    body = F.when(is_blank(F.col(text)), F.lit(None)).otherwise(F.col(text))
    heading = F.format_string(PAGE_HEADING, F.col(page_no).cast("long"))
    parts = pages.select(
        doc,
        F.floor(F.col(page_no) / STRETCH).alias("_stretch"),
        F.col(page_no).alias("_page"),
        F.concat_ws("\n\n", heading, body).alias("text"),
        F.col(text).alias("_raw"),
        (F.col(meta_title) if meta_title else F.lit(None).cast("string")).alias("_meta"),
    )
    stretches = parts.groupBy(doc, "_stretch").agg(
        _joined("text", "\n\n", "_page"),
        F.min_by("_raw", "_page").alias("_raw"),
        F.max("_meta").alias("_meta"),
    )
    whole = stretches.groupBy(doc).agg(
        _joined("text", "\n\n", "_stretch"),
        F.min_by("_raw", "_stretch").alias("_raw"),
        F.max("_meta").alias("_meta"),
    )
    title = document_title(F.col("_raw"), F.col("_meta"))
    top = F.when(title.isNotNull(), F.concat(F.lit("# "), title, F.lit("\n")))
    return whole.select(doc, title.alias("title"), F.concat_ws("\n\n", top, F.col("text")).alias("markdown"))
