"""Search hits to the cited context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of a snippet and of the reference list.
SNIPPET = ("[片段", "] 来源：", "\n")
REFERENCES = "\n\n---\n**引用：** "
NO_SOURCE = "-"


def _source(source: str) -> Column:
    return F.coalesce(F.col(source), F.lit(NO_SOURCE))


def _per_query(hits: DataFrame, query: str, line: Column, sep: str, name: str) -> DataFrame:
    """Join one line per hit in rank order; a query has at most k hits."""
    lines = hits.select(query, "rank", line.alias("line"))
    joined = F.expr(f"listagg(line, '{sep}') within group (order by rank)")
    return lines.groupBy(query).agg(joined.alias(name))


def assemble_context(
    hits: DataFrame, query: str = "query_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Numbered snippets with their sources, one text per query."""
    opening, named, body = (F.lit(s) for s in SNIPPET)
    line = F.concat(opening, F.col("rank"), named, _source(source), body, F.col(text))
    return _per_query(hits, query, line, "\n\n", "context")


def reference_footer(hits: DataFrame, query: str = "query_id", source: str = "source") -> DataFrame:
    """The list of all cited sources that closes an answer."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), _source(source))
    footers = _per_query(hits, query, line, "; ", "footer")
    return footers.withColumn("footer", F.concat(F.lit(REFERENCES), F.col("footer")))
