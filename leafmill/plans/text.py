"""Registered queries: text and document transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import chunking as ch
from leafmill.operators import layout
from leafmill.operators.frames import unnest
from leafmill.plans import sql
from leafmill.plans.registry import query
from leafmill.session import load, spread


def documents(spark, sf):
    return spread(load(spark, sf, "documents"), "doc_id")


def markdown_pages(spark, sf):
    pages = spread(load(spark, sf, "pages"), "page_id")
    return pages.select("page_id", tx.html_to_markdown(F.col("html")).alias("text"))


def chunks(spark, sf):
    """The basic chunker over documents, paragraphs ended by one line break."""
    rows = documents(spark, sf).select("doc_id", "lang", "source", "text")
    return ch.chunk_table(rows, separator="\n")


MARKDOWN = sql.strip(sql.rewrite(sql.rewrite("html", tx.HTML_RULES), tx.NORMALIZE_RULES))
MARKS = "(?m)" + "|".join(tx.MARKDOWN_MARKS)


@query(f"SELECT doc_id, {sql.strip('text')} AS text FROM documents")
def clean_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.strip(F.col("text")).alias("text"))


@query(
    r"""
    SELECT p_partkey, CASE WHEN trim(t) = '' THEN t WHEN size >= 16 THEN '### ' || t
             WHEN size >= 14 THEN '#### ' || t WHEN size >= 12 THEN '##### ' || t
             ELSE (CASE WHEN flags & 4 <> 0 THEN '<u>' ELSE '' END) || (CASE WHEN flags & 2 <> 0 THEN '*' ELSE '' END)
               || (CASE WHEN flags & 16 <> 0 THEN '**' ELSE '' END) || t || (CASE WHEN flags & 16 <> 0 THEN '**' ELSE '' END)
               || (CASE WHEN flags & 2 <> 0 THEN '*' ELSE '' END) || (CASE WHEN flags & 4 <> 0 THEN '</u>' ELSE '' END)
           END AS markdown
    FROM (SELECT p_partkey, p_size % 20 AS size, p_partkey % 32 AS flags,
                 CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS t FROM part)
    """
)
def span_markdown(spark, sf):
    spans = load(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name")).alias("t"),
        (F.col("p_size") % 20).alias("size"),
        (F.col("p_partkey") % 32).alias("flags"),
    )
    return spans.select(
        "p_partkey", tx.span_markdown(F.col("t"), F.col("size"), F.col("flags")).alias("markdown")
    )


@query(
    f"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    s AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
    w AS (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM s),
    p AS (SELECT doc_id, line_no // 4 AS block_no, line_no, unnest(ws) || ' ' AS t,
                 generate_subscripts(ws, 1) - 1 AS span_no FROM w),
    m AS (SELECT doc_id, block_no, line_no, span_no,
                 CASE WHEN {sql.strip('t')} = '' THEN t WHEN span_no % 40 = 39 THEN '##### ' || t
                      WHEN line_no % 2 = 1 THEN '**' || t || '**' ELSE t END AS t
          FROM p WHERE block_no % 5 <> 4),
    j AS (SELECT doc_id, block_no, line_no, string_agg(t, '' ORDER BY span_no) AS t FROM m GROUP BY ALL)
    SELECT doc_id, block_no, string_agg(t, chr(10) ORDER BY line_no) AS text
    FROM j WHERE {sql.strip('t')} <> '' GROUP BY doc_id, block_no
    """
)
def block_assemble(spark, sf):
    lines = unnest(documents(spark, sf), ["doc_id"], F.split("text", "\n"), "line", "line_no")
    words = unnest(lines, ["doc_id", "line_no"], F.split("line", " "), "word", "span_no")
    spans = words.select(
        "doc_id",
        F.expr("line_no div 4").alias("block_no"),
        "line_no",
        "span_no",
        F.concat("word", F.lit(" ")).alias("text"),
        F.when(F.col("span_no") % 40 == 39, 12).otherwise(10).alias("size"),
        F.when(F.col("line_no") % 2 == 1, 16).otherwise(0).alias("flags"),
        F.when(F.expr("line_no div 4") % 5 == 4, 1).otherwise(0).alias("block_type"),
    )
    return layout.assemble_blocks(spans, ["doc_id", "block_no"])


@query(
    f"""
    WITH p AS (
      SELECT conv_id, turn, text, '## 第 ' || (turn + 1) || ' 页' || chr(10) ||
             CASE WHEN {sql.strip('text')} = '' THEN '' ELSE chr(10) || chr(10) || text END AS page
      FROM conversations),
    d AS (SELECT conv_id, string_agg(page, chr(10) || chr(10) ORDER BY turn) AS body,
                 arg_min(text, turn) AS first_page FROM p GROUP BY conv_id),
    t AS (SELECT conv_id, body,
                 list_filter({sql.pieces('first_page', chr(10))}, lambda x: length(x) < 100)[1] AS title FROM d)
    SELECT conv_id, title, CASE WHEN title IS NULL THEN body
           ELSE '# ' || title || chr(10) || chr(10) || chr(10) || body END AS markdown
    FROM t
    """
)
def doc_assemble(spark, sf):
    pages = load(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page_no"), "text")
    return layout.assemble_document(pages, "conv_id", "page_no")


@query(
    f"""
    SELECT doc_id, list_filter({sql.pieces('text', chr(10))}, lambda x: length(x) < 100)[1] AS title
    FROM documents
    """
)
def doc_title(spark, sf):
    return documents(spark, sf).select("doc_id", tx.document_title(F.col("text")).alias("title"))


@query(f"SELECT page_id, {sql.strip(sql.rewrite('html', tx.NORMALIZE_RULES))} AS text FROM pages")
def markdown_normalize(spark, sf):
    pages = spread(load(spark, sf, "pages"), "page_id")
    return pages.select("page_id", tx.normalize_markdown(F.col("html")).alias("text"))


@query(f"SELECT doc_id, regexp_matches(text, '{MARKS}') AS is_markdown FROM documents")
def is_markdown(spark, sf):
    return documents(spark, sf).select("doc_id", tx.is_markdown(F.col("text")).alias("is_markdown"))


@query(f"SELECT page_id, {MARKDOWN} AS text FROM pages")
def html_to_markdown(spark, sf):
    return markdown_pages(spark, sf)


@query(f"WITH RECURSIVE {sql.CHUNKS} SELECT doc_id, chunk_index, text FROM chunks")
def chunk_basic(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", "text")


@query(
    f"""
    WITH RECURSIVE {sql.sentence_chunks('documents', 'doc_id', 'text')}
    SELECT doc_id, chunk_index, text FROM sentence_chunks
    """
)
def chunk_sentences(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text")
    return ch.chunk_table(rows, method="sentence")


@query(
    f"""
    WITH RECURSIVE {sql.recursive_chunks('documents', 'doc_id', 'text', ch.RECURSIVE_SEPARATORS)}
    SELECT doc_id, chunk_index, text FROM recursive
    """
)
def chunk_recursive(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text")
    return ch.chunk_table(rows, method="recursive")


@query(
    f"""
    WITH RECURSIVE {sql.sentence_tokens('documents', 'doc_id', 'text')}
    SELECT doc_id, chunk_index, text FROM sentence_tokens
    """
)
def chunk_sentence_tokens(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text")
    return ch.chunk_table(rows, method="sentence_tokens")


@query(
    f"""
    WITH t AS (SELECT doc_id, {sql.tokens('text')} AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 20, 1), 180)) AS s FROM t WHERE len(ws) > 0)
    SELECT doc_id, s // 180 AS chunk_index, array_to_string(ws[s + 1 : s + 200], ' ') AS text FROM s
    """
)
def chunk_token_window(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text")
    return ch.chunk_table(rows, method="token_window")


PAGES_MD = f"pages_md AS (SELECT page_id AS id, {MARKDOWN} AS text FROM pages)"
SECTIONS = f"{PAGES_MD}, {sql.sections('pages_md')}"


@query(f"WITH {SECTIONS} SELECT id AS page_id, chunk_index, path, text FROM sections")
def chunk_markdown_headers(spark, sf):
    rows = unnest(markdown_pages(spark, sf), ["page_id"], ch.markdown_sections(F.col("text")), "s", "chunk_index")
    return rows.select("page_id", "chunk_index", "s.path", "s.text")


@query(
    f"""
    WITH RECURSIVE {PAGES_MD},
    mixed AS (SELECT 'page ' || id AS id, text FROM pages_md UNION ALL SELECT 'document ' || doc_id, text FROM documents),
    marked AS (SELECT * FROM mixed WHERE regexp_matches(text, '{MARKS}')),
    {sql.sections('marked')},
    plain AS (SELECT * FROM mixed WHERE NOT regexp_matches(text, '{MARKS}')),
    {sql.sentence_tokens('plain', 'id', 'text')}
    SELECT id, chunk_index, text FROM sections UNION ALL SELECT id, chunk_index, text FROM sentence_tokens
    """
)
def chunk_auto(spark, sf):
    pages = markdown_pages(spark, sf).select(F.concat_ws(" ", F.lit("page"), "page_id").alias("id"), "text")
    texts = documents(spark, sf).select(F.concat_ws(" ", F.lit("document"), "doc_id").alias("id"), "text")
    return ch.chunk_table(pages.unionByName(texts), method="auto")


@query(
    f"""
    WITH {SECTIONS}
    SELECT id AS page_id, chunk_index AS chunk_id, length(text) AS chunk_size, 'markdown' AS chunk_type,
           regexp_matches(text, '(?m)^#{{1,6}}{sql.WS}+') AS has_headers, contains(text, '```') AS has_code,
           regexp_matches(text, '\\[.*?\\]\\(.*?\\)') AS has_links,
           regexp_matches(text, '(?m)^{sql.WS}*[-*+]{sql.WS}+') AS has_lists
    FROM sections
    """
)
def chunk_features(spark, sf):
    rows = ch.chunk_features(ch.chunk_table(markdown_pages(spark, sf), method="markdown"))
    return rows.drop("text", "chunk_index")


@query(
    f"""
    WITH RECURSIVE {sql.CHUNKS}
    SELECT count(*) AS total_chunks, CAST(sum(length(text)) AS BIGINT) AS total_characters,
           round(avg(length(text)), 6) AS average_chunk_size, min(length(text)) AS min_chunk_size,
           max(length(text)) AS max_chunk_size, count(*) FILTER (WHERE length(text) < 100) AS small,
           count(*) FILTER (WHERE length(text) BETWEEN 100 AND 200) AS medium,
           count(*) FILTER (WHERE length(text) > 200) AS large
    FROM chunks
    """
)
def chunk_stats(spark, sf):
    stats = ch.chunk_stats(chunks(spark, sf))
    return stats.withColumn("average_chunk_size", F.round("average_chunk_size", 6))


@query(
    f"""
    WITH RECURSIVE {sql.CHUNKS}
    SELECT doc_id, source, chunk_index + 1 AS chunk_id, chunk_index, length(chunks.text) AS chunk_size,
           'markdown' AS content_type, 'text_to_chunks' AS processing_stage
    FROM chunks JOIN documents USING (doc_id)
    """
)
def chunk_metadata(spark, sf):
    return ch.enrich_chunks(chunks(spark, sf), "markdown", "text_to_chunks").drop("text", "lang")


@query("SELECT doc_id, text AS block FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, '<python>' || text FROM documents WHERE lang = 'de'")
def extract_block(spark, sf):
    lang, text = F.col("lang"), F.col("text")
    wrapped = (
        F.when(lang == "en", F.concat(F.lit("```python\n"), text, F.lit("\n```\nthe end")))
        .when(lang == "fr", F.concat(F.lit("<python>\n"), text, F.lit("\n</python>")))
        .when(lang == "de", F.concat(F.lit("<python>"), text))
        .otherwise(text)
    )
    return load(spark, sf, "documents").select("doc_id", tx.extract_block(wrapped).alias("block"))


@query(
    """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k
    FROM events
    """
)
def json_structured(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise("7")
    reply = F.concat(F.lit('```json\n{"kind": '), kind, F.lit(', "k": '), k, F.lit("}\n```"))
    parsed = tx.parse_object(reply, {"kind": "string", "k": "number"})
    return load(spark, sf, "events").select("event_id", parsed.alias("o")).select("event_id", "o.kind", "o.k")
