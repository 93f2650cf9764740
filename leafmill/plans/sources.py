"""Registered queries: sources, sinks and file-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators.chunking import chunk_table
from leafmill.operators.store import read_store
from leafmill.plans import sql
from leafmill.plans.directory import ingest_directory
from leafmill.plans.registry import query
from leafmill.plans.text import documents
from leafmill.session import load, scratch
from leafmill.sources import csvfiles, files, records


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment,
           'said "' || c_mktsegment || '", twice' AS note FROM customer
    """
)
def csv_scan_roundtrip(spark, sf):
    rows = load(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_custkey") % 9 == 0, "NULL").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.concat(F.lit('said "'), "c_mktsegment", F.lit('", twice')).alias("note"),
    )
    path = scratch(spark, "csv")
    rows.write.csv(path, header=True, escape='"')
    return csvfiles.read_csv(spark, path)


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, CASE WHEN lang <> 'en' THEN 'ÆØÅ' ELSE 'plain' END AS word FROM documents"
)
def csv_encoding_fallback(spark, sf):
    # folders of one language each: UTF-8 for some, Latin-1 for the others
    rows = load(spark, sf, "documents").select(
        F.concat_ws(",", "doc_id", "lang", "n_chars", F.when(F.col("lang") == "en", "plain").otherwise("ÆØÅ")).alias("value"),
        "lang",
    )
    header = "doc_id,lang,n_chars,word"
    path = scratch(spark, "encodings")
    for name, condition, charset in (
        ("utf8", F.col("lang").isin("en", "fr"), "UTF-8"),
        ("latin1", ~F.col("lang").isin("en", "fr"), "ISO-8859-1"),
    ):
        rows.where(condition).select(
            F.lit(None).cast("string").alias(header), "value"
        ).select(F.col("value").alias(header)).write.option("encoding", charset).csv(
            f"{path}/{name}", header=True, quote="", escapeQuotes=False, sep="\x01"
        )
    return csvfiles.read_csv_any_encoding(spark, f"{path}/*")


def _document_files(spark, sf):
    """Documents written as CSV files, one folder per source."""
    path = scratch(spark, "files")
    load(spark, sf, "documents").select("source", "doc_id", "text").write.partitionBy("source").csv(path)
    return path


@query("SELECT DISTINCT source, '.csv' AS extension, true AS filled FROM documents")
def directory_scan(spark, sf):
    found = files.file_facts(files.scan_directory(spark, _document_files(spark, sf) + "/source=*"))
    folder = F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    return found.select(folder, "extension", (F.col("size") > 0).alias("filled")).distinct()


@query(
    """
    SELECT 'source=' || source AS folder, '.csv' AS extension, CAST(sum(strlen(text) + 1) AS BIGINT) AS size,
           true AS named, true AS hashed FROM (SELECT source, CAST(doc_id AS VARCHAR) AS text FROM documents)
    GROUP BY source
    """
)
def file_facts(spark, sf):
    path = scratch(spark, "files")
    load(spark, sf, "documents").select("source", "doc_id").write.partitionBy("source").csv(path)
    facts = files.file_facts(files.list_files(spark, path, "*.csv", recursive=True), with_hash=True)
    folder = F.element_at(F.split("path", "/"), -2)
    return facts.groupBy(folder.alias("folder"), "extension").agg(
        F.sum("size").alias("size"),
        F.bool_and(F.endswith("path", "name")).alias("named"),
        F.bool_and(F.length("hash") == 32).alias("hashed"),
    )


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))


EXT = "CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.csv' WHEN 'de' THEN '.xlsx' ELSE '.txt' END"
GATE = f"""
    g AS (SELECT doc_id, {EXT} AS file_type, n_chars,
                 CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unsupported format'
                      WHEN n_chars / 1048576.0 > 0.005 THEN 'file too large' END AS reason
          FROM documents)
"""


def _checked(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.expr(EXT).alias("file_type"), "n_chars")
    return files.check_files(rows, F.col("file_type"), F.col("n_chars"), max_mb=0.005)


@query(f"WITH {GATE} SELECT doc_id, file_type, n_chars, reason, reason IS NULL AS accepted FROM g")
def size_gate(spark, sf):
    return _checked(spark, sf)


@query(
    f"""
    WITH RECURSIVE {GATE}, {sql.CHUNKS},
    made AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
    SELECT doc_id, file_type, CASE WHEN reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS chunks_count,
           coalesce(reason, CASE WHEN coalesce(n, 0) = 0 THEN 'empty result' END) AS error_message,
           coalesce(reason, CASE WHEN coalesce(n, 0) = 0 THEN 'empty result' END) IS NULL AS success
    FROM g LEFT JOIN made USING (doc_id)
    """
)
def ingest_ledger(spark, sf):
    chunks = chunk_table(documents(spark, sf).select("doc_id", "text"), separator="\n")
    return files.ingest_ledger(_checked(spark, sf), chunks, "doc_id").select(
        "doc_id", "file_type", "chunks_count", "error_message", "success"
    )


@query(
    """
    SELECT source, true AS success, count(*) AS table_rows, 3 AS table_columns, 'doc_id, lang, n_chars' AS table_columns_list
    FROM documents GROUP BY source
    """
)
def directory_ingest(spark, sf):
    folder, root = scratch(spark, "tables"), scratch(spark, "store")
    rows = load(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    rows.write.partitionBy("source").csv(folder, header=True)
    ledger = ingest_directory(spark, f"{folder}/source=*", root)
    named = F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    outcome = ledger.groupBy(named).agg(F.bool_and("success").alias("success"))
    stored = read_store(spark, root)
    tables = stored.select(
        F.regexp_extract("source", "source=([^/]+)/", 1).alias("source"),
        F.col("source").alias("path"), "table_rows", "table_columns", "table_columns_list",
    ).distinct()
    sums = tables.groupBy("source", "table_columns", "table_columns_list").agg(F.sum("table_rows").alias("table_rows"))
    return outcome.join(sums, "source")


@query(
    """
    SELECT c_custkey, CASE WHEN c_nationkey % 7 = 0 THEN '{"key":"' || c_custkey || '","name":"' || c_name || '"}'
           ELSE '{"key":"' || c_custkey || '","name":"' || c_name || '","segment":"' || c_mktsegment || '"}' END AS record
    FROM customer
    """
)
def rows_to_records(spark, sf):
    full = F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    short = F.col("c_nationkey") % 7 == 0
    cells = F.when(short, F.slice(full, 1, 2)).otherwise(full)
    rows = load(spark, sf, "customer").select("c_custkey", cells.alias("cells"))
    return records.rows_to_records(rows, ["key", "name", "segment"]).drop("cells")


@query(
    """
    SELECT vec_id, label, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
           (SELECT count(*) FROM embeddings) AS total_documents, 'document_chunks' AS collection_name FROM embeddings
    """
)
def export_rows(spark, sf):
    store = load(spark, sf, "embeddings")
    path = scratch(spark, "export")
    envelope = records.export_json(store, path, "document_chunks", F.current_timestamp())
    back = records.read_export(spark, path, store.schema)
    return back.select(
        "vec_id",
        "label",
        F.size("embedding").cast("long").alias("dim"),
        F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"),
        envelope.select("total_documents").scalar().alias("total_documents"),
        envelope.select("collection_name").scalar().alias("collection_name"),
    )


@query(
    """
    SELECT md5(text) AS id, min(source) AS source FROM documents
    WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) GROUP BY text
    """
)
def import_skip_dups(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("id"), "source")
    store = docs.join(load(spark, sf, "labels"), "doc_id")
    incoming = docs.groupBy("id").agg(F.min("source").alias("source"))
    path = scratch(spark, "import")
    records.export_json(incoming, path, "incoming", F.current_timestamp())
    rows = records.read_export(spark, path, incoming.schema)
    return records.import_rows(rows, store)


@query("SELECT source || '_processed.md' AS file, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def processed_write(spark, sf):
    docs = load(spark, sf, "documents").select(F.concat("source", F.lit(".pdf")).alias("name"), "text")
    folder = records.write_processed(docs, scratch(spark, "processed"), "name", "text")
    lines = spark.read.text(folder)
    counts = docs.groupBy(F.regexp_replace("name", r"\.pdf$", "_processed.md").alias("file")).agg(
        F.count("*").alias("documents"), F.sum(F.size(F.split("text", "\n"))).alias("_lines")
    )
    # every line break in the files ends a line; those inside documents count as characters
    read = lines.groupBy("file").agg(F.sum(F.length("value")).alias("_chars"), F.count("*").alias("_read"))
    return counts.join(read.where("_read > 0"), "file").select(
        "file", "documents", (F.col("_chars") + F.col("_read") - F.col("documents")).alias("chars")
    )


@query(
    """
    SELECT source || '_processed.md' AS file, '.txt' AS extension, CAST(sum(strlen(text) + 1) AS BIGINT) AS size
    FROM documents GROUP BY source
    """
)
def processed_list(spark, sf):
    docs = load(spark, sf, "documents").select("source", "text")
    folder = records.write_processed(docs, scratch(spark, "processed"), "source", "text")
    found = files.file_facts(files.list_files(spark, f"{folder}/file=*_processed.*", "part-*"))
    name = F.regexp_extract("path", "file=([^/]+)/", 1)
    return found.groupBy(name.alias("file"), "extension").agg(F.sum("size").alias("size"))


@query(
    """
    SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(props, ts) AS props,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS saved_time FROM events GROUP BY user_id
    """
)
def metadata_latest(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "event_id", "props", F.col("ts").alias("saved_time"))
    latest = records.latest_metadata(rows, "user_id", "saved_time", "event_id")
    return latest.withColumn("saved_time", F.date_format("saved_time", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY")
def retention_keep(spark, sf):
    now = F.lit("2024-02-10 00:00:00").cast("timestamp")
    return files.retain(load(spark, sf, "events"), "ts", now).select("event_id", "event_type")


@query(
    """
    SELECT s AS name, coalesce(round(b / 1048576, 2), 0.0) AS size_mb FROM (
      SELECT DISTINCT source AS s FROM documents UNION ALL SELECT 'absent')
    LEFT JOIN (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS b FROM documents GROUP BY source) ON s = source
    """
)
def storage_usage(spark, sf):
    docs = load(spark, sf, "documents")
    names = docs.select(F.col("source").alias("name")).distinct().union(spark.sql("select 'absent'"))
    return files.storage_usage(docs, "source", "n_chars", names)
