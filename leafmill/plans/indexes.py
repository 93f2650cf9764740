"""Registered queries: changes of a store, its filters, and the indexes for search."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import id_filters, inverted_file, postings, search, store, store_changes
from leafmill.plans import sql
from leafmill.plans.registry import query
from leafmill.plans.text import documents
from leafmill.session import load, scratch, spread


@query(
    """
    SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'again' WHEN quality = 1 THEN 'checked' ELSE source END AS source, n_chars
    FROM documents LEFT JOIN labels USING (doc_id)
    WHERE NOT (lang = 'fr' AND n_chars > 1000) AND doc_id % 10 <> 9
    """
)
def merge_on_read(spark, sf):
    """Two batches, ids deleted, fields patched, some rows added again, rows deleted by a filter, compaction, ids deleted."""
    rows = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels, root = load(spark, sf, "labels"), scratch(spark, "store")
    toxic = labels.where("toxic = 1").select("doc_id")
    store.write_snapshot(rows.where("doc_id % 3 <> 0"), root)
    store.append_rows(rows.where("doc_id % 3 = 0"), root)
    store_changes.delete_rows(spark, root, toxic, "doc_id")
    store_changes.update_rows(spark, root, labels.where("quality = 1").select("doc_id", F.lit("checked").alias("source")), "doc_id")
    store.append_rows(rows.join(toxic, "doc_id", "left_semi").withColumn("source", F.lit("again")), root)
    store_changes.delete_matching(spark, root, {"lang": "fr", "n_chars": {"$gt": 1000}}, "doc_id")
    store_changes.compact(spark, root, "doc_id")
    store_changes.delete_rows(spark, root, rows.where("doc_id % 10 = 9").select("doc_id"), "doc_id")
    return store.read_store(spark, root, key="doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 5 IN (3, 4) OR lang = 'de'")
def filtered_new_rows(spark, sf):
    """What a store of three batches, some rows of it deleted, does not hold, by the filters of its batches."""
    rows, root = load(spark, sf, "documents").select("doc_id", "source", "lang"), scratch(spark, "store")
    for part in range(3):
        store.append_rows(rows.where(F.col("doc_id") % 5 == part), root)
    store_changes.delete_matching(spark, root, {"lang": "de"}, "doc_id")
    return id_filters.unstored(spark, rows.union(rows), root, "doc_id").select("doc_id", "source")


KEPT = f"""
    {sql.KNN_HITS},
    kept AS (SELECT * FROM knn_all WHERE id % 9 <> 4),
    best AS ({sql.ranked('kept')})
    SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM best
"""


def _indexed(spark, sf):
    """A store of vectors that was indexed before a fifth of its rows came and a ninth went."""
    rows, root = load(spark, sf, "embeddings").select("vec_id", "embedding"), scratch(spark, "store")
    store.append_rows(rows.where("vec_id % 5 <> 0"), root)
    inverted_file.index_store(spark, root, "vec_id")
    store.append_rows(rows.where("vec_id % 5 = 0"), root)
    store_changes.delete_rows(spark, root, rows.where("vec_id % 9 = 4").select("vec_id"), "vec_id")
    return root, rows.withColumnRenamed("vec_id", "query_id")


@query(f"WITH {KEPT}")
def knn_index(spark, sf):
    """The inverted file with all its cells, beside later rows and without deleted ones."""
    root, queries = _indexed(spark, sf)
    return inverted_file.search_store(spark, root, queries, target=1.0, key="vec_id", exclude_self=True)


@query(f"WITH {KEPT}")
def knn_index_blocked(spark, sf):
    """The same by the layout for many queries."""
    root, queries = _indexed(spark, sf)
    return inverted_file.search_store(spark, root, queries, target=1.0, key="vec_id", exclude_self=True, query_limit=20)


@query("SELECT count(*) AS queries, 5 * count(*) AS neighbours, true AS met, true AS fewer_cells FROM embeddings")
def index_recall(spark, sf):
    """Whether an index with a target of 0.95 finds 0.9 of the exact neighbours of all vectors at least, in fewer than all cells."""
    rows, path = load(spark, sf, "embeddings").select("vec_id", "embedding"), scratch(spark, "index")
    inverted_file.build_index(spread(rows, "vec_id"), path, "vec_id", cells=24)
    index = inverted_file.load_index(spark, path)
    asked = rows.withColumnRenamed("vec_id", "query_id")
    found = inverted_file.search_index(index, asked, id_type="bigint", exclude_self=True).select("query_id", "id", F.lit(1).alias("hit"))
    true = search.knn(spread(rows, "vec_id"), asked, corpus_id="vec_id", exclude_self=True)
    both = true.join(found, ["query_id", "id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count("*").alias("neighbours"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("met"),
        F.lit(index.probes(inverted_file.TARGET) < len(index.centres)).alias("fewer_cells"),
    )


def _stored_postings(spark, sf):
    docs, path = documents(spark, sf), scratch(spark, "postings")
    postings.add_postings(docs.where("doc_id % 4 > 0"), path)
    postings.add_postings(docs.where("doc_id % 4 = 0"), path)
    return path


@query(f"WITH {sql.BM25_HITS} SELECT query_id, id, score, rank FROM bm25_hits")
def bm25_stored(spark, sf):
    """BM25 from postings that were written in two parts."""
    return postings.search_postings(load(spark, sf, "benchmark"), _stored_postings(spark, sf), query_id="item_id")


@query(f"WITH {sql.BM25_HITS} SELECT query_id, id, score, rank FROM bm25_hits")
def bm25_stored_joined(spark, sf):
    """The same by the layout for many questions."""
    return postings.search_postings(load(spark, sf, "benchmark"), _stored_postings(spark, sf), query_id="item_id", term_limit=10)
