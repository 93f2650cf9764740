"""Registered queries: embedding, the chunk store and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import vectors as vx
from leafmill.operators import context, embedding, lexical, search, store, store_changes
from leafmill.operators.frames import unnest
from leafmill.plans import sql
from leafmill.plans.ingest import ingest, prepare_chunks
from leafmill.plans.registry import query
from leafmill.plans.text import documents
from leafmill.session import load, scratch, spread
from leafmill.streaming.ingest_stream import document_stream, start_ingest

# ---- embedding ----------------------------------------------------------------

NOW = "2024-03-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def embedded_documents(spark, sf):
    return embedding.embed_rows(documents(spark, sf).select("doc_id", "source", "lang", "text"))


def cache_table(spark, sf):
    """Vectors of ``embeddings`` as cache entries for the documents of the same number."""
    age = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 5).cast("int"))
    docs = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    return docs.join(load(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")).select(
        "text_hash", "embedding", (now() - F.make_dt_interval(F.lit(10)) - age).alias("cached_at"), "vec_id"
    )


CACHE = f"""
    cache AS (SELECT md5(text) AS text_hash, embedding, TIMESTAMP '{NOW}' - INTERVAL 10 DAY - to_minutes(5 * doc_id) AS cached_at
              FROM documents JOIN embeddings ON doc_id = vec_id),
    fresh AS (SELECT text_hash, arg_max(embedding, cached_at) AS embedding FROM cache
              WHERE cached_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY - INTERVAL 1 DAY GROUP BY text_hash)
"""
EXPIRE = 11


@query("SELECT doc_id, CASE WHEN length(text) * 1.5 > 512 THEN substr(text, 1, 341) ELSE text END AS text FROM documents")
def truncate_budget(spark, sf):
    return load(spark, sf, "documents").select("doc_id", vx.truncate_to_budget(F.col("text")).alias("text"))


@query(
    f"""
    WITH {sql.hashed('documents', 'doc_id', 'text', 'dv')}
    SELECT doc_id, dim, round(x, 5) AS weight FROM dv
    """
)
def hash_embed(spark, sf):
    vectors = unnest(embedded_documents(spark, sf), ["doc_id"], F.col("embedding"), "x", "dim")
    return vectors.where("x > 0").select("doc_id", "dim", F.round(F.col("x").cast("double"), 5).alias("weight"))


@query(f"WITH {CACHE} SELECT DISTINCT md5(text) AS text_hash, md5(text) IN (SELECT text_hash FROM fresh) AS hit FROM documents")
def cache_split(spark, sf):
    found = embedding.cache_lookup(load(spark, sf, "documents"), cache_table(spark, sf), now(), expire_days=EXPIRE)
    return found.select("text_hash", F.col("embedding").isNotNull().alias("hit"))


MERGED = f"""
    WITH {CACHE}, {sql.hashed('documents', 'doc_id', 'text', 'dv')},
    new AS (SELECT doc_id, sum(x) AS total FROM dv GROUP BY doc_id),
    merged AS (
      SELECT doc_id, md5(text) AS text_hash, f.text_hash IS NOT NULL AS cached,
             CASE WHEN f.text_hash IS NULL THEN round(total, 4)
                  ELSE round(list_sum(CAST(f.embedding AS DOUBLE[])), 4) END AS total
      FROM documents JOIN new USING (doc_id) LEFT JOIN fresh f ON md5(text) = f.text_hash)
"""


def _total(vector="embedding"):
    return F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)


@query(f"{MERGED} SELECT DISTINCT text_hash, cached, total FROM merged")
def cache_merge(spark, sf):
    rows = spread(load(spark, sf, "documents"), "doc_id")
    merged = embedding.embed_with_cache(rows, cache_table(spark, sf), now(), expire_days=EXPIRE)
    return merged.select("text_hash", "cached", _total().alias("total"))


@query(f"{MERGED} SELECT doc_id, cached, total FROM merged")
def attach_embeddings(spark, sf):
    rows = spread(load(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    merged = embedding.embed_with_cache(rows, cache_table(spark, sf), now(), expire_days=EXPIRE)
    return embedding.attach_embeddings(rows, merged).select("doc_id", "cached", _total().alias("total"))


def _mixed(spark, sf):
    """Vectors with some cut short, some emptied and some holding a NaN."""
    short, nan = F.slice("embedding", 1, 32), F.array(F.lit(float("nan")).cast("float"))
    kind = F.col("vec_id") % 10
    vector = (
        F.when(kind == 1, short).when(kind == 2, F.slice("embedding", 1, 0)).when(kind == 3, F.concat(short, nan))
    ).otherwise(F.col("embedding"))
    return load(spark, sf, "embeddings").select("vec_id", vector.alias("embedding"))


@query(
    """
    SELECT vec_id, vec_id % 10 NOT IN (2, 3) AS valid, 'unusual' AS dimension_class,
           CASE vec_id % 10 WHEN 1 THEN 32 WHEN 2 THEN 0 WHEN 3 THEN 33 ELSE len(embedding) END AS dim
    FROM embeddings
    """
)
def vector_valid(spark, sf):
    vector = F.col("embedding")
    return _mixed(spark, sf).select(
        "vec_id",
        vx.is_valid(vector).alias("valid"),
        vx.dimension_class(vector).alias("dimension_class"),
        F.size(vector).cast("long").alias("dim"),
    )


@query(
    """
    SELECT vec_id, CASE WHEN vec_id % 10 IN (2, 3) THEN 'invalid vector' WHEN vec_id % 10 = 1 THEN 'dimension mismatch' END AS reason,
           vec_id % 10 NOT IN (1, 2, 3) AS accepted FROM embeddings
    """
)
def dim_guard(spark, sf):
    return store.guard_dimension(_mixed(spark, sf), load(spark, sf, "embeddings")).drop("embedding")


@query(
    """
    SELECT count(*) AS entries, CAST(sum(4 * len(embedding)) AS BIGINT) AS total_bytes,
           round(sum(4 * len(embedding)) / 1048576, 6) AS total_mb, 30 AS expire_days FROM embeddings
    """
)
def cache_info(spark, sf):
    return embedding.cache_info(load(spark, sf, "embeddings"))


# ---- chunk store --------------------------------------------------------------

METADATA = ["chunk_id", "chunk_index", "chunk_size", "content_type", "lang", "processing_stage", "source"]
IDS = rf"""
    ids AS (
      SELECT doc_id, chunk_index, c.text, source, lang, md5(c.text || '_' || '{{"chunk_id": ' || (chunk_index + 1)
             || ', "chunk_index": ' || chunk_index || ', "chunk_size": ' || length(c.text)
             || ', "content_type": "markdown", "lang": "' || lang || '", "processing_stage": "text_to_chunks", "source": "'
             || source || '"}}') AS id
      FROM chunks c JOIN documents USING (doc_id))
"""


def identified(spark, sf):
    rows = documents(spark, sf).select("doc_id", "lang", "source", "text")
    return prepare_chunks(rows, METADATA, separator="\n")


@query(f"WITH RECURSIVE {sql.CHUNKS}, {IDS} SELECT doc_id, chunk_index, id FROM ids")
def chunk_id(spark, sf):
    return identified(spark, sf).select("doc_id", "chunk_index", "id")


@query(
    f"""
    WITH RECURSIVE {sql.CHUNKS}, {IDS}
    SELECT DISTINCT id, text FROM ids
    WHERE id NOT IN (SELECT id FROM ids JOIN labels USING (doc_id))
    """
)
def dedup_new(spark, sf):
    rows = identified(spark, sf)
    known = rows.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return store.new_rows(rows, known).select("id", "text")


@query(
    f"""
    SELECT DISTINCT md5(text || '_' || '{{"lang": "' || lang || '", "source": "' || source || '"}}') AS id
    FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 13 <> 0
    """
)
def add_documents(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    # some rows lack a text, some have a vector of the wrong dimension
    rows = docs.select(
        F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"), "lang", "source", "embedding"
    )
    root = scratch(spark, "store")
    store_changes.add_documents(spark, rows.where("lang = 'en'"), root, ["lang", "source"])
    store_changes.add_documents(spark, rows, root, ["lang", "source"])
    return store.read_store(spark, root).select("id")


ADDED = """SELECT DISTINCT md5(text || '_' || '{{"lang": "' || lang || '", "source": "' || source || '"}}') AS id
    FROM documents JOIN embeddings ON doc_id = vec_id WHERE {}"""


def with_vectors(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return docs.select("doc_id", "text", "lang", "source", "embedding")


@query(ADDED.format("true"))
def add_to_snapshot(spark, sf):
    """A snapshot of half the rows, then all rows added."""
    root, rows = scratch(spark, "store"), with_vectors(spark, sf)
    first = store.with_chunk_id(rows.where("doc_id % 2 = 0"), ["lang", "source"])
    store.write_snapshot(store.new_rows(first, None), root)
    store_changes.add_documents(spark, rows, root, ["lang", "source"])
    return store.read_store(spark, root).select("id")


@query(ADDED.format("lang = 'en'"))
def add_after_reset(spark, sf):
    root, rows = scratch(spark, "store"), with_vectors(spark, sf)
    store_changes.add_documents(spark, rows, root, ["lang", "source"])
    store.reset_store(spark, root)
    store_changes.add_documents(spark, rows.where("lang = 'en'"), root, ["lang", "source"])
    return store.read_store(spark, root).select("id")


@query(ADDED.format("doc_id % 5 <> 0"))
def add_mixed_dimensions(spark, sf):
    """Every fifth vector of the first batch is cut short."""
    root, rows = scratch(spark, "store"), with_vectors(spark, sf)
    short = F.when(F.col("doc_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    store_changes.add_documents(spark, rows.withColumn("embedding", short), root, ["lang", "source"])
    return store.read_store(spark, root).select("id")


@query("SELECT vec_id, label FROM embeddings JOIN labels ON vec_id = doc_id")
def get_by_ids(spark, sf):
    ids = load(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return store.get_by_ids(load(spark, sf, "embeddings"), ids, "vec_id").select("vec_id", "label")


@query(
    """
    SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'checked' END, source) AS source, lang, quality IS NOT NULL AS updated
    FROM documents LEFT JOIN labels USING (doc_id)
    """
)
def partial_update(spark, sf):
    patch = load(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "checked").alias("source"))
    return store.partial_update(load(spark, sf, "documents").select("doc_id", "source", "lang"), patch, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_ids(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "source")
    return store.delete_ids(rows, load(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE NOT (lang = 'fr' AND (n_chars > 1000 OR source IN ('src1', 'src2')))")
def delete_where(spark, sf):
    condition = {"lang": "fr", "$or": [{"n_chars": {"$gt": 1000}}, {"source": {"$in": ["src1", "src2"]}}]}
    return store.delete_where(load(spark, sf, "documents"), condition).select("doc_id", "lang")


@query(
    """
    SELECT count(*) AS total_documents, max(len(embedding)) AS vector_dimension,
           'document_chunks' AS collection_name, 'cosine' AS distance_metric FROM embeddings
    """
)
def store_stats(spark, sf):
    return store.store_stats(load(spark, sf, "embeddings"))


@query("SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after, 'vec_id,embedding,label' AS columns FROM embeddings")
def reset_empty(spark, sf):
    root = scratch(spark, "store")
    first = store.write_snapshot(load(spark, sf, "embeddings"), root)
    store.reset_store(spark, root)
    after = store.read_store(spark, root)
    return store.read_store(spark, root, first).agg(
        F.count("*").alias("rows_before"),
        F.max(after.agg(F.count("*")).scalar()).alias("rows_after"),
        F.max(F.lit(",".join(after.columns))).alias("columns"),
    )


@query("SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def snapshot_roundtrip(spark, sf):
    root, backup = scratch(spark, "store"), scratch(spark, "backup")
    first = store.write_snapshot(load(spark, sf, "embeddings"), root)
    store.copy_store(spark, root, backup)
    store.write_snapshot(store.delete_where(store.read_store(spark, root), {"label": {"$lt": 5}}), root)
    store.restore_snapshot(spark, root, first)
    saved = store.read_store(spark, backup).select("vec_id")
    return store.read_store(spark, root).join(saved, "vec_id").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


STREAMED = f"""
    WITH RECURSIVE {sql.CHUNKS}, {IDS}
    SELECT DISTINCT id, text, source FROM ids
"""


@query(STREAMED)
def ingest_batch(spark, sf):
    root = scratch(spark, "store")
    rows = documents(spark, sf).select("doc_id", "lang", "source", "text")
    ingest(spark, rows, root, METADATA, separator="\n")
    return store.read_store(spark, root).select("id", "text", "source")


@query(STREAMED)
def ingest_after_blanks(spark, sf):
    """The first documents are blank; the real ones come next."""
    root = scratch(spark, "store")
    rows = documents(spark, sf).select("doc_id", "lang", "source", "text")
    ingest(spark, rows.withColumn("text", F.lit(" ")), root, METADATA, separator="\n")
    ingest(spark, rows, root, METADATA, separator="\n")
    return store.read_store(spark, root).select("id", "text", "source")


@query(STREAMED)
def stream_ingest(spark, sf):
    root = scratch(spark, "store")
    schema = load(spark, sf, "documents").schema
    stream = document_stream(spark, f"{sf}/documents*.parquet", schema).select("doc_id", "lang", "source", "text")
    start_ingest(stream, root, scratch(spark, "progress"), METADATA, separator="\n").awaitTermination()
    return store.read_store(spark, root).select("id", "text", "source")


# ---- retrieval ----------------------------------------------------------------


def all_neighbours(spark, sf, **options):
    rows = spread(load(spark, sf, "embeddings"), "vec_id")
    return search.knn(rows, load(spark, sf, "embeddings"), corpus_id="vec_id", query_id="vec_id", exclude_self=True, **options)


def text_hits(spark, sf, **options):
    questions = load(spark, sf, "benchmark")
    return search.text_search(
        embedded_documents(spark, sf), questions, corpus_id="doc_id", query_id="item_id", **options
    )


def bm25_hits(spark, sf, k=5):
    return lexical.bm25(documents(spark, sf), load(spark, sf, "benchmark"), k, query_id="item_id")


@query(f"WITH {sql.KNN_HITS} SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM knn_hits")
def knn_cosine(spark, sf):
    return all_neighbours(spark, sf)


@query(
    f"""
    WITH {sql.KNN_HITS}, f AS (SELECT a.* FROM knn_all a JOIN embeddings e ON e.vec_id = a.id WHERE e.label IN (1, 3) OR e.label >= 8),
    best AS ({sql.ranked('f')})
    SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM best
    """
)
def knn_filtered(spark, sf):
    return all_neighbours(spark, sf, filter_metadata={"$or": [{"label": {"$in": [1, 3]}}, {"label": {"$gte": 8}}]})


@query(f"WITH {sql.KNN_HITS} SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM knn_hits")
def knn_blocked(spark, sf):
    """The layout for many queries."""
    return all_neighbours(spark, sf, query_limit=10)


@query(
    f"""
    WITH {sql.KNN_HITS}, f AS (SELECT * FROM knn_all WHERE id % 7 <> 0 AND query_id % 11 <> 0),
    best AS ({sql.ranked('f')})
    SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM best
    """
)
def knn_unusable(spark, sf):
    """One corpus vector in seven is null or holds a NaN, one query vector in eleven is empty."""
    rows = spread(load(spark, sf, "embeddings"), "vec_id")
    nan = F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float"))
    broken = F.when(F.col("vec_id") % 14 == 0, nan).when(F.col("vec_id") % 7 != 0, F.col("embedding"))
    empty = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))
    return search.knn(
        rows.withColumn("embedding", broken), rows.withColumn("embedding", empty), corpus_id="vec_id", query_id="vec_id", exclude_self=True
    )


@query("SELECT CAST(0 AS BIGINT) AS hits, count(*) AS queries FROM embeddings")
def knn_dim_mismatch(spark, sf):
    rows = load(spark, sf, "embeddings")
    short = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    hits = search.knn(rows, short, corpus_id="vec_id", query_id="vec_id")
    found = hits.agg(F.count("*")).scalar()
    return short.agg(F.count("*").alias("queries")).select(found.alias("hits"), "queries")


@query(f"WITH {sql.TEXT_HITS} SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM text_hits")
def text_search(spark, sf):
    return text_hits(spark, sf)


@query(
    f"""
    WITH {sql.TEXT_HITS}
    SELECT query_id, id AS chunk_index, score AS similarity_score, source
    FROM text_hits JOIN documents ON id = doc_id WHERE rank = 1
    """
)
def best_match(spark, sf):
    questions = embedding.embed_rows(load(spark, sf, "benchmark"))
    best = search.best_match(embedded_documents(spark, sf), questions, corpus_id="doc_id", query_id="item_id")
    named = load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_index"), "source")
    return best.join(named, "chunk_index")


@query(f"WITH {sql.BM25_HITS} SELECT query_id, id, score, rank FROM bm25_hits")
def bm25(spark, sf):
    return bm25_hits(spark, sf)


@query(f"WITH {sql.BM25_HITS} SELECT query_id, id, score, rank FROM bm25_hits")
def bm25_blocked(spark, sf):
    """The layout for many questions."""
    return lexical.bm25(documents(spark, sf), load(spark, sf, "benchmark"), 5, query_id="item_id", query_limit=1)


@query(
    f"""
    WITH {sql.BM25_HITS.replace('rank <= 5', 'rank <= 20')}, {sql.TEXT_HITS.replace('rank <= 5', 'rank <= 20')},
    fused AS (
      SELECT query_id, id, round(coalesce(1.0 / CAST(60 + b.rank AS DOUBLE), 0) + coalesce(1.0 / CAST(60 + t.rank AS DOUBLE), 0), 6) AS score
      FROM bm25_hits b FULL OUTER JOIN text_hits t USING (query_id, id)),
    best AS ({sql.ranked('fused')})
    SELECT query_id, id, score, rank FROM best
    """
)
def hybrid_rrf(spark, sf):
    return lexical.fuse_ranks(bm25_hits(spark, sf, 20), text_hits(spark, sf, k=20))


def cited(spark, sf):
    docs = load(spark, sf, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    return search.with_documents(text_hits(spark, sf), docs, "doc_id", "text", "source")


CITED = f"""
    WITH {sql.TEXT_HITS},
    cited AS (SELECT query_id, rank, text, CASE WHEN source <> 'src3' THEN source ELSE '-' END AS source
              FROM text_hits JOIN documents ON id = doc_id)
"""


@query(
    f"""{CITED}
    SELECT query_id, string_agg('[片段' || rank || '] 来源：' || source || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM cited GROUP BY query_id
    """
)
def context_assemble(spark, sf):
    return context.assemble_context(cited(spark, sf))


@query(
    f"""{CITED}
    SELECT query_id, chr(10) || chr(10) || '---' || chr(10) || '**引用：** ' || string_agg('[' || rank || '] ' || source, '; ' ORDER BY rank) AS footer
    FROM cited GROUP BY query_id
    """
)
def reference_footer(spark, sf):
    return context.reference_footer(cited(spark, sf))


@query(
    f"""
    WITH {sql.KNN_HITS},
    bits AS (SELECT greatest(1, ceil(log2(count(*) / {search.BUCKET_ROWS})))::int AS b FROM embeddings),
    planes AS (
      SELECT t, j, d, CASE WHEN md5(t || ':' || j || ':' || d) < '8' THEN 1.0::double ELSE -1.0::double END AS sign
      FROM bits, range({search.TABLES}) AS x(t), unnest(range(b)) AS y(j), range(64) AS z(d)),
    sides AS (
      SELECT vec_id, t, j, sum(embedding[d + 1]::double * sign) > 0 AS side FROM embeddings, planes GROUP BY vec_id, t, j),
    buckets AS (SELECT vec_id, t, sum(CASE WHEN side THEN 1 << j::int ELSE 0 END) AS bucket FROM sides GROUP BY vec_id, t),
    met AS (
      SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS id
      FROM buckets q JOIN buckets c ON q.t = c.t AND q.bucket = c.bucket AND q.vec_id <> c.vec_id),
    near AS (SELECT * FROM knn_all JOIN met USING (query_id, id)),
    best AS ({sql.ranked('near')})
    SELECT query_id, id, score, round(1 - score, 6) AS distance, rank FROM best
    """
)
def knn_lsh(spark, sf):
    rows = load(spark, sf, "embeddings")
    return search.knn_lsh(spread(rows, "vec_id"), rows, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
