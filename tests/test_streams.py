"""The incremental ingest with bounded steps and bounded state."""

from pyspark.sql import functions as F

from leafmill.operators import store
from leafmill.plans.ingest import prepare_chunks
from leafmill.session import load, scratch
from leafmill.streaming.ingest_stream import document_stream, first_arrivals, start_ingest

META = ["chunk_id", "chunk_index", "chunk_size", "content_type", "processing_stage", "source"]


def run(spark, folder, schema, root, checkpoint, within="1 day"):
    stream = document_stream(spark, f"{folder}/*.parquet", schema, max_files=1)
    stream = first_arrivals(stream, ["source", "text"], within).select("source", "text")
    query = start_ingest(stream, root, checkpoint, META, separator="\n")
    query.awaitTermination()
    return query


def ids(spark, root):
    return sorted(r.id for r in store.read_store(spark, root).select("id").collect())


def test_stream_equals_batch(spark, sf, tmp_path):
    """Repeated files, a file that comes late, a replay without its checkpoint, and a state that forgets at once."""
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    folder, root, checkpoint = f"{tmp_path}/in", scratch(spark, "t-store"), scratch(spark, "t-progress")
    for part in (0, 1, 1):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    query = run(spark, folder, docs.schema, root, checkpoint)
    files = [p["sources"][0]["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(files) == 3  # one file per step
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert state and max(s["numRowsTotal"] for s in state) <= docs.where("doc_id % 3 < 2").select("source", "text").distinct().count()
    assert all(s["numRowsDroppedByWatermark"] == 0 for s in state)
    docs.where(F.col("doc_id") % 3 == 2).union(docs.where("doc_id < 20")).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, docs.schema, root, checkpoint)
    want = sorted(r.id for r in prepare_chunks(docs.select("source", "text"), META, separator="\n").select("id").distinct().collect())
    assert ids(spark, root) == want
    run(spark, folder, docs.schema, root, scratch(spark, "t-progress"), within="0 seconds")
    assert ids(spark, root) == want
