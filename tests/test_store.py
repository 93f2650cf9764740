import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import embedding as em
from leafmill.operators import store, store_changes
from leafmill.plans.directory import ingest_directory
from leafmill.plans.ingest import ingest, prepare_chunks
from leafmill.session import load, scratch
from leafmill.streaming.ingest_stream import document_stream, start_ingest

META = ["chunk_id", "chunk_index", "chunk_size", "content_type", "processing_stage", "source"]


def rows(spark, values):
    return spark.createDataFrame(values, "text string, embedding array<float>, source string")


def test_ids_match_json_and_md5(spark):
    df = spark.createDataFrame([("txt", "中文", 3, "t1"), ("txt", "中文", 3, "t2")], "text string, source string, n long, created_at string")
    ids = [r.id for r in store.with_chunk_id(df, ["source", "n", "created_at"]).collect()]
    want = hashlib.md5(("txt_" + json.dumps({"source": "中文", "n": 3}, sort_keys=True)).encode()).hexdigest()
    assert ids == [want, want]
    volatile = [r.id for r in store.with_chunk_id(df, ["source", "n", "created_at"], volatile=True).collect()]
    assert len(set(volatile)) == 2


def test_add_validates_and_dedups(spark):
    root = scratch(spark, "t-store")
    first = store_changes.add_documents(spark, rows(spark, [("a", [1.0, 2.0], "s"), ("a", [1.0, 2.0], "s"), (None, [1.0, 1.0], "s"), ("b", [], "s")]), root, ["source"])
    assert first.count() == 1
    again = store_changes.add_documents(spark, rows(spark, [("a", [1.0, 2.0], "s"), ("c", [1.0, 2.0, 3.0], "s"), ("d", [3.0, 4.0], "s"), ("e", [float("nan"), 1.0], "s")]), root, ["source"])
    assert again.count() == 1
    table = store.read_store(spark, root)
    assert sorted(r.text for r in table.collect()) == ["a", "d"]
    stats = store.store_stats(table).first()
    assert (stats.total_documents, stats.vector_dimension) == (2, 2)


def test_update_delete_snapshots(spark):
    root = scratch(spark, "t-store")
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id long, text string, lang string")
    one = store.write_snapshot(base, root)
    patch = spark.createDataFrame([(2, "B", None), (9, "z", None)], "id long, text string, lang string")
    updated = store.partial_update(store.read_store(spark, root), patch)
    assert {(r.id, r.text, r.lang, r.updated) for r in updated.collect()} == {
        (1, "a", "x", False), (2, "B", "y", True), (3, "c", None, False)}
    assert [r.id for r in store.unknown_ids(base, patch).collect()] == [9]
    store.write_snapshot(updated.drop("updated"), root)
    table = store.read_store(spark, root)
    condition = {"lang": "y"}
    assert store.count_where(table, condition) == 1
    assert {r.id for r in store.delete_where(table, condition).collect()} == {1, 3}  # an undecided row stays
    assert {r.id for r in store.delete_ids(table, patch.select("id")).collect()} == {1, 3}
    assert {r.id for r in store.get_by_ids(table, [1, 3, 7]).collect()} == {1, 3}
    store.restore_snapshot(spark, root, one)
    assert {r.text for r in store.read_store(spark, root).collect()} == {"a", "b", "c"}
    store.reset_store(spark, root)
    assert store.read_store(spark, root).count() == 0 and store.read_store(spark, root).columns == base.columns
    assert store.snapshots(spark, root) == [1, 2, 3, 4]


def test_cache_embeds_each_new_text_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["old", "stale", "new", "new", "new"])], "i int, text string")
    now = F.lit("2024-03-01").cast("timestamp")
    cache = spark.createDataFrame(
        [("old", [9.0], "2024-02-20"), ("old", [8.0], "2024-02-10"), ("stale", [7.0], "2023-12-01")], "t string, embedding array<float>, at string"
    ).select(F.md5("t").alias("text_hash"), "embedding", F.col("at").cast("timestamp").alias("cached_at"))
    seen = spark.sparkContext.accumulator(0)

    def embedder(text):
        @F.pandas_udf("array<float>")
        def count(values):
            seen.add(int(values.notna().sum()))
            return values.map(lambda v: None if v is None else [float(len(v))])

        return count(text)

    merged = em.embed_with_cache(docs, cache, now, embedder)
    got = {r.text_hash: (r.embedding[0], r.cached) for r in merged.collect()}
    h = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {h("old"): (9.0, True), h("stale"): (5.0, False), h("new"): (3.0, False)}
    assert seen.value == 2
    assert em.attach_embeddings(docs, merged).where("embedding is null").count() == 0
    assert em.new_cache_entries(merged, now).count() == 2
    assert em.cache_info(cache).first().total_bytes == 12
    root = scratch(spark, "t-cache")
    store.write_snapshot(cache, root)
    em.save_cache(merged, root, now)
    assert {r.text_hash: r.embedding for r in em.prune_cache(store.read_store(spark, root), now).collect()} == {
        h("old"): [9.0], h("stale"): [5.0], h("new"): [3.0]}
    store.reset_store(spark, root)
    assert em.cache_info(store.read_store(spark, root)).first().entries == 0


def test_hot_texts_get_the_same_vectors(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(90)] + [(90, None)], "i int, text string")
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>, cached_at timestamp")
    merged = em.embed_with_cache(docs, cache, F.current_timestamp())
    plain = sorted((r.i, r.embedding) for r in em.attach_embeddings(docs, merged).collect())
    monkeypatch.setattr(em, "HOT_COPIES", 5)
    split = em.attach_embeddings(docs, merged)
    assert sorted((r.i, r.embedding) for r in split.collect()) == plain
    assert [i for i, _ in plain] == list(range(91)) and split.columns == ["i", "text", "embedding", "cached"]


def test_ingest_twice_adds_nothing(spark, sf):
    root = scratch(spark, "t-store")
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    assert ingest(spark, docs, root, META, separator="\n").count() > 0
    before = store.read_store(spark, root).count()
    assert ingest(spark, docs, root, META, separator="\n").count() == 0
    assert store.read_store(spark, root).count() == before
    assert before == prepare_chunks(docs, META, separator="\n").select("id").distinct().count()


def test_stream_equals_batch_and_replay_is_harmless(spark, sf):
    docs = load(spark, sf, "documents")
    want = {r.id for r in prepare_chunks(docs.select("source", "text"), META, separator="\n").select("id").collect()}
    root = scratch(spark, "t-store")
    for run in range(2):  # the second run lost its checkpoint
        stream = document_stream(spark, f"{sf}/documents*.parquet", docs.schema).select("source", "text")
        start_ingest(stream, root, scratch(spark, f"t-progress-{run}"), META, separator="\n").awaitTermination()
    got = [r.id for r in store.read_store(spark, root).select("id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_directory_gives_every_file_an_outcome(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名,n\n甲,1\n乙,22\n丙,3\n丁,4\n".encode("gbk"))
    (tmp_path / "b.csv").write_text("x,y\n")
    (tmp_path / "big.csv").write_text("x\n" * 5000)
    (tmp_path / "empty.csv").write_text("\n")
    (tmp_path / "c.pdf").write_text("%PDF")
    (tmp_path / "d.doc").write_text("?")
    (tmp_path / "zero.csv").write_bytes(b"")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3,4,5\n6\n")
    (tmp_path / "odd[1]{x}.csv").write_text("a\n1\n")
    root = scratch(spark, "t-store")
    for _ in range(2):  # the second run stores nothing new
        ledger = ingest_directory(spark, str(tmp_path), root, max_mb=0.005)
        got = {r.path.rsplit("/", 1)[1]: (r.chunks_count, r.error_message) for r in ledger.collect()}
        assert got == {
            "a.csv": (1, None), "b.csv": (1, None), "big.csv": (0, "file too large"), "empty.csv": (0, "empty result"),
            "c.pdf": (0, "unsupported format"), "d.doc": (0, "unsupported format"), "zero.csv": (0, "empty result"),
            "odd[1]{x}.csv": (1, None), "ragged.csv": (0, got["ragged.csv"][1])}
        assert got["ragged.csv"][1].startswith("unreadable")
    rows = {r.file_name: r for r in store.read_store(spark, root).collect()}
    assert set(rows) == {"a.csv", "b.csv", "odd[1]{x}.csv"}
    preview = pd.DataFrame({"名": ["甲", "乙", "丙"], "n": [1, 22, 3]}).to_string(max_cols=5, max_colwidth=20)
    assert rows["a.csv"].text == f"表格文件: a.csv\n行数: 4\n列数: 2\n列名: 名, n\n\n数据预览（前3行）:\n{preview}"
    assert (rows["a.csv"].table_rows, rows["a.csv"].content_type, rows["b.csv"].table_rows) == (4, "table_description", 0)
    assert rows["a.csv"].file_hash == hashlib.md5((tmp_path / "a.csv").read_bytes()).hexdigest()


def test_snapshots_and_batches_read_as_one(spark):
    root = scratch(spark, "t-store")
    base = store.with_chunk_id(rows(spark, [("a", [1.0, 2.0], "s"), ("b", [1.0, 2.0], "s")]), ["source"])
    store.write_snapshot(base, root)
    assert store_changes.add_documents(spark, rows(spark, [("c", [1.0, 2.0], "s"), ("a", [1.0, 2.0], "s")]), root, ["source"]).count() == 1
    assert {r.text for r in store.read_store(spark, root).collect()} == {"a", "b", "c"}
    unfinished = f"{root}/snapshot-00000001/batch-00000003"
    base.write.parquet(unfinished)
    fs, path = store._folder(spark, f"{unfinished}/_SUCCESS")
    fs.delete(path, False)
    assert store.read_store(spark, root).count() == 3
    store.reset_store(spark, root)
    assert store.read_store(spark, root).count() == 0
    assert store_changes.add_documents(spark, rows(spark, [("z", [1.0], "s")]), root, ["source"]).count() == 1
    assert store.storage_stats(spark, root).first().storage_bytes > 0


def test_first_batch_of_mixed_dimensions(spark):
    root = scratch(spark, "t-store")
    mixed = rows(spark, [("a", [1.0, 2.0], "s"), ("b", [1.0], "s"), ("c", [3.0, 4.0], "s"), ("d", [1.0, 2.0, 3.0], "s")])
    store_changes.add_documents(spark, mixed, root, ["source"])
    assert {r.text for r in store.read_store(spark, root).collect()} == {"a", "c"}


def test_blank_first_batch(spark, sf):
    root = scratch(spark, "t-store")
    docs = load(spark, sf, "documents").select("source", "text").limit(20)
    assert ingest(spark, docs.withColumn("text", F.lit("  ")), root, META, separator="\n").count() == 0
    assert ingest(spark, docs, root, META, separator="\n").count() > 0


def test_repeated_patches_merge(spark):
    base = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [1.0, 2.0])], "id long, text string, embedding array<float>")
    patch = spark.createDataFrame(
        [(1, "x", None, 1), (1, "y", None, 2), (1, None, [5.0, 6.0], 3), (2, None, [9.0], 1)], "id long, text string, embedding array<float>, at int"
    )
    got = {r.id: (r.text, r.embedding) for r in store.partial_update(base, patch, order="at").collect()}
    assert got == {1: ("y", [5.0, 6.0]), 2: ("b", [1.0, 2.0])}


def test_the_same_row_stays_in_any_order(spark):
    values = [("k", i) for i in range(50)]
    kept = {store.new_rows(spark.createDataFrame(v, "id string, n int").repartition(4), None).first().n for v in (values, values[::-1])}
    assert len(kept) == 1


def test_directory_takes_more_readers(spark, tmp_path):
    (tmp_path / "c.pdf").write_text("One page. Two.")

    def read_pdf(spark, path):
        return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))

    root = scratch(spark, "t-store")
    ledger = ingest_directory(spark, str(tmp_path), root, {".pdf": read_pdf})
    assert [(r.chunks_count, r.success) for r in ledger.collect()] == [(1, True)]


def test_dimension_guard_on_an_empty_store(spark):
    vectors = rows(spark, [("a", [1.0], "s"), ("b", [], "s")])
    got = {r.text: r.reason for r in store.guard_dimension(vectors, vectors.where("false")).collect()}
    assert got == {"a": None, "b": "invalid vector"}
