"""What a task holds at once, and what a search copies."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafmill.functions.text import tokens
from leafmill.functions.vectors import hash_embedding
from leafmill.operators import hits, inverted_file, lexical, postings, search


def _vectors(n: int, seed: int) -> pd.DataFrame:
    return pd.DataFrame({"id": range(n), "embedding": list(np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32))})


def test_a_block_is_scored_by_tiles(monkeypatch):
    corpus, queries = _vectors(300, 0), _vectors(40, 1).rename(columns={"id": "query_id"})
    kernel, floor, shapes = search.cosine_kernel(True), np.full(40, -np.inf), []

    def watched(c: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        shapes.append((len(q), len(c)))
        return kernel(c, q)

    whole = hits._block_hits(corpus, queries, kernel, 5, floor)
    monkeypatch.setattr(hits, "TILE", 32)
    monkeypatch.setattr(hits, "SLICE", 16)
    tiled = hits._block_hits(corpus.sample(frac=1, random_state=0), queries, watched, 5, floor)
    pd.testing.assert_frame_equal(whole, tiled)
    assert max(shapes) <= (16, 32)
    assert not (tiled["id"].to_numpy() == tiled["q"].to_numpy()).any()  # no row is its own neighbour


def test_products_are_bounded(monkeypatch):
    chance = np.random.default_rng(0)
    a, b = chance.integers(0, 3, (50, 20)), chance.integers(0, 3, (30, 20))
    d_row, d_term = np.nonzero(a)
    q_term, q_row = np.nonzero(b.T)
    sides = (d_row, d_term, a[d_row, d_term].astype(float)), (q_row, q_term, b.T[q_term, q_row].astype(float))
    sizes, bincount = [], np.bincount

    def watched(x, *args):
        sizes.append(len(x))
        return bincount(x, *args)

    monkeypatch.setattr(hits, "PRODUCTS", 700, raising=False)
    monkeypatch.setattr(hits.np, "bincount", watched)
    assert np.array_equal(hits.sparse_product(*sides, (30, 50)), b @ a.T)
    assert max(sizes) <= 1000


def test_postings_are_multiplied_in_stretches(monkeypatch, spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 11}" for j in range(1, 9))) for i in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i % 3} w7") for i in range(11)], "query_id long, text string")
    postings.add_postings(docs, str(tmp_path / "p"))
    monkeypatch.setattr(postings, "PRODUCTS", 50)
    found = postings.search_postings(asked, str(tmp_path / "p")).orderBy("query_id", "rank").toPandas()
    pd.testing.assert_frame_equal(found, lexical.bm25(docs, asked).orderBy("query_id", "rank").toPandas())
    stretches = list(postings._stretches(np.array([30, 30, 10, 90, 5])))
    assert [(s.start, s.stop) for s in stretches] == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_blocks_of_documents_are_cut_by_terms(monkeypatch, spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 7}" for j in range(1, 21))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(6)], "query_id long, text string")
    blocks, plain = [], lexical.blocked_hits
    monkeypatch.setattr(lexical, "blocked_hits", lambda *a, **o: blocks.append(o["least_blocks"]) or plain(*a, **o))
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    found = lexical.bm25(docs, asked, query_limit=2).orderBy("query_id", "rank").toPandas()
    assert blocks == [12]
    pd.testing.assert_frame_equal(found, lexical.bm25(docs, asked).orderBy("query_id", "rank").toPandas())


def test_queries_that_want_all_cells_are_not_copied_per_cell(monkeypatch, spark, tmp_path):
    rows = spark.createDataFrame(_vectors(200, 2))
    inverted_file.build_index(rows, str(tmp_path / "i"), cells=16)
    index, asked, copies = inverted_file.load_index(spark, str(tmp_path / "i")), rows.withColumnRenamed("id", "query_id"), []
    plain = inverted_file.blocked_hits
    monkeypatch.setattr(inverted_file, "blocked_hits", lambda c, q, *a: copies.append(q.count()) or plain(c, q, *a))
    found = inverted_file.search_index(index, asked, target=1.0, id_type="bigint", exclude_self=True, query_limit=10)
    true = search.knn(rows, asked, exclude_self=True)
    columns = ["query_id", "id", "score", "rank"]
    pd.testing.assert_frame_equal(*(df.select(columns).orderBy("query_id", "rank").toPandas() for df in (found, true)))
    assert copies == [200]


def test_texts_are_embedded_by_arrow_batches(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "漢字 x😀é Zz"), (5, None)], "i int, text string")
    embedded = rows.select("i", tokens(F.col("text")).alias("words"), hash_embedding(F.col("text")).alias("v"))
    for row in embedded.collect():
        if row["words"] is None:
            assert row["v"] is None
            continue
        counts = np.zeros(64)
        for word in row["words"]:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        norm = np.sqrt((counts * counts).sum())
        assert row["v"] == (counts / (norm or 1)).astype(np.float32).tolist()
    assert "], 250" in embedded._jdf.queryExecution().optimizedPlan().toString()  # the kind of an Arrow function
