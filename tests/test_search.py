import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import tokens
from leafmill.operators import context, hits, lexical, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(700, 8)).astype(np.float32)
    data[::3] = data[0]  # a third of all rows are one vector
    data[5] = 0
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(data)]
    return data.astype(np.float64), spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(5)


def brute(data, queries, k, keep=None, skip_self=False):
    out = set()
    for q in queries:
        scored = []
        for i, v in enumerate(data):
            if (keep is not None and not keep(i)) or (skip_self and i == q):
                continue
            norm = np.linalg.norm(v) * np.linalg.norm(data[q])
            scored.append((-round(float(v @ data[q] / norm) if norm else 0.0, 6), i))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def triples(df):
    return {(r.query_id, r.id, r.rank) for r in df.collect()}


@pytest.mark.parametrize("limit", [2000, 3])
def test_knn_equals_brute_force_on_both_routes(vectors, limit, monkeypatch):
    data, df = vectors
    monkeypatch.setattr(hits, "BLOCK_ROWS", 90)
    queries = df.where("id < 40").withColumnRenamed("id", "query_id")
    assert triples(search.knn(df, queries, 5, query_limit=limit)) == brute(data, range(40), 5)
    got = search.knn(df, queries, 3, filter_metadata={"label": {"$in": [1, 2]}}, exclude_self=True, query_limit=limit)
    assert triples(got) == brute(data, range(40), 3, lambda i: i % 4 in (1, 2), True)


def test_best_per_row_breaks_ties_by_position():
    scores = np.array([[1.0, 2, 2, 2, 0], [3, 3, 3, 3, 3], [0, 1, 1 - 1e-8, 0, -np.inf]])
    none = np.full(3, -np.inf)

    def cells(k, floor=none):
        r, c, _ = hits.best_per_row(scores, k, floor)
        return list(zip(r.tolist(), c.tolist(), strict=True))

    assert cells(2) == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 1), (2, 2)]
    assert len(cells(9)) == 14
    assert cells(2, np.array([2.0, 4.0, 1.0])) == [(0, 1), (0, 2), (2, 1), (2, 2)]


def test_other_dimensions_never_match(spark, vectors):
    _, df = vectors
    mixed = df.where("id < 3").select(F.col("id").alias("query_id"), F.when(F.col("id") == 1, F.slice("embedding", 1, 4)).otherwise(F.col("embedding")).alias("embedding"))
    assert {r.query_id for r in search.knn(df, mixed, 2).collect()} == {0, 2}
    assert search.knn(df, mixed.where("false"), 2).count() == 0
    assert search.knn(df.where("false"), mixed, 2).count() == 0


def test_filter_reaches_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = search.knn(rows, rows.limit(2), corpus_id="vec_id", query_id="vec_id", filter_metadata={"label": 3})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_lsh_recall_and_hot_bucket(vectors, monkeypatch):
    data, df = vectors
    monkeypatch.setattr(hits, "BLOCK_ROWS", 50)
    queries = df.where("id < 40 and id <> 5").withColumnRenamed("id", "query_id")
    exact = triples(search.knn(df, queries, 5))
    near = search.knn_lsh(df, queries, 5)
    assert len(exact & triples(near)) / len(exact) > 0.8


def words(text):
    return text.lower().replace(".", " ").split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    docs = [" ".join(rng.choice(vocabulary, rng.integers(3, 60), p=weights / weights.sum())) for _ in range(300)]
    questions = [" ".join(rng.choice(vocabulary, 6)) for _ in range(12)] + ["zzz"]
    return docs, questions


def bm25_brute(docs, questions, k):
    bags = [Counter(words(d)) for d in docs]
    lengths = [sum(b.values()) for b in bags]
    mean, n = sum(lengths) / len(docs), len(docs)
    out = set()
    for q, question in enumerate(questions):
        scored = []
        for i, bag in enumerate(bags):
            score = 0.0
            for t in set(words(question)):
                if bag[t]:
                    df = sum(1 for b in bags if t in b)
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    score += idf * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
            if score > 0:
                scored.append((-round(score, 6), i))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize(("limit", "terms"), [(2000, 50_000), (3, 50_000), (2000, 5)])
def test_bm25_equals_brute_force_on_all_routes(spark, corpus, limit, terms, monkeypatch):
    docs, questions = corpus
    monkeypatch.setattr(hits, "BLOCK_ROWS", 70)
    monkeypatch.setattr(lexical, "TERM_LIMIT", terms)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
    assert triples(lexical.bm25(d, q, 4, query_limit=limit)) == bm25_brute(docs, questions, 4)


def test_bm25_without_matches(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "..."), (2, "c")], "query_id long, text string")
    assert lexical.bm25(d, q).count() == 0
    assert lexical.bm25(d.where("false"), q).count() == 0


def test_fusion(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    right = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    got = [(r.id, r.score) for r in lexical.fuse_ranks(left, right).orderBy("rank").collect()]
    assert got == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6)), (12, round(1 / 62, 6))]


def test_tokens(spark):
    row = spark.createDataFrame([("Hello, WORLD! 中文abc é-x", )], "t string").select(tokens(F.col("t"))).first()[0]
    assert row == ["hello", "world", "中", "文", "abc", "é", "x"]


def test_context_and_footer(spark):
    rows = spark.createDataFrame([(1, 2, "B", None), (1, 1, "A", "s1")], "query_id long, rank int, text string, source string")
    assert context.assemble_context(rows).first().context == "[片段1] 来源：s1\nA\n\n[片段2] 来源：-\nB"
    assert context.reference_footer(rows).first().footer == "\n\n---\n**引用：** [1] s1; [2] -"
