"""Stored postings against BM25 over the whole corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import lexical, postings
from leafmill.session import load, scratch


def same(found, want):
    got, want = ({(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in h.collect()} for h in (found, want))
    assert got.keys() == want.keys()
    for key, (name, score) in got.items():
        assert name == want[key][0] and abs(score - want[key][1]) < 1.5e-6, key


def test_equals_bm25(spark):
    folder = "/root/testdata/sf0.01"
    docs, questions = load(spark, folder, "documents"), load(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    path = scratch(spark, "t-postings")
    postings.add_postings(docs.where("doc_id % 3 = 0"), path)
    postings.add_postings(docs.where("doc_id % 3 > 0"), path)
    assert postings.parts(spark, path) == [1, 2]
    for k in (1, 5, 30):
        found = postings.search_postings(questions, path, k)
        same(found, lexical.bm25(docs, questions, k))
    same(postings.search_postings(questions, path, 5, term_limit=10), postings.search_postings(questions, path, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_blocks_are_skipped(spark, monkeypatch):
    """Few documents hold the rare words of a question; the blocks without them are not scored."""
    monkeypatch.setattr(postings, "BLOCK", 16)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randrange(3, 30))) + (" rare gem" * 3 if i % 211 == 7 else "")) for i in range(2000)]
    rows += [(3000, None), (3001, ""), (3002, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    questions = spark.createDataFrame([(1, "rare gem c1"), (2, "c1 c2 c3"), (3, "unknown"), (4, None), (5, ""), (6, "gem gem")], "query_id long, text string")
    path = scratch(spark, "t-postings")
    postings.add_postings(docs, path)
    found = postings.search_postings(questions, path, 5)
    same(found, lexical.bm25(docs, questions, 5))
    same(postings.search_postings(questions, path, 5, term_limit=1), found)
    skipped = {r["query_id"]: (r["blocks"], r["skipped"]) for r in postings.skipped_blocks(questions, path, found).collect()}
    assert set(skipped) == {1, 2, 6}
    assert skipped[1][1] > 0.8 * skipped[1][0] and skipped[1][0] > 100


def test_empty_corpus(spark):
    path = scratch(spark, "t-postings")
    docs = spark.createDataFrame([], "doc_id long, text string")
    postings.add_postings(docs, path)
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert postings.search_postings(asked, path).collect() == []
    more = docs.union(spark.createDataFrame([(7, "word and word"), (8, "and")], "doc_id long, text string"))
    postings.add_postings(more, path)
    same(postings.search_postings(asked, path), lexical.bm25(more, asked))


def test_a_term_in_every_document(spark):
    """The hottest term is many rows of bounded size."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the w"), F.col("id") % 50).alias("text"))
    path = scratch(spark, "t-postings")
    postings.add_postings(docs, path)
    rows, terms = postings.read_postings(spark, path)
    assert rows.agg(F.max(F.size("docs"))).first()[0] < 3 * postings.BLOCK
    assert {r["term"]: r["df"] for r in terms.collect()}["the"] == 20_000


def test_blocks_stay_whole_and_scores_in_their_tasks(spark):
    """A block's postings are made and written where its texts are; no score per question and document is exchanged."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.col("id") % (i + 2)) for i in range(12))).alias("text"))
    path, name = scratch(spark, "t-postings"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        postings.add_postings(docs, path)
    finally:
        spark.conf.unset(name)
    rows, _ = postings.read_postings(spark, path)
    files = rows.select("block", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("block").count().where("count > 1").count() == 0
    questions = docs.where("doc_id < 40").withColumnRenamed("doc_id", "query_id")
    found = postings.search_postings(questions, path, 5, term_limit=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan) is None
    same(found, lexical.bm25(docs, questions, 5))


@pytest.mark.parametrize("cut", [False, True])
def test_groups_of_questions_meet_groups_of_blocks(spark, monkeypatch, cut):
    if cut:
        for name, value in (("BLOCK", 8), ("TASK_BLOCKS", 3), ("GROUP_QUESTIONS", 4)):
            monkeypatch.setattr(postings, name, value)
    rng = random.Random(7)
    rows = [(f"d{i}", " ".join(rng.choices("abcdefghijkl", k=rng.randrange(0, 25)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    questions = spark.createDataFrame([(f"q{i}", " ".join(rng.choices("abcdefghijklmn", k=3))) for i in range(15)], "query_id string, text string")
    path = scratch(spark, "t-postings")
    postings.add_postings(docs, path)
    same(postings.search_postings(questions, path, 4, term_limit=1), lexical.bm25(docs, questions, 4))


def test_rows_that_share_id_and_length_are_one_document(spark):
    rows = [(1, "a b a"), (1, "a c c"), (1, "a"), (None, "b"), (None, "b"), (2, None), (2, "")]
    path = scratch(spark, "t-postings")
    postings.add_postings(spark.createDataFrame(rows, "doc_id long, text string"), path)
    found, terms = postings.read_postings(spark, path)
    held = {r["term"]: (r["most_tf"], r["least_length"], sorted((d["id"] or 0, d["tf"], d["length"]) for d in r["docs"])) for r in found.collect()}
    assert held == {
        "": (2, 0, [(0, 2, 1), (1, 1, 1), (1, 2, 3), (2, 2, 0)]),
        "a": (3, 1, [(1, 1, 1), (1, 3, 3)]),
        "b": (2, 1, [(0, 2, 1), (1, 1, 3)]),
        "c": (2, 3, [(1, 2, 3)]),
    }
    assert {r["term"]: (r["df"], r["tokens"]) for r in terms.collect()} == {"": (4, 5), "a": (2, None), "b": (2, None), "c": (1, None)}
