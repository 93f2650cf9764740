"""Lexical ranking and its fusion with vector search."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import tokens
from leafmill.operators.frames import unnest
from leafmill.operators.hits import QUERY_LIMIT, blocked_hits, rank_hits, sparse_product, top_hits
from leafmill.session import checkpointed

# BM25 and rank-fusion constants.
K1, B = 1.2, 0.75
RRF = 60

# Up to this many terms in all questions the terms travel to every task.
TERM_LIMIT = 50_000
BLOCK_TERMS = 1 << 20  # terms of a block of documents, about; they are text in a worker


def _bm25_kernel(k1: float, b: float):
    def score(corpus: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
        q_len = queries["terms"].str.len().to_numpy()
        q_row = np.repeat(np.arange(len(queries)), q_len)
        words, q_term = np.unique(np.concatenate(list(queries["terms"])).astype(object), return_inverse=True)
        slot = {w: i for i, w in enumerate(words)}
        q_weight = np.concatenate(list(queries["idf"])).astype(np.float64)
        order = np.argsort(q_term, kind="stable")

        lengths = corpus["length"].to_numpy(dtype=np.float64)
        size = corpus["terms"].str.len().to_numpy()
        row = np.repeat(np.arange(len(corpus)), size)
        term = np.fromiter(
            (slot.get(w, -1) for ws in corpus["terms"] for w in ws), dtype=np.int64, count=int(size.sum())
        )
        known = term >= 0
        cell, tf = np.unique(row[known] * len(words) + term[known], return_counts=True)
        d_row, d_term = cell // len(words), cell % len(words)
        ratio = lengths[d_row] / corpus["mean_length"].to_numpy(dtype=np.float64)[d_row]
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))
        scores = sparse_product(
            (d_row, d_term, weight),
            (q_row[order], q_term[order], q_weight[order]),
            (len(queries), len(corpus)),
        )
        scores[scores <= 0] = -np.inf
        return scores

    return score


def bm25(
    documents: DataFrame,
    questions: DataFrame,
    k: int = 5,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    text: str = "text",
    k1: float = K1,
    b: float = B,
    query_limit: int = QUERY_LIMIT,
) -> DataFrame:
    """The best k documents per question by BM25: ``query_id, id, score, rank``.

    Documents keep only terms that occur in some question, by a hash lookup in the
    row where the questions are few and short. Document frequencies are one pre-aggregated
    count per term; scores never leave the task that holds the document.
    """
    spark = documents.sparkSession
    asked = questions.select(
        F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("terms")
    )
    words = unnest(asked, [], F.col("terms"), "term").distinct()
    size = asked.agg(F.count(F.lit(1)).alias("questions"), F.sum(F.size("terms")).alias("terms")).first()
    small = size["questions"] <= query_limit and (size["terms"] or 0) <= TERM_LIMIT
    if small:
        vocabulary = [r["term"] for r in words.collect()]  # at most TERM_LIMIT

    terms = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))  # a null text has none
    docs = documents.select(F.col(doc_id).alias("id"), terms.alias("terms")).select("id", F.size("terms").alias("length"), "terms")
    if small:
        listed = ", ".join(f"'{w}'" for w in vocabulary) or "null"  # tokens hold no quotes
        docs = docs.withColumn("terms", F.expr(f"filter(terms, t -> t in ({listed}))"))
    # one pass counts each term's documents and, under the empty term, all documents
    marked = F.concat(F.array(F.lit("")), F.array_distinct("terms"))
    counts = unnest(docs, ["length"], marked, "term")
    if not small:
        counts = counts.join(words.union(spark.createDataFrame([("",)], "term string")), "term", "left_semi")
    stats = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("tokens")
    )
    if small:  # a row per vocabulary term
        stats = spark.createDataFrame(stats.collect(), stats.schema)
    else:
        stats = checkpointed(stats)
    totals = stats.where("term = ''").first()
    n, mean = (totals["df"], totals["tokens"] / totals["df"]) if totals else (0, 1.0)
    frequency = stats.where("term <> ''")

    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        unnest(asked, ["query_id"], F.col("terms"), "term")
        .join(frequency, "term")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("_t"))
        .select("query_id", F.col("_t.term").alias("terms"), F.col("_t.idf").alias("idf"))
    )
    corpus = docs.withColumn("mean_length", F.lit(mean))
    kernel = _bm25_kernel(k1, b)
    if small:
        return top_hits(corpus, weighted, kernel, k, query_limit)
    return blocked_hits(corpus, weighted, kernel, k, least_blocks=ceil(n * mean / BLOCK_TERMS))


def fuse_ranks(lexical: DataFrame, dense: DataFrame, k: int = 5, constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``(query_id, id, rank)``."""
    sides = [
        side.select("query_id", "id", (1.0 / (constant + F.col("rank"))).alias(name))
        for side, name in ((lexical, "_l"), (dense, "_d"))
    ]
    both = sides[0].join(sides[1], ["query_id", "id"], "full_outer")
    score = F.round(F.coalesce("_l", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0)), 6)
    return rank_hits(both.select("query_id", "id", score.alias("score")), k)
