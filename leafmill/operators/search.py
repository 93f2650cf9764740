"""Nearest-neighbour search over vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.filters import where
from leafmill.functions.vectors import hash_embedding, is_valid
from leafmill.operators.frames import broadcast_if_small
from leafmill.operators.hits import QUERY_LIMIT, blocked_hits, top_hits
from leafmill.session import checkpointed

# Fixed value: default number of results.
RESULTS = 5

TABLES = 32  # of the approximate search
BUCKET_ROWS = 64  # rows per bucket that it aims at


def _unit_rows(vectors: pd.Series, dim: int) -> np.ndarray:
    """The vectors as unit rows; a zero vector stays zero."""
    flat = np.concatenate(vectors.to_numpy()).astype(np.float64).reshape(-1, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    norms[norms == 0] = 1.0
    return flat / norms[:, None]


def cosine_kernel(exclude_self: bool = False):
    """Cosine of every query with every corpus row of its dimension.

    A zero vector scores 0; another dimension is no hit.
    """

    def score(corpus: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
        c_dim, q_dim = (side["embedding"].str.len().to_numpy() for side in (corpus, queries))
        dims = np.union1d(c_dim, q_dim)
        if len(dims) == 1 and dims[0]:
            scores = _unit_rows(queries["embedding"], dims[0]) @ _unit_rows(corpus["embedding"], dims[0]).T
        else:
            scores = np.full((len(queries), len(corpus)), -np.inf)
            for dim in dims[dims > 0]:
                rows, cols = np.flatnonzero(q_dim == dim), np.flatnonzero(c_dim == dim)
                if len(rows) and len(cols):
                    q, c = queries["embedding"].iloc[rows], corpus["embedding"].iloc[cols]
                    scores[np.ix_(rows, cols)] = _unit_rows(q, dim) @ _unit_rows(c, dim).T
        if exclude_self:
            ids, asked = corpus["id"].to_numpy(), queries["query_id"].to_numpy()  # the ids are sorted
            first, end = np.searchsorted(ids, asked), np.searchsorted(ids, asked, "right")
            for row in np.flatnonzero(first < end).tolist():
                if ids[first[row]] == asked[row]:
                    scores[row, first[row] : end[row]] = -np.inf
        return scores

    return score


def _vectors(df: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    """Ids and vectors; a null or empty vector and one with a NaN or null match nothing."""
    rows = df.select(F.col(id_col).alias(name), F.col(vector).alias("embedding"))
    return rows.where(is_valid(F.col("embedding")))


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = RESULTS,
    corpus_id: str = "id",
    query_id: str = "query_id",
    vector: str = "embedding",
    filter_metadata: dict | None = None,
    exclude_self: bool = False,
    query_limit: int = QUERY_LIMIT,
) -> DataFrame:
    """The k nearest corpus rows per query by cosine: ``query_id, id, score, distance, rank``.

    The metadata filter comes before scoring and reaches the scan. Corpus rows of
    another dimension than the query never match.
    """
    rows = _vectors(corpus.where(where(filter_metadata)), corpus_id, vector, "id")
    asked = _vectors(queries, query_id, vector, "query_id")
    hits = top_hits(rows, asked, cosine_kernel(exclude_self), k, query_limit)
    return hits.withColumn("distance", F.round(1 - F.col("score"), 6))


def text_search(
    corpus: DataFrame,
    questions: DataFrame,
    k: int = RESULTS,
    embedder: Callable[[Column], Column] = hash_embedding,
    text: str = "text",
    **options,
) -> DataFrame:
    """Embed the questions, then search. The corpus brings its ``embedding``."""
    return knn(corpus, questions.withColumn("embedding", embedder(F.col(text))), k, **options)


def best_match(corpus: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """The single best row per query; the first row wins a tie."""
    return knn(corpus, queries, k=1, **options).select(
        "query_id", F.col("id").alias("chunk_index"), F.col("score").alias("similarity_score")
    )


def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    """One random direction of +1 and -1 per table and bit: (dim, tables * bits).

    The signs come from md5, so that any other engine can make the same ones.
    """
    names = (f"{t}:{j}:{d}" for d in range(dim) for t in range(tables) for j in range(bits))
    signs = [1.0 if hashlib.md5(n.encode()).hexdigest() < "8" else -1.0 for n in names]
    return np.array(signs).reshape(dim, tables * bits)


def hash_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """How many bits make buckets of about ``bucket_rows`` rows."""
    return max(1, ceil(log2(max(1, rows) / bucket_rows)))


def _buckets(df: DataFrame, name: str, tables: int, bits: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def hashed(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        sizes = vectors.str.len()
        for dim in sizes.unique():
            at = np.flatnonzero(sizes == dim)
            rows = np.concatenate(vectors.iloc[at].to_numpy()).astype(np.float64).reshape(-1, dim)
            if dim not in planes:
                planes[dim] = hyperplanes(dim, tables, bits)
            sides = (rows @ planes[dim] > 0).reshape(len(at), tables, bits)
            codes = (sides << np.arange(bits)).sum(2).astype(np.int32)
            for i, code in zip(at.tolist(), codes, strict=True):
                out.iat[i] = code
        return out

    planes: dict[int, np.ndarray] = {}
    return df.select(name, "embedding", F.size("embedding").alias("_dim"), F.posexplode(hashed("embedding")).alias("_table", "_bucket"))


def knn_lsh(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = RESULTS,
    corpus_id: str = "id",
    query_id: str = "query_id",
    vector: str = "embedding",
    tables: int = TABLES,
    bits: int | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Approximate neighbours: exact cosine among rows that share a bucket in some table.

    A bucket holds the vectors on the same side of ``bits`` random hyperplanes; their
    number follows from the size of the corpus, so a query meets about as many rows per
    table whatever that size. A pair at angle a shares a bucket of a table with chance
    (1 - a / pi) ** bits. Buckets are cut into blocks of bounded size, so one that holds
    much of the corpus is shared out.
    """
    rows, asked = _vectors(corpus, corpus_id, vector, "id"), _vectors(queries, query_id, vector, "query_id")
    bits = bits or hash_bits(rows.count())
    hits = blocked_hits(
        _buckets(rows, "id", tables, bits),
        _buckets(asked, "query_id", tables, bits),
        cosine_kernel(exclude_self),
        k,
        ["_dim", "_table", "_bucket"],
    )
    return hits.withColumn("distance", F.round(1 - F.col("score"), 6))


def with_documents(hits: DataFrame, documents: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """Hits with the text and metadata of the rows they name.

    The hits, a few per query, are materialised and counted; where they are few enough
    they travel to the documents, which then stay in place.
    """
    named = documents.select(F.col(doc_id).alias("id"), *columns)
    found = broadcast_if_small(checkpointed(hits))
    return named.join(found, "id").select(*hits.columns, *columns)
