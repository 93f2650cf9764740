"""Exact top-k scoring of many corpus rows against many queries.

A kernel scores one block of corpus rows against one block of queries with numpy
and keeps the best k per query, so no pair of rows ever becomes a row. Two
layouts feed it:

* few queries (at most ``QUERY_LIMIT``, checked): they travel to every task and
  the corpus is scanned in place, without a shuffle;
* more: both sides are cut into blocks of bounded size and every block of one
  side meets every block of the other once.

Either way k rows per query and task reach the final ranking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.frames import broadcast_if_small
from leafmill.session import checkpointed

QUERY_LIMIT = 2_000
BLOCK_ROWS = 20_000
SLICE = 256
TILE = 4096  # corpus rows that are scored at once
PRODUCTS = 1 << 20  # of weights that are multiplied at once
DIGITS = 6

# A kernel maps (corpus block sorted by id, query block) to a score matrix (queries x
# corpus); -inf marks a pair that is no hit.
Kernel = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def best_per_row(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of up to k entries per row.

    The first column wins among equal rounded scores. Entries clearly below the row's
    ``floor`` are passed over; without any floor the k-th best score serves as one.
    """
    n = scores.shape[1]
    if n > k and not np.isfinite(floor).any():
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
    slack = 2 * 10.0**-DIGITS  # rounding may make near scores equal
    r, c = np.nonzero(scores >= (floor - slack)[:, None])
    v = scores[r, c]
    hit = np.isfinite(v)
    r, c, v = r[hit], c[hit], np.round(v[hit], DIGITS) + 0.0
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first], v[first]


def _block_hits(
    corpus: pd.DataFrame, queries: pd.DataFrame, kernel: Kernel, k: int, floor: np.ndarray
) -> pd.DataFrame:
    """The best k of a block per query, by slices of queries and tiles of the corpus; only a tile's scores are held."""
    corpus = corpus.sort_values("id", kind="stable")
    ids, found = corpus["id"].to_numpy(), []
    for at in range(0, len(queries), SLICE):
        some, least = queries.iloc[at : at + SLICE], floor[at : at + SLICE].copy()
        r, c, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(corpus), TILE):
            new = best_per_row(kernel(corpus.iloc[start : start + TILE], some), k, least)
            r, c, v = np.append(r, new[0]), np.append(c, new[1] + start), np.append(v, new[2])
            order = np.lexsort((c, -v, r))
            nth = np.arange(len(r)) - np.searchsorted(r[order], r[order])
            last, order = order[nth == k - 1], order[nth < k]
            least[r[last]] = np.maximum(least[r[last]], v[last])
            r, c, v = r[order], c[order], v[order]
        found.append((r + at, c, v))
    rows, cols, values = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return pd.DataFrame({"q": rows, "id": ids[cols], "score": values})


def _merge(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values(["q", "score", "id"], ascending=[True, False, True])
    return ordered[ordered.groupby("q").cumcount() < k]


def _kth_scores(hits: pd.DataFrame, k: int, queries: int) -> np.ndarray:
    floor = np.full(queries, -np.inf)
    last = hits[hits.groupby("q").cumcount() == k - 1]
    floor[last["q"].to_numpy()] = last["score"].to_numpy()
    return floor


def _named(hits: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    query_ids = queries["query_id"].to_numpy()[hits["q"].to_numpy()]
    return pd.DataFrame({"query_id": query_ids, "id": hits["id"].to_numpy(), "score": hits["score"].to_numpy()})


def _schema(corpus: DataFrame, queries: DataFrame) -> str:
    query_type = queries.schema["query_id"].dataType.simpleString()
    id_type = corpus.schema["id"].dataType.simpleString()
    return f"query_id {query_type}, id {id_type}, score double"


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """The best k per query with their rank; the smaller id wins a tie."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def top_hits(
    corpus: DataFrame, queries: DataFrame, kernel: Kernel, k: int, query_limit: int = QUERY_LIMIT
) -> DataFrame:
    """``(query_id, id, score, rank)`` of the best k corpus rows per query, exactly."""
    schema = _schema(corpus, queries)
    batch = queries.limit(query_limit + 1).toPandas()  # bounded by the limit
    if len(batch) > query_limit:
        return blocked_hits(corpus, queries, kernel, k)

    def scan(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, floor = None, np.full(len(batch), -np.inf)
        for block in blocks:
            if len(block) and len(batch):
                hits = _block_hits(block, batch, kernel, k, floor)
                best = _merge(hits if best is None else pd.concat([best, hits]), k)
                floor = _kth_scores(best, k, len(batch))
        if best is not None:
            yield _named(best, batch)

    return rank_hits(corpus.mapInPandas(scan, schema), k)


def _blocks(rows: int) -> int:
    return max(1, ceil(rows / BLOCK_ROWS))


def blocked_hits(
    corpus: DataFrame, queries: DataFrame, kernel: Kernel, k: int, keys: Sequence[str] = (), least_blocks: int = 1
) -> DataFrame:
    """The same for any number of queries, optionally only where ``keys`` agree.

    With ``keys`` the blocks are sized per key value, so a value that holds a third
    of all rows becomes many groups of bounded size instead of one. Without keys the
    corpus, whose rows may be large, is cut into ``least_blocks`` blocks at least.
    """
    schema = _schema(corpus, queries)
    if keys:  # blocks per key value, for values that both sides hold
        sizes = [
            side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
            for side, name in ((corpus, "_corpus_n"), (queries, "_query_n"))
        ]
        blocks = broadcast_if_small(checkpointed(sizes[0].join(sizes[1], list(keys))))
        corpus, queries = (side.join(blocks, list(keys)) for side in (corpus, queries))
    else:
        counts = {"_corpus_n": F.lit(max(least_blocks, _blocks(corpus.count()))), "_query_n": F.lit(_blocks(queries.count()))}
        corpus, queries = (side.withColumns(counts) for side in (corpus, queries))

    def cut(side: DataFrame, id_col: str, own: str, facing: str) -> DataFrame:
        every = F.sequence(F.lit(0), F.col(f"{facing}_n") - 1)
        return (
            side.withColumn(own, F.pmod(F.xxhash64(id_col), F.col(f"{own}_n")).cast("int"))
            .withColumn(facing, F.explode(every))
            .drop("_corpus_n", "_query_n")
        )

    group = [*keys, "_corpus", "_query"]
    left, right = cut(corpus, "id", "_corpus", "_query"), cut(queries, "query_id", "_query", "_corpus")

    def meet(block: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(batch):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _named(_block_hits(block, batch, kernel, k, np.full(len(batch), -np.inf)), batch)

    hits = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, schema)
    if keys:  # a pair may meet in several groups; its scores agree up to rounding
        hits = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return rank_hits(hits, k)


def sparse_product(
    docs: tuple[np.ndarray, np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray, np.ndarray], shape
) -> np.ndarray:
    """Sum of weight products over shared terms; each side is (row, term, weight), and
    the query side is sorted by term, the other by row.

    About ``PRODUCTS`` products are held at once, or those of one document.
    """
    d_row, d_term, d_weight = docs
    q_row, q_term, q_weight = queries
    lo, hi = np.searchsorted(q_term, d_term, "left"), np.searchsorted(q_term, d_term, "right")
    ends = np.cumsum(np.bincount(d_row, hi - lo, shape[1]))
    sums, first = np.zeros(shape), 0
    while first < shape[1]:
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + PRODUCTS, "right")))
        here = slice(*np.searchsorted(d_row, (first, stop)))
        times = hi[here] - lo[here]
        at = np.repeat(lo[here] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum()) if len(times) else times
        cell = q_row[at] * (stop - first) + np.repeat(d_row[here] - first, times)
        part = np.bincount(cell, np.repeat(d_weight[here], times) * q_weight[at], shape[0] * (stop - first))
        sums[:, first:stop] = part.reshape(shape[0], -1)
        first = stop
    return sums
