"""Stored postings: BM25 without reading or tokenising the corpus again.

Documents are dealt into blocks by the hash of their id. A posting is one row per term and
block: the documents of the block that have the term, how often, and their lengths, beside
the greatest frequency and the least length among them. These two bound what the term can
add to a document of the block, whatever the mean length becomes, so that later additions
leave what is written as it is. Texts are exchanged once, by block; their postings are made
where the block is, and a file has whole blocks, with postings sorted by term. Each addition
is a part of its own. The empty term stands for all documents.

A search reads the postings of its terms only and brings those of a block together. Going
through its blocks, a task keeps the k-th score of every question so far; a block whose
bounds add up to less for a question is skipped for it. The result is that of scoring every
document. Questions with too many terms to travel are joined instead: the blocks with the
greatest bounds are scored first. Then groups of questions meet groups of blocks, and a
block is scored where its bound reaches the k-th score so far. So the postings are
exchanged, once per group of questions, but never a score per question and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.functions.text import tokens
from leafmill.operators import store
from leafmill.operators.frames import broadcast_if_small, unnest
from leafmill.operators.hits import DIGITS, PRODUCTS, best_per_row, rank_hits
from leafmill.operators.lexical import K1, TERM_LIMIT, B
from leafmill.session import bounded_batches, checkpointed

BLOCK = 128  # documents of a block, about
SEEDS = 4  # blocks per question that are scored first
CELLS = 1 << 20  # scores of questions and documents that a task holds at once
TASK_BLOCKS = 128  # blocks that a task makes or scores, about
GROUP_TOKENS = 1 << 22  # words of the documents that meet a group of questions, about
GROUP_QUESTIONS = 2_000  # questions of a group, about
PART = 40  # a block's number has that of its part above this bit
ALL = ""  # the term that every document has


def parts(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished parts."""
    found = [n for n in store.folder_names(spark, path) if n.startswith("part-")]  # one entry per addition
    return sorted(int(n.split("-")[1]) for n in found if store.exists(spark, f"{path}/{n}/terms/_SUCCESS"))


def add_postings(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> int:
    """Write the postings of documents that the index does not hold yet; the number of the new part.

    A null text is as one without terms. Ids must be unique in the index.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    part = max(parts(spark, path), default=0) + 1
    blocks = max(1, ceil(documents.count() / BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)) + F.lit(part << PART)
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).select(block.alias("block"), "id", "text")
    docs = docs.repartition(_tasks(spark, blocks), "block").sortWithinPartitions("block")
    docs = docs.select("block", "id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    entry = T.StructType([docs.schema["id"]]).add("tf", "integer").add("length", "integer")
    schema = T.StructType().add("term", "string").add("block", "long").add("most_tf", "integer").add("least_length", "integer").add("docs", T.ArrayType(entry))
    rows = docs.mapInArrow(_postings(to_arrow_schema(schema)), schema)
    at = f"{path}/part-{part:08d}"
    rows.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{at}/postings")
    written = spark.read.schema(rows.schema).parquet(f"{at}/postings")
    lengths = F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["length"])
    terms = written.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(F.when(F.col("term") == ALL, lengths)).alias("tokens"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/terms")
    return part


def _tasks(spark: SparkSession, blocks: int) -> int:
    """Tasks for so many blocks: one per core, and more where a task would have many blocks."""
    return max(min(blocks, spark.sparkContext.defaultParallelism), ceil(blocks / TASK_BLOCKS))


def _postings(schema: pa.Schema):
    """Postings from batches of (block, id, terms) that are sorted by block."""
    entry = schema.field("docs").type.value_type

    def of_block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, lists = table["id"].combine_chunks(), table["terms"].combine_chunks()
        sizes, coded = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        # rows with the same id and length are one document
        name = ids.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        _, row, doc = np.unique(name * (sizes.max() + 1) + sizes, return_index=True, return_inverse=True)
        term = np.concatenate((np.zeros(len(sizes), np.int64), coded.indices.to_numpy() + np.int64(1)))
        cell, tf = np.unique(term * len(row) + np.concatenate((doc, np.repeat(doc, sizes))), return_counts=True)
        term, doc = cell // len(row), cell % len(row)
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        length = sizes[row][doc]
        docs = pa.StructArray.from_arrays(
            [ids.take(pa.array(row[doc])).cast(entry.field("id").type), pa.array(tf, pa.int32()), pa.array(length, pa.int32())], fields=list(entry)
        )
        words = pa.concat_arrays([pa.array([ALL], pa.string()), coded.dictionary.cast(pa.string())])
        columns = [
            words.take(pa.array(term[heads])),
            pa.array(np.full(len(heads), table["block"][0].as_py()), pa.int64()),
            pa.array(np.maximum.reduceat(tf, heads), pa.int32()),
            pa.array(np.minimum.reduceat(length, heads), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.append(heads, len(cell)), pa.int32()), docs, type=schema.field("docs").type),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(of_block, _whole_blocks(batches, 1))

    return make


def read_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, block, most_tf, least_length, docs) and (term, df, tokens) of all parts."""
    at = [f"{path}/part-{n:08d}" for n in parts(spark, path)]
    return tuple(spark.read.parquet(*(f"{p}/{name}" for p in at)) for name in ("postings", "terms"))


def _weight(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))


def search_postings(
    questions: DataFrame,
    path: str,
    k: int = 5,
    query_id: str = "query_id",
    text: str = "text",
    k1: float = K1,
    b: float = B,
    seeds: int = SEEDS,
    term_limit: int = TERM_LIMIT,
) -> DataFrame:
    """The best k documents per question by BM25, as ``lexical.bm25`` finds them: ``query_id, id, score, rank``."""
    spark = questions.sparkSession
    postings, terms = read_postings(spark, path)
    asked = questions.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("terms"))
    asked = broadcast_if_small(checkpointed(unnest(asked, ["query_id"], F.col("terms"), "term")))
    total = terms.where(F.col("term") == ALL).agg(F.sum("df").alias("n"), F.sum("tokens").alias("tokens")).first()
    n, mean = total["n"] or 0, max((total["tokens"] or 0) / max(1, total["n"] or 0), 1e-9)
    found = terms.where(F.col("term") != ALL).join(asked, "term").groupBy("query_id", "term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = checkpointed(found.select("query_id", "term", idf.alias("idf")))
    few = weighted.limit(term_limit + 1).toPandas()  # bounded by the limit
    if len(few) <= term_limit:
        schema = T.StructType([weighted.schema["query_id"]]).add("id", _id_type(postings)).add("score", "double")
        wanted = spark.createDataFrame([(t,) for t in few["term"].unique()], "term string")
        rows = postings.join(F.broadcast(wanted), "term")
        rows = rows.select("block", "term", "most_tf", "least_length", *_entries()).repartition("block").sortWithinPartitions("block")
        return rank_hits(rows.mapInArrow(_by_block(few, k, mean, k1, b, to_arrow_schema(schema)), schema), k)
    weighted = broadcast_if_small(weighted)
    most = F.greatest("idf", F.lit(0.0)) * _weight(F.col("most_tf"), F.col("least_length"), mean, k1, b)
    heads = postings.select("term", "block", "most_tf", "least_length").join(weighted, "term")
    bounds = heads.groupBy("query_id", "block").agg(F.sum(most).alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    first = checkpointed(bounds.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= seeds).select("query_id", "block"))
    pairs = broadcast_if_small(checkpointed(weighted.join(first, "query_id")))
    each = postings.join(pairs, ["term", "block"]).select("query_id", "idf", F.explode("docs").alias("d"))
    weight = F.col("idf") * _weight(F.col("d.tf"), F.col("d.length"), mean, k1, b)
    hits = each.groupBy("query_id", F.col("d.id").alias("id")).agg(F.sum(weight).alias("score"))
    best = rank_hits(hits.select("query_id", "id", F.round("score", DIGITS).alias("score")), k)
    floor = checkpointed(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
    size = weighted.agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("terms")).first()
    batches = max(1, ceil(size["questions"] / GROUP_QUESTIONS), ceil(size["terms"] / TERM_LIMIT))
    groups = max(1, ceil(n / (TASK_BLOCKS * BLOCK)), ceil(n * mean / GROUP_TOKENS))
    batch, group = F.pmod(F.xxhash64("query_id"), F.lit(batches)), F.pmod(F.xxhash64("block"), F.lit(groups))
    asking = weighted.join(floor, "query_id", "left").where(F.col("query_id").isNotNull()).withColumn("batch", batch)
    wanted = broadcast_if_small(checkpointed(asking.select("batch", "term").distinct()))
    columns = ["batch", group.alias("group"), "block", "term", "most_tf", "least_length", *_entries()]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    sides = postings.join(wanted, "term").select(*columns), asking.withColumn("group", every)
    tasks = max(min(batches * groups, 1 << 14), spark.sparkContext.defaultParallelism)
    left, right = (side.repartition(tasks, "batch", "group").groupBy("batch", "group") for side in sides)
    schema = T.StructType().add("query_id", weighted.schema["query_id"].dataType).add("id", _id_type(postings)).add("score", "double")
    names = to_arrow_schema(schema)

    def meet(blocks: pa.Table, questions: pa.Table) -> pa.Table:
        if not blocks.num_rows or not questions.num_rows:
            return names.empty_table()
        rows = blocks.drop_columns(["batch", "group"]).sort_by("block")
        return pa.Table.from_batches(_by_block(questions.to_pandas(), k, mean, k1, b, names)(rows.to_batches()), names)

    return rank_hits(left.cogroup(right).applyInArrow(meet, schema), k)


def _entries() -> list[Column]:
    """What a posting has of its documents, as three arrays."""
    return [F.col("docs.id").alias("ids"), F.col("docs.tf").alias("tfs"), F.col("docs.length").alias("lengths")]


def _id_type(postings: DataFrame) -> T.DataType:
    return postings.schema["docs"].dataType.elementType["id"].dataType


def _by_block(weighted: pd.DataFrame, k: int, mean: float, k1: float, b: float, schema: pa.Schema):
    """Hits of the questions from batches that are sorted by block; a column ``floor`` has scores that k documents reach."""
    weighted = weighted.sort_values(["term", "query_id"])
    names, q_of = np.unique(weighted["query_id"].to_numpy(), return_inverse=True)
    words, first = np.unique(weighted["term"].to_numpy(dtype=object), return_index=True)
    slot = {w: i for i, w in enumerate(words)}
    first = np.append(first, len(weighted))
    idf = weighted["idf"].to_numpy(float)
    least = np.full(len(names), -np.inf)
    if "floor" in weighted:
        least[q_of] = weighted["floor"].fillna(-np.inf).to_numpy(float)

    def weight(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    def scored(table: pa.Table, floor: np.ndarray) -> pd.DataFrame:
        table = table.combine_chunks()
        term = np.array([slot[w] for w in table["term"].to_pylist()])
        blocks, block = np.unique(table["block"].to_numpy(), return_inverse=True)
        row, at = _spans(first[term], first[term + 1])  # a posting for each question that has its term
        most = weight(table["most_tf"].to_numpy(), table["least_length"].to_numpy())
        bounds = np.bincount(q_of[at] * len(blocks) + block[row], np.maximum(idf[at], 0) * most[row], len(names) * len(blocks)).reshape(len(names), -1)
        reached = bounds >= (floor - 2 * 10.0**-DIGITS)[:, None]
        keep = reached[q_of[at], block[row]]
        row, at = row[keep], at[keep]
        ids, tfs, lengths = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tfs", "lengths"))
        sizes = pc.list_value_length(table["ids"]).to_numpy()
        ends = np.cumsum(sizes)
        known, doc = np.unique(ids, return_inverse=True)
        scores = np.zeros(len(names) * len(known))
        for part in _stretches(sizes[row]):
            pair, entry = _spans((ends - sizes)[row[part]], ends[row[part]])
            asked = at[part][pair]
            add = idf[asked] * weight(tfs[entry], lengths[entry])
            scores += np.bincount(q_of[asked] * len(known) + doc[entry], add, len(scores))
        scores = scores.reshape(len(names), -1)
        scores[scores <= 0] = -np.inf
        q, c, v = best_per_row(scores, k, floor)
        return pd.DataFrame({"q": q, "id": known[c], "score": v})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = None, least.copy()
        for table in _whole_blocks(batches, max(1, CELLS // max(1, len(names)))):
            hits = scored(table, floor)
            best = hits if best is None else pd.concat([best, hits])
            best = best.sort_values(["q", "score", "id"], ascending=[True, False, True])
            best = best[best.groupby("q").cumcount() < k]
            last = best[best.groupby("q").cumcount() == k - 1]
            reached = last["q"].to_numpy()
            floor[reached] = np.maximum(floor[reached], last["score"].to_numpy())
        if best is not None and len(best):
            values = (names[best["q"].to_numpy()], best["id"].to_numpy(), best["score"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v.tolist(), t) for v, t in zip(values, schema.types, strict=True)], schema.names)

    return search


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, place) of all places of the spans."""
    size = end - start
    span = np.repeat(np.arange(len(size)), size)
    return span, np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _stretches(sizes: np.ndarray) -> Iterator[slice]:
    """Slices with about ``PRODUCTS`` places together, or one span that has more."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PRODUCTS, "right")))
        yield slice(start, stop)
        start = stop


def _whole_blocks(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.Table]:
    """Tables of whole blocks, of about so many documents or one block, from batches sorted by block."""
    held: list[pa.RecordBatch] = []
    blocks, last = 0, None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        if not len(numbers):
            continue
        new = np.concatenate(([numbers[0] != last], numbers[1:] != numbers[:-1]))
        start = 0
        for at in np.flatnonzero(new).tolist():
            if blocks * BLOCK >= docs:
                if at > start:
                    held.append(batch.slice(start, at - start))
                yield pa.Table.from_batches(held)
                held, blocks, start = [], 0, at
            blocks += 1
        held.append(batch.slice(start))
        last = numbers[-1]
    if held:
        yield pa.Table.from_batches(held)


def skipped_blocks(questions: DataFrame, path: str, hits: DataFrame, query_id: str = "query_id", text: str = "text", k: int = 5) -> DataFrame:
    """(query_id, blocks, skipped): blocks that have a term of the question, and those whose bound is below its k-th hit."""
    spark = questions.sparkSession
    postings, terms = read_postings(spark, path)
    total = terms.where(F.col("term") == ALL).agg(F.sum("df").alias("n"), F.sum("tokens").alias("tokens")).first()
    mean = (total["tokens"] or 0) / max(1, total["n"] or 0)
    asked = questions.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("terms"))
    found = terms.where(F.col("term") != ALL).join(unnest(asked, ["query_id"], F.col("terms"), "term"), "term").groupBy("query_id", "term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    most = F.sum(idf * _weight(F.col("most_tf"), F.col("least_length"), mean, K1, B)).alias("most")
    bounds = postings.select("term", "block", "most_tf", "least_length").join(found, "term").groupBy("query_id", "block").agg(most)
    floor = hits.where(F.col("rank") == k).select("query_id", "score")
    below = F.count_if(F.col("most") < F.col("score") - 2 * 10.0**-DIGITS)
    return bounds.join(floor, "query_id", "left").groupBy("query_id").agg(F.count("*").alias("blocks"), below.alias("skipped"))
