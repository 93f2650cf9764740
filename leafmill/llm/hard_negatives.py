"""Hard negatives of anchors by a secondary-sort shuffle of packed pair scores.

The score of two vectors is their inner product. Every anchor takes the rows of its label
with the highest scores as positives, and of each positive the rows of other labels whose
score lies in a window below the positive's.

Pairs are scored in tiles, a block of anchors against a block of rows; no pair is a row
of a frame. What a tile has to say about an anchor is cut to what can matter: of its own
label the best few, of other labels the best few of each window; both are combined exactly,
as the best of all are among the best of each tile. These pairs become keys of bytes,
(anchor, descending score, id), which sort as they are written.
``repartitionAndSortWithinPartitions`` brings an anchor's keys together in that order, and
an iterator goes through them once: a row of the anchor's label opens a window, a row of
another label is emitted for each window that is open at its score and not full. It holds
the windows of one anchor and the rows that tie with the current score, never an anchor's
rows.

The windows follow from the positives, so there are two such passes: the first finds the
positives, the second scores other labels against their windows. Neither the anchors nor
the rows travel to all tasks; both sides are cut into blocks of bounded bytes, and each
tile is one key of a join.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.spark import bounded_batches, shuffle_parts, stored

POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # per cent of the positive's score
SCALE = 256  # components are floor(SCALE * x)
LARGEST = float(1 << 53)  # components beyond are cut to it
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20  # a block of rows has no more, unless one vector has
ANCHOR_ROWS, ANCHOR_BYTES = 16_384, 16 << 20  # a block of anchors
BLOCKS_PER_KEY = 256  # blocks of rows that meet a block of anchors under one key of the join, about
ANCHOR_SLICE = 256  # anchors of a block scored at once
KEY = struct.Struct(">QQQBq")  # anchor, descending score, id, label (0 is the anchor's own), score
SHIFT = 1 << 63
NO_ROW = np.iinfo(np.int64).min
BLOCKS = "part long, block long, n int, width int, ids binary, labels binary, vectors binary"
PAIRS = "anchor long, score long, id long, other int"


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part, with whole components.

    Rows with a null id, label, vector or component, or one that is not finite, don't. Of
    several rows with one id the one with the least label, then vector, counts.
    """
    whole = F.transform(F.col(vector_col), _whole)
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    kept = kept.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), whole.alias("vector")).alias("v"))
    return kept.groupBy("id").agg(F.min("v").alias("v")).select("id", "v.label", "v.vector")


def _whole(x: Column) -> Column:
    scaled = x.cast("double") * float(SCALE)
    return F.when(F.abs(scaled) < LARGEST, F.floor(scaled).cast("double")).otherwise(F.signum(x.cast("double")) * LARGEST)


def packed(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the rows of each partition: ids, labels and vectors as bytes, sorted by id.

    A shorter vector counts as if zeros followed.
    """

    def block(part: int, number: int, ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        width = max(1, max(map(len, vectors)))
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        table = np.zeros((len(ids), width))
        for place, k in enumerate(order.tolist()):
            table[place, : len(vectors[k])] = vectors[k]
        values = [part, number, len(ids), width, np.array(ids, np.int64)[order].tobytes(), np.array(labels, np.int64)[order].tobytes(), table.tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, 0
        ids, labels, vectors = [], [], []
        for batch in batches:
            column = batch.column(2)
            flat, cuts = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            for k, (name, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                vector = flat[cuts[k] : cuts[k + 1]]
                if ids and (len(ids) == most_rows or size + vector.nbytes > most_bytes):
                    yield block(part, number, ids, labels, vectors)
                    ids, labels, vectors, number, size = [], [], [], number + 1, 0
                ids.append(name)
                labels.append(label)
                vectors.append(vector)
                size += vector.nbytes
        if ids:
            yield block(part, number, ids, labels, vectors)

    return rows.mapInArrow(blocks, BLOCKS)


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The blocks written, with gapless numbers in the column ``k``, and how many they are."""
    written = stored(blocks, name)
    counts = written.groupBy("part").agg(F.count("*").alias("c")).collect()  # a row per partition
    ends, at = [], 0
    for row in sorted(counts, key=lambda r: r["part"]):
        ends.append((row["part"], at))
        at += row["c"]
    offsets = written.sparkSession.createDataFrame(ends or [(0, 0)], "part long, first long")
    return written.join(F.broadcast(offsets), "part").withColumn("k", F.col("first") + F.col("block")).drop("part", "block", "first"), at


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole components as 64-bit integers.

    In floating point where every sum is sure to be exact, else in integers, which wrap
    beyond 64 bits.
    """
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (anchors, rows))
    if np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * width < LARGEST:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _best(scores: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best few of each row that are no ``NO_ROW``; among ties the leftmost first."""
    rows, columns = scores.shape
    if columns > few:
        least = np.partition(scores, columns - few, axis=1)[:, columns - few]
    else:
        least = np.full(rows, NO_ROW)
    at, column = np.nonzero((scores >= least[:, None]) & (scores > NO_ROW))
    order = np.lexsort((column, -scores[at, column], at))
    at, column = at[order], column[order]
    first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.empty(0, bool)
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[rank < few], column[rank < few]


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "vectors"], np.float64).reshape(row[prefix + "n"], row[prefix + "width"])


def tiled(rows: DataFrame, anchors: DataFrame, groups: int, of_tile: Callable[[dict], Iterable[tuple]], slices: int) -> DataFrame:
    """``PAIRS`` of all tiles.

    Each block of rows meets each block of anchors once: the rows go to a slice by their
    number, and the anchors to every slice.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))).alias("g")
    left = rows.select("*", F.pmod("k", F.lit(slices)).cast("int").alias("s"), spread)
    right = anchors.select(
        F.col("k").cast("int").alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"),
        *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "k"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PAIRS.split(", ")]
        for batch in batches:
            for at in range(batch.num_rows):
                for columns in of_tile(batch.slice(at, 1).to_pylist()[0]):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "other" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

    return left.join(right, ["g", "s"]).drop("g", "s", "k").mapInArrow(score, PAIRS)


def own_label(row: dict) -> Iterator[tuple]:
    """The best ``POSITIVES`` rows of each anchor's label in a tile."""
    ids, labels, vectors = _unpacked(row)
    a_ids, a_labels, a_vectors = _unpacked(row, "a_")
    for label in np.intersect1d(labels, a_labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
        for first in range(0, len(theirs), ANCHOR_SLICE):
            part = theirs[first : first + ANCHOR_SLICE]
            scores = products(a_vectors[part], vectors[mine])
            scores[a_ids[part][:, None] == ids[mine][None, :]] = NO_ROW
            at, column = _best(scores, POSITIVES)
            yield a_ids[part][at], scores[at, column], ids[mine][column], np.zeros(len(at), np.int32)


def other_labels(row: dict) -> Iterator[tuple]:
    """The best ``NEGATIVES`` rows of other labels in each window of a tile's anchors."""
    ids, labels, vectors = _unpacked(row)
    a_ids, a_labels, a_vectors = _unpacked(row, "a_")
    opened = np.frombuffer(row["a_opened"], np.int64).reshape(len(a_ids), POSITIVES)
    for first in range(0, len(a_ids), ANCHOR_SLICE):
        part = slice(first, first + ANCHOR_SLICE)
        scores = products(a_vectors[part], vectors)
        scores[a_labels[part][:, None] == labels[None, :]] = NO_ROW
        found = set()
        for k in range(POSITIVES):
            low, high = window_bounds(opened[part, k])
            inside = np.where((scores >= low[:, None]) & (scores <= high[:, None]), scores, NO_ROW)
            some = np.flatnonzero((inside > NO_ROW).any(1))
            at, column = _best(inside[some], NEGATIVES)
            found.update(zip(some[at].tolist(), column.tolist(), strict=True))
        at, column = np.array(sorted(found), np.int64).reshape(-1, 2).T
        yield a_ids[part][at], scores[at, column], ids[column], np.ones(len(at), np.int32)


def window_bounds(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score with LEAST * s <= 100 * n <= MOST * s; an empty window for no positive or one below zero."""
    whole = [int(s) for s in score.tolist()]  # products with 100 may not fit 64 bits
    low = [-(-LEAST * s // 100) if s >= 0 else 1 for s in whole]
    high = [MOST * s // 100 if s >= 0 else 0 for s in whole]
    return np.array(low, np.int64), np.array(high, np.int64)


def pack(anchor: int, score: int, name: int, other: int) -> bytes:
    """A key whose bytes sort by anchor, descending score and id."""
    return KEY.pack(anchor + SHIFT, SHIFT - 1 - score, name + SHIFT, other, score)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, id, other)."""
    anchor, _, name, other, score = KEY.unpack(key)
    return anchor - SHIFT, score, name - SHIFT, other


def _anchor_hash(key: bytes) -> int:
    x = (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return x >> 33


def _sorted_keys(pairs: DataFrame, parts: int):
    keys = pairs.rdd.map(lambda r: (pack(r["anchor"], r["score"], r["id"], r["other"]), None))
    return keys.repartitionAndSortWithinPartitions(parts, _anchor_hash).keys()


def first_positives(keys: Iterable[bytes]) -> Iterator[tuple[int, int, int]]:
    """(anchor, positive, score) of the first ``POSITIVES`` keys of each anchor."""
    last, left = None, 0
    for key in keys:
        anchor, score, name, _ = unpack(key)
        if anchor != last:
            last, left = anchor, POSITIVES
        if left:
            left -= 1
            yield anchor, name, score


def negatives(keys: Iterable[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive_score, negative_score) from sorted keys.

    Positives open windows; rows of other labels come out for all windows that hold their
    score and have room. Only a positive of score 0 has its window at its own score; of the
    rows that tie with it the first few of other labels are kept for that.
    """
    for anchor, own in groupby(map(unpack, keys), key=lambda k: k[0]):
        windows: list[list[int]] = []  # positive, its score, emitted so far
        tied, at = [], None
        for _, score, name, other in own:
            if score != at:
                tied, at = [], score
            if other:
                if score == 0 and len(tied) < NEGATIVES:
                    tied.append(name)
                for window in windows:
                    if window[2] < NEGATIVES and LEAST * window[1] <= 100 * score <= MOST * window[1]:
                        window[2] += 1
                        yield anchor, window[0], window[2], name, window[1], score
            else:
                windows.append([name, score, 0])
                for negative in tied if score == 0 else ():
                    windows[-1][2] += 1
                    yield anchor, name, windows[-1][2], negative, score, 0


def mined(rows: DataFrame, anchor_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``. An anchor without other
    rows of its label, or a positive without rows in its window, gives no row; so does an
    empty table. ``usable`` says which rows take part; other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    parts = shuffle_parts(spark)
    taking_part = stored(usable(rows, id_col, vector_col, label_col), "vectors")
    blocks, n_blocks = _numbered(packed(taking_part), "blocks")
    asked = taking_part.where(F.pmod("id", F.lit(anchor_every)) == 0)
    asked = stored(asked.repartition(_groups(asked), "id"), "anchors")
    anchors, groups = _numbered(packed(asked, ANCHOR_ROWS, ANCHOR_BYTES), "anchor-blocks")
    slices = max(1, -(-parts // max(1, groups)), -(-n_blocks // BLOCKS_PER_KEY))
    best = tiled(blocks, anchors, groups, own_label, slices)
    positives = _frame(spark, _sorted_keys(best, parts).mapPartitions(first_positives), "anchor long, id long, score long")
    positives = stored(positives, "positives")
    opened = positives.groupBy("anchor").agg(F.collect_list("score").alias("opened"))  # POSITIVES values at most
    with_windows = anchors_with_windows(anchors, opened)
    other = tiled(blocks, with_windows, groups, other_labels, slices)
    keys = positives.select("anchor", "score", "id", F.lit(0).alias("other")).union(other)
    found = _sorted_keys(keys, parts).mapPartitions(negatives)
    return _frame(spark, found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _groups(asked: DataFrame) -> int:
    """Partitions that fill about one block of anchors each."""
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("vector") * 8).alias("b")).first()
    return max(1, -(-size["n"] // ANCHOR_ROWS), -(-(size["b"] or 0) // ANCHOR_BYTES))


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema, verifySchema=False)


def anchors_with_windows(anchors: DataFrame, opened: DataFrame) -> DataFrame:
    """Anchor blocks with a column ``opened``: the positives' scores of each anchor in the order of its ids, padded with -1."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k)), pa.array(names)], ["k", "anchor"])

    members = anchors.select("k", "ids").mapInArrow(ids, "k long, anchor long")
    padded = F.slice(F.concat(F.coalesce("opened", F.array().cast("array<long>")), F.array_repeat(F.lit(-1).cast("long"), POSITIVES)), 1, POSITIVES)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("anchor", padded.alias("w")))), lambda x: x["w"])  # ANCHOR_ROWS at most
    by_block = members.join(opened, "anchor", "left").groupBy("k").agg(F.flatten(scores).alias("w"))

    @F.arrow_udf("binary")
    def as_bytes(values: pa.Array) -> pa.Array:
        return pa.array([np.array(v, np.int64).tobytes() for v in values.to_pylist()], pa.binary())

    return anchors.join(by_block.select("k", as_bytes("w").alias("opened")), "k")
