"""Toxicity scores from class-conditional Kneser-Ney models.

Two kinds of models compare a text's probability as a toxic and as an ordinary one. Those
of words and pairs of words (``expressions``) grow with the corpus and know every script.
Those of spelling see texts folded to 32 symbols (letters without accents or case, digits,
marks, white space) in runs of four, 32^4 cells whatever the input: they catch what is
spelt like a toxic word. Either class discounts its own counts and backs off to the counts
of all texts, labelled or not, so what is rare in both classes gets nearly the same
probability from both.

A text is judged by length-normalised log-likelihood ratios, of both signs: per word and per
symbol of the whole text, of its most toxic word or pair, and of its most toxic stretch of
``WINDOW`` symbols. A logistic function, fitted on labelled texts that the class models
have not seen, turns the four into a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.expressions import Evidence, gather
from leafmill.llm.spark import arrays, bounded_batches, stored
from leafmill.llm.words import segments, slices
from leafmill.operators.frames import broadcast_if_small

SYMBOLS = 32
ORDER = 4
CELLS = SYMBOLS**ORDER
WINDOW = 12
DISCOUNT = 0.75
BACKOFF = 32.0  # pseudo-counts of the shared model in each context of a class
CALIBRATION_ROWS = 20_000  # labelled texts that fit the logistic function, at most
TOXIC_WEIGHT = 3.0  # of a toxic text in that fit; they are the fewer
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
FEATURES = ["mean", "peak", "words", "expression"]


def _symbol(char: str) -> int:
    base = unicodedata.normalize("NFD", char)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    if base.isdigit():
        return 27
    if base in "'’`":
        return 28
    if base in ".,!?;:":
        return 29
    return 0 if base < "\x80" else 30


# Single bytes, and second bytes of the two-byte characters that begin with 0xC3.
_ASCII = np.array([_symbol(chr(b)) if b < 128 else 31 for b in range(256)], np.uint8)
_LATIN = np.array([_symbol(chr(b + 0x40)) if 0x80 <= b < 0xC0 else 31 for b in range(256)], np.uint8)


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs of four symbols, and how many each text has.

    A text counts with three blanks before and one after it; an empty one has no runs.
    """
    pad = b" " * (ORDER - 1)
    coded = [pad + t.encode("utf-8", "replace") + b" " if t else b"" for t in texts]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    if not len(raw):
        return np.empty(0, np.int32), sizes
    symbols = _ASCII[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    symbols[after] = _LATIN[raw[after]]
    kept = raw < 0xC0  # a first byte of several says nothing by itself
    filled = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[filled]
    counts = sizes.copy()
    counts[filled] = np.add.reduceat(kept, starts, dtype=np.int64)
    symbols = symbols[kept].astype(np.int32)
    n = len(symbols) - ORDER + 1
    cells = symbols[:n].copy()
    for k in range(1, ORDER):
        cells = cells * SYMBOLS + symbols[k : n + k]
    inside = np.ones(len(symbols), bool)
    ends = np.cumsum(counts[filled])
    for k in range(1, ORDER):
        inside[ends - k] = False
    return cells[inside[:n]], np.maximum(counts - ORDER + 1, 0)


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS).cast("int")


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(label_id, label): one row per labelled document outside the held-out fold.

    Rows without id or with a label other than 0 or 1 are ignored; of several labels
    the toxic one counts.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    return rows.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))


def run_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cell, ordinary, toxic, every): how often each run of symbols occurs."""
    trained = broadcast_if_small(labels.where(fold(F.col("label_id")) != CALIBRATION))
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    rows = rows.join(trained, "label_id", "left").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, CELLS), np.int64)
        for batch in batches:
            names = batch.column(1).to_numpy(zero_copy_only=False)
            done = 0
            for part in slices(batch.column(0).to_pylist()):
                cells, counts = runs(part)
                totals[2] += np.bincount(cells, minlength=CELLS)
                owners = np.repeat(names[done : done + len(part)], counts)
                for label in (0, 1):
                    if (own := owners == label).any():
                        totals[label] += np.bincount(cells[own], minlength=CELLS)
                done += len(part)
        seen = np.flatnonzero(totals[2])
        for at in range(0, len(seen), 1 << 16):
            cells = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (cells, *totals[:, cells])], ["cell", "ordinary", "toxic", "every"])

    found = rows.mapInArrow(count, "cell long, ordinary long, toxic long, every long")
    return found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("ordinary", "toxic", "every")))


def _dense(counts: DataFrame) -> np.ndarray:
    """Rows of the ordinary, toxic and all texts' counts, a column per cell."""
    tables = np.zeros((3, CELLS), np.float32)
    found = arrays(counts)  # 32^4 rows at most
    for i, name in enumerate(("ordinary", "toxic", "every")):
        tables[i, found["cell"]] = found[name]
    return tables


def _shared(counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of each symbol after each context of three."""
    orders = [counts]
    while orders[-1].size > SYMBOLS:
        orders.append((orders[-1].reshape(SYMBOLS, -1) > 0).sum(0).astype(float))
    p = (orders[-1] + 0.1) / (orders[-1] + 0.1).sum()
    for table in orders[-2::-1]:
        rows = table.reshape(-1, SYMBOLS)
        below = np.tile(p.reshape(-1, SYMBOLS), (len(rows) * SYMBOLS // p.size, 1))
        total = rows.sum(1, keepdims=True)
        kinds = (rows > 0).sum(1, keepdims=True)
        own = (np.maximum(rows - DISCOUNT, 0) + DISCOUNT * kinds * below) / np.maximum(total, 1)
        p = np.where(total > 0, own, below).ravel()
    return p


def log_ratios(ordinary: np.ndarray, toxic: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Of each run: the log probability of its last symbol in toxic less that in ordinary texts."""
    below = _shared(every.astype(float)).reshape(-1, SYMBOLS)

    def model(counts: np.ndarray) -> np.ndarray:
        rows = counts.reshape(-1, SYMBOLS).astype(float)
        kinds = (rows > 0).sum(1, keepdims=True)
        own = np.maximum(rows - DISCOUNT, 0) + (DISCOUNT * kinds + BACKOFF) * below
        return own / (rows.sum(1, keepdims=True) + BACKOFF)

    return np.log(model(toxic) / model(ordinary)).ravel().astype(np.float32)


def ratios(text: Column, table: Broadcast) -> Column:
    """struct(mean, peak): the ratio per symbol of the whole text and of its most toxic stretch."""

    @F.arrow_udf("struct<mean: double, peak: double>")
    def both(texts: pa.Array) -> pa.Array:
        means, peaks = [], []
        for part in slices(texts.to_pylist()):
            cells, counts = runs(part)
            sums = np.concatenate(([0.0], np.cumsum(table.value[cells], dtype=float)))
            steps = sums[WINDOW:] - sums[:-WINDOW]
            for a, b in segments(counts):
                means.append((sums[b] - sums[a]) / (b - a) if b > a else 0.0)
                peaks.append(steps[a : b - WINDOW + 1].max() / WINDOW if b - a >= WINDOW else means[-1])
        return pa.StructArray.from_arrays([pa.array(means, pa.float64()), pa.array(peaks, pa.float64())], ["mean", "peak"])

    return both(text)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Newton's method with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return [float(b) for b in beta]


@dataclass
class Model:
    """The broadcast table of log ratios, the evidence of expressions and the logistic function's numbers."""

    table: Broadcast
    evidence: Evidence
    beta: list[float] | None = None

    def features(self, rows: DataFrame) -> DataFrame:
        """The columns of (text, ...) but the text, with ``FEATURES``; null texts are as empty ones."""
        own = [c for c in rows.columns if c != "text"]
        mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
        found = rows.select(*own, mark, ratios(F.col("text"), self.table).alias("r"), self.evidence.lookup(F.col("text")).alias("said"))
        joined = self.evidence.joined(found.select(*own, "mark", "r.mean", "r.peak", "said"))
        said = F.col("total") / F.greatest("n", F.lit(1))
        return joined.select(*own, "mark", "mean", "peak", said.alias("words"), F.col("top").alias("expression"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """The columns of (text, ...) but the text, with mark and score, 0 to 1.

        Null and empty texts are scored as texts without any evidence.
        """
        if self.beta is None:
            mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
            return rows.select(*(c for c in rows.columns if c != "text"), mark, F.lit(0.0).alias("score"))
        start, *slopes = self.beta
        found = self.features(rows)
        power = sum((b * F.col(c) for b, c in zip(slopes, FEATURES, strict=True)), F.lit(start))
        return found.withColumn("score", 1 / (1 + F.exp(-power))).drop(*FEATURES)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labels outside the held-out fold and from the texts of all documents.

    Fold: crc32 of the id as text, modulo 5. Fold 0 is held out, folds 1 to 3 give the
    class counts, fold 4 fits the logistic function, with ``CALIBRATION_ROWS`` rows at
    most. Without labels of both classes there is no evidence and every score is 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    labels = known_labels(labels)
    tables = _dense(run_counts(docs, labels, id_col, text_col))
    table = spark.sparkContext.broadcast(log_ratios(*tables))
    both = bool(tables[0].any() and tables[1].any())
    del tables
    pa.default_memory_pool().release_unused()
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    trained = broadcast_if_small(labels.where(fold(F.col("label_id")) != CALIBRATION))
    model = Model(table, gather(rows.join(trained, "label_id", "left").select("text", "label")))
    some = broadcast_if_small(
        labels.where(fold(F.col("label_id")) == CALIBRATION)
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(CALIBRATION_ROWS)
    )
    seen = model.features(rows.join(some, "label_id").select("label", "text")).select("label", *FEATURES).toPandas()
    y = seen["label"].to_numpy(dtype=float)
    pa.default_memory_pool().release_unused()
    if len(set(y)) < 2 or not both:
        return model
    order = np.lexsort((*(seen[c] for c in reversed(FEATURES)), y))
    x = seen[FEATURES].to_numpy()[order]
    model.beta = _logistic(x, y[order], np.where(y[order] > 0, TOXIC_WEIGHT, 1.0))
    return model


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, learnt by ``fit`` on the same rows.

    Repeated rows each give a row, an empty table gives none, other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return model.scored(rows).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    found = fit(docs, labels, id_col, text_col).scored(docs.select(F.col(text_col).alias("text")))
    marks = stored(found.where("score >= 0.5").select(F.col("mark").alias("t_mark")).distinct(), "toxic-texts")
    here = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("t_mark")
    return docs.join(broadcast_if_small(marks), here, "left_anti")
