"""Quality scores: ridge regression on random Fourier features of document statistics.

Each text gives ``STATISTICS``: lengths, shares of kinds of characters, how often words,
pairs of words and lines repeat. They are standardised over all documents and turned into
cosines of random directions, whose inner products approximate a Gaussian kernel. Every
partition sums the normal equations of its labelled rows, in whole numbers, so that the
sum does not depend on how the rows are dealt out; their size is fixed by the number of
features. The solution gives raw scores, and isotonic regression on labelled rows that the
fit has not seen turns these into probabilities.

Labels are read outside the held-out fold only. The statistics are those of the text
alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.spark import bounded_batches, stored
from leafmill.llm.toxicity import fold
from leafmill.operators.frames import broadcast_if_small

STATISTICS = [
    "log_bytes",
    "log_words",
    "word_length",
    "word_length_deviation",
    "one_letter_words",
    "distinct_words",
    "commonest_word",
    "equal_neighbours",
    "distinct_pairs",
    "log_lines",
    "distinct_lines",
    "letters",
    "capitals",
    "other_letters",
    "digits",
    "white_space",
    "sentence_marks",
    "symbols",
    "words_per_sentence",
    "byte_entropy",
]
FEATURES = 256
SEED = 13
RIDGE = 1e-3  # times the number of labelled rows
WHOLE = 1 << 14  # features are rounded to 1 / WHOLE in the normal equations
FARTHEST = 4.0  # standard deviations; statistics beyond are cut to it
BINS = 1024  # of raw scores, per unit, from LOWEST to HIGHEST
LOWEST, HIGHEST = -1.0, 2.0
HELD_OUT = 0  # fold of crc32 of the id, modulo 5
CALIBRATION = 4
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Which class each byte counts for: letters, capitals, other letters, digits, white space, marks, symbols."""
    table = np.zeros((256, 7))
    for byte in range(256):
        char = chr(byte)
        if byte >= 128:
            table[byte, [0, 2]] = 1
        elif char.isalpha():
            table[byte, 0] = 1
            table[byte, 1] = char.isupper()
        elif char.isdigit():
            table[byte, 3] = 1
        elif char.isspace():
            table[byte, 4] = 1
        else:
            table[byte, 5 if char in ".,!?;:" else 6] = 1
    return table


_CLASSES = _classes()
_SENTENCE = re.compile(r"[.!?。！？]+(?=\s|$)")


def statistics(text: str) -> list[float]:
    """The values of ``STATISTICS``; zeros for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    histogram = np.bincount(raw, minlength=256)
    share = histogram[histogram > 0] / len(raw)
    letters, capitals, others, digits, spaces, marks, symbols = (histogram @ _CLASSES).tolist()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for line in text.split("\n") if (x := line.strip())]
    return [
        np.log1p(len(raw)),
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        float((lengths == 1).mean()),
        len(set(words)) / n,
        max(Counter(words).values()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        letters / len(raw),
        capitals / max(1.0, letters),
        others / max(1.0, letters),
        digits / len(raw),
        spaces / len(raw),
        marks / n,
        symbols / n,
        np.log1p(n / (1 + len(_SENTENCE.findall(text)))),
        float(-(share * np.log2(share)).sum()),
    ]


def of_text(text: Column) -> Column:
    """The statistics of a text as an array; null counts as empty."""

    @F.arrow_udf("array<float>")
    def values(texts: pa.Array) -> pa.Array:
        table = np.array([statistics(t or "") for t in texts.to_pylist()], np.float32).reshape(-1, len(STATISTICS))
        cuts = np.arange(0, table.size + 1, len(STATISTICS), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(table.ravel()))

    return values(text)


def directions(inputs: int, features: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies and phases for a Gaussian kernel whose width is the root of the number of inputs."""
    chance = np.random.default_rng(seed)
    return chance.standard_normal((inputs, features)) / np.sqrt(inputs), chance.uniform(0, 2 * np.pi, features)


def cosines(table: np.ndarray, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """The features of standardised rows, the first one a constant."""
    frequencies, phases = directions(table.shape[1], features)
    standard = np.clip((table - mean) / deviation, -FARTHEST, FARTHEST)
    return np.column_stack((np.ones(len(table)), np.cos(standard @ frequencies + phases)))


def isotonic(at: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks of the non-decreasing step function nearest to the shares of ones.

    ``at`` is sorted; neighbours that violate the order are pooled.
    """
    blocks: list[list[float]] = []  # sum of places, ones, rows
    for place, one, n in zip(at.tolist(), ones.tolist(), rows.tolist(), strict=True):
        blocks.append([place * n, one, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _matrix(batch: pa.Array) -> np.ndarray:
    return batch.flatten().to_numpy().astype(float).reshape(len(batch), -1)


@dataclass
class Model:
    """Standardisation, the solution of the ridge, and the calibration's places and values."""

    mean: np.ndarray
    deviation: np.ndarray
    beta: np.ndarray | None
    places: np.ndarray
    values: np.ndarray

    def raw(self, values: Column) -> Column:
        mean, deviation, beta = self.mean, self.deviation, self.beta

        @F.arrow_udf("double")
        def scores(rows: pa.Array) -> pa.Array:
            found = cosines(_matrix(rows), mean, deviation, len(beta) - 1) @ beta
            return pa.array(np.round(found, 9), pa.float64())  # the last bits depend on a row's place in its batch

        return scores(values)

    def score(self, values: Column) -> Column:
        """Of an array of statistics: how likely label 1 is, between the calibration's blocks by interpolation."""
        if self.beta is None:
            return F.lit(float(self.values[0]))
        places, steps = self.places, self.values

        @F.arrow_udf("double")
        def calibrated(raw: pa.Array) -> pa.Array:
            return pa.array(np.interp(raw.to_numpy(), places, steps), pa.float64())

        return calibrated(self.raw(values))


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(label_id, label): one row per labelled document outside the held-out fold.

    Rows without id or with a label other than 0 or 1 are ignored; of several labels the
    lower one counts.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    return rows.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label"))


def normal_equations(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, int]:
    """Sums over (label, stats) of the products of all features and the label, and the number of rows.

    The last row and column are those of the label. A partition gives one row per cell.
    """
    size = features + 2
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                table = np.column_stack((cosines(_matrix(batch.column(1)), mean, deviation, features), batch.column(0).to_numpy()))
                whole = np.rint(table * WHOLE)
                total += (whole.T @ whole).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["cell", "total"])

    cells = rows.select("label", "stats").mapInArrow(sums, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total"))
    found = cells.toPandas()  # one row per pair of features
    flat = np.zeros(len(upper[0]))
    flat[found["cell"].to_numpy(int)] = found["total"].to_numpy(float) / WHOLE**2
    table = np.zeros((size, size))
    table[upper] = flat
    return table + np.triu(table, 1).T, round(table[0, 0])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from (id, stats) of all documents and from ``known_labels``.

    Folds 1 to 3 fit the ridge, fold 4 the calibration, whatever their number of rows.
    Without labels of both classes in both, every score is the share of label 1 (0.5 without
    labels).
    """
    moments = [f(F.get("stats", F.lit(k)).cast("double")) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    row = np.array([v or 0.0 for v in stats.agg(*moments).first()]).reshape(-1, 2)
    mean, deviation = row[:, 0], np.where(row[:, 1] > 1e-9, row[:, 1], 1.0)
    known = stored(stats.join(broadcast_if_small(labels), F.col("id") == F.col("label_id")).select("label_id", "label", "stats"), "labelled")
    counted = known.groupBy("label", (fold(F.col("label_id")) == CALIBRATION).alias("later")).count().collect()
    ones, rows = (sum(r["count"] for r in counted if r["label"] in kinds) for kinds in ((1,), (0, 1)))
    if len(counted) < 4:
        return Model(mean, deviation, None, np.zeros(1), np.array([ones / rows if rows else 0.5]))
    sums, n = normal_equations(known.where(fold(F.col("label_id")) != CALIBRATION), mean, deviation)
    own = sums[:-1, :-1] + RIDGE * n * np.diag([0.0] + [1.0] * FEATURES)
    model = Model(mean, deviation, np.linalg.solve(own, sums[:-1, -1]), np.zeros(1), np.zeros(1))
    later = known.where(fold(F.col("label_id")) == CALIBRATION)
    bins = F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), model.raw(F.col("stats")))) * BINS).alias("bin")
    shares = later.select(bins, "label").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("rows")).orderBy("bin").toPandas()
    model.places, model.values = isotonic(*(shares[c].to_numpy(float) for c in ("bin", "ones", "rows")))
    model.places = model.places / BINS
    return model


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, learnt by ``fit`` on the same rows.

    Equal texts have equal scores. Null and empty texts count as texts whose statistics are
    all zero. Repeated rows each give a row, an empty table gives none, other columns are
    not read.
    """
    bounded_batches(docs.sparkSession)
    stats = stored(docs.select(F.col(id_col).alias("id"), of_text(F.col(text_col)).alias("stats")), "statistics")
    model = fit(stats, known_labels(labels))
    rows = stats.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == HELD_OUT).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
