"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block is article or not. A block's weight is the sum of the weights of its
features (ancestor tags, hints in class, id and role, and its text), and neighbouring
labels are weighted against each other. The field is trained by maximum likelihood on
labelled pages and decoded by Viterbi. A page's blocks are one chain, so each page is
worked on by itself and pages need no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.labelled_pages import labelled_pages
from leafmill.llm.page_blocks import NAMES, Block, blocks
from leafmill.llm.spark import bounded_batches
from leafmill.llm.words import slices

TRAINING_PAGES = 600
STEPS = 150
RIDGE = 0.02


@dataclass
class Field:
    """Weights for label 1 against 0: of features, of a first block, of label pairs."""

    features: np.ndarray
    first: float
    pairs: np.ndarray

    def decode(self, page: list[Block], known: dict[int, float] | None = None) -> list[bool]:
        """The most likely labels of a page's blocks (Viterbi)."""
        if not page:
            return []
        known = {} if known is None else known
        stay0, enter, leave, stay1 = self.pairs.ravel().tolist()
        came: list[tuple[bool, bool]] = []
        no = yes = 0.0
        for i, block in enumerate(page):
            weight = known.get(block.features)
            if weight is None:
                weight = known[block.features] = float(self.features[active(block.features)].sum())
            if i == 0:
                no, yes = 0.0, self.first + weight
                continue
            from_yes_to_no, from_yes_to_yes = yes + leave > no + stay0, yes + stay1 > no + enter
            no, yes = (
                yes + leave if from_yes_to_no else no + stay0,
                (yes + stay1 if from_yes_to_yes else no + enter) + weight,
            )
            came.append((from_yes_to_no, from_yes_to_yes))
        label = yes > no
        labels = [label]
        for step in reversed(came):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def active(mask: int) -> list[int]:
    return [i for i in range(len(NAMES)) if mask >> i & 1]


def train(pages: list[tuple[list[Block], list[bool]]]) -> Field:
    """Fit a field to labelled pages by gradient ascent on the conditional likelihood."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(p[0]) for p in pages)
    x = np.zeros((n, longest, len(NAMES)), np.float32)
    y = np.zeros((n, longest), int)
    here = np.zeros((n, longest), bool)
    for i, (page, labels) in enumerate(pages):
        for t, block in enumerate(page):
            x[i, t, active(block.features)] = 1
        y[i, : len(page)] = labels
        here[i, : len(page)] = True
    gold_x = np.einsum("ntf,nt->f", x, y * here)
    both = here[:, 1:]
    gold_pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    gold_first = y[:, 0].sum()
    weights = np.zeros(len(NAMES) + 5)
    squares = np.full(len(weights), 1e-8)
    for _ in range(STEPS):
        pairs = weights[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = x @ weights[: len(NAMES)]
        emit[:, 0, 1] += weights[len(NAMES)]
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + emit[:, t]
            forward[:, t] = np.where(here[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1])
            backward[:, t] = np.where(here[:, t + 1, None], new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        p = np.exp(forward[:, :, 1] + backward[:, :, 1] - total) * here
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = forward[:, :-1, a] + pairs[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - total
                expected[a, b] = np.exp(joint)[both].sum()
        slope = np.concatenate((gold_x - np.einsum("ntf,nt->f", x, p), [gold_first - p[:, 0].sum()], (gold_pairs - expected).ravel()))
        slope = slope / n - RIDGE * weights / 10
        squares += slope**2
        weights += 0.5 * slope / np.sqrt(squares)
    return Field(weights[: len(NAMES)], float(weights[len(NAMES)]), weights[-4:].reshape(2, 2))


def trained_field(pages: int = TRAINING_PAGES) -> Field:
    """The field of the library's own labelled pages; a few thousand blocks, fitted at once."""
    return train([(page, labels) for page, labels in map(lambda p: (blocks(p.html), p.labels), labelled_pages(pages))])


def main_text(field: Field, page: str, known: dict[int, float] | None = None) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, field.decode(found, known), strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the article of every page.

    Blocks are joined in page order by one line break. Null and empty pages and pages
    without an article give an empty text; repeated rows each give a row, an empty
    table gives none, other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    field = field or trained_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            done = 0
            for part in slices(batch.column(2).to_pylist()):
                texts = [main_text(field, p, known) for p in part]
                if len(known) > 100_000:
                    known.clear()
                ids, urls = (batch.column(i).slice(done, len(part)) for i in (0, 1))
                done += len(part)
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
