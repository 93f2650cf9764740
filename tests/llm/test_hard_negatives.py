import random

import numpy as np
import pytest

from leafmill.llm import hard_negatives


def brute(rows, every):
    """Every anchor against every row; ``rows`` has one (id, label, vector) per id."""
    out = []
    for a, own, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, label) for i, label, w in rows if i != a)
        positives = [(i, -s) for s, i, label in scored if label == own][:5]
        others = [(i, -s) for s, i, label in scored if label != own]
        for p, s in positives:
            kept = [(i, n) for i, n in others if 50 * s <= 100 * n <= 95 * s][:3]
            out += [(a, p, rank, i, s, n) for rank, (i, n) in enumerate(kept, 1)]
    return sorted(out)


def taking_part(rows):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * x)) for x in v]
        if i not in best or (label, whole) < best[i]:
            best[i] = (label, whole)
    return [(i, label, v) for i, (label, v) in best.items()]


def mined(spark, rows, every=50, **names):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(tuple(r) for r in hard_negatives.mined(frame, every, **names).collect())


@pytest.mark.parametrize("seed", range(3))
def test_small_whole_vectors(spark, monkeypatch, seed):
    """Many ties, scores of zero and below, windows that hold their own score; several blocks on both sides."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 8)
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-1, 3) / 256 for _ in range(3)], rng.randrange(4)) for i in range(-30, 260)]
    rng.shuffle(rows)
    assert mined(spark, rows, 5) == brute(taking_part(rows), 5)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [(120, [nan, 0.0, 0.0, 1.0], 1), (121, [None, 1.0, 1.0, 1.0], 1), (122, None, 0), (123, [1.0, inf, 0.0, 0.0], 2), (124, [1.0] * 4, None)]
    rows += [(None, [1.0] * 4, 1), (125, [], 1), (126, [2.0], 0), (127, [1.0, 2.0, 3.0, 4.0, 5.0], 2)]
    rows += rows[:40] + [(50, [9.0] * 4, 0), (100, [9.0] * 4, 2)]
    assert mined(spark, rows) == brute(taking_part(rows), 50)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = frame.selectExpr("vec_id as name", "embedding as points", "label as kind", "1 as id", "'x' as vector", "2 as score", "3 as anchor", "4 as k")
    other = hard_negatives.mined(wide, id_col="name", vector_col="points", label_col="kind")
    assert sorted(tuple(r) for r in other.collect()) == mined(spark, rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_large_components(spark):
    """Scores beyond the whole numbers of floating point stay exact."""
    big = float(1 << 21)
    rows = [(0, [big, 1 / 256], 0), (1, [big, 2 / 256], 0), (2, [big * 0.9, 1 / 256], 1), (3, [big * 0.9, 2 / 256], 1), (4, [big * 0.6, 0.0], 2)]
    rows += [(5, [1e300, 0.0], 3)]
    got = mined(spark, rows)
    assert got == [r for r in brute(taking_part(rows[:5]), 50)]


def test_equal_vectors(spark, monkeypatch):
    """One vector many times: ties go by id over all blocks, one label holds most rows."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 32)
    rows = [(i, [0.25, 0.5], 0 if i % 3 else 1) for i in range(200)] + [(i, [0.2, 0.45], i % 4) for i in range(200, 400)]
    assert mined(spark, rows) == brute(taking_part(rows), 50)


def test_keys_sort_as_bytes():
    rng = random.Random(2)
    ends = [-(1 << 63) + 1, -1, 0, 1, (1 << 63) - 1]
    pairs = [(rng.choice(ends), rng.choice(ends), rng.choice(ends), rng.randrange(2)) for _ in range(300)]
    keys = sorted(hard_negatives.pack(*p) for p in pairs)
    assert [hard_negatives.unpack(k) for k in keys] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_iterator_holds_no_anchor():
    """Keys come out as they come in: a negative is emitted before the next key is read."""
    read = []

    def keys():
        for score, name, other in [(100, 1, 0), (90, 2, 1), (80, 3, 1), (70, 4, 1), (60, 5, 1)] + [(50 - i, 10 + i, 1) for i in range(50)]:
            read.append(name)
            yield hard_negatives.pack(7, score, name, other)

    found = hard_negatives.negatives(keys())
    assert next(found) == (7, 1, 1, 2, 100, 90)
    assert read == [1, 2]
