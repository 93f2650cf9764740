import random

import pytest

from leafmill.llm import ngram_join
from tests.llm import brute


def near_copies(seed, bases, copies, size=60):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(bases):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(20, size))]
        rows.append(" ".join(base))
        for _ in range(pick.randint(0, copies)):
            other = list(base)
            for _ in range(pick.randint(0, 3)):
                other[pick.randrange(len(other))] = pick.choice(vocabulary)
            rows.append(" ".join(other))
    pick.shuffle(rows)
    return list(enumerate(rows))


def check(spark, rows, frame=None):
    frame = spark.createDataFrame(rows, "doc_id long, text string") if frame is None else frame
    expected = brute.classes(rows)
    got = ngram_join.classes(frame).collect()
    assert len(got) == len(rows)
    back = {}
    for r in got:
        key = tuple(brute.at(x) for x in (r.text_id, r.class_id)) + (r.copies, r.links)
        back.setdefault(brute.at(r.doc_id), []).append(key)
    for d in {d for d, _ in rows}:
        want = sorted((expected[t or ""][0], expected[t or ""][2], expected[t or ""][1], expected[t or ""][3]) for i, t in rows if i == d)
        assert sorted(back[brute.at(d)]) == want, d
    return got


def test_classes_and_links_as_by_brute_force(spark):
    check(spark, near_copies(1, 120, 5))


def test_large_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "TILE_CHARS", 4000)
    check(spark, near_copies(2, 3, 90, 80))


def test_odd_rows(spark, odd_docs):
    frame, rows = odd_docs
    check(spark, rows, frame)
    kept = ngram_join.one_per_class(frame)
    assert kept.columns == frame.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len({c[4] for c in brute.classes(rows).values()})
    assert sum(t == rows[0][1] for _, t in found) == 1


def test_one_per_class_keeps_the_least_id(spark):
    rows = near_copies(3, 60, 4)
    expected = brute.classes(rows)
    kept = {r.doc_id for r in ngram_join.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {c[2] for c in expected.values()}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.classes(none).count() == 0
    assert ngram_join.one_per_class(none).count() == 0


@pytest.mark.parametrize(("threshold", "recall"), [(0.8, 0.99), (0.5, 0.9), (0.95, 0.999)])
def test_depth_meets_the_recall(threshold, recall):
    d = ngram_join.depth_for(threshold, recall)
    assert 1 - (1 - threshold**d) ** ngram_join.TREES >= recall
