import random

import pytest

from leafmill.llm import line_dedup
from tests.llm import brute


def made_up(seed):
    pick = random.Random(seed)
    vocabulary, pool = [f"w{i}" for i in range(12)], []

    def edited(line):
        words = line.split()
        i, how = pick.randrange(len(words)), pick.random()
        if how < 0.33:
            words[i] = pick.choice(vocabulary)
        elif how < 0.66:
            del words[i]
        else:
            words.insert(i, pick.choice(vocabulary))
        return " ".join(words)

    def line():
        if pool and pick.random() < 0.5:
            made = pick.choice(pool)
            made = edited(made) if made and pick.random() < 0.7 else made
        else:
            made = " ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 3, 4, 5, 9, 10, 11, 12, 20, 21])))
        pool.append(made)
        return made

    rows = [(d, "\n".join(line() for _ in range(pick.randint(1, 6)))) for d in range(90)]
    return rows + [(None, line()), (500, None), (501, ""), (3, rows[3][1]), (7, line())]


def check(rows, frame):
    got = line_dedup.deduplicated(frame).collect()
    want = [(d, t, gone, n) for (d, _), (_, t, gone, n) in zip(rows, brute.without_lines(rows), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, list(r.removed), r.lines)) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_lines_as_by_brute_force(spark, seed):
    rows = made_up(seed)
    check(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_odd_rows(odd_docs):
    frame, rows = odd_docs
    check(rows, frame)
    kept = line_dedup.without_repeated_lines(frame)
    assert kept.columns == frame.columns
    left = [(d, t) for (d, _), (_, t, gone, _) in zip(rows, brute.without_lines(rows), strict=True) if not gone or t.strip()]
    assert sorted(map(repr, left)) == sorted(repr((r.doc_id, r.text)) for r in kept.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicated(none).count() == 0


def test_one_edit_is_levenshtein():
    pick = random.Random(5)
    for _ in range(3000):
        a = [pick.randrange(3) for _ in range(pick.randint(0, 6))]
        b = [pick.randrange(3) for _ in range(pick.randint(0, 6))]
        assert line_dedup.one_edit(a, b) == (brute.distance(a, b) <= 1)
