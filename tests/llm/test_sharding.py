from collections import Counter

import pytest

from leafmill.llm import sharding


def check(rows, got, shards=16):
    assert sorted(repr((d, t)) for d, t in rows) == sorted(repr((r.doc_id, r.text)) for r in got)
    assert all(r.size_ == len((r.text or "").encode()) + 1 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size_
    return [loads[s] for s in range(shards)]


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sharding.sharded(frame, **options).withColumnRenamed("size", "size_").collect()


def test_sizes_are_near_equal_and_equal_texts_together(spark):
    rows = [(i, f"text {i % 1900} " * (i % 23)) for i in range(4000)]
    got = run(spark, rows)
    loads = check(rows, got)
    assert max(loads) < 1.02 * sum(loads) / 16 and min(loads) > 0.98 * sum(loads) / 16
    home = {}
    for r in got:
        assert home.setdefault(r.text, r.shard) == r.shard


def test_large_groups(spark):
    rows = [(i, "a group that is larger than one shard by itself") for i in range(1500)]
    rows += [(5000 + i, "half of a shard") for i in range(300)]
    rows += [(10_000 + i, f"single text number {i}") for i in range(2500)]
    got = run(spark, rows)
    loads = check(rows, got)
    assert max(loads) < 1.05 * sum(loads) / 16 and min(loads) > 0.95 * sum(loads) / 16
    assert len({r.shard for r in got if r.text == "half of a shard"}) == 1


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 3])
def test_large_groups_without_ids_of_their_own(spark, ids):
    rows = [(ids(i), "a group that is larger than one shard by itself") for i in range(2000)]
    rows += [(10_000 + i, f"single text number {i}") for i in range(500)]
    loads = check(rows, run(spark, rows))
    assert max(loads) < 1.05 * sum(loads) / 16 and min(loads) > 0.95 * sum(loads) / 16


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, ""), (None, None)]])
def test_few_rows(spark, rows):
    check(rows, run(spark, rows))


def test_odd_rows(odd_docs):
    frame, rows = odd_docs
    out = sharding.sharded(frame, shards=4)
    assert out.columns == [c for c in frame.columns if c not in ("size", "shard")] + ["size", "shard", "slot"]
    check(rows, out.withColumnRenamed("size", "size_").collect(), 4)


def test_splitters_count_exactly(spark):
    units = spark.createDataFrame([(i * i - 5000, 1 + i % 3) for i in range(3000)], "u long, bytes long")
    total = sum(1 + i % 3 for i in range(3000))
    goals = [total * i / 7 for i in range(1, 7)]
    for goal, key in zip(goals, sharding.splitters(units, goals, total, 5), strict=True):
        below = sum(1 + i % 3 for i in range(3000) if i * i - 5000 < key)
        assert abs(below - goal) <= 5
