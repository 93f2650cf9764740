"""The store's changes against a plain dictionary, and the filters of its ids."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import id_filters, store, store_changes
from leafmill.session import scratch

SCHEMA = "id string, text string, lang string, embedding array<float>"


def frame(spark, values, schema=SCHEMA):
    return spark.createDataFrame(values, schema)


def state(spark, root, **options):
    return {r.id: (r.text, r.lang, list(r.embedding)) for r in store.read_store(spark, root, **options).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_changes(spark, seed):
    """Rows added, patched, deleted and added again read like the dictionary they make."""
    rng = random.Random(seed)
    root, now = scratch(spark, "t-changes"), {}
    names = [f"k{i}" for i in range(12)]
    for step in range(9):
        kind = rng.choice(["add", "add", "patch", "delete", "where", "compact"]) if step else "add"
        if kind == "add":
            new = [n for n in names if n not in now and rng.random() < 0.6]
            rows = [(n, f"{n} of {step}", rng.choice(["en", "fr", None]), [float(step), 1.0]) for n in new]
            store.append_rows(frame(spark, rows), root)
            now |= {r[0]: (r[1], r[2], r[3]) for r in rows}
        elif kind == "patch":
            some = rng.sample(names, 4)
            rows = [(n, rng.choice([None, f"new {step}"]), rng.choice([None, "de"]), rng.choice([None, [9.0, float(step)], [1.0], [float("nan"), 1.0]])) for n in some]
            store_changes.update_rows(spark, root, frame(spark, rows))
            for n, text, lang, vector in rows:
                if n in now:
                    old = now[n]
                    fits = vector is not None and len(vector) == 2 and vector[0] == vector[0]
                    now[n] = (text or old[0], lang or old[1], vector if fits else old[2])
        elif kind == "delete":
            some = rng.sample(names, 3)
            ids = some if rng.random() < 0.5 else frame(spark, [(n,) for n in some * 2], "id string")
            assert store_changes.delete_rows(spark, root, ids) == 3
            for n in some:
                now.pop(n, None)
        elif kind == "where":
            gone = [n for n, v in now.items() if v[1] == "fr"]
            assert store_changes.delete_matching(spark, root, {"lang": "fr"}) == len(gone)
            for n in gone:
                del now[n]
        else:
            store_changes.compact(spark, root)
        assert state(spark, root) == now, (step, kind)
    store_changes.compact(spark, root)
    assert state(spark, root) == now


def test_changes_write_what_they_change(spark):
    root = scratch(spark, "t-changes")
    store.write_snapshot(spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit("text").alias("text")), root)
    fs, path = store._folder(spark, store.snapshot_path(root, 1))
    before = fs.getContentSummary(path).getLength()
    store_changes.delete_rows(spark, root, ["a", "b"])
    store_changes.update_rows(spark, root, frame(spark, [("c", "new")], "id string, text string"))
    assert fs.getContentSummary(path).getLength() - before < 5000
    assert store.snapshots(spark, root) == [1] and store.batches(spark, root, 1) == [1]
    assert not store_changes.maintain(spark, root, most=3)
    assert store_changes.maintain(spark, root, most=2)
    assert store.snapshots(spark, root) == [1, 2] and store.read_store(spark, root).count() == 5000


def test_older_snapshots_keep_their_changes(spark):
    root = scratch(spark, "t-changes")
    rows = [(f"k{i}", "t", "en", [1.0, 2.0]) for i in range(4)]
    first = store.write_snapshot(frame(spark, rows), root)
    store_changes.delete_rows(spark, root, ["k0", None, "unknown"])
    copy = scratch(spark, "t-copy")
    store.copy_store(spark, root, copy)
    store_changes.compact(spark, root)
    store_changes.delete_rows(spark, root, ["k1"])
    assert set(state(spark, root)) == {"k2", "k3"}
    assert set(state(spark, root, number=first)) == set(state(spark, copy)) == {"k1", "k2", "k3"}
    store.restore_snapshot(spark, root, first)
    assert set(state(spark, root)) == {"k1", "k2", "k3"}


def test_unfinished_changes_are_not_read(spark):
    root = scratch(spark, "t-changes")
    store.write_snapshot(frame(spark, [("a", "t", "en", [1.0]), ("b", "t", "en", [1.0])]), root)
    store_changes.delete_rows(spark, root, ["a"])
    path = store.change_path(root, 1, store.DELETED, 2)
    fs, done = store._folder(spark, f"{path}/_SUCCESS")
    fs.delete(done, False)
    assert set(state(spark, root)) == {"a", "b"}
    store_changes.delete_rows(spark, root, ["b"])  # takes the next number
    assert store.changes(spark, root, 1, store.DELETED) == [3]


def test_filters_miss_no_id_and_pass_few_others(spark):
    root = scratch(spark, "t-filters")
    ids = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("id"))
    store.write_snapshot(ids.where("rand(1) < 0.5"), root)
    store.append_rows(ids.join(store.read_store(spark, root), "id", "left_anti"), root)
    known = id_filters.filters(spark, root, 1)
    assert sorted(known) == [1, 2] and id_filters.filters(spark, root, 1) == known
    found = id_filters.may_hold(ids, known)
    right = [store.read_store(spark, root, 1, b).select("id", F.lit(b).alias("batch")) for b in (1, 2)]
    assert right[0].union(right[1]).exceptAll(found.select("id", F.col("batch").cast("int"))).count() == 0
    others = spark.range(20_000, 60_000).select(F.md5(F.col("id").cast("string")).alias("id"))
    assert id_filters.may_hold(others, known).count() / (2 * 40_000) < 0.01


def test_only_batches_that_may_hold_an_id_are_read(spark):
    root = scratch(spark, "t-filters")
    for k in range(4):
        store.append_rows(frame(spark, [(f"{k}-{i}", "t", "en", [1.0]) for i in range(50)]), root)
    new = frame(spark, [(f"2-{i}", "x", "en", [1.0]) for i in range(5)] + [("9-9", "x", "en", [1.0])] * 2)
    held = id_filters.held_ids(spark, root, new.select("id"))
    files = {f.split("/batch-")[1][:8] for f in held.inputFiles() if "/batch-" in f}
    assert files == {"00000003"}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the stored ids stay where they are
    assert [r.id for r in id_filters.unstored(spark, new, root).collect()] == ["9-9"]
    store_changes.delete_rows(spark, root, ["2-0"])
    assert sorted(r.id for r in id_filters.unstored(spark, new, root).collect()) == ["2-0", "9-9"]
    assert id_filters.held_ids(spark, root, frame(spark, [("none", "x", "en", [1.0])]).select("id")) is None


def test_filters_of_odd_stores(spark):
    root = scratch(spark, "t-filters")
    store.write_snapshot(frame(spark, []), root)
    new = frame(spark, [(None, "x", "en", [1.0]), ("a", "x", "en", [1.0])])
    assert {r.id for r in id_filters.unstored(spark, new, root).collect()} == {None, "a"}
    store.append_rows(frame(spark, [("a", "t", "en", [1.0])]), root)
    assert {r.id for r in id_filters.unstored(spark, new, root).collect()} == {None}
    numbers = scratch(spark, "t-filters")
    store.write_snapshot(spark.range(100).withColumnRenamed("id", "n"), numbers)
    rows = spark.range(90, 110).withColumnRenamed("id", "n")
    assert {r.n for r in id_filters.unstored(spark, rows, numbers, "n").collect()} == set(range(100, 110))
