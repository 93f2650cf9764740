"""The index by cells: recall against exact neighbours, and a store that goes on changing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import inverted_file as ivf
from leafmill.operators import search, store, store_changes
from leafmill.session import load, scratch

SF = "/root/testdata/sf0.1"


def copies(spark, times, noise=0.05):
    """The test vectors, and noisy copies of them."""
    base = load(spark, SF, "embeddings").select("vec_id", "embedding")
    many = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("n"))
    moved = F.transform("embedding", lambda x, i: (x + F.when(F.col("n") > 0, (F.pmod(F.xxhash64("vec_id", "n", i), F.lit(2001)) / 1000 - 1) * noise).otherwise(0.0)).cast("float"))
    return many.select((F.col("vec_id") * times + F.col("n")).alias("id"), moved.alias("embedding"))


def recall(found, true):
    got, want = ({(r["query_id"], r["id"]) for r in hits.select("query_id", "id").collect()} for hits in (found, true))
    return len(got & want) / len(want)


@pytest.mark.parametrize("times", [1, 25])
def test_recall(spark, times):
    """Against the exact neighbours of other queries than those that the index was measured with."""
    path = scratch(spark, "t-index")
    rows = copies(spark, times).repartition(8).persist()
    ivf.build_index(rows, path)
    index = ivf.load_index(spark, path)
    assert ivf.read_cells(spark, path, "long").count() == 2000 * times
    asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(10 * times)) == 3).select(F.col("id").alias("query_id"), "embedding")
    true = search.knn(rows, asked, exclude_self=True)
    for target in (0.9, 0.95):
        found = ivf.search_index(index, asked, target=target, id_type="bigint", exclude_self=True)
        assert recall(found, true) >= target - 0.03
    assert index.probes(0.9) <= index.probes(0.95) <= len(index.centres)
    if times > 1:
        assert index.probes(0.95) < 0.5 * len(index.centres)
    rows.unpersist()


def test_all_cells_are_exact_in_both_layouts(spark):
    path = scratch(spark, "t-index")
    rows = copies(spark, 1)
    ivf.build_index(rows, path, cells=12)
    index = ivf.load_index(spark, path)
    asked = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = sorted(map(tuple, search.knn(rows, asked).select("query_id", "id", "score", "rank").collect()))
    for limit in (1000, 10):
        got = ivf.search_index(index, asked, target=1.0, id_type="bigint", query_limit=limit)
        assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == want
    few = ivf.search_index(index, asked, target=0.6, id_type="bigint")
    many = ivf.search_index(index, asked, target=0.6, id_type="bigint", query_limit=10)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_only_wanted_cells_are_read(spark):
    path = scratch(spark, "t-index")
    rows = copies(spark, 5)
    ivf.build_index(rows, path)
    index = ivf.load_index(spark, path)
    one = rows.where("id = 5").select(F.col("id").alias("query_id"), "embedding")
    found = ivf.search_index(index, one, target=0.5, id_type="bigint")
    plan = found._jdf.queryExecution().executedPlan().toString()
    cells = {f.split("/cell=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(cells) <= index.probes(0.5) < 20 == len(index.centres)
    assert "Exchange hashpartitioning(query_id" in plan and plan.count("Exchange") <= 2  # hits only


def test_odd_vectors(spark):
    path = scratch(spark, "t-index")
    values = [(i, [float(i), 1.0]) for i in range(60)] + [(100, None), (101, []), (102, [float("nan"), 1.0]), (103, [0.0, 0.0]), (104, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(values, "id long, embedding array<float>")
    ivf.build_index(rows, path, cells=4)
    index = ivf.load_index(spark, path)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 2.0, 1.0]), (3, None), (4, [0.0, 0.0])], "query_id long, embedding array<float>")
    want = sorted(map(tuple, search.knn(rows, asked).collect()))
    assert sorted(map(tuple, ivf.search_index(index, asked, target=1.0, id_type="bigint").select("query_id", "id", "score", "rank", "distance").collect())) == want
    empty = scratch(spark, "t-index")
    ivf.build_index(rows.limit(0), empty)
    assert ivf.search_index(ivf.load_index(spark, empty), asked, id_type="bigint").collect() == []


def test_one_vector_fills_a_third(spark):
    path = scratch(spark, "t-index")
    rows = copies(spark, 1).withColumn("embedding", F.when(F.col("id") % 3 == 0, F.array_repeat(F.lit(0.5).cast("float"), 64)).otherwise(F.col("embedding")))
    ivf.build_index(rows, path, cells=8)
    asked = rows.where("id < 12").select(F.col("id").alias("query_id"), "embedding")
    got = ivf.search_index(ivf.load_index(spark, path), asked, target=1.0, id_type="bigint")
    assert sorted(map(tuple, got.select("query_id", "id", "rank").collect())) == sorted(map(tuple, search.knn(rows, asked).select("query_id", "id", "rank").collect()))


def test_a_store_goes_on_changing(spark):
    """Added, deleted, patched and re-added rows are found as an exact search finds them."""
    rng = np.random.default_rng(3)
    root = scratch(spark, "t-store")

    def batch(names):
        return spark.createDataFrame([(n, "t", [float(x) for x in rng.normal(size=6)]) for n in names], "id string, text string, embedding array<float>")

    def check():
        exact = search.knn(store.read_store(spark, root), asked, 7)
        found = ivf.search_store(spark, root, asked, 7, target=1.0)
        assert sorted(map(tuple, found.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "id", "score", "rank").collect()))

    store.append_rows(batch([f"a{i}" for i in range(300)]), root)
    asked = batch([f"q{i}" for i in range(6)]).select(F.col("id").alias("query_id"), "embedding")
    check()
    ivf.index_store(spark, root)
    check()
    store.append_rows(batch([f"b{i}" for i in range(100)]), root)
    check()
    store_changes.update_rows(spark, root, batch([f"a{i}" for i in range(0, 300, 7)] + ["b1", "none"]).drop("text"))
    check()
    store_changes.delete_rows(spark, root, [f"a{i}" for i in range(0, 300, 5)] + ["b2"])
    check()
    store.append_rows(batch([f"a{i}" for i in range(0, 300, 10)]), root)
    check()
    assert ivf.index_store(spark, root) == 5
    check()
    store_changes.compact(spark, root)
    check()
