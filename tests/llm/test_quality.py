import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality
from leafmill.session import load


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    rows = quality.scores(load(spark, folder, "documents"), load(spark, folder, "labels"))
    return rows.toPandas(), load(spark, folder, "labels").toPandas()


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert (rows["held_out"] == rows["doc_id"].map(held_out)).all()
    both = rows[rows["held_out"]].merge(labels, on="doc_id")
    bad, good = (both[both["quality"] == k]["score"].to_numpy() for k in (0, 1))
    order = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert order > 0.99
    assert (both["predicted"] == both["quality"]).mean() > 0.97
    assert ((both["score"] - both["quality"]) ** 2).mean() < 0.02


def test_held_out_labels_are_not_read(spark, scored):
    folder = "/root/testdata/sf0.01"
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5
    turned = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    once, again = (sorted(map(tuple, quality.scores(docs.repartition(n), known).collect())) for n, known in ((3, labels), (7, turned)))
    assert [r[:2] for r in once] == [r[:2] for r in again]
    assert np.allclose([r[2] for r in once], [r[2] for r in again], atol=1e-6)


def test_normal_equations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(500, len(quality.STATISTICS)))
    rows = [(int(i % 2), [float(x) for x in r]) for i, r in enumerate(table)]
    frame = spark.createDataFrame(rows, "label int, stats array<float>")
    mean, deviation = np.zeros(table.shape[1]), np.ones(table.shape[1])
    sums = [quality.normal_equations(frame.repartition(n), mean, deviation, 16) for n in (1, 7)]
    assert (sums[0][0] == sums[1][0]).all() and sums[0][1] == sums[1][1] == 500
    z = np.column_stack((quality.cosines(table.astype(np.float32).astype(float), mean, deviation, 16), np.arange(500) % 2))
    assert np.allclose(sums[0][0], z.T @ z, atol=0.2)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 20))
    z = quality.cosines(a, np.zeros(20), np.ones(20), 20_000)[:, 1:]
    a = np.clip(a, -quality.FARTHEST, quality.FARTHEST)
    distances = ((a[:, None] - a) ** 2).sum(2)
    assert np.allclose(2 * z @ z.T / 20_000, np.exp(-distances / (2 * 20)), atol=0.05)


def test_isotonic():
    """Against the least squares among all non-decreasing sequences, by the formula of largest and least means."""
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        rows = [rng.randrange(1, 5) for _ in range(n)]
        ones = [rng.randrange(0, r + 1) for r in rows]

        def mean(a, b, ones=ones, rows=rows):
            return sum(ones[a : b + 1]) / sum(rows[a : b + 1])

        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        places, values = quality.isotonic(np.arange(n, dtype=float), np.array(ones, float), np.array(rows, float))
        assert sorted(set(np.round(want, 9))) == list(np.round(values, 9))
        assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()


def test_odd_rows(spark, odd_docs):
    frame, rows = odd_docs
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 10)] + [(None, 1, 1), (3, None, 0), (4, 5, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.scores(frame, labels)
    got = found.collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.scores(frame.limit(0), labels).collect() == []
    none = quality.scores(frame, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    ones = quality.scores(frame, labels.withColumn("quality", F.lit(1))).collect()
    assert {r["score"] for r in ones} == {1.0}


def test_equal_texts_score_alike(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["plain", "words", "here", "&&&", "a"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 60]) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("&&&" not in texts[i % 60][:40])) for i in range(600)], "doc_id long, quality int")
    found = quality.scores(docs.repartition(9), labels).collect()
    for k in range(60):
        assert len({r["score"] for r in found if r["doc_id"] % 60 == k}) == 1
