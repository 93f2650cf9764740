"""Functions of the user's own: ordered, per group, and by states that merge."""

import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import user_functions as uf


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def rises():
    """A class of its own each time, which travels to the workers by value."""

    class Rises:
        def __init__(self):
            self.rises, self.last, self.key = 0, None, None

        def eval(self, row):
            self.rises += self.last is not None and row["v"] > self.last
            self.last, self.key = row["v"], row["k"]

        def terminate(self):
            yield self.key, self.rises, self.last

    return Rises


def test_ordered_rows(spark):
    rows = [("a", 3, 1), ("a", 1, 5), ("a", 2, 2), ("b", 1, 7), (None, 2, 4), (None, 1, 9)]
    frame = spark.createDataFrame(rows, "k string, at int, v int").repartition(4)
    found = uf.ordered(frame, rises(), "k string, rises int, last int", ["k"], ["at"])
    assert collected(found) == collected(spark.createDataFrame([("a", 0, 1), ("b", 0, 7), (None, 0, 4)], "k string, rises int, last int"))
    up = uf.ordered(frame, rises(), "k string, rises int, last int", ["k"], ["v"])
    assert {r["k"]: r["rises"] for r in up.collect()} == {"a": 2, "b": 0, None: 1}


def test_groups_come_in_frames(spark):
    """A group is a stream of frames; none has all of a large group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        frame = spark.range(20_000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id")

        def sizes(key, frames):
            frames = list(frames)
            yield pd.DataFrame({"k": [key[0]], "rows": [sum(map(len, frames))], "largest": [max(map(len, frames))]})

        found = uf.per_group(frame, ["k"], sizes, "k long, rows long, largest long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: r["rows"] for r in found} == {None: 6667, 0: 6666, 1: 6667}
    assert max(r["largest"] for r in found) <= 1000


def test_states_merge(spark, monkeypatch):
    """One key has most rows, one is null; few states reach the exchange, and any cut gives the same."""

    def bounds(rows):
        return {"n": len(rows), "low": int(rows["id"].min()), "high": int(rows["id"].max())}

    def merged(states):
        return {"n": int(states["n"].sum()), "low": int(states["low"].min()), "high": int(states["high"].max())}

    frame = spark.range(30_000).selectExpr("if(id % 10 < 8, 1, if(id % 10 = 8, null, id)) as k", "cast(id % 7 as string) as t", "id")
    want = frame.groupBy("k", "t").agg(F.count("id"), F.min("id"), F.max("id")).collect()
    for held in (50_000, 10):
        monkeypatch.setattr(uf, "STATES", held)
        found = uf.aggregated(frame, ["k", "t"], bounds, merged, "n long, low long, high long")
        assert collected(found) == sorted(map(tuple, want), key=str)
    assert found.schema["k"].dataType.simpleString() == "bigint"
    assert uf.aggregated(frame.limit(0), ["k", "t"], bounds, merged, "n long, low long, high long").collect() == []
