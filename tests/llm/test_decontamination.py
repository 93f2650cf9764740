import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination as dec
from leafmill.llm.queries import LEAKS
from tests.llm import brute

QUESTION = "once Tom has 12 apples and gives 5 apples to Anna, and how many kilograms does Tom carry over 3.5 km of road in all?"
ITEMS = [
    (1, "The story: " + QUESTION),
    (2, "Short question here now"),
    (3, None),
    (4, ""),
    (1, "another text under the same id that is quite a bit longer than before and plain"),
    (None, "a null item with enough words to be found when it is planted somewhere in a document"),
    (5, "another text under the same id that is quite a bit longer than before and plain"),
]
OTHER = QUESTION.replace("Tom", "Bob").replace("Anna", "Eve Smith").replace("12", "99").replace("3.5 km", "4 miles")
DOCS = [
    (1, "Start of it: " + QUESTION + " End of it"),
    (2, "We read: " + OTHER),
    (3, "We read: " + OTHER.replace("carry", "carry").replace("does Bob", "does Jim")),
    (4, "We read: " + QUESTION.replace("12 apples", "7 apples").replace("5 apples", "7 apples")),
    (5, None),
    (6, ""),
    (None, "so " + ITEMS[5][1]),
    (7, "ANOTHER text under the same id, that is quite a bit longer than before"),
    (8, "another text under the same id but not much of it"),
    (9, "xx short question here now yy"),
    (9, "nothing of the kind under the same id"),
    (1, "Start of it: " + QUESTION + " End of it"),
]
FOUND = {(1, 1, False), (2, 1, True), (None, None, False), (7, 1, False), (7, 5, False), (9, 2, False)}


@pytest.fixture
def frames(spark):
    docs = spark.createDataFrame([r + ("x", 1) for r in DOCS], "doc_id long, text string, words string, at long")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_same_and_changed_items(frames):
    got = {(r.doc_id, r.item_id, r.changed) for r in dec.found_items(*frames).collect()}
    assert got == FOUND


def test_sql_says_the_same(frames):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in DOCS])
    con.executemany("insert into benchmark values (?, ?)", [list(r) for r in ITEMS])
    got = [tuple(r) for r in dec.found_items(*frames).select("doc_id", "item_id", "windows", "share", "changed").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(LEAKS).fetchall()))


def test_rows_without_items_stay(frames):
    kept = dec.without_items(*frames)
    assert kept.columns == frames[0].columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "8", "9"])


def test_empty_tables(frames):
    docs, items = frames
    assert dec.found_items(docs.limit(0), items).count() == 0
    assert dec.found_items(docs, items.limit(0)).count() == 0


def test_main_path_is_native(frames):
    docs, items = frames
    rows = docs.select("at", dec.template(F.col("text")).alias("words"), dec.values(F.col("text")).alias("v"))
    plan = dec.windows(rows, dec.WINDOW, "at")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_windows_as_by_brute_force(spark):
    texts = [" ".join(f"w{chr(97 + (i * j) % 26)}" for i in range(j)) for j in (0, 3, 7, 8, 9, 20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", F.split("text", " ").alias("words"))
    got = dec.windows(frame, 8, "i").collect()
    assert sorted((r.i, r.place) for r in got) == [(i, p) for i, t in enumerate(texts) for p in range(len(t.split()) - 7)]
    runs = {}
    for r in got:
        runs.setdefault(tuple(texts[r.i].split()[r.place : r.place + 8]), set()).add(r.window)
    assert all(len(v) == 1 for v in runs.values()) and len(set().union(*runs.values())) == len(runs)


def test_test_tables_as_by_brute_force(spark, sf):
    docs, items = (pq.read_table(f"{sf}/{n}.parquet").to_pylist() for n in ("documents", "benchmark"))
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if brute.holds(d["text"], i["text"])}
    got = dec.found_items(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert want and want == {(r.doc_id, r.item_id) for r in got}


def test_items_of_few_literal_words_are_found(spark):
    items = [(1, "Add 12, 15, 18, 21 and 24 to get the total sum"), (2, "Compute 3 5 7"), (3, "1 2 3 4 5 6 7 8 9 10 and so on")]
    docs = [
        (1, "Then: " + items[0][1] + ". Next"),
        (2, "compute 3, 5, 7 now"),
        (3, "compute 3 5 8 now"),
        (4, "see 1 2 3 4 5 6 7 8 9 10 and so on, then"),
        (5, "add 12 15 18 21 and 24 to get a total sum"),
        (6, "nothing at all"),
        (7, "add 3, 4, 5, 6 and 9 to get the total sum"),
        (8, "then 4, 5, 6 and 9 to get the total sum"),
    ]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = dec.found_items(*frames).collect()
    assert {(r.doc_id, r.item_id, r.share, r.changed) for r in rows} == {(1, 1, 1.0, False), (2, 2, 1.0, False), (4, 3, 1.0, False), (7, 1, 1.0, True)}
    assert len(rows) == 4
    assert sorted(r.doc_id for r in dec.without_items(*frames).collect()) == [3, 5, 6, 8]


def test_long_lists_of_names_and_numbers(spark):
    lists = ["by" + " Tom" * 20_000, "see 1" + ",2" * 20_000, "see 1" + "/23" * 20_000, "of " + "Anna Eve " * 10_000]
    docs = [(i, f"{text} and then {ITEMS[4][1]}") for i, text in enumerate(lists)] + [(9, lists[0])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS[4:5], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.changed) for r in dec.found_items(*frames).collect()} == {(i, 1, False) for i in range(len(lists))}
    assert [r.doc_id for r in dec.without_items(*frames).collect()] == [9]
    words, numbers = frames[0].where("doc_id = 1").select(dec.template(F.col("text")), dec.values(F.col("text"))["numbers"]).first()
    assert words[:3] == ["see", dec.NUMBER, "and"] and numbers == ["1" + ",2" * 20_000]
    assert frames[0].where("doc_id = 9").select(dec.template(F.col("text"))).first()[0] == ["by", dec.NAME]


def test_sql_keeps_the_plain_patterns(spark):
    texts = ["so Tom Ñandú Eve ran 1,2.5:7/8 km, 3. Anna", "a 1, 2,,3 x Tom  Eve", "é Ä́b C d1.", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for plain, java in ((dec.NUMBERS, dec.JAVA_NUMBERS), (dec.NAMES, dec.JAVA_NAMES)):
        assert plain in LEAKS and java not in LEAKS
        both = frame.select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (plain, java))).collect()
        assert all(a == b for a, b in both)
