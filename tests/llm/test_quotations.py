import duckdb
import pytest

from leafmill.llm import quotations
from leafmill.llm.queries import REPLIES

MESSAGES = [
    (1, 0, "a", "Hello there.\n\nHow are  you doing\ntoday?\n\nBye"),
    (1, 1, "b", "On Monday A wrote:\n> How are you\n> doing today?\n\nFine."),
    (1, 2, "c", "> > How are you doing today?\n> Fine.\n\nGood"),
    (1, 3, "a", "> nothing known\n>> Fine.\nok"),
    (1, 4, "d", "unrelated\nIt wrote:\nno quote"),
    (1, 5, "e", ">Good\r\nyes"),
    (2, 0, "a", "Fine."),
    (2, 1, "b", "> Good\nx"),
    (None, 0, "a", "n"),
    (None, 1, "a", "> n\nz"),
    (3, None, "a", "> x"),
    (3, 0, None, None),
    (3, 1, "a", "> "),
    (1, 5, "e", ">Good\r\nyes"),
    (4, 0, "a", ""),
]
EXPECTED = [
    (None, 0, "n", None, 0, 0),
    (None, 1, "z", 0, 0, 1),
    (1, 0, "Hello there.\n\nHow are  you doing\ntoday?\n\nBye", None, 0, 0),
    (1, 1, "Fine.", 0, 0, 1),
    (1, 2, "Good", 1, 0, 2),
    (1, 3, "ok", 1, 0, 2),
    (1, 5, "yes", 2, 0, 3),
    (1, 5, "yes", 2, 0, 3),
    (1, 4, "unrelated\nIt wrote:\nno quote", None, 4, 0),
    (2, 0, "Fine.", None, 0, 0),
    (2, 1, "x", None, 1, 0),
    (3, None, "", None, None, 0),
    (3, 0, None, None, 0, 0),
    (3, 1, "", None, 1, 0),
    (4, 0, "", None, 0, 0),
]


@pytest.fixture
def messages(spark):
    rows = [m + ("x", 2) for m in MESSAGES]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string, at long")


def test_replies_follow_what_they_quote(messages):
    got = quotations.conversations(messages).collect()
    assert [(r.conv_id, r.turn, r.text, r.parent_turn, r.thread, r.depth) for r in got] == EXPECTED


def test_sql_says_the_same(messages):
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    for row in MESSAGES:
        con.execute("insert into conversations values (?, ?, ?, ?)", list(row))
    got = con.sql(REPLIES).fetchall()
    assert sorted(map(repr, [(c, t, x, p, th, d) for c, t, _, x, p, th, d in got])) == sorted(map(repr, EXPECTED))


def test_long_thread(spark):
    rows = [(1, i, "a", f"> my message {i - 1}\nmy message {i}") for i in range(60)]
    got = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.text, r.parent_turn, r.thread, r.depth) for r in got] == [(i, f"my message {i}", i - 1 if i else None, 0, i) for i in range(60)]


def test_many_quotes_of_one_message(spark):
    rows = [(1, 0, "a", "first")] + [(1, i, "a", "> first\nsame") for i in range(1, 400)]
    got = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.parent_turn, r.depth) for r in got if r.turn} == {(0, 1)} and len(got) == 400


def test_empty_table(messages):
    assert quotations.conversations(messages.limit(0)).count() == 0


def test_no_python_in_the_plan(messages):
    for frame in (quotations.quoted_keys(messages.selectExpr("conv_id conv", "turn at", "text")), quotations.conversations(messages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
