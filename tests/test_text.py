import json
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.ids import canonical_json, json_string
from leafmill.functions.filters import where
from leafmill.operators import layout


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("value", ["  a b \n", "　 x\xa0", "\x1c\x85y\x0b", "", "\t", "z"])
def test_strip_is_unicode_aware(spark, value):
    assert one(spark, value, tx.strip) == value.strip()


@pytest.mark.parametrize(
    "value",
    [
        "a\n \n\n\nb",
        "#Title\n##  Sub\n-item\n*  x\n```py \ncode\n```  \nend",
        "**b** at start\n---\n  - deep",
        "a\n\nb",
        "####### seven",
        "x\n　\n\n y",
    ],
)
def test_normalize_markdown(spark, value):
    want = re.sub(r"\n\s*\n\s*\n", "\n\n", value)
    for mark in ("#{1,6}", "[-*+]"):
        want = re.sub(rf"^(\s*)({mark})\s*", r"\1\2 ", want, flags=re.MULTILINE)
    want = re.sub(r"```\s*\n", "```\n", want).strip()
    assert one(spark, value, tx.normalize_markdown) == want


@pytest.mark.parametrize(
    ("value", "expected"),
    [("# x", True), ("a *b* c", True), ("[a](b)", True), (" - x", True), ("1. x", True), ("a # b", False),
     ("no marks", False), ("```a```", True), ("```a\nb```", False), ("a\n٣. x", True)],
)
def test_is_markdown(spark, value, expected):
    assert one(spark, value, tx.is_markdown) is expected


def test_links_and_entities(spark):
    page = "<a class='x' href='/u'>a</a> <a href = \"/v\">b</a> &copy; &mdash; &#8217;x&rsquo; &#160;"
    assert one(spark, page, tx.html_to_markdown) == "[a](/u) [b](/v) © — 'x'"


def test_html_to_markdown(spark):
    html = (
        "<html><head><title>t</title></head><body><script>var a='<p>'</script><!-- c --><h2 class='x'>Head</h2>"
        '<p>See <a href="/u">this &amp; that</a> <b>now</b><br>next</p><ul><li>one</li><li><em>two</em></li></ul></body></html>'
    )
    assert one(spark, html, tx.html_to_markdown) == "# t\n\n## Head\n\nSee [this & that](/u) **now**\nnext\n\n* one\n* *two*"


@pytest.mark.parametrize(
    ("size", "flags", "text", "expected"),
    [(16.0, 16, "a", "### a"), (14.0, 0, "a", "#### a"), (12.0, 0, "a", "##### a"), (11.9, 16, "a", "**a**"),
     (10.0, 2, "a", "*a*"), (10.0, 4, "a", "<u>a</u>"), (10.0, 22, "a", "<u>***a***</u>"), (20.0, 0, "  ", "  "), (10.0, 1, "a", "a")],
)
def test_span_markdown(spark, size, flags, text, expected):
    row = spark.createDataFrame([(text, size, flags)], "t string, s double, f int")
    assert row.select(tx.span_markdown(F.col("t"), F.col("s"), F.col("f"))).first()[0] == expected


def test_title_skips_long_lines(spark):
    assert one(spark, "x" * 100 + "\n  \n  short \nnext", tx.document_title) == "short"
    assert one(spark, "x" * 100, tx.document_title) is None
    assert one(spark, "short", lambda c: tx.document_title(c, F.lit("meta"))) == "meta"
    assert one(spark, "short", lambda c: tx.document_title(c, F.lit(""))) == "short"


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("```python\na = 1\nb\n```\nrest", "a = 1\nb"),
        ("<python>\nx\n</python>", "x"),
        ("python\n<python>\ny\n</python>", "y"),
        ("text ```python\nx\n```", "text ```python\nx\n```"),
        ("```python\nunclosed", "```python\nunclosed"),
    ],
)
def test_extract_block(spark, value, expected):
    assert one(spark, value, tx.extract_block) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ('{"a": "x", "n": 1.5, "extra": true}', ("x", 1.5)),
        ('```json\n{"a": "x", "n": "2"}\n```', ("x", 2.0)),
        ('{"a": 3, "n": 1}', None),
        ('{"a": "x"}', None),
        ('{"a": "x", "n": true}', None),
        ("not json", None),
    ],
)
def test_parse_object(spark, value, expected):
    got = one(spark, value, lambda c: tx.parse_object(c, {"a": "string", "n": "number"}))
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("value", ["plain", 'q"uo\\te', "中文 é", "tab\tnl\n", "😀", "", "\x7f", "\x1b\x00\x08\x0c\r", "a😀é\"b"])
def test_json_string_matches_json_dumps(spark, value):
    assert one(spark, value, json_string) == json.dumps(value)


def test_canonical_json(spark):
    rows = spark.createDataFrame([("中", 3, 1.5, True, None)], "b string, a long, d double, c boolean, e string")
    columns = {f.name: (F.col(f.name), f.dataType) for f in rows.schema.fields}
    want = json.dumps({"b": "中", "a": 3, "d": 1.5, "c": True, "e": None}, sort_keys=True)
    assert rows.select(canonical_json(columns)).first()[0] == want


def test_filters(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "n int, s string")

    def ids(condition):
        return sorted(r.n for r in rows.where(where(condition)).collect())

    assert ids(None) == [1, 2, 3]
    assert ids({"s": "x"}) == [1]
    assert ids({"n": {"$gte": 2, "$lt": 3}}) == [2]
    assert ids({"$or": [{"s": "x"}, {"n": {"$in": [3]}}]}) == [1, 3]
    assert ids({"$and": [{"n": {"$ne": 1}}, {"n": {"$nin": [3]}}]}) == [2]
    assert ids({"n": {"$gt": 1}, "s": {"$eq": "y"}}) == [2]
    assert ids({"n": {"$lte": 1}}) == [1]


def test_blocks_and_documents(spark):
    spans = spark.createDataFrame(
        [(1, 0, 0, 0, "Hello ", 10, 0, 0), (1, 0, 0, 1, "bold", 10, 16, 0), (1, 0, 1, 0, "  ", 10, 0, 0),
         (1, 0, 2, 0, "Big", 16, 0, 0), (1, 1, 0, 0, "image", 10, 0, 1)],
        "page int, block int, line_no int, span_no int, text string, size int, flags int, block_type int",
    )
    got = layout.assemble_blocks(spans, ["page", "block"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "Hello **bold**\n### Big")]
    pages = spark.createDataFrame([("d", 2, "  "), ("d", 1, "Title\nbody"), ("d", 1500, "end")], "doc string, no int, text string")
    [row] = layout.assemble_document(pages, "doc", "no").collect()
    assert row.markdown == (
        "# Title\n\n\n## 第 1 页\n\n\nTitle\nbody\n\n## 第 2 页\n\n\n## 第 1500 页\n\n\nend"
    )
