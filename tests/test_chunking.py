"""Chunkers against a plain restatement and their invariants."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators import chunking as ch
from leafmill.operators.frames import unnest

ALPHABET = "ab c.。!？\n\t 中文x#*-　é"
texts = st.lists(st.text(ALPHABET, max_size=120), min_size=1, max_size=25)
quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def run(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, text string")
    return [r[0] for r in rows.select("i", column(F.col("text")).alias("c")).orderBy("i").select("c").collect()]


def pack(units, size, gap, glue, close=""):
    """Greedy packing, written over whole strings."""
    done, cur, used = [], [], 0
    for u in units:
        if cur and used + len(u) > size:
            done.append(glue.join(cur) + close)
            cur, used = [], 0
        cur.append(u)
        used += len(u) + gap
    return done + ([glue.join(cur) + close] if cur else [])


def sentences(text, size):
    units = [s.strip() for s in re.split("[。！？.!?]", text) if s.strip()]
    return pack(units, size, 1, "。", "。")


def basic(text, size, separator):
    out, short = [], []
    for p in (p.strip() for p in text.split(separator)):
        if len(p) > size:
            out += pack(short, size, 2, "\n\n") + sentences(p, size)
            short = []
        elif p:
            short.append(p)
    return out + pack(short, size, 2, "\n\n")


@quick
@given(texts)
def test_sentence_chunks(spark, values):
    got = run(spark, values, lambda c: ch.sentence_chunks(c, 20))
    assert got == [sentences(v, 20) for v in values]


@quick
@given(texts)
def test_basic_chunks(spark, values):
    got = run(spark, values, lambda c: ch.basic_chunks(c, 15, "\n"))
    assert got == [basic(v, 15, "\n") for v in values]
    for chunks in got:
        assert all(c.strip() == c and c for c in chunks)


def test_basic_default_separator(spark):
    text = "# 测试\n\n一段。\n\n" + "长句。" * 90 + "\n\n尾"
    [got] = run(spark, [text], ch.basic_chunks)
    assert got == basic(text, 200, "\n\n")
    assert run(spark, ["", " \n　 ", None], ch.basic_chunks) == [[], [], None]


def test_decimal_point_splits_and_long_sentence_stays_whole(spark):
    assert run(spark, ["pi is 3.14"], ch.sentence_chunks) == [["pi is 3。14。"]]
    assert run(spark, ["x" * 450], ch.sentence_chunks) == [["x" * 450 + "。"]]


@quick
@given(texts)
def test_token_windows(spark, values):
    got = run(spark, values, lambda c: ch.token_window_chunks(c, 5, 2))
    words = run(spark, values, lambda c: ch.tokens(c))
    for chunks, ws in zip(got, words, strict=True):
        n = len(ws)
        starts = [s for s in range(0, n, 3) if s == 0 or s + 2 < n]
        assert chunks == [" ".join(ws[s : s + 5]) for s in starts]


def token_count(text):
    return len(re.findall(r"[中文]|[^\s中文]+", text))


@quick
@given(texts)
def test_sentence_tokens(spark, values):
    size, overlap = 6, 2
    got = run(spark, values, lambda c: ch.sentence_token_chunks(c, size, overlap))
    for text, chunks in zip(values, got, strict=True):
        parts = []
        for s in re.findall("[^。！？.!?]*[。！？.!?]+|[^。！？.!?]+", text):
            s = s.strip()
            while s:
                m = re.match(r"(?:(?:[中文]|[^\s中文]+)\s*){1,%d}" % size, s)
                if token_count(s) <= size:
                    m = re.match("(?s).*", s)
                parts.append(m.group().strip())
                s = s[m.end() :]
        expected, window = [], []
        for p in parts:
            if window and sum(map(token_count, window)) + token_count(p) > size:
                expected.append(" ".join(window))
                while window and (
                    sum(map(token_count, window)) > overlap
                    or sum(map(token_count, window)) + token_count(p) > size
                ):
                    window.pop(0)
            window.append(p)
        if window:
            expected.append(" ".join(window))
        assert chunks == expected
        assert all(token_count(c) <= size for c in chunks)


@quick
@given(texts)
def test_recursive_chunks(spark, values):
    got = run(spark, values, lambda c: ch.recursive_chunks(c, 20, 5))
    for text, chunks in zip(values, got, strict=True):
        assert all(len(c) <= 20 and c.strip() == c for c in chunks)
        # in order and complete: every visible character is covered
        at, covered = 0, set()
        for c in chunks:
            found = text.find(c, max(0, at - 20))
            assert found >= 0
            covered.update(range(found, found + len(c)))
            at = found + len(c)
        assert all(text[i].isspace() for i in set(range(len(text))) - covered)


def plain_recursion(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Coarse-to-fine splitting of one text by recursion, pieces merged up to ``size``."""
    mark = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark in separators else ()
    if mark == "":
        parts = list(text)
    else:  # a separator opens the piece that follows it
        head, *rest = text.split(mark)
        parts = [p for p in (head, *(mark + r for r in rest)) if p]

    out: list[str] = []
    window: list[str] = []
    used = 0

    def flush() -> None:
        merged = "".join(window).strip()
        if merged:
            out.append(merged)

    for part in parts:
        if len(part) >= size:
            flush()
            window, used = [], 0
            out.extend(plain_recursion(part, size, overlap, finer) if finer else [part])
            continue
        if used + len(part) > size and window:
            flush()
            while window and (used > overlap or used + len(part) > size):
                used -= len(window.pop(0))
        window.append(part)
        used += len(part)
    flush()
    return out


@pytest.mark.parametrize("separators", [ch.RECURSIVE_SEPARATORS, ("\n\n", "\n", " "), ("。",), ("",)])
def test_recursive_chunks_as_by_recursion(spark, separators):
    rng = random.Random(4)
    values = ["".join(rng.choices("ab c\n。.!é", k=rng.randrange(90))) for _ in range(150)] + ["", " ", "\n\n"]
    for sizes in ((20, 5), (7, 6), (5, 9), (1, 0)):
        got = run(spark, [*values, None], lambda c: ch.recursive_chunks(c, *sizes, separators))  # noqa: B023
        assert got == [*(plain_recursion(v, *sizes, separators) for v in values), None], sizes


def test_recursive_long_text(spark):
    """A text of many characters and no separator, and one of many words."""
    values = ["x" * 30_000, "word " * 10_000]
    got = run(spark, values, ch.recursive_chunks)
    assert got == [plain_recursion(v, 200, 20, ch.RECURSIVE_SEPARATORS) for v in values]


def test_recursive_known_values(spark):
    text = "aaaa bbbb cccc dddd"
    [got] = run(spark, [text], lambda c: ch.recursive_chunks(c, 10, 5))
    assert got == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]


def test_markdown_sections(spark):
    text = "top\n# A\n\none\ntwo\n\nthree\n## B\n```\n# not a heading\n```\n### C\n# D\nend"
    [got] = run(spark, [text], ch.markdown_sections)
    assert [(s.path, s.text) for s in got] == [
        ("", "top"),
        ("A", "one\ntwo  \nthree"),
        ("A > B", "```\n# not a heading\n```"),
        ("D", "end"),
    ]


def test_auto_routes(spark):
    got = run(spark, ["# T\nbody", "One. Two.", "  ", "- item"], ch.auto_chunks)
    assert got == [["body"], ["One. Two."], [], ["- item"]]


def test_unknown_method_means_basic(spark):
    rows = spark.createDataFrame([(1, "a\n\nb")], "i long, text string")
    assert [tuple(r) for r in ch.chunk_table(rows, method="nope").collect()] == [(1, 0, "a\n\nb")]


def test_features_and_stats(spark):
    rows = spark.createDataFrame([(0, "# h\n```x```"), (1, "[a](b)\n - c"), (2, "#no")], "chunk_index int, text string")
    got = [tuple(r) for r in ch.chunk_features(rows).select("has_headers", "has_code", "has_links", "has_lists").collect()]
    assert got == [(True, True, False, False), (False, False, True, True), (False, False, False, False)]
    stats = ch.chunk_stats(rows, size=10).first()
    assert (stats.total_chunks, stats.total_characters, stats.small, stats.medium, stats.large) == (3, 25, 1, 0, 2)
    assert ch.chunk_stats(rows.where("false")).count() == 0


def test_chunking_is_one_narrow_pass(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for method in ch.CHUNKERS:
        plan = ch.chunk_table(rows, method=method)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        # no filter below the generator computes the array a second time
        assert "Filter (" not in plan.split("Generate ")[1]


def test_unnest_drops_empty(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "i long, xs array<string>")
    assert [tuple(r) for r in unnest(rows, ["i"], F.col("xs"), "x", "p").collect()] == [(1, 0, "a"), (1, 1, "b")]


@pytest.mark.parametrize("n", [3000])
def test_long_document(spark, n):
    text = "\n".join(f"sentence number {i}. and more" for i in range(n))
    [got] = run(spark, [text], lambda c: ch.basic_chunks(c, 200, "\n"))
    assert got == basic(text, 200, "\n")
