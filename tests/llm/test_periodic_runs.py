import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import periodic_runs, queries


def brute_runs(words):
    """All runs by comparing every word with those up to a quarter of the text later."""
    found = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            smaller = any(all(words[k] == words[k + r] for k in range(at, at + length - r)) for r in range(1, q))
            if end > at and length >= max(6, 4 * q) and not smaller:
                found.append((at, length, q))
            at = max(at + 1, end)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    dropped = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def texts_of(seed):
    rng = random.Random(seed)
    for _ in range(120):
        kinds = rng.choice([1, 2, 2, 3, 5, 40])
        words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(0, 90))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 3))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        yield words


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    for words in texts_of(seed):
        numbers = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1].astype(np.int64)
        assert [tuple(r) for r in periodic_runs.runs(numbers).tolist()] == brute_runs(words)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=6), max_size=4), st.integers(1, 6))
def test_nested_repeats(parts, times):
    """Runs within the period of another run, where small scales find the inner ones first."""
    words = [w for part in parts for w in part * times] * 4
    assert [tuple(r) for r in periodic_runs.runs(np.array(words, np.int64)).tolist()] == brute_runs(words)


def test_exact_convolution():
    rng = np.random.default_rng(5)
    for length in (1, 2, 8, 64):
        blocks = rng.integers(0, 1 << 31, (5, length)).astype(np.uint64) % np.uint64(periodic_runs.PRIME)
        windows = rng.integers(0, 1 << 31, (5, 2 * length)).astype(np.uint64) % np.uint64(periodic_runs.PRIME)
        windows[0, :length] = blocks[0]
        found = periodic_runs.squared_differences(blocks, windows)
        for k in range(5):
            for e in range(length):
                want = sum((int(b) - int(w)) ** 2 for b, w in zip(blocks[k], windows[k, e : e + length], strict=True)) % periodic_runs.PRIME
                assert int(found[k, e]) == want
        assert found[0, 0] == 0
    rows = rng.integers(0, 1 << 31, (3, 32)).astype(np.uint64) % np.uint64(periodic_runs.PRIME)
    assert (periodic_runs.transform(periodic_runs.transform(rows), inverse=True) == rows).all()


def test_large_texts_take_seconds():
    began = time.time()
    assert periodic_runs.runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    assert periodic_runs.runs(np.tile(np.arange(30_001), 9)).tolist() == [[0, 270_009, 30_001]]
    assert len(periodic_runs.runs(np.tile(np.repeat([0, 1], 8), 20_000))) == 40_001
    assert time.time() - began < 20


def test_odd_rows(spark, odd_docs):
    frame, rows = odd_docs
    found = periodic_runs.with_runs(frame.withColumn("periodic", F.lit(1))).collect()
    assert len(found) == len(rows)
    assert set(found[0].asDict()) == set(frame.columns) | {"periodic"}
    by_text = {r["text"]: r["periodic"] for r in found}
    for text in {r[1] for r in rows}:
        words = [w.decode() for w in (text or "").encode().split()]
        got = by_text[text]
        assert got["n_words"] == len(words)
        if len(words) < 1000:
            want = brute_runs(words)
            assert [tuple(x) for x in got["runs"]] == want
            assert got["collapsed"] == brute_collapsed(words, want)
        else:
            assert len(got["collapsed"].split(" ")) + sum(r["length"] - r["period"] for r in got["runs"]) == len(words)
    empty = periodic_runs.with_runs(frame.limit(0))
    assert empty.collect() == []


def test_texts_do_not_meet(spark):
    """A run ends with its text, also where the next text goes on in the same way."""
    frame = spark.createDataFrame([(i, "a b " * 6) for i in range(40)] + [(40, "a a a"), (41, "a a a a a a")], "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: [tuple(x) for x in r["periodic"]["runs"]] for r in periodic_runs.with_runs(frame).collect()}
    assert all(found[i] == [(0, 12, 2)] for i in range(40))
    assert found[40] == [] and found[41] == [(0, 6, 1)]


def test_query(spark, tmp_path):
    """The query against brute force over odd words: other blanks, marks and scripts are part of words."""
    rng = random.Random(11)
    rows = [(None, "x x x x x x x"), (3, None), (4, ""), (5, " \t\n")]
    for i in range(300):
        words = next(iter([w for w in texts_of(i) if w]), ["one"])
        gap = rng.choice([" ", "\n", "\t ", "\x0b", " \r\n"])
        rows.append((i * 7, gap.join(words) + rng.choice(["", " z", "    ", "\x1c", " 😀 ü ü"])))
    rows += rows[:20]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, kept))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 50
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
