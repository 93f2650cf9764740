import hashlib

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import fingerprints as fp
from leafmill.llm import words
from tests.llm import brute


def test_shingle_hashes_tell_shingles_apart():
    texts = ["a b c d e f", "A  b c d\ne f", "a b", "b a", "", None, "x " * 300, "a b c d e f g", "é è ê ë 😀 z"]
    hashes, counts = words.shingle_hashes(texts)
    assert counts.tolist() == [2, 2, 1, 1, 0, 0, 296, 3, 2]
    parts = [set(hashes[a:b].tolist()) for a, b in words.segments(counts)]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(parts[i] & parts[j]) == len(brute.shingles(a) & brute.shingles(b)), (i, j)


def exact(text, k=fp.SKETCH):
    hashes, _ = words.shingle_hashes([text])
    return sorted(set((hashes >> np.uint64(1)).tolist()))[:k]


def likeness(a, b, k=fp.SKETCH):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def test_edited_fingerprints_of_odd_rows(odd_docs):
    frame, rows = odd_docs
    got = fp.edited_fingerprints(frame).collect()
    assert len(got) == len(rows)
    first = -(1 << 63)
    ordered = sorted(rows, key=lambda r: first if r[0] is None else r[0])
    texts = {}
    for d, t in ordered:
        texts.setdefault(d, []).append(t or "")
    allowed = {}
    ids = list(texts)
    for i, d in enumerate(ids):  # rows of one id may come in any order
        for t in texts[d]:
            after = texts[d] + texts[ids[(i + 1) % len(ids)]]
            for n in after:
                e = fp.edited_text(t, n)
                allowed[(d, len(t), hashlib.sha256(e.encode()).hexdigest())] = (t, e, n)
    for r in got:
        t, e, n = allowed[(r.doc_id, r.n_chars, r.edited_sha256)]
        assert list(r.sketch) == exact(t) and list(r.edited_sketch) == exact(e)
        assert r.near_edited == likeness(exact(t), exact(e))
        assert 0 <= r.near_next <= 1


def test_every_text_meets_the_next(spark):
    rows = [(i * 3, f"text number {i} has a few words of its own {i * i}") for i in range(300)]
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        assert got[d].edited_sha256 == hashlib.sha256(fp.edited_text(t, n).encode()).hexdigest()
        assert got[d].near_next == likeness(exact(t), exact(n))


def test_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")
    row = fp.edited_fingerprints(one).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"a b c da b c d"[:8] + b"a b c d").hexdigest() or row.n_chars == 15
    assert fp.edited_fingerprints(one.limit(0)).count() == 0


def test_merge_containment_and_counts(spark):
    parts = [("g", " ".join(f"a{i}" for i in range(j * 100, j * 100 + 150))) for j in range(20)] + [("h", "x y")] * 3 + [(None, "p q")]
    df = spark.createDataFrame(parts, "g string, t string").withColumn("s", fp.sketch(F.col("t"), 64))
    merged = {r.g: list(r.s) for r in fp.merge(df, "g", "s", 64).collect()}
    for g in ("g", "h", None):
        values = set()
        for name, t in parts:
            if name == g:
                values |= set(exact(t, 10**9))
        assert merged[g] == sorted(values)[:64]
    pair = spark.createDataFrame([(" ".join(f"a{i}" for i in range(2000)), " ".join(f"a{i}" for i in range(1000)), "")], "a string, b string, e string")
    s = pair.select(*(fp.sketch(F.col(c)).alias(c) for c in ("a", "b", "e")))
    r = s.select(
        fp.resemblance(F.col("a"), F.col("b")).alias("r"),
        fp.containment(F.col("b"), F.col("a")).alias("c"),
        fp.distinct_shingles(F.col("a")).alias("n"),
        fp.resemblance(F.col("e"), F.col("e")).alias("e"),
        fp.resemblance(F.col("e"), F.col("a")).alias("x"),
        fp.distinct_shingles(F.col("e")).alias("z"),
    ).first()
    assert abs(r.r - 0.5) < 0.1 and abs(r.c - 1) < 0.2 and abs(r.n / 1996 - 1) < 0.2
    assert (r.e, r.x, r.z) == (1.0, 0.0, 0.0)
