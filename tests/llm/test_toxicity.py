import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import expressions
from leafmill.llm import toxicity as tox


def test_runs_as_by_brute_force():
    texts = ["", "Ab c", "é", "x" * 50, "日本", "Zoë's 42!", "a"]
    cells, counts = tox.runs(texts)
    done = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        symbols = [tox._symbol(c) if c < "\x80" or "\xc0" <= c <= "\xff" else 31 for c in f"   {text} "] if text else []
        symbols = [s for c, s in zip(f"   {text} ", symbols, strict=False) for _ in range(1 if c < "ࠀ" else 2)]
        want = [sum(s * 32 ** (3 - k) for k, s in enumerate(symbols[i : i + 4])) for i in range(len(symbols) - 3)]
        assert cells[done : done + n].tolist() == want, text
        done += n


def test_models_are_distributions():
    pick = np.random.default_rng(1)
    every = pick.poisson(0.3, tox.CELLS)
    shared = tox._shared(every.astype(float)).reshape(-1, tox.SYMBOLS)
    assert np.allclose(shared.sum(1), 1)
    same = tox.log_ratios(every, every, every)
    assert np.allclose(same, 0)
    nothing = np.zeros(tox.CELLS)
    assert np.isfinite(tox.log_ratios(nothing, nothing, nothing)).all()


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels, tox.scores(docs, labels).toPandas()


def test_held_out_accuracy(scored):
    _, labels, found = scored
    held = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    toxic, clean = held[held.toxic == 1].predicted, held[held.toxic == 0].predicted
    assert toxic.mean() > 0.5 and clean.mean() < 0.03  # a few hundred toxic texts to learn from
    order = held.score.rank()
    area = (order[held.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert area > 0.85
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]).all()


def test_held_out_labels_are_not_used(scored, spark):
    docs, labels, found = scored
    other = labels.withColumn("toxic", F.when(tox.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.scores(docs, other).toPandas()
    both = found.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y)


def test_odd_rows(spark, odd_docs):
    frame, rows = odd_docs
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (5, 7), (77, 1)], "doc_id long, toxic int")
    got = tox.scores(frame, labels).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(d) for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert tox.without_toxic(frame, labels).columns == frame.columns
    assert tox.scores(frame.limit(0), labels).count() == 0
    assert {r.score for r in tox.scores(frame, labels.limit(0)).collect()} == {0.0}


def made_up(spark, bad, good, between=" ", copies=6):
    """Texts of common words; toxic ones hold a word that differs from an ordinary one in its letters only."""
    pick = np.random.default_rng(3)
    rows = []
    for i in range(50 * copies):
        toxic = i % 5 == 0
        words = [good[k] for k in pick.integers(0, len(good), 30)]
        words[int(pick.integers(1, 29))] = bad[i // 5 % len(bad)] if toxic else good[i % len(good)]
        rows.append((i, between.join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


@pytest.mark.parametrize(
    ("bad", "good", "between"),
    [
        (["дурак", "тупой"], ["слово", "книга", "город", "вечер", "поезд"], " "),
        (["βλάκα", "χαζός"], ["λόγος", "βιβλί", "πόλις", "δρόμο", "ημέρα"], " "),
        (["蠢货", "白痴"], ["天气", "城市", "书本", "火车", "晚上"], ""),
    ],
)
@pytest.mark.parametrize("held", [1 << 19, 3])
def test_toxic_words_in_other_scripts(spark, monkeypatch, bad, good, between, held):
    monkeypatch.setattr("leafmill.llm.expressions.HELD", held)
    docs, labels = made_up(spark, bad, good, between)
    found = tox.scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held_out = found[found.held_out]
    assert held_out.toxic.sum() >= 5
    assert (held_out.predicted == held_out.toxic).mean() > 0.95


def test_expressions_grow_with_the_corpus(spark):
    def size(n):
        rows = [(" ".join(f"{chr(97 + i % 26)}{i}x{j}" for j in range(20)), 1) for i in range(n) for _ in range(9)] + [("other words", 0)] * 9
        found = expressions.known_counts(spark.createDataFrame(rows, "text string, label int"))
        return found.count(), expressions.evidence(found).rows.count()

    small, large = size(10), size(100)
    assert small[0] == 10 * 20 * 2 + 2 and large[0] == 100 * 20 * 2 + 2
    assert large[1] > 9 * small[1] > 0


def test_only_asked_for_counts_are_exchanged(spark):
    """The counts of all texts travel as four numbers a word or pair, and the places of pairs as zeros."""
    rows = [("fool fool a", 1), ("a fool", 1), ("a b a b", 0), ("a fool b", None), ("", 0), (None, 1), ("x", 1)]
    frame = spark.createDataFrame(rows, "text string, label int").repartition(3)
    hashed = frame.select(F.coalesce("label", F.lit(-1)).cast("long").alias("label"), expressions._hashes(F.col("text")).alias("h"))
    bits = spark.sparkContext.broadcast(np.full(expressions.FILTER_WORDS, -1))
    found = expressions.counts(hashed, ["every", "ordinary"], bits)
    assert found.columns == ["pair", "key", "every", "ordinary", "places", "ordinary_places"]
    assert found.where("pair").agg(F.sum(F.col("places") + F.col("ordinary_places"))).first()[0] == 0
    known = expressions.known_counts(frame)
    assert [f"{f.name} {f.dataType.typeName()}" for f in known.schema] == expressions.COUNTS.split(", ")
    sums = {(r["pair"], r["key"]): tuple(r[c] for c in expressions.SUMS) for r in known.collect()}
    key = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("a", "fool")}
    assert sums.pop((False, expressions.START)) == (5, 1, 3, 5, 1, 3)
    assert sums.pop((False, 0)) == (0, 0, 0, 13, 4, 6)
    assert sums.pop((False, key["a"])) == (4, 1, 2, 5, 2, 2)
    assert sums.pop((False, key["fool"])) == (3, 0, 2, 4, 0, 3)
    assert sums == {}


def class_models(rows):
    """P(w) and P(w | v) of both classes by plain counting, over the known words and ``None`` for all others."""
    kinds = {"every": lambda y: True, "ordinary": lambda y: y == 0, "toxic": lambda y: y == 1}
    split = [(re.findall(r"\w+", text.lower()), y) for text, y in rows]
    pairs_of = [(set(zip(["<s>", *w], w, strict=False)), y) for w, y in split]
    n, m, c, tokens = ({k: Counter() for k in kinds} for _ in range(4))
    for k, fits in kinds.items():
        for (w, y), (pairs, _) in zip(split, pairs_of, strict=True):
            if fits(y):
                n[k].update(set(w))
                m[k].update(pairs)
                c[k].update([*w, *(["<s>"] if w else [])])
                tokens[k]["all"] += len(w)
    words = {w for w, x in n["toxic"].items() if x >= expressions.LEAST}
    pairs = {p for p, x in m["toxic"].items() if x >= expressions.LEAST}
    assert all(w in words and (v in words or v == "<s>") for v, w in pairs)
    less = lambda x: max(x - expressions.DISCOUNT, 0)
    unknown = {k: tokens[k]["all"] - sum(c[k][w] for w in words) for k in kinds}
    total = {k: sum(n[k][w] for w in words) + unknown[k] for k in kinds}
    models = {}
    for k in ("ordinary", "toxic"):
        even = expressions.EVEN * total[k] / total["toxic"]
        mass = total[k] - sum(less(n[k][w]) for w in words) - less(unknown[k]) + expressions.BACKOFF
        whole = total[k] + expressions.BACKOFF + even * (len(words) + 1)
        one = {w: (less(n[k][w]) + mass * n["every"][w] / total["every"] + even) / whole for w in words}
        one[None] = (less(unknown[k]) + mass * unknown["every"] / total["every"] + even) / whole

        def two(v, w, k=k, one=one):
            after = [p for p in pairs if p[0] == v]
            left = (c[k][v] - sum(less(m[k][p]) for p in after) + expressions.BACKOFF) / (c[k][v] + expressions.BACKOFF)
            others = 1 - sum(m["every"][p] for p in after) / c["every"][v]
            own, share = (less(m[k][v, w]) / (c[k][v] + expressions.BACKOFF), m["every"][v, w] / c["every"][v]) if (v, w) in pairs else (0, 0)
            return own + left * (share + others * one[w] + one[w]) / 2

        models[k] = one, two
    return words, pairs, models, split


def test_word_models_as_by_brute_force(spark, monkeypatch):
    """Probabilities that sum to one, the rows of evidence, and the mean log ratio and the largest one of whole texts."""
    rng = random.Random(6)
    common, bad = [f"w{i}" for i in range(12)], ["vile", "fool", "mean one"]
    rows = []
    for i in range(160):
        y = [1, 0, 0, None][i % 4]
        rows.append((" ".join(rng.choices(common, k=rng.randrange(1, 9)) + ([rng.choice(bad)] if y == 1 else []) + rng.choices([*common, "fool", f"x{i}"], k=3)), y))
    rows += [("", 1), ("", None), ("vile vile vile fool", 1)]
    words, pairs, models, split = class_models(rows)
    for one, two in models.values():
        assert abs(sum(one.values()) - 1) < 1e-9
        for v in [*sorted(words), "<s>"]:
            assert abs(sum(two(v, w) for w in one) - 1) < 1e-9
    (o_one, o_two), (t_one, t_two) = models["ordinary"], models["toxic"]
    frame = spark.createDataFrame(rows, "text string, label int").repartition(3)
    for held in (1 << 19, 8):
        monkeypatch.setattr(expressions, "HELD", held)
        said = expressions.gather(frame)
        asked = frame.select("text", F.xxhash64("text").alias("mark"), said.lookup(F.col("text")).alias("said"))
        found = {r["text"]: (r["n"], r["total"], r["top"]) for r in said.joined(asked).collect()}
        for (text, _), (w, _) in zip(rows, split, strict=True):
            known = [x if x in words else None for x in w]
            total, top = 0.0, math.log(t_one[None] / o_one[None])
            for v, x in zip(["<s>", *known], known, strict=False):
                if v is None:  # nothing is known of what follows an unknown word
                    total += math.log(t_one[x] / o_one[x])
                else:
                    total += math.log(t_two(v, x) / o_two(v, x))
                top = max(top, *([math.log(t_one[x] / o_one[x])] if x else []), *([math.log(t_two(v, x) / o_two(v, x))] if (v, x) in pairs else []), top)
            if known and known[-1] is not None:  # something unknown follows the last word
                total += math.log(t_two(known[-1], None) / o_two(known[-1], None)) - math.log(t_one[None] / o_one[None])
            n, got, largest = found[text]
            assert n == len(w) and abs(got - total) < 1e-6 and (not w or abs(largest - top) < 1e-6), text


def test_evidence_held_or_joined_is_the_same(spark, monkeypatch):
    docs, labels = made_up(spark, ["stupid fool", "idiot"], ["word", "book", "town", "road", "fool", "stupid"])
    docs = docs.union(docs.limit(7))
    once = sorted((r.doc_id, round(r.score, 6)) for r in tox.scores(docs, labels).collect())
    monkeypatch.setattr("leafmill.llm.expressions.HELD", 4)
    assert once == sorted((r.doc_id, round(r.score, 6)) for r in tox.scores(docs, labels).collect())
