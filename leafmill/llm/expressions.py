"""Class-conditional Kneser-Ney models of words and pairs of words, as rows.

Words are runs of letters, marks and digits of any script in lower case; in scripts
without blanks each character is one. Known are the words and the pairs of neighbours that
``LEAST`` toxic labelled texts have; they grow with the corpus. All other words are one,
unknown, word, as they would be to a model that had not seen the text they come from.
Either class, toxic or ordinary, has

    P(w)     = (less(n(w)) + (M + B) S(w) + U) / (N + B + U (V + 1)),  M = N - sum of less(n(.))
    P(w | v) = less(n(v, w)) / (c(v) + B) + a(v) (S(w | v) + r(v) P(w) + P(w)) / 2

with n the texts of the class that have the word or pair, c the places of v in them, N the
sum of its n(w) and V the number of words, less(x) = max(x - D, 0), and a(v) what less
takes from the counts behind v. S is the share of the word or pair in all texts, labelled
or not, and r(v) what that leaves to pairs that are not known; U is the same probability
in both classes, ``EVEN`` texts among the toxic ones. So what is rare in both classes gets
nearly the same probability from both. Probabilities behind v sum to one. A text is as toxic as
the mean log ratio of the two models over its words, whatever its sign, and as that of its
most toxic word or pair.

The toxic texts are read first. Of all texts only their words and pairs are counted, which
a filter of bits sorts out before anything is exchanged. A text's sum of log ratios is one
term per word for an unknown word, and for each known word or pair what it changes; these
changes are the rows of evidence, and they meet the texts by hash. The ``HELD`` most
frequent of them at most travel to all tasks, the others are joined; that changes where a
row is looked up, not the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.spark import arrays, stored
from leafmill.operators.frames import broadcast_if_small, unnest

LEAST = 2  # toxic texts that have a known word or pair
DISCOUNT = 1.0  # the text that is left out, were the model to score it
EVEN = 0.1  # toxic texts that every word is taken to be in beside those counted, and as many per text in ordinary ones
BACKOFF = 32.0  # pseudo-counts of the shared words in a class, and of its words behind another
START = 0x1B873593CC9E2D51  # stands before the first word
TURN = 21  # bits by which the hash of a pair's first word is turned
HELD = 1 << 19  # rows of evidence that travel to all tasks, 24 bytes each
AT_ONCE = 1 << 17  # words that a task counts or looks up at once
FILTER_WORDS = 1 << 20  # of 64 bits: a filter of the hashes of words and pairs
# Scripts without blanks between words.
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
WORD = rf"[a-z0-9ß-öø-ɏ[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]]+|[\p{{L}}\p{{N}}&&[{UNSPACED}]]\p{{M}}*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pair_keys(single: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash before each one, and the hash of both, for texts of these sizes."""
    before = np.empty(len(single), np.int64)
    before[1:] = single[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    bits = before.view(np.uint64)
    turned = (bits << np.uint64(TURN)) | (bits >> np.uint64(64 - TURN))
    return before, single ^ turned.view(np.int64)


def _parts(hashed: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``AT_ONCE`` words together, or one longer text."""
    ends = np.cumsum(np.diff(hashed.offsets.to_numpy()))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield start, stop
        start = stop


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & (FILTER_WORDS * 64 - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


COUNTS = "pair boolean, key long, before long, every long, ordinary long, toxic long, places long, ordinary_places long, toxic_places long"
SUMS = [c.split()[0] for c in COUNTS.split(", ")][3:]
PLACES = dict(zip(SUMS[:3], SUMS[3:], strict=True))


def _fits(label: np.ndarray, kind: str) -> np.ndarray:
    return {"every": np.ones(len(label), bool), "ordinary": label == 0, "toxic": label == 1}[kind]


def _counted(keys: np.ndarray, owner: np.ndarray, fits: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Per key: the key, one row that has it, and for each kind its texts, and then its places."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    kinds = [f[owner] for f in fits]
    sums = [np.add.reduceat(v.astype(np.int64), heads) if len(heads) else heads for v in (*(k & once for k in kinds), *kinds)]
    return (keys[heads], order[heads], *sums)


def counts(hashed: DataFrame, kinds: list[str], bits: Broadcast | None = None) -> DataFrame:
    """Of ``COUNTS`` those of these kinds of texts, of all words and pairs of (label, h), or of those that pass the filter.

    A pair's key is the hash of both, of which the first may be ``START``. Without a filter
    the word before comes along. Nothing asks for the places of pairs, which are the most
    rows; they are 0. As a word, ``START`` counts the texts that have words. The key 0 of no
    pair counts, as places, the words of all texts, known or not.
    """
    sums = [*kinds, *(PLACES[k] for k in kinds)]
    names = ["pair", "key", *([] if bits else ["before"]), *sums]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in _parts(b.column(1))):
            label, column = batch.column(0).to_numpy(), batch.column(1)
            single, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            before, pairs = _pair_keys(single, sizes)
            fits = [_fits(label, k) for k in kinds]
            filled, tokens = [int((f & (sizes > 0)).sum()) for f in fits], [int(sizes[f].sum()) for f in fits]
            none = np.zeros(2, np.int64)
            rows = [(False, [np.array([START, 0]), none, *(np.array([n, 0]) for n in filled), *(np.array(n) for n in zip(filled, tokens, strict=True))])]
            for pair, keys in ((False, single), (True, pairs)):
                here = np.ones(len(keys), bool) if bits is None else _passes(bits.value, keys)
                key, row, *found = _counted(keys[here], owner[here], fits)
                none = np.zeros(len(key), np.int64)
                places = [none] * len(kinds) if pair else found[len(kinds) :]
                rows.append((pair, [key, before[here][row] if pair else none, *found[: len(kinds)], *places]))
            for pair, (key, first, *found) in rows:
                if len(key):
                    values = [key, *([] if bits else [first]), *found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), pair)), *(pa.array(v, pa.int64()) for v in values)], names)

    schema = "pair boolean, " + ", ".join(f"{c} long" for c in names[1:])
    first = [] if bits else [F.max("before").alias("before")]
    return hashed.mapInArrow(count, schema).groupBy("pair", "key").agg(*first, *(F.sum(c).alias(c) for c in sums))


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A filter of 2^26 bits that passes the column ``key``."""
    place = F.col("key").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words_of = arrays(keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("bits")))  # FILTER_WORDS rows at most
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[words_of["at"]] = words_of["bits"]
    return bits


def known_counts(rows: DataFrame) -> DataFrame:
    """``COUNTS`` of the words and pairs that toxic texts have, and of ``START`` and 0, from (text, label)."""
    spark = rows.sparkSession
    hashed = rows.select(F.coalesce("label", F.lit(-1)).cast("long").alias("label"), _hashes(F.col("text")).alias("h"))
    always = F.col("key").isin(START, 0) & ~F.col("pair")
    own = stored(counts(hashed.where("label = 1"), ["toxic"]).where((F.col("toxic") >= LEAST) | always), "toxic-keys")
    # what toxic texts have is counted; the others' counts alone are exchanged
    bits = spark.sparkContext.broadcast(bit_filter(own.where(F.col("toxic") >= LEAST)))
    found = counts(hashed, ["every", "ordinary"], bits)
    mine = ["before", "toxic", "toxic_places"]
    known = broadcast_if_small(own.select(F.col("pair").alias("o_pair"), F.col("key").alias("o_key"), *mine))
    both = found.join(known, (F.col("pair") == F.col("o_pair")) & (F.col("key") == F.col("o_key")), "left").where(F.col("toxic").isNotNull() | always)
    return stored(both.select("pair", "key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", *SUMS))), "known-counts")


def less(n: Column) -> Column:
    return F.greatest(n - DISCOUNT, F.lit(0.0))


@dataclass
class Model:
    """What all words and pairs share: the totals of the counts, and the log ratio of an unknown word."""

    unknown: float
    start: float
    rows: DataFrame  # (key, every, gain, peak)


def evidence(found: DataFrame) -> Model:
    """What each known word and pair changes in a text's sum of log ratios (``gain``), and its own log ratio (``peak``)."""
    is_word = ~F.col("pair") & ~F.col("key").isin(START, 0)
    sums = [F.sum(F.when(is_word, F.col(c))).alias(c) for c in SUMS]
    kinds = [F.sum(F.when(is_word, less(F.col(c)))).alias(f"l_{c}") for c in ("ordinary", "toxic")]
    tokens = [F.sum(F.when(~F.col("pair") & (F.col("key") == 0), F.col(c))).alias(f"t_{c}") for c in SUMS[3:]]
    total = found.agg(*sums, *kinds, *tokens, F.count_if(is_word).alias("kinds")).first()
    t = {c: float(total[c] or 0) for c in total.asDict()}
    unknown = {c: max(0.0, t[f"t_{p}"] - t[p]) for c, p in zip(SUMS[:3], SUMS[3:], strict=True)}
    shared = max(1.0, t["every"] + unknown["every"])

    even = {c: EVEN * (t[c] + unknown[c]) / max(1.0, t["toxic"] + unknown["toxic"]) for c in ("ordinary", "toxic")}

    def share(c: str) -> tuple[float, float]:
        """The weight of the shared words in a class, and all its counts."""
        counted = t[f"l_{c}"] + max(unknown[c] - DISCOUNT, 0.0)
        return t[c] + unknown[c] - counted + BACKOFF, t[c] + unknown[c] + BACKOFF + even[c] * (t["kinds"] + 1)

    def of_word(c: str) -> Column:
        weight, n = share(c)
        return (less(F.col(c)) + weight / shared * F.col("every") + even[c]) / n

    def of_unknown(c: str) -> float:
        weight, n = share(c)
        return (max(unknown[c] - DISCOUNT, 0.0) + weight * unknown["every"] / shared + max(even[c], 1e-9)) / n

    nothing = math.log(of_unknown("toxic") / of_unknown("ordinary"))
    pairs = found.where("pair").select("key", "before", "every", F.col("ordinary").alias("p_ordinary"), F.col("toxic").alias("p_toxic"))
    spent = pairs.groupBy(F.col("before").alias("key")).agg(*(F.sum(less(F.col(f"p_{c}"))).alias(f"d_{c}") for c in ("ordinary", "toxic")), F.sum("every").alias("d_every"))
    words_of = found.where(is_word | (~F.col("pair") & (F.col("key") == START))).join(spent, "key", "left")

    def behind(c: str) -> Column:
        places = F.col(f"{c}_places")
        return (places - F.coalesce(f"d_{c}", F.lit(0.0)) + BACKOFF) / (places + BACKOFF)

    columns = [*(of_word(c).alias(f"w_{c}") for c in ("ordinary", "toxic")), *(behind(c).alias(f"a_{c}") for c in ("ordinary", "toxic"))]
    columns.append((1 - F.coalesce("d_every", F.lit(0)) / F.col("places")).alias("others"))
    known = stored(words_of.select("key", "every", *SUMS[3:], *columns), "known-words")
    ratio, back = F.log(F.col("w_toxic") / F.col("w_ordinary")), F.log(F.col("a_toxic") / F.col("a_ordinary"))
    singles = known.where(F.col("key") != START).select("key", "every", (ratio - nothing + back).alias("gain"), ratio.alias("peak"))
    second = known.select(F.col("key").alias("word"), "w_ordinary", "w_toxic")
    first = known.select(F.col("key").alias("before"), "a_ordinary", "a_toxic", "others", *SUMS[3:])
    turned = F.shiftleft("before", TURN).bitwiseOR(F.shiftrightunsigned("before", 64 - TURN))
    joined = pairs.withColumn("word", F.col("key").bitwiseXOR(turned)).join(second, "word").join(first, "before")

    def of_pair(c: str) -> Column:
        shared_pair = F.col("every") / F.col("places")
        return less(F.col(f"p_{c}")) / (F.col(f"{c}_places") + BACKOFF) + F.col(f"a_{c}") * (shared_pair + (1 + F.col("others")) * F.col(f"w_{c}")) / 2

    of_both = F.log(of_pair("toxic") / of_pair("ordinary"))
    both = joined.select("key", "every", (of_both - ratio - back).alias("gain"), of_both.alias("peak"))
    start = known.where(F.col("key") == START).select(back.alias("b")).first()
    return Model(nothing, start["b"] if start else 0.0, singles.union(both))


@dataclass
class Evidence:
    """The rows that travel, sorted by key; the others, or None, and the filter of their keys; and the log ratios of an unknown word and of a text's start."""

    held: Broadcast
    others: DataFrame | None
    unknown: float
    start: float

    def lookup(self, text: Column) -> Column:
        """struct(n, total, top, keys, times): words, sum of log ratios and the largest of a text, from what travels, and what is left to join."""
        held, unknown, start = self.held, self.unknown, self.start

        def of_part(hashed: pa.Array) -> pa.Array:
            keys, gains, peaks, bits = held.value
            sizes = np.diff(hashed.offsets.to_numpy())
            n = len(sizes)
            single = hashed.flatten().to_numpy()
            every = np.concatenate((single, _pair_keys(single, sizes)[1]))
            owner = np.tile(np.repeat(np.arange(n), sizes), 2)
            at = np.minimum(np.searchsorted(keys, every), max(0, len(keys) - 1))
            here = keys[at] == every if len(keys) else np.zeros(len(every), bool)
            total = np.bincount(owner[here], gains[at[here]], n) + sizes * unknown + (sizes > 0) * start
            top = np.full(n, unknown)
            np.maximum.at(top, owner[here], peaks[at[here]])
            rest, whose = every[~here], owner[~here]
            if bits is None:
                rest, whose = rest[:0], whose[:0]
            else:
                may = _passes(bits, rest)
                rest, whose = rest[may], whose[may]
            order = np.lexsort((rest, whose))
            rest, whose = rest[order], whose[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (whose[1:] != whose[:-1])
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(rest)))
            cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(whose[heads], minlength=n)))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int64())) for v in (rest[heads], times)]
            return pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(total, pa.float64()), pa.array(top, pa.float64()), *lists], ["n", "total", "top", "keys", "times"]
            )

        @F.arrow_udf("struct<n: long, total: double, top: double, keys: array<long>, times: array<long>>")
        def found(hashed: pa.Array) -> pa.Array:
            parts = [of_part(hashed.slice(i, j - i)) for i, j in _parts(hashed)]
            return pa.concat_arrays(parts) if parts else of_part(hashed)

        return found(_hashes(text))

    def joined(self, rows: DataFrame) -> DataFrame:
        """The rows with (mark, said) where ``said`` is that of ``lookup``, as (n, total, top) with the other rows' evidence added."""
        own = [F.col(c) for c in rows.columns if c != "said"]
        if self.others is not None:  # read twice, looked up once
            rows = stored(rows, "looked-up")
        flat = rows.select(*own, "said.n", "said.total", "said.top")
        if self.others is None:
            return flat
        asked = unnest(rows, ["mark"], F.arrays_zip("said.keys", "said.times"), "k").select("mark", F.col("k.keys").alias("key"), F.col("k.times").alias("times"))
        asked = asked.groupBy("mark", "key").agg(F.max("times").alias("times"))  # equal texts ask once
        met = asked.join(self.others, "key").groupBy(F.col("mark").alias("j_mark"))
        more = met.agg(F.sum(F.col("times") * F.col("gain")).alias("j_total"), F.max("peak").alias("j_top"))
        both = flat.join(more, F.col("mark") == F.col("j_mark"), "left")
        return both.select(*own, "n", (F.col("total") + F.coalesce("j_total", F.lit(0.0))).alias("total"), F.greatest("top", "j_top").alias("top"))


def gather(rows: DataFrame) -> Evidence:
    """Count the words and pairs of (text, label); ``label`` is 1 for toxic texts, 0 for ordinary ones."""
    model = evidence(known_counts(rows))
    found = stored(model.rows, "evidence")
    # the most frequent rows by powers of two, so that no more than HELD are ever collected
    power = F.floor(F.log2("every")).cast("int")
    sizes = {r["p"]: r["count"] for r in found.groupBy(power.alias("p")).count().collect()}  # 64 rows at most
    least, n = 64, 0
    for p in sorted(sizes, reverse=True):
        if n + sizes[p] > HELD:
            break
        least, n = p, n + sizes[p]
    held = arrays(found.where(power >= least).select("key", "gain", "peak"))
    order = np.argsort(held["key"])
    others, bits = None, None
    if n < sum(sizes.values()):
        others = found.where(power < least).select("key", "gain", "peak")
        bits = bit_filter(others)
    pa.default_memory_pool().release_unused()
    values = (*(held[c][order] for c in ("key", "gain", "peak")), bits)
    return Evidence(rows.sparkSession.sparkContext.broadcast(values), others, model.unknown, model.start)
