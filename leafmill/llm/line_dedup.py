"""Removal of lines that repeat an earlier line, exactly or up to one word.

Lines are compared as sequences of words in lower case. Two lines are near if one word
inserted, deleted or replaced turns one into the other. They are found by a deletion
neighbourhood: each line emits its hash and the hash without each of its words, and
equal hashes join. Of the lines that meet at a hash each is compared with the earliest
only, so a group of any size gives as many pairs as it has lines. The words of each
pair are compared before a line goes.

One edit leaves one half of a line as it is, so only lines that share a half with
another distinct line emit their neighbourhood; that loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.spark import bounded_batches, stored
from leafmill.llm.words import _powers, mix, slices, word_hashes

LEAST_WORDS = 4  # shorter lines recur in clean documents and always stay
NEAR_WORDS = 10  # from here on one word is a small part of a line
LAST_ID = (1 << 63) - 1
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_KEYS = ["k1", "k2"]


class Lines:
    """The lines of some texts with hashes of whole lines and of runs of their words."""

    def __init__(self, lines: list[str]):
        self.words, self.counts = word_hashes(lines)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        place = np.arange(len(self.words)) - np.repeat(self.starts, self.counts)
        longest = int(self.counts.max()) + 1 if len(self.counts) else 1
        power = _powers(longest)
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(longest, _BACK))))
        zero = np.zeros(1, np.uint64)
        self.sums = np.concatenate((zero, np.cumsum(self.words * power[place])))
        other = mix(self.words ^ np.uint64(0x5851F42D4C957F2D))
        self.others = np.concatenate((zero, np.cumsum(other * power[place])))

    def whole(self) -> np.ndarray:
        return mix(self.sums[self.ends] - self.sums[self.starts] + self.counts.astype(np.uint64))

    def second(self) -> np.ndarray:
        return mix(self.others[self.ends] - self.others[self.starts])

    def half(self, size: np.ndarray, last: bool) -> np.ndarray:
        """Hash of the first or last ``size`` words of each line, with side and size."""
        if last:
            run = (self.sums[self.ends] - self.sums[self.ends - size]) * self.back[self.counts - size]
        else:
            run = self.sums[self.starts + size] - self.sums[self.starts]
        return mix(run + mix(size.astype(np.uint64) * np.uint64(2) + np.uint64(last)))


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per document and distinct line: where it stands, its keys and the hashes of its halves."""
    kinds = "at long, mark long, line int, again array<int>, k1 long, k2 long, n int, h1 long, h2 long, h3 long, h4 long"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = 0
            for part in slices(batch.column(2).to_pylist()):
                cut = [t.split("\n") for t in part]
                sizes = np.array([len(c) for c in cut])
                found = Lines([x for c in cut for x in c])
                owner = np.repeat(np.arange(done, done + len(part)), sizes)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                done += len(part)
                first, second = found.whole(), found.second()
                use = np.flatnonzero(found.counts >= LEAST_WORDS)
                if not len(use):
                    continue
                order = use[np.lexsort((number[use], second[use], first[use], owner[use]))]
                new = np.ones(len(order), bool)
                new[1:] = (owner[order[1:]] != owner[order[:-1]]) | (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(order))
                repeats = [number[order[a + 1 : b]] if b - a > 1 else [] for a, b in zip(heads.tolist(), tails.tolist(), strict=True)]
                pick = order[heads]
                near = found.counts >= NEAR_WORDS
                size = np.where(near, found.counts // 2, 0)
                less = np.where(near, (found.counts - 1) // 2, 0)
                halves = [found.half(size, False), found.half(size, True), found.half(less, False), found.half(less, True)]
                lacking = [~near[pick], ~near[pick], ~(near & (size != less))[pick], ~(near & (size != less))[pick]]
                columns = [
                    pa.array(at[owner[pick]], pa.int64()),
                    pa.array(mark[owner[pick]], pa.int64()),
                    pa.array(number[pick], pa.int32()),
                    pa.array(repeats, pa.list_(pa.int32())),
                    pa.array(first[pick].view(np.int64)),
                    pa.array(second[pick].view(np.int64)),
                    pa.array(found.counts[pick], pa.int32()),
                    *(pa.array(h[pick].view(np.int64), mask=m) for h, m in zip(halves, lacking, strict=True)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("at", "mark", "text").mapInArrow(run, kinds)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, mark, text): the place of each row and a hash of its text, which tell rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"), F.xxhash64(text).alias("mark"), text.alias("text")
    )


def close_lines(distinct: DataFrame) -> DataFrame:
    """(close_key): first keys of lines that share a half with another distinct line."""
    halves = distinct.where(F.col("n") >= NEAR_WORDS).select("k1", F.explode(F.array("h1", "h2", "h3", "h4")).alias("half"))
    halves = halves.where("half is not null")
    shared = halves.groupBy("half").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least < most").select("half")
    return halves.join(shared, "half").select(F.col("k1").alias("close_key")).distinct()


def with_words(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, k2, at, line, words): the word hashes of lines given by (at, mark, line, k1, k2)."""
    kinds = "k1 long, k2 long, at long, line int, words array<bigint>"
    wanted = places.groupBy("at", "mark").agg(F.collect_list(F.struct("line", "k1", "k2")).alias("wanted"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                words, counts = word_hashes([lines[p["line"]] for p in places])
                ends = np.cumsum(counts)
                for p, a, b in zip(places, (ends - counts).tolist(), ends.tolist(), strict=True):
                    rows.append((p["k1"], p["k2"], at, p["line"], words[a:b].view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k1", "k2", "at", "line", "words"])

    wanted = stored(wanted.withColumnsRenamed({"at": "w_at", "mark": "w_mark"}), "wanted")
    found = docs.join(wanted, (F.col("at") == F.col("w_at")) & (F.col("mark") == F.col("w_mark")))
    return found.select("at", "text", "wanted").mapInArrow(run, kinds).dropDuplicates(_KEYS)


def variants(lines: DataFrame) -> DataFrame:
    """(v, form, at, line): hashes of each line and of the line without each word.

    ``form`` is the number of words that the hash covers, for the line itself, and that
    number and the place of the missing word, for the others.
    """
    kinds = "v long, form long, at long, line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.array(row["words"], np.int64).view(np.uint64)
                n = len(words)
                power = _powers(n + 1)[:n]
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power)))
                dropped = mix(sums[:-1] + (sums[-1] - sums[1:]) * _BACK + np.uint64(n - 1))
                whole = mix(sums[-1:] + np.uint64(n))
                form = np.concatenate(([n << 32], ((n - 1) << 32) + np.arange(1, n + 1)))
                columns = [np.concatenate((whole, dropped)).view(np.int64), form, np.full(n + 1, row["at"]), np.full(n + 1, row["line"])]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["v", "form", "at", "line"])

    return lines.mapInArrow(run, kinds)


def one_edit(a: list[int], b: list[int]) -> bool:
    """Whether at most one word inserted, deleted or replaced makes the sequences equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    start = next((i for i in range(least) if a[i] != b[i]), least)
    stop = next((i for i in range(least - start) if a[-1 - i] != b[-1 - i]), least - start)
    return max(len(a), len(b)) - start - stop <= 1


def near_repeats(lines: DataFrame) -> DataFrame:
    """(k1, k2): lines with an earlier line one edit away. Earlier: lesser id, then lesser line number."""
    emitted = stored(variants(lines), "variants")
    place = F.struct("at", "line")
    covered, missing = F.shiftright("form", 32), F.col("form").bitwiseAND(0xFFFFFFFF)
    dropped = emitted.where(missing > 0)
    earliest = dropped.groupBy("v", "form").agg(F.min(place).alias("e"), F.count("*").alias("c")).where("c > 1").select("v", "form", "e")
    replaced = dropped.join(earliest, ["v", "form"]).where(place > F.col("e")).select("at", "line", F.col("e.at").alias("e_at"), F.col("e.line").alias("e_line"))
    whole = emitted.where(missing == 0).select("v", covered.alias("covered"), F.col("at").alias("w_at"), F.col("line").alias("w_line"))
    met = dropped.select("v", covered.alias("covered"), "at", "line").join(whole, ["v", "covered"])
    longer_goes = place > F.struct("w_at", "w_line")

    def of(longer: str, shorter: str) -> Column:
        return F.when(longer_goes, F.col(longer)).otherwise(F.col(shorter))

    inserted = met.select(of("at", "w_at").alias("at"), of("line", "w_line").alias("line"), of("w_at", "at").alias("e_at"), of("w_line", "line").alias("e_line"))
    pairs = replaced.union(inserted).distinct()
    later = lines.select("at", "line", "k1", "k2", F.col("words").alias("a"))
    earlier = lines.select(F.col("at").alias("e_at"), F.col("line").alias("e_line"), F.col("words").alias("b"))
    both = pairs.join(later, ["at", "line"]).join(earlier, ["e_at", "e_line"]).select("k1", "k2", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [one_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], _KEYS)

    return both.mapInArrow(verify, "k1 long, k2 long").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, mark, removed): the numbers of the lines to remove, for rows that have any.

    A line goes if an earlier row (a lesser id) or an earlier line of its own row equals
    it, or if the first such line is one edit away from an earlier line. Rows that share
    an id are equally early. Lines of fewer than ``LEAST_WORDS`` words stay, and only
    lines of ``NEAR_WORDS`` or more have near ones.
    """
    rows = keyed(docs, id_col, text_col)
    lines = stored(line_rows(rows), "lines")
    distinct = stored(
        lines.groupBy(*_KEYS).agg(
            F.min("at").alias("first"), F.max("at").alias("last"), *(F.max(c).alias(c) for c in ("n", "h1", "h2", "h3", "h4"))
        ),
        "distinct-lines",
    )
    own = F.concat(F.array("line"), "again").alias("gone")
    close = distinct.join(close_lines(distinct), F.col("k1") == F.col("close_key"), "left")
    known = close.select(*_KEYS, "first", "last", F.col("close_key").isNotNull().alias("close")).where("first < last or close")
    met = stored(lines.select("at", "mark", "line", "again", *_KEYS).join(known, _KEYS).where("at > first or close"), "met-lines")
    exact = met.where("at > first").select("at", "mark", own)
    firsts = met.where("close and at = first")
    worded = stored(with_words(firsts.select("at", "mark", "line", *_KEYS), rows), "line-words")
    near = firsts.join(near_repeats(worded), _KEYS).select("at", "mark", own)
    inside = lines.where(F.size("again") > 0).select("at", "mark", F.col("again").alias("gone"))
    gone = exact.union(near).union(inside).groupBy("at", "mark")
    return gone.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with all columns, the repeated lines gone from the text.

    Two columns are added: ``lines``, how many the text had, and ``removed``, the numbers
    (from 0) of those that went; input columns of these names are replaced. Null texts
    stay null and have no lines, empty ones have one; null ids count as the last.
    """
    bounded_batches(docs.sparkSession)
    gone = stored(repeated_lines(docs, id_col, text_col).withColumnsRenamed({"at": "g_at", "mark": "g_mark", "removed": "g_removed"}), "removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    here = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)) == F.col("g_at")) & (F.xxhash64(text) == F.col("g_mark"))

    @F.arrow_udf("string")
    def rest(texts: pa.Array, removed: pa.Array) -> pa.Array:
        kept = []
        for t, numbers in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            drop = set(numbers or [])
            kept.append(t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
        return pa.array(kept, pa.string())

    found = docs.join(gone, here, "left")
    changed = F.col("g_removed").isNotNull()
    # computed once, wherever filters and projections move
    found = found.withColumn("g_text", rest.asNondeterministic()(F.when(changed, F.col(text_col)), F.col("g_removed")))
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    own = {
        "lines": F.coalesce(breaks + 1, F.lit(0)).cast("int"),
        "removed": F.coalesce("g_removed", F.array().cast("array<int>")),
        text_col: F.when(changed, F.col("g_text")).otherwise(F.col(text_col)),
    }
    return found.withColumns(own).drop("g_at", "g_mark", "g_removed", "g_text")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their columns, repeated lines gone; rows that lost all their words go."""
    kept = deduplicated(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text")), "own_id", "own_text")
    kept = kept.where((F.size("removed") == 0) | F.col("own_text").rlike(r"\S"))
    return kept.select(*(F.col("own_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
