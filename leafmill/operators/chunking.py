"""Splitting documents into chunks.

Every splitter is a Column expression from text to ``array<string>``, so a chunk
table is one narrow pass over the documents: no shuffle, no regrouping. Packing
folds over piece *lengths* and records only where a chunk starts; each chunk is
then joined once from a slice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import (
    WS,
    is_blank,
    is_markdown,
    let,
    pieces,
    strip,
    tokens,
)
from leafmill.operators.frames import unnest

# Sizes, sentence marks and separators.
CHUNK_SIZE = 200
CHUNK_OVERLAP = 20
SEPARATOR = "\n\n"
SENTENCE_MARKS = "[。！？.!?]"
RECURSIVE_SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", "")

__all__ = [
    "auto_chunks",
    "basic_chunks",
    "chunk_features",
    "chunk_stats",
    "chunk_table",
    "markdown_sections",
    "recursive_chunks",
    "sentence_chunks",
    "sentence_token_chunks",
    "token_window_chunks",
]


def _ints() -> Column:
    return F.array().cast("array<int>")


STRETCH = 256


def _fold(values: Column, start: dict[str, Column], step, grown: str, finish) -> Column:
    """``aggregate`` for a state with a list that grows with the text.

    Each step would copy the whole list. So the values are folded in stretches of about
    their number's square root: a step copies the list of its stretch only, and the
    stretches' lists are joined once each.
    """
    names = [n for n in start if n != grown]

    def whole(bound: Column) -> Column:
        stretch = F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(F.size(bound))).cast("int"))
        last = F.greatest(F.lit(0), F.ceil(F.size(bound) / stretch).cast("int") - 1)

        def one(state: Column, k: Column) -> Column:
            begin = F.struct(*((F.slice(start[grown], 1, 0) if n == grown else state[n]).alias(n) for n in start))
            return let(
                F.aggregate(F.slice(bound, k * stretch + 1, stretch), begin, step),
                lambda end: F.struct(*(end[n].alias(n) for n in names), F.concat(state[grown], end[grown]).alias(grown)),
            )

        first = F.struct(*(start[n].alias(n) for n in names), start[grown].alias(grown))
        return F.aggregate(F.sequence(F.lit(0), last), first, one, finish)

    return let(values, whole)


def _cut_points(lengths: Column, size: int, gap: int) -> Column:
    """Start positions (1-based) of greedily packed runs, and the end position."""

    def step(state: Column, n: Column) -> Column:
        opens = (state["at"] == 1) | (state["used"] + n > size)
        return F.struct(
            F.when(opens, n + gap).otherwise(state["used"] + n + gap).alias("used"),
            (state["at"] + 1).alias("at"),
            F.when(opens, F.concat(state["cuts"], F.array(state["at"])))
            .otherwise(state["cuts"])
            .alias("cuts"),
        )

    start = {"used": F.lit(0), "at": F.lit(1), "cuts": _ints()}
    return _fold(lengths, start, step, "cuts", lambda s: F.concat(s["cuts"], F.array(s["at"])))


def _runs(parts: Column, cuts: Column, joined) -> Column:
    """One element per run, made by ``joined`` from the slice between two cuts."""
    starts = F.slice(cuts, 1, F.size(cuts) - 1)
    return F.transform(starts, lambda s, k: joined(F.slice(parts, s, F.get(cuts, k + 1) - s)))


def sentence_chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Pack sentences up to ``size`` characters, each closed with one full stop mark.

    A sentence longer than ``size`` stays whole.
    """
    stop = "。"

    def pack(sentences: Column) -> Column:
        cuts = _cut_points(F.transform(sentences, F.length), size, len(stop))
        return let(
            cuts,
            lambda c: _runs(sentences, c, lambda run: F.concat(F.array_join(run, stop), F.lit(stop))),
        )

    return let(pieces(text, SENTENCE_MARKS), pack)


def basic_chunks(text: Column, size: int = CHUNK_SIZE, separator: str = SEPARATOR) -> Column:
    """Pack paragraphs up to ``size`` characters; split a longer one by sentence."""
    gap = "\n\n"

    def step(state: Column, n: Column) -> Column:
        long = n > size
        opens = long | (state["used"] == 0) | (state["used"] + n > size)
        return F.struct(
            F.when(long, 0).when(opens, n + len(gap)).otherwise(state["used"] + n + len(gap)).alias("used"),
            (state["at"] + 1).alias("at"),
            F.when(opens, F.concat(state["cuts"], F.array(state["at"])))
            .otherwise(state["cuts"])
            .alias("cuts"),
        )

    def chunk(run: Column) -> Column:
        first = F.get(run, 0)
        return F.when(F.length(first) > size, sentence_chunks(first, size)).otherwise(
            F.array(F.array_join(run, gap))
        )

    def pack(paragraphs: Column) -> Column:
        start = {"used": F.lit(0), "at": F.lit(1), "cuts": _ints()}
        lengths = F.transform(paragraphs, F.length)
        cuts = _fold(lengths, start, step, "cuts", lambda s: F.concat(s["cuts"], F.array(s["at"])))
        return F.flatten(let(cuts, lambda c: _runs(paragraphs, c, chunk)))

    return let(pieces(text, re.escape(separator)), pack)


def token_window_chunks(text: Column, window: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of tokens, each repeating the last ``overlap`` tokens of the one before.

    No window holds only repeated tokens.
    """
    stride = window - overlap

    def cut(words: Column) -> Column:
        last = F.greatest(F.size(words) - overlap - 1, F.lit(0))
        starts = F.sequence(F.lit(0), last, F.lit(stride))
        windows = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, window), " "))
        return F.when(F.size(words) > 0, windows).otherwise(F.array().cast("array<string>"))

    return let(tokens(text), cut)


def markdown_sections(text: Column) -> Column:
    """Sections between headings as ``array<struct<path string, text string>>``.

    Headings inside a fenced block do not count. The path holds the headings above
    the text, outermost first; a section without text is left out.
    """
    heading = rf"^(#{{1,6}})(?: (.*))?$"

    def step(state: Column, line: Column) -> Column:
        fence = line.startswith("```") | line.startswith("~~~")
        level = F.when(
            ~state["fenced"] & line.rlike("(?d)" + heading), F.length(F.regexp_extract(line, heading, 1))
        ).otherwise(0)
        name = strip(F.regexp_extract(line, heading, 2))
        kept = F.filter(state["path"], lambda p: p["level"] < level)
        path = F.when(
            level > 0, F.concat(kept, F.array(F.struct(level.alias("level"), name.alias("name"))))
        ).otherwise(state["path"])
        opened = F.array(F.struct(state["at"].alias("at"), path.alias("path")))
        return F.struct(
            F.when(fence, ~state["fenced"]).otherwise(state["fenced"]).alias("fenced"),
            (state["at"] + 1).alias("at"),
            path.alias("path"),
            F.when(level > 0, F.concat(state["heads"], opened)).otherwise(state["heads"]).alias("heads"),
        )

    def cut(lines: Column) -> Column:
        path_type = "array<struct<level:int,name:string>>"
        start = {
            "fenced": F.lit(False),
            "at": F.lit(1),
            "path": F.array().cast(path_type),
            "heads": F.array(F.struct(F.lit(0).alias("at"), F.array().cast(path_type).alias("path"))),
        }
        folded = _fold(lines, start, step, "heads", lambda s: s["heads"])

        def body(heads: Column) -> Column:
            def section(head: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines) + 1)
                inner = F.array_join(F.slice(lines, head["at"] + 1, stop - head["at"] - 1), "\n")
                return F.struct(
                    F.array_join(F.transform(head["path"], lambda p: p["name"]), " > ").alias("path"),
                    # paragraphs of one section are held together by a hard line break
                    F.regexp_replace(strip(inner), "\n{2,}", "  \n").alias("text"),
                )

            return F.filter(F.transform(heads, section), lambda s: s["text"] != "")

        return let(folded, body)

    return let(F.transform(F.split(text, "\n"), strip), cut)


def _merged_parts(parts: Column, size: int, overlap: int) -> Column:
    """struct(text, open) of parts below ``size`` packed up to it, trailing ones repeated up to ``overlap``; longer parts are open.

    A longer part ends what was packed before it, and nothing of that is repeated after it.
    """

    def ended(state: Column) -> Column:
        span = F.struct(state["first"].alias("first"), (state["at"] - 1).alias("last"), F.lit(False).alias("open"))
        return F.when(F.size(state["window"]) > 0, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])

    def step(state: Column, n: Column) -> Column:
        long, full = n >= size, (state["used"] + n > size) & (F.size(state["window"]) > 0)
        limit = F.least(F.lit(overlap), F.lit(size) - n)
        start = F.struct(state["used"].alias("left"), F.lit(0).alias("k"))
        # how many of the leading parts leave the window
        trimmed = F.aggregate(
            state["window"], start, lambda a, x: F.when(a["left"] > limit, F.struct((a["left"] - x).alias("left"), (a["k"] + 1).alias("k"))).otherwise(a)
        )

        def advance(t: Column) -> Column:
            rest = F.slice(state["window"], t["k"] + 1, F.size(state["window"]) - t["k"])
            own = F.array(F.struct(state["at"].alias("first"), state["at"].alias("last"), F.lit(True).alias("open")))
            return F.struct(
                F.when(long, _ints()).otherwise(F.concat(rest, F.array(n))).alias("window"),
                F.when(long, 0).otherwise(t["left"] + n).alias("used"),
                F.when(long, state["at"] + 1).otherwise(state["first"] + t["k"]).alias("first"),
                (state["at"] + 1).alias("at"),
                F.when(long, F.concat(ended(state), own)).when(full, ended(state)).otherwise(state["spans"]).alias("spans"),
            )

        return let(F.when(full & ~long, trimmed).otherwise(start), advance)

    spans = F.array().cast("array<struct<first:int,last:int,open:boolean>>")
    begin = {"window": _ints(), "used": F.lit(0), "first": F.lit(1), "at": F.lit(1), "spans": spans}

    def joined(span: Column) -> Column:
        run = F.array_join(F.slice(parts, span["first"], span["last"] - span["first"] + 1), "")
        return F.struct(F.when(span["open"], run).otherwise(strip(run)).alias("text"), span["open"].alias("open"))

    return let(_fold(F.transform(parts, F.length), begin, step, "spans", ended), lambda found: F.transform(found, joined))


def _character_chunks(text: Column, size: int, overlap: int) -> Column:
    """struct(text, open) of a text cut after ``size`` characters each, the last ``overlap`` of them repeated."""
    step = max(1, size - min(overlap, size - 1))

    def cut(chars: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(chars) - size) / step).cast("int"))
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(chars, k * step + 1, size), ""))
        # a single character is as long as ``size`` 1 allows, and stays as it is
        return F.transform(runs, lambda run: F.struct((run if size <= 1 else strip(run)).alias("text"), F.lit(False).alias("open")))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), cut)


def recursive_chunks(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = RECURSIVE_SEPARATORS,
) -> Column:
    """Split on the coarsest separator present, then on finer ones where still too long.

    One level after the other: each opens the parts that are still too long, and leaves the
    chunks that the levels before it have made. A separator opens the piece that follows it.
    A part in which none of the finer separators stands is cut by characters; one that the last
    separator leaves too long stays whole.
    """

    def level(found: Column, mark: Column) -> Column:
        def opened(s: Column) -> Column:
            marked = F.transform(F.split(s["text"], mark["pattern"], -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(mark["mark"], x)))
            packed = let(F.filter(marked, lambda x: x != ""), lambda parts: _merged_parts(parts, size, overlap))
            packed = F.transform(packed, lambda c: F.struct(c["text"].alias("text"), (c["open"] & ~mark["last"]).alias("open")))
            here = s["open"] & s["text"].contains(mark["mark"])
            made = F.when(mark["mark"] == "", _character_chunks(s["text"], size, overlap)).otherwise(packed)
            return F.when(here, made).otherwise(F.array(s))

        return F.flatten(F.transform(found, opened))

    marks = F.array(*(F.struct(F.lit(m).alias("mark"), F.lit(re.escape(m)).alias("pattern"), F.lit(m == separators[-1]).alias("last")) for m in separators))
    whole = F.array(F.struct(text.alias("text"), F.lit(True).alias("open"))).cast("array<struct<text:string,open:boolean>>")
    found = F.aggregate(marks, whole, level)
    if "" not in separators:  # what none of the finer separators stands in
        found = let(found, lambda f: F.flatten(F.transform(f, lambda s: F.when(s["open"], _character_chunks(s["text"], size, overlap)).otherwise(F.array(s)))))
    texts = let(found, lambda f: F.transform(F.filter(f, lambda s: s["text"] != ""), lambda s: s["text"]))
    return F.when(text.isNotNull(), texts)


def sentence_token_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pack whole sentences up to ``size`` tokens, repeating trailing ones up to ``overlap``.

    A token is a run without blanks or a single Han character. A sentence of more
    than ``size`` tokens is cut between tokens first.
    """
    marks = SENTENCE_MARKS[1:-1]
    # visible ASCII stands first in the class, where it is matched fastest
    word = rf"[!-~[^{WS[1:-1]}\p{{IsHan}}]]+|\p{{IsHan}}"
    stretch = rf"(?:(?:{word}){WS}*){{1,{size}}}"

    def counted(part: Column) -> Column:
        n = F.size(F.regexp_extract_all(part, F.lit(word), F.lit(0)))
        return F.struct(n.alias("n"), part.alias("text"))

    def cut(sentence: Column) -> Column:
        parts = F.regexp_extract_all(sentence["text"], F.lit(stretch), F.lit(0))
        return F.when(
            sentence["n"] > size, F.transform(parts, lambda p: counted(strip(p)))
        ).otherwise(F.array(sentence))

    def step(state: Column, n: Column) -> Column:
        full = (state["used"] + n > size) & (F.size(state["window"]) > 0)
        limit = F.least(F.lit(overlap), F.lit(size) - n)
        # how many of the leading sentences leave the window
        trimmed = F.aggregate(
            state["window"],
            F.struct(state["used"].alias("left"), F.lit(0).alias("k")),
            lambda a, x: F.when(
                a["left"] > limit, F.struct((a["left"] - x).alias("left"), (a["k"] + 1).alias("k"))
            ).otherwise(a),
        )
        kept = F.struct(state["used"].alias("left"), F.lit(0).alias("k"))
        span = F.array(F.struct(state["first"].alias("first"), (state["at"] - 1).alias("last")))

        def advance(t: Column) -> Column:
            rest = F.slice(state["window"], t["k"] + 1, F.size(state["window"]) - t["k"])
            return F.struct(
                F.concat(rest, F.array(n)).alias("window"),
                (t["left"] + n).alias("used"),
                (state["first"] + t["k"]).alias("first"),
                (state["at"] + 1).alias("at"),
                F.when(full, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
            )

        return let(F.when(full, trimmed).otherwise(kept), advance)

    def pack(parts: Column) -> Column:
        start = {
            "window": _ints(),
            "used": F.lit(0),
            "first": F.lit(1),
            "at": F.lit(1),
            "spans": F.array().cast("array<struct<first:int,last:int>>"),
        }
        last = lambda s: F.when(
            s["at"] > 1,
            F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))),
        ).otherwise(s["spans"])
        spans = _fold(F.transform(parts, lambda p: p["n"]), start, step, "spans", last)

        def joined(s: Column) -> Column:
            run = F.slice(parts, s["first"], s["last"] - s["first"] + 1)
            return F.array_join(F.transform(run, lambda p: p["text"]), " ")

        return F.transform(spans, joined)

    sentences = F.regexp_extract_all(text, F.lit(f"[^{marks}]*[{marks}]+|[^{marks}]+"), F.lit(0))
    solid = F.filter(F.transform(sentences, strip), lambda s: s != "")
    return let(F.flatten(F.transform(F.transform(solid, counted), cut)), pack)


def auto_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Markdown by heading, other text by sentence and token; blank text gives no chunk."""
    sections = F.transform(markdown_sections(text), lambda s: s["text"])
    return (
        F.when(is_blank(text), F.array().cast("array<string>"))
        .when(is_markdown(text), sections)
        .otherwise(sentence_token_chunks(text, size, overlap))
    )


CHUNKERS = {
    "auto": auto_chunks,
    "basic": basic_chunks,
    "sentence": sentence_chunks,
    "sentence_tokens": sentence_token_chunks,
    "token_window": token_window_chunks,
    "recursive": recursive_chunks,
    "markdown": lambda text: F.transform(markdown_sections(text), lambda s: s["text"]),
}


def chunk_table(df: DataFrame, text: str = "text", method: str = "basic", **options) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` (0-based) and ``text``.

    An unknown method means the basic one.
    """
    chunks = CHUNKERS.get(method, basic_chunks)(F.col(text), **options)
    keep = [c for c in df.columns if c != text]
    return unnest(df, keep, chunks, "text", "chunk_index")


def chunk_features(chunks: DataFrame, text: str = "text", order: str = "chunk_index") -> DataFrame:
    """Markdown feature flags per chunk."""
    col = F.col(text)
    return chunks.withColumns(
        {
            "chunk_id": F.col(order),
            "chunk_size": F.length(col).cast("long"),
            "chunk_type": F.lit("markdown"),
            "has_headers": col.rlike(rf"(?md)^#{{1,6}}{WS}+"),
            "has_code": col.contains("```"),
            "has_links": col.rlike(r"(?d)\[.*?\]\(.*?\)"),
            "has_lists": col.rlike(rf"(?md)^{WS}*[-*+]{WS}+"),
        }
    )


def chunk_stats(chunks: DataFrame, text: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    """One row of totals and size classes; no row where there is no chunk."""
    n = F.length(text).cast("long")
    return chunks.agg(
        F.count(text).alias("total_chunks"),
        F.sum(n).alias("total_characters"),
        F.avg(n).alias("average_chunk_size"),
        F.min(n).alias("min_chunk_size"),
        F.max(n).alias("max_chunk_size"),
        F.count_if(n < size // 2).alias("small"),
        F.count_if((n >= size // 2) & (n <= size)).alias("medium"),
        F.count_if(n > size).alias("large"),
    ).where("total_chunks > 0")


def enrich_chunks(chunks: DataFrame, content_type: str, stage: str, text: str = "text") -> DataFrame:
    """Add the running number, size, content type and stage to each chunk."""
    return chunks.withColumns(
        {
            "chunk_id": F.col("chunk_index") + 1,
            "chunk_size": F.length(text).cast("long"),
            "content_type": F.lit(content_type),
            "processing_stage": F.lit(stage),
        }
    )
