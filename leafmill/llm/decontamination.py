"""Benchmark items in documents, also with other numbers, names or units.

Texts become templates: numbers, units behind them and names (capitalised words within a
sentence) give way to typed placeholders, the rest is lower-case words. Windows of
``WINDOW`` template words of all documents join those of all items by hash. Matches of
one document and item that lie at the same distance make a passage; it counts if it is
long enough and if what stands in the placeholders is consistent: each value of the item
stands for one value of the document and the other way round. Items with too few windows
of literal words to make a passage must agree in all their template words, and are also
found as they stand, by one window of all their words.

All of it is DataFrame functions; each document is read by itself, and only windows that
an item has too reach an exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.spark import stored
from leafmill.operators.frames import broadcast_if_small

WINDOW = 8
PASSAGE = 13  # template words that a passage has at least, if the item has as many
LITERAL = 4  # words in a window that are no placeholders, at least
BROADCAST_WINDOWS = 1_000_000  # windows of items that travel to all tasks, 24 bytes each
LAST_ID = (1 << 63) - 1

NUMBER, UNIT, NAME = "\ue001", "\ue002", "\ue003"  # private characters
# Units that may follow a number.
UNITS = (
    "km m cm mm mi mile miles meter meters metre metres foot feet ft inch inches kg g mg lb lbs pound pounds oz ounce ounces"
    " l ml liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros percent degree degrees watt watts volt volts joule joules newton newtons"
).split()
NUMBERS = r"\d+(?:[.,:/]\d+)*"
NAMES = r"([\p{Ll},;:] )(\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)*)"
MEASURED = rf"{NUMBER}\s+((?i:{'|'.join(UNITS)}))\b"
# Java repeats a group by recursion, which a long list overflows, unless it gives nothing back.
# Nothing follows these repeats, so they match the same; the SQL has the plain forms.
JAVA_NUMBERS, JAVA_NAMES = (p.replace(")*", ")*+") for p in (NUMBERS, NAMES))
PLAIN = rf"{JAVA_NUMBERS}|[\p{{L}}\p{{M}}]+"
BETWEEN = rf"[^\p{{L}}\p{{M}}{NUMBER}-{NAME}]+"


def _marked(text: Column) -> Column:
    """Names and numbers replaced."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), JAVA_NAMES, f"$1{NAME}")
    return F.regexp_replace(named, JAVA_NUMBERS, f" {NUMBER} ")


def template(text: Column) -> Column:
    """The template words of a text."""
    measured = F.regexp_replace(_marked(text), MEASURED, f"{NUMBER} {UNIT}")
    return F.array_remove(F.split(F.lower(measured), BETWEEN), "")


def plain_words(text: Column) -> Column:
    """The words and numbers of a text as they stand, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN), F.lit(0))


def values(text: Column) -> Column:
    """struct(numbers, units, names): what the placeholders stand for, in order."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), JAVA_NAMES, f"$1{NAME}")
    return F.struct(
        F.regexp_extract_all(named, F.lit(JAVA_NUMBERS), F.lit(0)).alias("numbers"),
        F.transform(F.regexp_extract_all(_marked(text), F.lit(MEASURED), F.lit(1)), F.lower).alias("units"),
        F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JAVA_NAMES), F.lit(2)), F.lower).alias("names"),
    )


def windows(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep..., place, window): hashes of all runs of ``size`` words of the column ``words``.

    The outer form of the explosion and no filter before it: either would have the words
    made a second time, for a filter by their number.
    """
    hashed = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    starts = F.when(F.size("h") >= size, F.slice("h", 1, F.size("h") - (size - 1)))
    runs = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, size))))
    return hashed.select(*keep, F.posexplode_outer(runs).alias("place", "window")).where(F.col("window").isNotNull())


def _literal(size: int) -> Column:
    words = F.slice("words", F.col("place") + 1, size)
    return F.size(F.filter(words, lambda w: ~w.isin(NUMBER, UNIT, NAME)))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(i_mark, i_place, window, whole, usable) of items; ``whole`` is how many windows the item has.

    Items of fewer than ``WINDOW`` words are one window of their own length. Windows of
    placeholders mostly are left out; ``whole_items`` has what that would lose.
    """
    fits = F.size("words") >= WINDOW if size == WINDOW else F.size("words") == size
    rows = items.where(fits)
    found = windows(rows, size, "i_mark", "words", "usable").where(_literal(size) >= min(LITERAL, (size + 1) // 2))
    return found.select("i_mark", F.col("place").alias("i_place"), "window", (F.size("words") - (size - 1)).alias("whole"), "usable")


def usable_windows() -> Column:
    """How many windows of the column ``words`` are not placeholders mostly."""
    size = F.least(F.size("words"), F.lit(WINDOW))
    literal = F.transform("words", lambda w: (~w.isin(NUMBER, UNIT, NAME)).cast("int"))

    def enough(place: Column) -> Column:
        return F.aggregate(F.slice(literal, place + 1, size), F.lit(0), lambda n, x: n + x) >= F.least(F.lit(LITERAL), F.floor((size + 1) / 2))

    return F.when(F.size("words") > 0, F.size(F.filter(F.sequence(F.lit(0), F.size("words") - size), enough))).otherwise(0)


def whole_items(items: DataFrame) -> DataFrame:
    """(i_mark, whole, size, words) of items with fewer usable windows than a passage has.

    They are also met by all their words as they stand, numbers included.
    """
    whole = F.size("words") - F.least(F.size("words"), F.lit(WINDOW)) + 1
    rows = items.where(F.size("words") > 0).select("i_mark", "usable", whole.alias("whole"), plain_words(F.col("text")).alias("words"))
    rows = rows.where((F.col("usable") < F.least("whole", F.lit(PASSAGE - WINDOW + 1))) & (F.size("words") > 0))
    return rows.select("i_mark", "whole", F.size("words").alias("size"), "words")


def _slot_pairs() -> Column:
    """What stands in each placeholder of a passage: array of struct(kind, i, d)."""

    def value(words: str, kinds: str, mark: Column, place: Column) -> Column:
        nth = F.size(F.filter(F.slice(words, F.lit(1), place + 1), lambda w: w == mark)) - 1
        return F.when(mark == NUMBER, F.get(f"{kinds}.numbers", nth)).when(mark == UNIT, F.get(f"{kinds}.units", nth)).otherwise(F.get(f"{kinds}.names", nth))

    places = F.filter(
        F.sequence(F.col("from"), F.col("to")),
        lambda p: F.get("i_words", p).isin(NUMBER, UNIT, NAME) & (F.get("i_words", p) == F.get("d_words", p + F.col("shift"))),
    )
    return F.transform(
        places,
        lambda p: F.struct(
            F.get("i_words", p).alias("kind"),
            value("i_words", "i_values", F.get("i_words", p), p).alias("i"),
            value("d_words", "d_values", F.get("i_words", p), p + F.col("shift")).alias("d"),
        ),
    )


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(at, mark, item, windows, whole, changed): documents with passages of items.

    ``windows`` is the most windows in one consistent passage, of the ``whole`` that the
    item has; ``changed`` tells that numbers, units or names are others than the item's.
    Null texts are empty and leak nothing; null ids of documents are the last. Repeated
    rows and items are found like any other, empty tables give no rows, other columns
    are not read. ``at`` and ``mark`` (id and hash of the text) name the document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"), F.xxhash64(text).alias("mark"), text.alias("text"))
    worded = rows.select("at", "mark", template(F.col("text")).alias("words"))
    asked = items.where(F.col(item_text).isNotNull()).select(
        F.col(item_col).alias("item"), F.xxhash64(item_text).alias("i_mark"), F.col(item_text).alias("text")
    )
    known = stored(
        asked.dropDuplicates(["i_mark"]).select("i_mark", "text", template(F.col("text")).alias("words"), values(F.col("text")).alias("values")).withColumn("usable", usable_windows()),
        "items",
    )
    short = [r["n"] for r in known.select(F.size("words").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect()]

    def met(size: int) -> DataFrame:
        own = broadcast_if_small(stored(item_windows(known, size), "item-windows"), BROADCAST_WINDOWS)
        shift = (F.col("place") - F.col("i_place")).alias("shift")
        pairs = windows(worded, size, "at", "mark").join(own, "window").select("at", "mark", "i_mark", "whole", "usable", shift, "i_place")
        found = pairs.groupBy("at", "mark", "i_mark", "whole", "usable", "shift").agg(
            F.count_distinct("i_place").alias("windows"), F.min("i_place").alias("from"), (F.max("i_place") + (size - 1)).alias("to")
        )
        asked_for = F.least(F.col("whole"), F.lit(PASSAGE - WINDOW + 1))
        found = found.where(F.col("windows") >= F.least("usable", asked_for)).withColumn("all", F.col("usable") < asked_for)
        # of an item with fewer usable windows all template words are compared
        return found.select(
            "at",
            "mark",
            "i_mark",
            "whole",
            "shift",
            "all",
            F.when(F.col("all"), F.col("whole").cast("long")).otherwise(F.col("windows")).alias("windows"),
            F.when(F.col("all"), 0).otherwise(F.col("from")).alias("from"),
            F.when(F.col("all"), F.col("whole") + (size - 2)).otherwise(F.col("to")).alias("to"),
        )

    passages = stored(reduce(DataFrame.union, [met(size) for size in sorted({WINDOW, *short})]), "passages")
    wanted = passages.select(F.col("at").alias("w_at"), F.col("mark").alias("w_mark")).distinct()
    here = (F.col("at") == F.col("w_at")) & (F.col("mark") == F.col("w_mark"))
    texts = rows.join(broadcast_if_small(wanted), here).select("at", "mark", "text").dropDuplicates(["at", "mark"])
    texts = texts.select("at", "mark", template(F.col("text")).alias("d_words"), values(F.col("text")).alias("d_values"))
    of_items = known.select("i_mark", F.col("words").alias("i_words"), F.col("values").alias("i_values"))
    same = F.forall(F.sequence(F.col("from"), F.col("to")), lambda p: F.coalesce(F.get("i_words", p) == F.get("d_words", p + F.col("shift")), F.lit(False)))
    slots = passages.join(texts, ["at", "mark"]).join(of_items, "i_mark").where(~F.col("all") | same)
    slots = slots.select("at", "mark", "i_mark", "windows", "whole", _slot_pairs().alias("slots"))

    def kinds(*fields: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], *(s[f] for f in fields)))))

    consistent = slots.where((kinds("i", "d") == kinds("i")) & (kinds("i", "d") == kinds("d")))
    changed = F.exists("slots", lambda s: s["i"] != s["d"])
    exact = stored(whole_items(known), "whole-items")
    sizes = [r["size"] for r in exact.select("size").distinct().collect()]
    if sizes:
        plain = rows.select("at", "mark", plain_words(F.col("text")).alias("words"))

        def copied(size: int) -> DataFrame:
            own = windows(exact.where(F.col("size") == size), size, "i_mark", "whole").drop("place")
            met = windows(plain, size, "at", "mark").join(broadcast_if_small(stored(own, "whole-windows"), BROADCAST_WINDOWS), "window")
            return met.select("at", "mark", "i_mark", F.col("whole").cast("long").alias("windows"), "whole", F.lit(False).alias("changed")).distinct()

        consistent = reduce(DataFrame.union, [consistent.select("at", "mark", "i_mark", "windows", "whole", changed.alias("changed")), *map(copied, sizes)])
        changed = F.col("changed")
    found = consistent.groupBy("at", "mark", "i_mark").agg(
        F.max("windows").alias("windows"), F.max("whole").alias("whole"), F.min(changed).alias("changed")
    )
    return found.join(asked.select("item", "i_mark").distinct(), "i_mark").drop("i_mark")


def found_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, share, changed): one row per document and item found in it."""
    rows = leaks(docs, items, id_col, text_col)
    return rows.select(
        F.when(F.col("at") != LAST_ID, F.col("at")).alias("doc_id"),
        F.col("item").alias("item_id"),
        "windows",
        (F.col("windows") / F.col("whole")).alias("share"),
        "changed",
    )


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in which no item was found, with all their columns."""
    found = stored(leaks(docs, items, id_col, text_col).select(F.col("at").alias("f_at"), F.col("mark").alias("f_mark")).distinct(), "leaks")
    here = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)) == F.col("f_at")) & (
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("f_mark")
    )
    return docs.join(broadcast_if_small(found), here, "left_anti")
