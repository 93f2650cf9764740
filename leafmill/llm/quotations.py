"""Reply-ordered conversations from messages that quote each other.

A line's quote level is the number of ``>`` that it starts with. Neighbouring lines of
one level are a passage. Passages, and their single lines, are normalised and hashed and
joined to the earliest message of the conversation that has them as its own words: as a
whole, as a paragraph or as a line. A message replies to what it quotes at the outermost
level that is found. Quotes and the lines that announce them then leave the text.

All of it is DataFrame functions. A hash meets one message of its conversation at most,
so nothing grows with the square of a group, and no conversation is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.spark import stored

MARKS = r"^(?:\s*>)+"
# How a quote is announced, at the end of a line.
ANNOUNCED = r"(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def body(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normalised(text: Column) -> Column:
    """Words and marks without regard to case and spacing."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def own_text(text: Column) -> Column:
    """The text without quotes and announcements; as it is if it quotes nothing."""
    lines = _lines(text)
    kept = F.filter(
        lines,
        lambda x, i: (level(x) == 0) & ~(x.rlike(ANNOUNCED) & (level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)),
    )
    return F.when(quotes(text), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(text)


def quotes(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?m)^\s*>"), F.lit(False))


def quoted_keys(messages: DataFrame) -> DataFrame:
    """(conv, at, level, key): hashes of the passages and lines that each message quotes."""
    rows = messages.where(quotes(F.col("text"))).select("conv", "at", "text", F.xxhash64("text").alias("mark")).distinct()
    lines = rows.select("conv", "at", "mark", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("conv", "at", "mark", "pos", level(F.col("line")).alias("level"), body(F.col("line")).alias("body"))
    of_message = Window.partitionBy("conv", "at", "mark").orderBy("pos")  # the lines of one text
    begins = F.coalesce((F.lag("level").over(of_message) != F.col("level")).cast("int"), F.lit(1))
    lines = lines.withColumn("begins", begins).withColumn("run", F.sum("begins").over(of_message)).where("level > 0")
    runs = lines.groupBy("conv", "at", "mark", "run", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("p"))
    passage = F.array_join(F.transform("p", lambda x: x["body"]), " ")
    texts = runs.select("conv", "at", "level", F.explode(F.concat(F.array(passage), F.transform("p", lambda x: x["body"]))).alias("t"))
    return _hashed(texts, "conv", "at", "level")


def _hashed(texts: DataFrame, *keep: str) -> DataFrame:
    rows = texts.select(*keep, normalised(F.col("t")).alias("t")).where("t <> ''")
    return rows.select(*keep, F.md5("t").alias("key")).distinct()


def own_keys(messages: DataFrame) -> DataFrame:
    """(conv, at, key): hashes of each message's own words as a whole, of paragraphs and of lines."""
    own = messages.where("text is not null").select("conv", "at", own_text(F.col("text")).alias("own"))
    parts = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), _lines(F.col("own"))))
    return _hashed(own.select("conv", "at", F.explode(parts).alias("t")), "conv", "at")


def replies(messages: DataFrame) -> DataFrame:
    """(conv, at, parent): the turn that each quoting message replies to, where it is found."""
    quoted = stored(quoted_keys(messages), "quoted")
    wanted = quoted.select("conv", "key").distinct()
    own = own_keys(messages)
    same = own["conv"].eqNullSafe(wanted["conv"]) & (own["key"] == wanted["key"])
    firsts = own.join(wanted, same, "left_semi").groupBy("conv", "key").agg(F.min("at").alias("origin"))
    here = quoted["conv"].eqNullSafe(firsts["conv"]) & (quoted["key"] == firsts["key"]) & (F.col("origin") < F.col("at"))
    links = quoted.join(firsts, here).select(quoted["conv"], "at", "level", "origin")
    outermost = F.max(F.struct((-F.col("level")).alias("level"), "origin")).alias("best")
    return links.groupBy("conv", "at").agg(outermost).select("conv", "at", F.col("best.origin").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, at, parent, root, depth): the first message of each reply's thread and how far it is.

    Paths double in length each round, so a thread of n messages takes log2(n) rounds.
    """
    rows = stored(links.select("conv", "at", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = rows.select(F.col("conv").alias("u_conv"), F.col("at").alias("u_at"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"))
        joined = rows.join(up, F.col("conv").eqNullSafe(F.col("u_conv")) & (F.col("root") == F.col("u_at")), "left")
        if joined.where("u_at is not null").isEmpty():
            return rows
        rows = stored(
            joined.select(
                "conv",
                "at",
                "parent",
                F.coalesce("u_root", "root").alias("root"),
                (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"),
            ),
            "threads",
        )


def conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, thread, depth) in reply order.

    Each message has its own words as text, the turn it replies to, the turn that began
    its thread and its distance from there; the rows are sorted by conversation, thread
    and turn. A message that quotes nothing that is found begins a thread. Null texts
    stay null and quote nothing, a text of quotes only becomes empty; messages without a
    turn neither reply nor are replied to. Rows that share conversation and turn are
    one message for links, and each gives a row. Null conversations are one
    conversation; an empty table gives no rows; other columns are not read.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("at"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    found = threads(replies(rows.where("at is not null"))).withColumnsRenamed({"conv": "t_conv", "at": "t_at"})
    joined = rows.join(found, F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("at") == F.col("t_at")), "left")
    ordered = joined.select(
        F.col("conv").alias("conv_id"),
        F.col("at").alias("turn"),
        "role",
        own_text(F.col("text")).alias("text"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "at").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    return ordered.orderBy("conv_id", "thread", "turn")
