"""Quotation linking: which message a reply quotes, and conversations ordered by reply.

A line's quote level is the number of ``>`` in front of it.  Lines of one level without a blank line
between them are a passage; passages are normalised (lower case, single spaces) and hashed.  A
message offers its own passages, lines and whole text (level 0); a reply looks up its quoted
passages and lines, and the whole of each level, among the earlier messages of its conversation.  Its parent
is the message found for the outermost level; of several, the one with most characters found, then
the latest; a text said more than once counts for the last time it was said before the reply.

Quotes of one text meet the messages that say it in one running maximum over turns, block by block,
so a text that is said and quoted all the time makes neither pairs nor large groups.  Roots of
reply chains come from pointer doubling, written to the shared folder step by step.

Only built-in expressions.  Messages of a conversation are ordered by thread (the root's turn), then
by turn: an answer comes after what it answers, and without quotes the order is that of turns.

Defined results: null text is empty; a message without a conversation or turn is kept, has no parent
and is a thread of its own; rows with the same turn are kept, and share parent and thread; control
characters U+0001 and U+0002 are ignored when passages are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equivcheck.operators.scan import running
from equivcheck.session import written

BLOCK = 1_024  # turns per block of a running maximum or count
# Marks stand in a run of marks and blanks, each less than four blanks behind the one before.
_RUN, _FAR, _QUOTE = r"^[ \t>]*", r"[ \t]{4}", r"^[ \t>]*>"
# How mail programs introduce a quote.
_INTRODUCTION = r"(?i)^.{0,200}(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Lines with their quote level and what follows the marks."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002\r", "")

    def line(x: Column) -> Column:
        near = F.split(F.regexp_extract(x, _RUN, 0), _FAR, 2)[0]
        marks = F.regexp_extract(near, _QUOTE, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        body = F.substring(x, F.length(marks) + 1, F.length(x))
        return F.struct(level.alias("level"), body.alias("body"), (F.trim(body) == "").alias("blank"))

    return F.transform(F.split(clean, "\n", -1), line)


def _passages(lines: Column) -> Column:
    """Passages as ``level``, ``text`` (normalised, not empty)."""

    def marked(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        goes_on = (i > 0) & ~before["blank"] & (before["level"] == x["level"])
        start = F.concat(F.lit("\u0001"), x["level"].cast("string"), F.lit("\u0002"), x["body"])
        return F.when(x["blank"], F.lit("")).when(F.coalesce(goes_on, F.lit(False)), F.concat(F.lit(" "), x["body"])).otherwise(start)

    parts = F.split(F.array_join(F.transform(lines, marked), ""), "\u0001", -1)

    def passage(x: Column) -> Column:
        cut = F.split(x, "\u0002", 2)
        return F.struct(cut[0].cast("int").alias("level"), _normal(cut[1]).alias("text"))

    return F.filter(F.transform(F.filter(parts, lambda x: x.contains("\u0002")), passage), lambda p: p["text"] != "")


def _whole(passages: Column, level: Column) -> Column:
    texts = F.transform(F.filter(passages, lambda p: p["level"] == level), lambda p: p["text"])
    return F.struct(level.alias("level"), F.array_join(texts, " ").alias("text"))


def _own(lines: Column) -> Column:
    """A message's text without quotes and without the line that introduces one."""

    def stays(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)
        introduces = x["body"].rlike(_INTRODUCTION) & F.coalesce(after["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~introduces

    kept = F.transform(F.filter(lines, stays), lambda x: x["body"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _parsed(messages: DataFrame) -> DataFrame:
    lined = messages.withColumn("__lines", _lines(F.col("text")))
    return lined.withColumn("__passages", _passages(F.col("__lines")))


def _links(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent)``: one row per message with a quote that was found."""
    keyed = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    p = F.col("__passages")
    levels = F.array_distinct(F.transform(F.filter(p, lambda x: x["level"] > 0), lambda x: x["level"]))
    # A quote may be trimmed to some lines of a passage: they are sought one by one as well.
    lines = F.filter(F.col("__lines"), lambda x: (x["level"] > 0) & ~x["blank"])
    lines = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), _normal(x["body"]).alias("text")))
    lines = F.filter(lines, lambda x: x["text"] != "")
    sought = F.concat(F.filter(p, lambda x: x["level"] > 0), F.transform(levels, lambda n: _whole(p, n)), lines)
    quotes = keyed.select("conv_id", "turn", F.explode(F.array_distinct(sought)).alias("q")).select(
        "conv_id",
        F.md5(F.col("q.text").cast("binary")).alias("hash"),
        "turn",
        F.col("q.level").alias("level"),
        F.length("q.text").alias("chars"),
    )
    quotes = written(quotes, "quotes")
    # Only what is quoted somewhere in the conversation is looked for in its messages.
    wanted = quotes.select("conv_id", "hash").distinct()
    own = F.filter(F.col("__lines"), lambda x: (x["level"] == 0) & ~x["blank"])
    offered = F.concat(
        F.transform(F.filter(p, lambda x: x["level"] == 0), lambda x: x["text"]),
        F.transform(own, lambda x: _normal(x["body"])),
        F.array(_whole(p, F.lit(0))["text"]),
    )
    said = keyed.select("conv_id", "turn", F.explode(F.array_distinct(offered)).alias("text"))
    said = said.select("conv_id", F.md5(F.col("text").cast("binary")).alias("hash"), "turn").join(
        wanted, ["conv_id", "hash"], "left_semi"
    )
    said = said.distinct().select(
        "conv_id", "hash", "turn", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("int").alias("chars"), F.col("turn").alias("said"),
    )
    asked = quotes.distinct().select(
        "conv_id", "hash", "turn", F.lit(0).alias("kind"), "level", "chars",
        F.lit(None).cast(quotes.schema["turn"].dataType).alias("said"),
    )
    # In one turn the question stands before the answer, so a message never quotes itself.
    both = said.unionByName(asked).withColumn("block", F.floor(F.col("turn") / BLOCK))
    met = running(both, ["conv_id", "hash"], ["turn", "kind", "level"], {"parent": ("max", "said")}, "block")
    found = met.where("kind = 0 and parent is not null")
    by_parent = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("chars").alias("chars"))
    best = F.max_by("parent", F.struct(-F.col("level"), F.col("chars"), F.col("parent")))
    return by_parent.groupBy("conv_id", "turn").agg(best.alias("parent"))


def _threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent, thread, depth)`` of linked messages, by pointer doubling."""
    now = written(links.select("*", F.col("parent").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("__up"), F.col("depth").alias("__more"))
        joined = now.join(up, ["conv_id", "thread"], "left")
        now = written(
            joined.select(
                "conv_id",
                "turn",
                "parent",
                F.coalesce("__up", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth"),
                F.col("__up").isNotNull().alias("moved"),
            ),
            "threads",
        )
        if not now.where("moved").take(1):
            return now.drop("moved")
        now = now.drop("moved")


def replies(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, content, parent_turn, thread_turn, depth, n_quoted, position)``.

    ``messages`` has conv_id, turn, role and text.  ``position`` counts from 0 in the conversation.
    """
    parsed = _parsed(messages.select("conv_id", "turn", "role", "text"))
    links = _threads(written(_links(parsed), "replies"))
    quoted = F.size(F.filter("__passages", lambda x: x["level"] > 0))
    rows = parsed.select(
        "conv_id", "turn", "role", _own(F.col("__lines")).alias("content"), quoted.cast("long").alias("n_quoted")
    )
    kept = links.withColumnsRenamed({"parent": "parent_turn", "thread": "thread_turn"})
    rows = rows.join(kept, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "content",
        "parent_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quoted",
        F.md5(F.concat_ws("\u0001", F.coalesce("role", F.lit("")), "content").cast("binary")).alias("__tie"),
        F.lit(1).cast("long").alias("__one"),
    )
    rows = written(rows, "messages")
    threads = rows.groupBy("conv_id", "thread_turn").agg(F.sum("__one").alias("__size"))
    threads = threads.withColumn("__block", F.floor(F.col("thread_turn") / BLOCK))
    placed = running(threads, ["conv_id"], ["thread_turn"], {"__upto": ("sum", "__size")}, "__block")
    placed = placed.select(
        F.col("conv_id").alias("__conv"), F.col("thread_turn").alias("__thread"), (F.col("__upto") - F.col("__size")).alias("__before")
    )
    within = rows.withColumn("__block", F.floor(F.col("turn") / BLOCK))
    within = running(within, ["conv_id", "thread_turn"], ["turn", "__tie"], {"__rank": ("sum", "__one")}, "__block")
    same = [within["conv_id"].eqNullSafe(placed["__conv"]), within["thread_turn"].eqNullSafe(placed["__thread"])]
    return within.join(placed, same).select(
        "conv_id",
        "turn",
        "role",
        "content",
        "parent_turn",
        "thread_turn",
        "depth",
        "n_quoted",
        (F.col("__before") + F.col("__rank") - 1).alias("position"),
    )
