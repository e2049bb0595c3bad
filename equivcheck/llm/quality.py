"""Line-first cleaning: rules per line, failing lines go, documents that lose too much go.

Only built-in expressions.  A document passes through one projection; nothing is shuffled.

Line rules (a line without a word is kept and counts for nothing):

* punctuation: no letter or digit at all, or symbols of ``[#*$%&|<>]`` are more than 15 % of its
  characters in words;
* navigation: three or more separators standing alone, and one word in five is a separator;
* boilerplate: one of the phrases below.

A document is rejected if lines with more than half of its characters in words fail.

Defined results: a null or empty text has no words, fails the base rules and is not kept; repeated
rows are judged one by one; other columns pass through, except that columns of the names this
operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equivcheck.llm.common import SPACES, let, words

WINDOW = 8

# Symbols, separators and phrases of the line rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", "||", ">", ">>", "»", "›", "•", "·", "/", "::"]
BOILERPLATE = [
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "please enable javascript",
    "licensed under the",
    "without warranties or conditions",
    "permission is hereby granted",
]


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, ""))


def _symbols(text: Column) -> Column:
    # Most texts have none: a look is cheaper than taking symbols out.
    found = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(text.rlike(r"[#*$%&|<>]"), found).otherwise(0)


def line_fails(line: Column) -> Column:
    """Whether one of the three rules rejects a line that has words."""
    noisy = F.when(line.rlike(r"[#*$%&|<>]"), _symbols(line) * 100 > _word_chars(line) * 15)
    punctuation = ~line.rlike(r"[\p{L}\p{N}]") | noisy.otherwise(False)

    def separated(parts: Column) -> Column:
        n = F.size(F.filter(parts, lambda w: w.isin(SEPARATORS)))
        return (n >= 3) & (n * 5 >= F.size(parts))

    navigation = F.when(line.rlike(r"[|>»›•·/:]"), let(words(line), separated)).otherwise(False)

    def says(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | low.contains(phrase)
        return found

    return punctuation | navigation | let(F.lower(line), says)


def _window(parts: Column, at: Column) -> list[Column]:
    return [F.get(parts, at + k) for k in range(WINDOW)]


def _covered(starts: Column) -> Column:
    """Words in the union of the windows at ``starts`` (ascending)."""
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(
        starts,
        first,
        lambda a, x: F.struct(
            x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total")
        ),
        lambda a: a["total"],
    )


def repeated_words(parts: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Hashes decide fast that all windows differ; where two hashes agree, the windows themselves
    are sorted and compared, so the count is exact.
    """
    last = F.size(parts) - WINDOW
    at = F.sequence(F.lit(0), last)
    hashes = F.transform(at, lambda i: F.xxhash64(*_window(parts, i)))
    distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))

    def starts(s: Column) -> Column:
        def twin(k: Column) -> Column:
            here = F.get(s, k)["w"]
            return F.coalesce(here == F.get(s, k - 1)["w"], F.lit(False)) | F.coalesce(
                here == F.get(s, k + 1)["w"], F.lit(False)
            )

        found = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(twin(k), F.get(s, k)["i"])
        )
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    windows = F.sort_array(
        F.transform(
            at, lambda i: F.struct(F.concat_ws(" ", *_window(parts, i)).alias("w"), i.alias("i"))
        )
    )
    exact = let(windows, lambda s: _covered(starts(s)))
    return F.when(last < 1, F.lit(0)).when(distinct, F.lit(0)).otherwise(exact)


def judge(docs: DataFrame, text: str = "text", max_lost_percent: int = 50) -> DataFrame:
    """Add the counts, ``clean_text``, ``lost_chars``, ``base_failed`` and ``kept`` to documents."""
    added = [
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "lost_chars",
        "clean_text",
        "base_failed",
        "kept",
    ]
    given = [F.col(f"`{c}`") for c in docs.columns if c not in added]

    def line(x: Column) -> Column:
        has = _has_word(x)
        fails = F.when(has, line_fails(x)).otherwise(False)
        return F.struct(x.alias("line"), has.alias("words"), fails.alias("fails"))

    def verdicts(whole: Column) -> Column:
        lines = let(
            F.transform(F.split(whole, "\n", -1), line),
            lambda j: F.struct(
                let(
                    F.transform(F.filter(j, lambda x: x["words"]), lambda x: x["line"]),
                    lambda x: F.size(x) - F.size(F.array_distinct(x)),
                ).alias("dup"),
                F.aggregate(
                    F.filter(j, lambda x: x["fails"]), F.lit(0), lambda a, x: a + _word_chars(x["line"])
                ).alias("lost"),
                F.array_join(
                    F.transform(F.filter(j, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"
                ).alias("clean"),
            ),
        )
        parts = let(
            words(whole), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))
        )
        return let(
            F.struct(lines.alias("lines"), parts.alias("parts")),
            lambda x: F.struct(
                x["parts"]["n"].cast("long").alias("n_words"),
                _word_chars(whole).cast("long").alias("word_chars"),
                _symbols(whole).cast("long").alias("n_symbols"),
                x["lines"]["dup"].cast("long").alias("n_dup_lines"),
                x["parts"]["repeated"].cast("long").alias("n_repeat_words"),
                x["lines"]["lost"].cast("long").alias("lost_chars"),
                x["lines"]["clean"].alias("clean_text"),
            ),
        )

    # inline() keeps the optimizer from working the counts out once more for a later filter.
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(*given, F.inline(F.transform(F.array(whole), verdicts)))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    stays = F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & stays)
