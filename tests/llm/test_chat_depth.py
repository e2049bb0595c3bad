"""Quote levels of any depth, against a reading of the marks one by one."""

import random

from pyspark.sql import functions as F

from equivcheck.llm import chat


def _level(line):
    level, blanks = 0, 0
    for c in line:
        if c == ">":
            level, blanks = level + 1, 0
        elif c in " \t" and blanks < 3:
            blanks += 1
        else:
            break
    return level


def test_levels_agree_with_marks_read_one_by_one(spark):
    draw = random.Random(6)
    lines = ["".join(draw.choice(">>>  \tab") for _ in range(draw.randrange(14))) for _ in range(400)]
    lines += [">" * 70 + " deep", "> " * 20_000 + "x", "    > code", ">    > far", "", ">", "   >", " " * 30_000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, text string")
    read = chat._lines(F.col("text"))[0]
    got = df.select("i", read["level"].alias("level"), read["body"].alias("body")).collect()
    for r in got:
        level = _level(lines[r.i])
        marks = 0
        for _ in range(level):
            marks = lines[r.i].index(">", marks) + 1
        assert (r.level, r.body) == (level, lines[r.i][marks:])


def test_a_quote_behind_seventy_marks_finds_its_message(spark):
    rows = [("c", 0, "u", "the first words"), ("c", 1, "v", "others"), ("c", 2, "u", ">" * 70 + " the first words\nyes")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["turn"]: r for r in chat.replies(df).collect()}
    assert got[2]["parent_turn"] == 0 and got[2]["content"] == "yes"
