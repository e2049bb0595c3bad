"""Digests of bags, and what they save."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from equivcheck.plans import multiset, suite
from equivcheck.plans.compare import EQUAL


def test_equal_bags_have_equal_digests(spark, tmp_path):
    rng = random.Random(3)
    ddl = "a int, b string, c double"
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "", "x"]), rng.choice([None, 0.0, 1.5, float("nan")])) for _ in range(200)]
    df = spark.createDataFrame(rows, ddl)
    first = multiset.digest(df)
    rng.shuffle(rows)
    assert multiset.digest(spark.createDataFrame(rows, ddl).repartition(7)) == first
    assert multiset.write(df, f"{tmp_path}/w") == first
    # The class of a column counts, not its width.
    assert multiset.digest(df.select(F.col("a").cast("bigint"), "b", "c")) == first
    half = [multiset.digest(df.where(p)) for p in ("a = 1", "a is null or a != 1")]
    assert half[0] + half[1] == first
    with pytest.raises(ValueError):
        half[0] + multiset.digest(df.select("a"))


def test_other_bags_have_other_digests(spark):
    ddl = "a int, b int"
    bags = [
        [],
        [(1, 2)],
        [(2, 1)],
        [(1, 2), (1, 2)],
        [(None, 1)],
        [(1, None)],
        [(None, None)],
        [(0, 0)],
        [(1, 2), (3, 4)],
        [(1, 4), (3, 2)],
    ]
    found = Counter(multiset.digest(spark.createDataFrame(rows, ddl)) for rows in bags)
    assert set(found.values()) == {1}


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "a int")
    digests = [multiset.write(none, f"{tmp_path}/a"), multiset.write(none.where("a > 1"), f"{tmp_path}/b")]
    assert all(d is None or (d.rows, d.sums) == (0, (0, 0)) for d in digests)


def test_results_with_equal_digests_are_not_read_again(spark, tmp_path):
    first = suite.Case(0, 0, suite.ORIGIN, "Filter", "s", None, None, None, None, "key", None, None, "union", f"{tmp_path}/o")
    second = suite.replace(first, case_id="Other0", predicate="ts > 50", result_path=f"{tmp_path}/x")
    rows = spark.range(100).select(F.col("id").alias("ts"), (F.col("id") % 3).alias("key"))
    sources, digests = {"s": suite.SuiteSource("s", rows)}, {}
    for case in (first, second):
        assert suite.execute(case, sources, None, digests)[0] == suite.SUCCESS
    # The results are gone: only digests can tell.
    away = [suite.replace(c, result_path=c.result_path + "-gone") for c in (first, second)]
    moved = {f"{path}-gone": d for path, d in digests.items()}
    verdict = suite.judge(spark, *away, suite.SuiteConfig(), moved)
    assert (verdict.relation, verdict.left_rows, verdict.right_rows, verdict.differing) == (EQUAL, 100, 100, 0)
    assert suite.judge(spark, first, second, suite.SuiteConfig()) == verdict
