from collections import defaultdict

from pyspark.sql import functions as F

from equivcheck.operators.split import branches, tagged, union_all
from equivcheck.operators.windows import event_millis, millis, rewindow, tumbling
from equivcheck.plans.compare import compare


def test_alignment_against_brute_force(spark):
    stamps = [-1001, -1000, -999, -700, -5, -1, 0, 1, 699, 700, 701, 1399, 1400, None]
    rows = spark.createDataFrame([(t,) for t in stamps], "ts bigint")
    got = tumbling(rows, 700, {"n": F.count(F.lit(1))}).collect()
    expected = defaultdict(int)
    for t in stamps:
        if t is not None:
            expected[t // 700 * 700] += 1
    assert {(r.start, r.end, r.n) for r in got} == {(s, s + 700, n) for s, n in expected.items()}


def test_same_windows_as_the_window_function(mixed):
    for size in (1, 250, 7001):
        ours = tumbling(mixed, size, {"n": F.count(F.lit(1))}, ["key"])
        builtin = (
            mixed.groupBy(F.window(F.timestamp_millis("ts"), f"{size} milliseconds"), "key")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_millis("window.start"), F.unix_millis("window.end"), "key", "n")
        )
        assert compare(ours, builtin).relation == "Equal"


def test_windows_over_starts_land_on_themselves(mixed):
    once = tumbling(mixed, 480, {"n": F.count(F.lit(1))})
    assert compare(once, rewindow(once, 480, {"n": F.sum("n")})).relation == "Equal"


def test_several_keys_and_several_aggregates(mixed):
    out = tumbling(mixed, 1000, {"a": F.min("small"), "b": F.max("small")}, ["key", "medium"])
    assert out.columns == ["start", "end", "key", "medium", "a", "b"]


def test_units(spark):
    assert millis(90, "minutes") == 5_400_000
    assert spark.range(3, 4).select(event_millis(F.col("id"), "hours")).first()[0] == 10_800_000


def test_branches_cover_every_row_once(mixed):
    for predicate in ("(value > 5)", "(wide > 0)", "(NULL > 1)", "(value > 5 OR wide > 0)"):
        assert compare(mixed, union_all(branches(mixed, predicate))).relation == "Equal"
        sizes = [b.count() for b in branches(mixed, predicate)]
        by_tag = dict(tagged(mixed, predicate).groupBy("branch").count().collect())
        assert [by_tag.get(i, 0) for i in range(3)] == sizes
