"""Golden cases of the comparison, and the tolerant part against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from equivcheck.plans import pairing
from equivcheck.plans.compare import close, compare, diff_columns, diff_rows

# The golden rows (ts, id, value).
GOLDEN = [
    (4, 2640107033871964592, 4717616570401959493),
    (5, 8912120879298085137, 8306436399312939728),
    (6, 6235324137994233735, 8500869912308157169),
    (7, 122154706967589397, 9063209755160279896),
    (8, 4127129296106256735, 2403277047778102033),
    (9, 3000629464555624686, -564384158816576237),
    (10, -8165581157611751641, 5717466228514099554),
    (11, 5809620390719566466, -5611274108733340469),
    (12, -8937184432160593850, 3517000156326659898),
]
DDL = "ts bigint, id bigint, value bigint"


def _frame(spark, order):
    rows = [(*GOLDEN[i], pos) for pos, i in enumerate(order)]
    return spark.createDataFrame(rows, DDL + ", pos int")


@pytest.mark.parametrize(
    "order,expected",
    [
        (range(9), "Equal"),
        ([7, 8, 0, 2, 1, 4, 3, 6, 5], "Reordered"),
        ([], "Diff"),
        ([0, 1, 2, 3, 5, 6, 8], "Diff"),
        ([0, 1, 1, 2, 3, 4, 4, 5, 6, 7, 7, 8], "Diff"),
        ([0, 0, 2, 3, 4, 4, 6, 7, 7], "Diff"),
    ],
    ids=["equal", "reordered", "empty", "missing", "doubled", "missing_and_doubled"],
)
def test_golden(spark, order, expected):
    left, right = _frame(spark, range(9)), _frame(spark, order)
    assert compare(left, right, pos="pos").relation == expected
    bag = compare(left.drop("pos"), right.drop("pos")).relation
    assert bag == {"Reordered": "Equal"}.get(expected, expected)


def test_two_empty_results_are_equal(spark):
    empty = spark.createDataFrame([], DDL)
    verdict = compare(empty, empty)
    assert (verdict.relation, verdict.left_rows, verdict.right_rows) == ("Equal", 0, 0)


def _values(spark, values, ddl="k int, v double"):
    return spark.createDataFrame(values, ddl)


@pytest.mark.parametrize(
    "a,b,expected,tolerant",
    [
        (1.0, 1.0, "Equal", False),
        (1.0, 1.0009, "Reordered", True),
        (1.0, 1.0011, "Diff", False),
        (1e12, 1e12 + 500, "Reordered", True),
        (1e12, 1e12 + 5000, "Diff", False),
        (math.nan, math.nan, "Equal", False),
        (math.nan, 1.0, "Diff", False),
        (math.inf, math.inf, "Equal", False),
        (math.inf, 1e308, "Diff", False),
        (math.inf, -math.inf, "Diff", False),
        (None, None, "Equal", False),
        (None, 0.0, "Diff", False),
        (None, math.nan, "Diff", False),
        (0.0, -0.0, "Equal", False),
    ],
)
def test_floats(spark, a, b, expected, tolerant):
    for left, right in ((a, b), (b, a)):
        verdict = compare(_values(spark, [(1, left)]), _values(spark, [(1, right)]))
        assert (verdict.relation, verdict.tolerant, verdict.maybe) == (expected, tolerant, False)


def test_null_in_exact_columns(spark):
    left = _values(spark, [(None, 1.0), (None, 2.0), (3, None)])
    right = _values(spark, [(None, 2.0004), (None, 1.0004), (3, None)])
    assert compare(left, right).relation == "Reordered"
    assert compare(left, right, group_limit=1).relation == "Reordered"


def test_pairs_by_number_and_not_by_text(spark):
    left = _values(spark, [(1, 9.9996), (1, 10.5)])
    right = _values(spark, [(1, 10.0001), (1, 10.5)])
    assert compare(left, right).relation == "Reordered"


def test_exact_columns_are_not_tolerant(spark):
    left, right = _values(spark, [(1, 1.0)]), _values(spark, [(2, 1.0)])
    assert compare(left, right).relation == "Diff"


def test_schema_classes(spark):
    ints = spark.createDataFrame([(1, 2)], "a int, b int")
    wide = spark.createDataFrame([(1, 2)], "x bigint, y smallint")
    assert compare(ints, wide).relation == "Equal"
    big = ints.select(F.col("a").cast("decimal(20,0)"), "b")
    assert compare(big, wide).relation == "Equal"
    for other in (
        ints.select("a"),
        ints.select("a", F.col("b").cast("double")),
        ints.select("a", F.col("b").cast("string")),
    ):
        verdict = compare(ints, other)
        assert verdict.relation == "Error" and "classes" in verdict.reason


def test_several_float_columns(spark):
    ddl = "k int, v double, w double"
    left = _values(spark, [(1, 1.0, 5.0), (1, 1.0001, 7.0)], ddl)
    crossed = _values(spark, [(1, 1.0, 7.0), (1, 1.0001, 5.0)], ddl)
    assert compare(left, crossed).relation == "Reordered"
    # 7 and 8 are in different clusters: nothing is close to either, so the difference is certain.
    moved = _values(spark, [(1, 1.0, 5.0), (1, 1.0001, 8.0)], ddl)
    verdict = compare(left, moved)
    assert verdict.relation == "Diff" and not verdict.maybe
    single = compare(_values(spark, [(1, 1.0, 5.0)], ddl), _values(spark, [(1, 1.0, 6.0)], ddl))
    assert single.relation == "Diff" and not single.maybe


def test_close_in_different_columns(spark):
    """Two pairs are close in x, two in y: neither column alone leads to the pairing."""
    ddl = "k int, x double, y double"
    left = [(1, 0.0, 1.0), (1, 0.0004, 2.0), (1, 5.0, 7.0), (1, 6.0, 7.0004)]
    right = [(1, 0.0003, 2.0003), (1, 0.0005, 1.0), (1, 6.0, 7.0001), (1, 5.0001, 7.0003)]
    verdict = compare(_values(spark, left, ddl), _values(spark, right, ddl))
    assert (verdict.relation, verdict.tolerant, verdict.maybe) == ("Reordered", True, False)


def _perfect(left, right, atol):
    """Whether some pairing of all rows is close in every column."""
    partner = {}

    def find(i, tried):
        for j, row in enumerate(right):
            if j not in tried and all(a == b or abs(a - b) < atol for a, b in zip(left[i], row)):
                tried.add(j)
                if j not in partner or find(partner[j], tried):
                    partner[j] = i
                    return True
        return False

    return all(find(i, set()) for i in range(len(left)))


@pytest.mark.parametrize("group_limit", [1_000_000, 4])
@pytest.mark.parametrize("seed", range(4))
def test_several_columns_against_all_pairings(spark, seed, group_limit):
    """Verdicts are certain; with the small limit components are matched on a table of edges."""
    rng = random.Random(seed)
    left = [(rng.randrange(3), rng.randrange(12) / 20, rng.randrange(12) / 20) for _ in range(45)]
    right = [(row[0], *(v + rng.uniform(-0.03, 0.03) for v in row[1:])) for row in left]
    if seed % 2:
        right[3] = (right[3][0], right[3][1], right[3][2] + 0.09)
    rng.shuffle(right)
    ddl = "k int, x double, y double"
    frames = _values(spark, left, ddl), _values(spark, right, ddl)
    got = compare(*frames, atol=0.031, rtol=0.0, group_limit=group_limit)
    expected = {True: "Reordered", False: "Diff"}[_perfect(left, right, 0.031)]
    assert (got.relation, got.maybe) == (expected, False)


def _crossed(n):
    """Rows in one dense component that have a pairing, which no order along a column gives."""
    rng = random.Random(n)
    left = [(rng.uniform(0, n / 60), rng.uniform(0, n / 60)) for _ in range(n)]
    right = [(x + rng.choice([-0.9, 0.9]) * 0.05, y + rng.choice([-0.9, 0.9]) * 0.05) for x, y in left]
    return left, rng.sample(right, n)


@pytest.mark.parametrize("group_limit", [1_000_000, 4])
def test_pairing_that_ranks_miss(spark, group_limit):
    left, right = _crossed(60)
    assert _perfect(left, right, 0.05)
    ddl = "x double, y double"
    got = compare(_values(spark, left, ddl), _values(spark, right, ddl), atol=0.05, rtol=0.0, group_limit=group_limit)
    assert (got.relation, got.tolerant) == ("Reordered", True)


def test_copies_are_matched_as_counts():
    """Against the same rows one by one, on small sets where many matchings fail."""
    rng, seen = random.Random(1), set()
    for _ in range(400):
        left, right = Counter(), Counter()
        for _ in range(rng.randint(1, 7)):
            row, n = (rng.randrange(6) / 20, rng.randrange(6) / 20), rng.randint(1, 4)
            left[row] += n
            for _ in range(n):
                right[tuple(round(v + rng.choice([-0.05, 0, 0.05, 0.1 if rng.random() < 0.1 else 0]), 6) for v in row)] += 1
        expected = _perfect(list(left.elements()), list(right.elements()), 0.051)
        sides = [[(n, row) for row, n in side.items()] for side in (left, right)]
        assert pairing.perfect(*sides, 0.051, 0.0) == expected
        seen.add(expected)
    assert seen == {True, False}


def test_places_of_close_values_are_neighbours(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-1, 1) * 10.0 ** rng.randint(-5, 15),) for _ in range(3000)]
    rows += [(0.0,), (1e6,), (-1e6,), (999_999.9995,)]
    v = F.col("v")
    near = _values(spark, rows, "v double").select("v", F.explode(F.array(F.lit(0.99e-3), v * 0.99e-9, v * -0.99e-9)).alias("by"))
    cells = [pairing.cell(c, 1e-3, 1e-9) for c in (v, v + F.col("by"))]
    assert near.where(close(v, v + F.col("by"))).where(F.abs(cells[0] - cells[1]) > 1).isEmpty()


def test_missing_values_in_several_columns(spark):
    inf, nan = math.inf, math.nan
    left = [(None, 1.0, 2.0), (nan, 1.0, 2.0), (inf, 1.0, None), (-inf, 1.0, nan), (0.0, None, -0.0)]
    right = [(x, y if y is None else y + 0.0004, z if z is None else z + 0.0004) for x, y, z in left]
    ddl = "x double, y double, z double"
    for limit in (1_000_000, 1):
        assert compare(_values(spark, left, ddl), _values(spark, right, ddl), group_limit=limit).relation == "Reordered"
    other = [(inf if x == -inf else x, y, z) for x, y, z in right]
    assert compare(_values(spark, left, ddl), _values(spark, other, ddl)).relation == "Diff"


def _brute(left, right, atol):
    """k-th smallest against k-th smallest per key."""
    for k in {r[0] for r in left + right}:
        a = sorted(v for kk, v in left if kk == k)
        b = sorted(v for kk, v in right if kk == k)
        if len(a) != len(b) or any(x != y and abs(x - y) >= atol for x, y in zip(a, b)):
            return "Diff"
    return "Equal" if sorted(left) == sorted(right) else "Reordered"


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("group_limit", [1_000_000, 3])
def test_tolerance_against_brute_force(spark, seed, group_limit):
    """Hot groups with many copies; with the small limit they are scanned in blocks."""
    rng = random.Random(seed)
    left = [(min(rng.randrange(9), 1), rng.choice([1.0, 1.25, 1.5, rng.random()])) for _ in range(80)]
    step = rng.choice([0.0, 0.03, 0.08])
    right = [(k, v + rng.uniform(-step, step)) for k, v in left]
    if seed % 3 == 2:
        right[0] = (right[0][0], right[0][1] + 0.4)
    rng.shuffle(right)
    got = compare(
        _values(spark, left), _values(spark, right), atol=0.05, rtol=0.0, group_limit=group_limit
    )
    assert got.relation == _brute(left, right, 0.05)


def test_no_exact_column(spark):
    left = _values(spark, [(float(i % 40),) for i in range(200)], "v double")
    right = left.select((F.col("v") + 0.0005).alias("v"))
    assert compare(left, right).relation == "Reordered"
    assert compare(left, left.select((F.col("v") + 0.002).alias("v"))).relation == "Diff"


def test_one_value_repeated_a_lot(spark):
    """Copies are counted and never expanded or gathered."""
    left = spark.range(2_000_000).select(F.lit(1).alias("k"), F.lit(0.5).alias("v"))
    right = left.withColumn("v", F.col("v") + F.lit(0.0001))
    assert compare(left, right, group_limit=1000).relation == "Reordered"
    assert compare(left, right.withColumn("v", F.col("v") + 1), group_limit=1000).relation == "Diff"


def test_close_is_strict_at_the_bound(spark):
    row = spark.range(1).select(
        close(F.lit(0.0), F.lit(0.5), atol=0.5, rtol=0.0).alias("at"),
        close(F.lit(0.0), F.lit(0.499), atol=0.5, rtol=0.0).alias("below"),
    )
    assert row.first() == (False, True)


def test_diff_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "x int, y string")
    right = spark.createDataFrame([(1, "a"), (2, "c"), (2, "c"), (3, None)], "p int, q string")
    got = {tuple(r) for r in diff_rows(left, right).collect()}
    assert got == {("left", 1, 1, "a"), ("left", 1, 2, "b"), ("right", 2, 2, "c")}
    with pytest.raises(ValueError):
        diff_rows(left, right.select("p"))


def test_diff_rows_within_tolerance(spark):
    ddl = "k int, v double, w double"
    left = [(1, 1.0, 0.0), (2, 5.0, 1.0), (3, 7.0, None), (4, 1.0, 1.0), (4, 1.0002, 1.0), (5, math.nan, 2.0)]
    right = [(1, 1.0004, 0.0), (2, 5.0, 1.5), (3, 7.0, None), (4, 1.0001, 1.0), (5, math.nan, 2.0003)]
    frames = _values(spark, left, ddl), _values(spark, right, ddl)
    got = sorted(tuple(r) for r in diff_rows(*frames, atol=1e-3).collect())
    assert got == [("left", 1, 2, 5.0, 1.0), ("left", 1, 4, 1.0, 1.0), ("right", 1, 2, 5.0, 1.5)]
    assert diff_rows(*frames).count() == 9
    small = sorted(tuple(r) for r in diff_rows(*frames, atol=1e-3, group_limit=1).collect())
    assert small == got


def test_diff_rows_sets_copies_off(spark):
    left = spark.range(1000).select(F.lit(1).alias("k"), F.lit(2.0).alias("v"))
    right = spark.range(900).select(F.lit(1).alias("k"), F.lit(2.0004).alias("v"))
    assert [tuple(r) for r in diff_rows(left, right, atol=1e-3).collect()] == [("left", 100, 1, 2.0)]
    chain = spark.createDataFrame([(1, 0.0), (1, 0.0008), (1, 0.0016)], "k int, v double")
    other = spark.createDataFrame([(1, 0.0004)], "k int, v double")
    assert diff_rows(chain, other, atol=1e-3).count() == 4


def test_diff_columns(spark):
    ddl = "a int, b string, c double, d string"
    left = [(1, "x", 1.0, "k"), (2, None, 2.0, "k"), (3, "", None, "k"), (4, "y", 4.0, "k"), (5, "z", 5.0, "k"), (5, "z", 5.0, "k"), (9, "same", 0.0, "k")]
    right = [(1, "x", 1.5, "k"), (2, "", 2.0, "k"), (3, None, 3.0, "k"), (4, "other", 4.5, "k"), (5, "z", 5.0, "m"), (5, "z", 5.0, "m"), (9, "same", 0.0, "k")]
    got = diff_columns(_values(spark, left, ddl), _values(spark, right, "p int, q string, r double, s string")).collect()
    pairs = {(r["left"]["a"], r["column"], r["left_value"], r["right_value"], r["n"]) for r in got if r["column"]}
    assert pairs == {(1, "c", "1.0", "1.5", 1), (2, "b", None, "", 1), (5, "d", "k", "m", 2)}
    alone = {(side, r[side]["a"]) for r in got if not r["column"] for side in ("left", "right") if r[side]}
    assert alone == {("left", 3), ("right", 3), ("left", 4), ("right", 4)}
    # Two rows that agree with each other in the rest: which belongs to which cannot be told.
    two = _values(spark, [(1, "x", 1.0, "k"), (2, "x", 1.0, "k")], ddl)
    moved = _values(spark, [(3, "x", 1.0, "k"), (4, "x", 1.0, "k")], ddl)
    assert {r["column"] for r in diff_columns(two, moved).collect()} == {None}
    assert diff_columns(two, two).count() == 0
