"""Exact sums and safe arithmetic against Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.functions import arith
from equivcheck.functions.exact import carried, combine, exact_sum, limbs, unscaled
from equivcheck.operators.aggregates import BIN, Measure

LOW, HIGH = -(2**63), 2**63 - 1


@pytest.mark.parametrize(
    "values",
    [
        [0],
        [HIGH] * 5,
        [LOW] * 5,
        [LOW, HIGH, LOW, 7],
        [HIGH, -1, 1, -HIGH],
        [2**42, -(2**42) - 1, 2**21, -1, None],
        [None, None],
        [-1] * 9,
    ],
)
def test_exact_sum(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    present = [v for v in values if v is not None]
    got = rows.agg(exact_sum(F.col("v"))).first()[0]
    assert got == (sum(present) if present else None)


def test_exact_sum_does_not_depend_on_the_split(spark, mixed):
    total = mixed.agg(exact_sum(F.col("wide"))).first()[0]
    assert total == sum(r.wide for r in mixed.select("wide").collect() if r.wide is not None)
    assert total == mixed.repartition(13).agg(exact_sum(F.col("wide"))).first()[0]


def test_unscaled_cents(spark):
    values = [0.01, 490.02, 1.1, 2.675, -3.35, 104949.99]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(unscaled(F.col("v"), 2)).collect()]
    assert got == [round(v * 100) for v in values]


TINY, HUGE = 5e-324, 1.7976931348623157e308


@pytest.mark.parametrize(
    "values",
    [
        [0.1] * 10,
        [1e16, 1.0, -1e16],
        [1e300, 1.0, -1e300, 2.0**-40],
        [TINY, TINY, -2.2250738585072014e-308],
        [2.0**k for k in range(-1074, 1024, 7)],
        [-(2.0**k) for k in (7, 8, 9, 15, 16)] + [math.nextafter(2.0**k, 0) for k in (8, 16, 512, 1016)],
        [HUGE, -HUGE, 3.5],
        [HUGE / 4, HUGE / 4, HUGE / 4],
        [0.0, -0.0],
        [None, 2.5],
        [None, None],
    ],
)
def test_sums_of_doubles_are_exact_in_any_split(spark, values):
    m = Measure("sum", "v", T.DoubleType())
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    present = [v for v in values if v is not None]
    wanted = math.fsum(present) if present else None
    for parts in (1, 2, 3):
        binned = m.with_bin(rows)
        part = binned.groupBy((F.col("i") % parts).alias("p"), BIN)
        merged = part.agg(*[c.alias(n) for n, c in m.partial().items()]).groupBy(BIN)
        whole = merged.agg(*[c.alias(n) for n, c in m.merge().items()])
        total = whole.agg(*[c.alias(n) for n, c in m.collapse().items()])
        assert total.select(m.final()["v"]).first()[0] == wanted


@pytest.mark.parametrize(
    "values, wanted",
    [
        ([float("inf"), 1.0], float("inf")),
        ([float("inf"), float("-inf"), 1.0], None),
        ([float("nan"), None], None),
        ([HUGE, HUGE], float("inf")),
    ],
)
def test_sums_beyond_all_doubles(spark, values, wanted):
    m = Measure("sum", "v", T.DoubleType())
    rows = m.with_bin(spark.createDataFrame([(v,) for v in values], "v double"))
    parts = rows.groupBy(BIN).agg(*[c.alias(n) for n, c in m.partial().items()])
    got = parts.agg(*[c.alias(n) for n, c in m.collapse().items()]).select(m.final()["v"]).first()[0]
    assert got == wanted if wanted is not None else math.isnan(got)


def test_random_doubles_agree_with_fsum(spark):
    draw = random.Random(3)
    groups = {g: [draw.uniform(-1, 1) * 2.0 ** draw.randint(-60, 60) for _ in range(300)] for g in range(40)}
    m = Measure("sum", "v", T.DoubleType())
    rows = m.with_bin(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double"))
    parts = rows.groupBy("g", BIN).agg(*[c.alias(n) for n, c in m.partial().items()])
    whole = parts.groupBy("g").agg(*[c.alias(n) for n, c in m.collapse().items()])
    for g, total in whole.select("g", m.final()["v"]).collect():
        assert total == math.fsum(groups[g])


def _python(op, a, b, low, high):
    if a is None or b is None:
        return None
    if op == "/":
        if b == 0:
            return None
        out = math.trunc(a / b)
    elif op == "%":
        if b == 0:
            return None
        out = int(math.fmod(a, b)) if abs(a) < 2**50 and abs(b) < 2**50 else a - b * _quotient(a, b)
    else:
        out = {"+": a + b, "-": a - b, "*": a * b}[op]
    return out if low <= out <= high else None


def _quotient(a, b):
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("bits,dtype", [(8, T.ByteType()), (32, T.IntegerType()), (64, T.LongType())])
def test_arithmetic_at_the_limits(spark, bits, dtype, ansi):
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    root = int(math.isqrt(high))
    points = [low, low + 1, -root - 1, -root, -1, 0, 1, 2, root, root + 1, high - 1, high, None]
    pairs = [(a, b) for a in points for b in points]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        name = dtype.simpleString()
        rows = spark.createDataFrame(pairs, f"a {name}, b {name}")
        ops = ["+", "-", "*", "%"] + (["/"] if bits < 64 else [])
        got = rows.select(
            "a", "b", *[F.expr(arith.arithmetic(op, "a", "b", dtype)).alias(op) for op in ops]
        ).collect()
        for row in got:
            for op in ops:
                assert row[op] == _python(op, row.a, row.b, low, high), (op, row.a, row.b)
        typed = rows.select(*[F.expr(arith.arithmetic(op, "a", "b", dtype)) for op in [*ops, "/", "**"]])
        assert {f.dataType for f in typed.schema} == {dtype}
        typed.collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_nested_operands_take_the_wide_form(spark):
    long = T.LongType()
    padded = f"CAST('{'0' * arith._SHORT}' AS BIGINT)"
    points = [LOW, LOW + 1, -1, 0, 1, 3, 2**32, HIGH - 1, HIGH, None]
    rows = spark.createDataFrame([(a, b) for a in points for b in points], "a bigint, b bigint")
    deep = {op: arith.arithmetic(op, f"(a + {padded})", "b", long) for op in "+-*"}
    assert all("DECIMAL" in text for text in deep.values())
    for row in rows.select("a", "b", *[F.expr(t).alias(op) for op, t in deep.items()]).collect():
        for op in deep:
            assert row[op] == _python(op, row.a, row.b, LOW, HIGH), (op, row.a, row.b)


def test_power_and_absolute(spark):
    long, byte = T.LongType(), T.ByteType()
    one = spark.range(1)

    def value(text):
        return one.select(F.expr(text)).first()[0]

    assert value(arith.arithmetic("**", arith.literal(3, long), arith.literal(4, long), long)) == 81
    assert value(arith.arithmetic("**", arith.literal(10, long), arith.literal(40, long), long)) is None
    assert value(arith.arithmetic("**", arith.literal(-2, byte), arith.literal(7, byte), byte)) == -128
    assert value(arith.arithmetic("**", arith.literal(2, byte), arith.literal(7, byte), byte)) is None
    assert value(arith.absolute(arith.literal(-(2**63), long), long)) is None
    assert value(arith.absolute(arith.literal(-127, byte), byte)) == 127
    assert value(arith.absolute(arith.literal(-1.5, T.DoubleType()), T.DoubleType())) == 1.5


def test_literals_keep_the_extremes(spark):
    cases = [
        (-(2**63), T.LongType()),
        (2**64 - 1, T.DecimalType(20, 0)),
        (-128, T.ByteType()),
        (True, T.BooleanType()),
        (0.1, T.DoubleType()),
    ]
    row = spark.range(1).select(*[F.expr(arith.literal(v, t)) for v, t in cases])
    assert list(row.first()) == [v for v, _ in cases]
    assert [f.dataType for f in row.schema] == [t for _, t in cases]


def test_average_of_wide_integers_is_exact(spark):
    """2^62 + 1 - 2^62 over three rows: doubles would lose the one."""
    from pyspark.sql import functions as F

    from equivcheck.plans.compare import compare
    from equivcheck.plans.relations import RELATIONS, Params, origin, other

    rows = [(i, 1, v) for i, v in enumerate([2**62, 1, -(2**62)])]
    df = spark.createDataFrame(rows, "ts bigint, key bigint, value bigint")
    for frame in (df, df.withColumn("value", F.col("value").cast("decimal(20,0)"))):
        p = Params(field="value", window_ms=1000, inner_ms=500)
        for name in ("AggAvg", "KeyAggAvg", "WinPartAvg"):
            rel = RELATIONS[name]
            left = origin(rel, frame, p)
            right = other(rel, frame, p, "ts = 1 OR key = 5")
            assert left.first()["value"] == 1 / 3
            assert compare(left, right).relation == "Equal"


def test_predicates_without_brackets(spark):
    from equivcheck.operators.split import branches, tagged, union_all

    df = spark.createDataFrame([(1, 2.0), (2, 7.0), (3, None)], "key int, value double")
    for predicate in ("value > 6 OR key = 1", "value > 6 AND key = 1", "NOT value > 6 OR key = 2"):
        assert sorted(map(str, union_all(branches(df, predicate)).collect())) == sorted(map(str, df.collect()))
        got = {r["key"]: r["branch"] for r in tagged(df, predicate).collect()}
        for n, part in enumerate(branches(df, predicate)):
            assert all(got[r["key"]] == n for r in part.collect())


def _limb_sums(value, rows):
    """What the partial step makes of so many rows of one value."""
    low, mid, top = value & (2**21 - 1), value >> 21 & (2**21 - 1), value >> 42
    return [low * rows, mid * rows, top * rows]


def _carried(sums):
    mask = 2**21 - 1
    mid = sums[1] + (sums[0] >> 21)
    top = sums[2] + (mid >> 21)
    return [sums[0] & mask, mid & mask, top & mask, top >> 21]


@pytest.mark.parametrize("value", [HIGH, LOW, 1, -1, 12_345_678_901_234_567])
def test_parts_of_more_rows_than_a_limb_sum_holds(spark, value):
    """Parts of 2^41 rows each, as many as make 2^43 rows and more: merged twice, then put together."""
    rows, parts = 2**41, 9
    columns = [f"sum{i}" for i in range(4)]
    made = _carried(_limb_sums(value, rows))
    frame = spark.createDataFrame([(*made, rows)] * parts, ", ".join(f"{c} bigint" for c in [*columns, "count"]))
    for agg in ("sum", "avg"):
        m = Measure(agg, "v", T.LongType())
        merged = frame.withColumn("k", F.monotonically_increasing_id() % 2).groupBy("k").agg(*[c.alias(n) for n, c in m.merge().items()])
        out = merged.agg(*[c.alias(n) for n, c in m.merge().items()]).select(*[c.alias(n) for n, c in m.final().items()])
        want = value * rows * parts if agg == "sum" else float(value)
        assert out.first()["v"] == want
    # The sums of parts cannot be held without carrying.
    assert abs(_limb_sums(HIGH, rows)[2] * parts) > HIGH


def test_carried_sums_stand_for_the_same_number(spark):
    rows = spark.createDataFrame([(v,) for v in (HIGH, LOW, LOW, -7, 2**42, None)], "v bigint")
    sums = [F.sum(limb) for limb in limbs(F.col("v"))]
    got = rows.agg(combine(sums).alias("a"), combine(carried(sums)).alias("b"), *[c.alias(f"s{i}") for i, c in enumerate(carried(sums))]).first()
    assert got.a == got.b == HIGH + 2 * LOW - 7 + 2**42
    assert all(0 <= got[f"s{i}"] < 2**21 for i in range(3))
