"""Origin and other of every relation are equal bags, for many seeds and every field type."""

import os
import random

import pytest
from pyspark.sql import functions as F

from equivcheck.functions.predicates import ExpressionPool, quantiles
from equivcheck.operators.split import union_all
from equivcheck.plans.compare import compare
from equivcheck.plans.relations import RELATIONS, Params, origin, other

# One seed per field type; EQUIVCHECK_SEEDS=20 for a thorough run.
SEEDS = int(os.environ.get("EQUIVCHECK_SEEDS", "8"))
FIELDS = ["value", "wide", "small", "medium", "normal", "unsigned", "single", "real"]
EXACT = (*FIELDS, None)


def _params(seed, field):
    rng = random.Random(seed)
    outer = rng.randint(20, 200) * 120
    return Params(
        field=field,
        scale=2 if field == "value" else None,
        window_ms=outer,
        inner_ms=outer // rng.choice([1, 2, 3, 4, 5]),
        expr=f"try_add(ts, {seed}L)",
    )


def test_names_and_codes():
    assert len(RELATIONS) == 17
    assert (RELATIONS["KeyAggSum"].code, RELATIONS["KeyAggSum"].family) == ("R10", "keyagg")
    assert (RELATIONS["WinPartAvg"].code, RELATIONS["WinPartAvg"].agg) == ("R17", "avg")


@pytest.fixture
def interpreted(spark):
    """Hundreds of small plans: running them takes less time than compiling them."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", RELATIONS)
def test_many_seeds(spark, mixed, interpreted, name):
    """All seeds go into two comparisons, exact and tolerant, told apart by a column."""
    rel = RELATIONS[name]
    pool = ExpressionPool(mixed.schema, list(RELATIONS).index(name), quantiles(mixed))
    pairs = {"string": [], "double": []}
    for seed in range(SEEDS):
        field = FIELDS[seed % len(FIELDS)] if rel.agg else None
        p = _params(seed, field)
        predicate = pool.predicate(1 + seed % 3)
        mode = "tagged" if seed % 2 else "union"
        left, right = origin(rel, mixed, p), other(rel, mixed, p, predicate, mode)
        assert [f.dataType for f in left.schema] == [f.dataType for f in right.schema]
        exact = field in EXACT or rel.agg == "count"
        shown = "string" if exact else "double"
        last = left.columns[-1]
        pairs[shown].append(
            [
                df.withColumnRenamed(last, "result")
                .withColumn("result", F.col("result").cast(shown))
                .withColumn("seed", F.lit(seed))
                for df in (left, right)
            ]
        )
    for shown, sides in pairs.items():
        if sides:
            verdict = compare(union_all([s[0] for s in sides]), union_all([s[1] for s in sides]))
            assert verdict.relation in ("Equal", "Reordered"), verdict
            assert verdict.left_rows > 0
            assert shown == "double" or verdict.relation == "Equal", verdict


def test_window_that_does_not_divide_is_refused(mixed):
    with pytest.raises(ValueError, match="does not divide"):
        other(RELATIONS["WinPartSum"], mixed, Params("value", 2, 1000, 300))


def test_several_keys(mixed):
    rel, p = RELATIONS["KeyAggAvg"], Params("value", 2, 5000, keys=("key", "small"))
    assert compare(origin(rel, mixed, p), other(rel, mixed, p, "(small > 3)")).relation == "Equal"


def test_sums_by_hand(mixed):
    rel = RELATIONS["AggSum"]
    got = {r.start: r.wide for r in origin(rel, mixed, Params("wide", window_ms=5000)).collect()}
    expected = {}
    for r in mixed.select("ts", "wide").collect():
        start = r.ts // 5000 * 5000
        if r.wide is not None:
            expected[start] = expected.get(start, 0) + r.wide
    assert {k: int(v) for k, v in got.items()} == expected


def test_filters_and_columns_reach_the_scan(spark, sf):
    from equivcheck.sources.tables import LINEITEM

    p = Params("l_quantity", 2, 86_400_000)
    df = other(RELATIONS["AggSum"], LINEITEM.read(spark, sf), p, "(l_quantity > 25D)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan and "LessThanOrEqual(l_quantity,25.0)" in plan
    assert "l_extendedprice" not in plan and "l_suppkey" not in plan
    one_scan = other(RELATIONS["AggSum"], LINEITEM.read(spark, sf), p, "(l_quantity > 25D)", "tagged")
    assert one_scan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
