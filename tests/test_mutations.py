"""Broken rewrites must be found."""

import pytest
from pyspark.sql import functions as F

from equivcheck.operators.aggregates import Measure
from equivcheck.operators.split import branches, union_all
from equivcheck.operators.windows import rewindow, tumbling, with_bounds
from equivcheck.plans.compare import compare
from equivcheck.plans.relations import RELATIONS, Params, origin

P = "(real > 0.5)"  # NULL for every thirteenth row


def _rewritten(df, agg, keys=(), parts=None, window=5000, inner=None, merge=None):
    m = Measure(agg, "value", df.schema["value"].dataType, 2)
    frames = [tumbling(b, inner or window, m.partial(), keys) for b in (parts or branches(df, P))]
    merged = rewindow(union_all(frames), window, merge or m.merge(), keys)
    return with_bounds(merged, keys, m.final())


def _origin(df, name):
    return origin(RELATIONS[name], df, Params("value", 2, 5000))


def test_the_unbroken_form_is_equal(mixed):
    for name, agg, keys in (("AggSum", "sum", ()), ("KeyAggAvg", "avg", ("key",))):
        assert compare(_origin(mixed, name), _rewritten(mixed, agg, keys)).relation == "Equal"


@pytest.mark.parametrize(
    "name,agg,keys",
    [("AggCount", "count", ()), ("AggSum", "sum", ()), ("KeyAggMin", "min", ("key",)),
     ("KeyAggAvg", "avg", ("key",))],
)
def test_lost_null_branch(mixed, name, agg, keys):
    two = branches(mixed, P)[:2]
    broken = _rewritten(mixed, agg, keys, parts=two, window=5000)
    assert compare(_origin(mixed, name), broken).relation == "Diff"


def test_lost_null_branch_of_a_filter(mixed):
    assert compare(mixed, union_all(branches(mixed, P)[:2])).relation == "Diff"


def test_sum_merged_by_max(mixed):
    parts = Measure("sum", "value", mixed.schema["value"].dataType, 2).partial()
    merge = {name: F.max(name) for name in parts}
    assert compare(_origin(mixed, "AggSum"), _rewritten(mixed, "sum", merge=merge)).relation == "Diff"


def test_inner_window_that_does_not_divide(mixed):
    broken = _rewritten(mixed, "count", parts=[mixed], inner=3000)
    assert compare(_origin(mixed, "AggCount"), broken).relation == "Diff"


def test_distinct_instead_of_bag_union(mixed):
    narrow = mixed.select("key", "small", "real")
    broken = union_all(branches(narrow.select("key", "small", "real"), P)).drop("real").distinct()
    assert compare(narrow.drop("real"), broken).relation == "Diff"


def test_overlapping_branches(mixed):
    parts = branches(mixed, P)
    assert compare(mixed, union_all([*parts, parts[2]])).relation == "Diff"


def test_average_of_averages(mixed):
    a = tumbling(mixed, 1000, {"value": F.avg("value")})
    broken = rewindow(a, 5000, {"value": F.avg("value")})
    assert compare(_origin(mixed, "AggAvg"), broken).relation == "Diff"
