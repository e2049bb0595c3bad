from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.functions.predicates import (
    ExpressionPool,
    Leaf,
    Node,
    acceptable,
    partition_profile,
    quantiles,
    splitting_predicates,
)

SCHEMA = (
    T.StructType()
    .add("ts", T.LongType())
    .add("key", T.LongType())
    .add("a", T.ByteType())
    .add("b", T.DoubleType())
    .add("c", T.DecimalType(20, 0))
    .add("d", T.IntegerType())
    .add("e", T.FloatType())
    .add("flag", T.BooleanType())
)


def test_drawn_predicates_are_acceptable_and_seeded():
    for depth in (1, 2, 3, 6):
        first = ExpressionPool(SCHEMA, depth)
        again = ExpressionPool(SCHEMA, depth)
        for _ in range(60):
            tree = first.predicate_tree(depth)
            assert acceptable(tree)
            assert tree.sql == again.predicate_tree(depth).sql


def test_rejected_forms():
    literal, flag = Leaf("1", True), Leaf("true", True, True)
    column = Leaf("a", False)
    assert not acceptable(literal)
    assert not acceptable(Node("", (literal, literal)))
    assert not acceptable(Node("", (column, Node("", (literal, literal)))))
    assert not acceptable(Node("", (flag, Node("", (column, literal)))))
    assert acceptable(Node("", (column, literal)))


def test_predicates_of_any_depth_run(spark, mixed):
    pool = ExpressionPool(mixed.schema, 3)
    predicates = [pool.predicate(d) for d in (1, 2, 3, 4) for _ in range(2)]
    profile = partition_profile(mixed, predicates).collect()
    assert [r.predicate for r in profile] == predicates
    for r in profile:
        assert r.n_true + r.n_false + r.n_null == 600
        assert r.n_true == mixed.where(r.predicate).count()
        assert r.n_null == mixed.where(f"({r.predicate}) IS NULL").count()


def test_the_deepest_predicates_run(spark, mixed):
    predicate = ExpressionPool(mixed.schema, 4).predicate(6)
    (r,) = partition_profile(mixed, [predicate]).collect()
    assert r.n_true + r.n_false + r.n_null == 600


def test_numbers_have_the_asked_type(spark, mixed):
    pool = ExpressionPool(mixed.schema, 8)
    for dtype in list(pool.by_type):
        text = pool.number(dtype, 3)
        assert mixed.select(F.expr(text)).schema[0].dataType == dtype


def test_quantile_literals_split(spark, mixed):
    values = quantiles(mixed, 4)
    assert len(values["small"]) == 3
    drawn = splitting_predicates(mixed, 5, 6)
    assert len(drawn) == 6
    profile = partition_profile(mixed, drawn).collect()
    assert sum(r.n_true > 0 and r.n_false > 0 for r in profile) == 6
