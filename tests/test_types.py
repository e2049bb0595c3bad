import pytest
from pyspark.sql import types as T

from equivcheck import types
from equivcheck.sources import catalog


def test_declared_types_and_unknown_names():
    assert types.declared("UINT8") == T.ShortType()
    assert types.declared("UINT64") == T.DecimalType(20, 0)
    for name in ("Undefined", "INT128", "int8"):
        with pytest.raises(ValueError, match="unknown declared type"):
            types.declared(name)


def test_header_types_both_ways():
    for name, dtype in types.IN_HEADER.items():
        assert types.from_header(types.to_header(dtype)) == dtype
        assert types.from_header(name.upper()) == dtype
    with pytest.raises(ValueError, match="unknown result type"):
        types.from_header("TEXT")


def test_classes():
    assert types.value_class(T.ByteType()) == types.value_class(T.DecimalType(20, 0)) == "Int"
    assert types.value_class(T.FloatType()) == types.value_class(T.DoubleType()) == "Float"
    assert types.value_class(T.DecimalType(8, 2)) == "Decimal"


def test_catalogue_round_trip(spark, tmp_path):
    sources = [
        catalog.LogicalSource("a", (("ts", "INT64"), ("f0", "UINT32"))),
        catalog.LogicalSource("b", (("ts", "INT64"), ("flag", "BOOL"), ("f0", "FLOAT32"))),
    ]
    path = f"{tmp_path}/catalogue"
    catalog.write_catalogue(spark, sources, path)
    assert list(catalog.read_catalogue(spark, path).values()) == sources
    bad = {"logicalSources": [{"logicalSourceName": "x", "fields": [{"name": "a", "type": "?"}]}]}
    with pytest.raises(ValueError):
        catalog.parse_catalogue(bad)


def test_out_of_range(spark):
    source = catalog.LogicalSource("s", (("a", "UINT8"), ("b", "INT8"), ("c", "UINT64"), ("d", "FLOAT64")))
    rows = spark.createDataFrame(
        [(0, -128, 0, 1.0), (255, 127, 5, 1.0), (256, 128, -1, 1.0), (-1, 0, None, 1.0)],
        "a int, b int, c bigint, d double",
    )
    found = {r.field: r.outside for r in catalog.out_of_range(rows, source).collect()}
    assert found == {"a": 2, "b": 1, "c": 1}
