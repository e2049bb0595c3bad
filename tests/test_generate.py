import pytest
from pyspark.sql import functions as F

from equivcheck import types
from equivcheck.plans.compare import compare
from equivcheck.sources import catalog, files, generate


def _listed(spark, counts):
    return spark.createDataFrame(list(enumerate(counts)), "producer bigint, records bigint")


def _times(rows):
    out = {}
    for r in rows.orderBy("producer", "row").collect():
        out.setdefault(r.producer, []).append((r.row, r.ts))
    return out


def test_rows_are_numbered_and_times_rise(spark):
    counts = [1, 2, 7, 500, 0, 1]
    times = _times(generate.bursty_rows(_listed(spark, counts), 3))
    for producer, count in enumerate(counts):
        rows = times.get(producer, [])
        assert [r for r, _ in rows] == list(range(count))
        assert all(t >= generate.START_MS for _, t in rows)
        assert all(a <= b for (_, a), (_, b) in zip(rows, rows[1:]))


def test_bursts_and_quiet_gaps(spark):
    ((_, rows),) = _times(generate.bursty_rows(_listed(spark, [4000]), 5)).items()
    stamps = [generate.START_MS] + [t for _, t in rows]
    gaps = [b - a for a, b in zip(stamps, stamps[1:])]
    assert all(0 <= g < 3000 for g in gaps)
    # at most five short gaps in a row, and a gap of 500 ms or more is the end of a cycle
    run, runs = 0, []
    for g in gaps:
        if g < 500:
            run += 1
        else:
            runs.append(run)
            run = 0
    assert set(runs) == {1, 2, 3, 4, 5}


def test_blocks_do_not_change_the_times(spark, monkeypatch):
    listed = _listed(spark, [300, 41, 1])
    whole = _times(generate.bursty_rows(listed, 9))
    monkeypatch.setattr(generate, "CYCLES_PER_BLOCK", 8)
    assert _times(generate.bursty_rows(listed, 9)) == whole


def test_partitioning_does_not_change_the_data(spark):
    source = generate.random_source("s", 4)
    first = generate.generate_source(spark, source, 4, producers=3, records=60).frame
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = generate.generate_source(spark, source, 4, producers=3, records=60).frame
        assert compare(first, again).relation == "Equal"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    other = generate.generate_source(spark, source, 5, producers=3, records=60).frame
    assert compare(first, other).relation == "Diff"


def test_declared_types_and_ranges(spark):
    fields = [(f"f{i}", t) for i, t in enumerate([*generate.FIELD_TYPES, "BOOL"])]
    source = catalog.LogicalSource("all", (("ts", "INT64"), ("key", "INT64"), *fields))
    frame = generate.generate_source(spark, source, 1, producers=2, records=3000).frame
    assert {f.name: f.dataType for f in frame.schema if f.name in dict(fields)} == {
        n: types.declared(t) for n, t in fields
    }
    assert {r.outside for r in catalog.out_of_range(frame, source).collect()} == {0}
    stats = frame.agg(
        F.min("key"), F.max("key"), F.count_distinct("key"),
        *[F.min(n) for n, t in fields if t.startswith("FLOAT")],
        *[F.max(n) for n, t in fields if t.startswith("FLOAT")],
    ).first()
    assert tuple(stats)[:3] == (0, 20, 21)
    assert all(0 <= v < 1 for v in tuple(stats)[3:])
    # small types are used over their whole range
    small = frame.agg(F.min("f0"), F.max("f0"), F.min("f1"), F.max("f1")).first()
    assert tuple(small) == (0, 255, -128, 127)
    wide = frame.agg(F.min("f6"), F.max("f6")).first()
    assert wide[0] < 2**60 and wide[1] > 2**63


def test_default_sizing(spark):
    made = generate.generate_sources(spark, 0)
    assert [m.source.name for m in made] == [f"source-{i}" for i in range(5)]
    assert len(made[0].source.fields) == 12
    assert made[1].frame.count() == 2500
    assert len({m.source.fields for m in made}) > 1


def test_written_producers_are_one_source_again(spark, tmp_path):
    made = generate.generate_source(spark, generate.random_source("w", 2), 2, 3, 40)
    paths = generate.write_producers(made, f"{tmp_path}/w")
    assert len(paths) == 3
    back = files.read_producers(spark, made.source.schema, paths)
    assert compare(made.frame.select(*back.columns), back).relation == "Equal"


def test_typed_header(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2**40, 0.5, None)], "a tinyint, b bigint, c float, d double")
    files.write_typed_csv(rows, f"{tmp_path}/t", "test")
    header = spark.read.option("header", True).csv(f"{tmp_path}/t").columns
    assert header[:3] == ["test$a:INTEGER(8 bits)", "test$b:INTEGER(64 bits)", "test$c:FLOAT(32 bits)"]
    back = files.read_typed_csv(spark, f"{tmp_path}/t")
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert back.collect() == rows.collect()


@pytest.mark.parametrize("header", ["ts", "test$ts", "test$ts:TEXT"])
def test_bad_headers(header):
    with pytest.raises(ValueError):
        files.header_fields([header])


def test_values_beyond_the_declared_type_fail(spark, tmp_path):
    spark.createDataFrame([("18446744073709551615",)], "`s$v:INTEGER(64 bits)` string").write.option(
        "header", True
    ).csv(f"{tmp_path}/u")
    with pytest.raises(Exception):
        files.read_typed_csv(spark, f"{tmp_path}/u").collect()
    (row,) = files.read_typed_csv(spark, f"{tmp_path}/u", unsigned=["v"]).collect()
    assert row.v == 2**64 - 1


def test_sinks(spark, mixed, tmp_path):
    for fmt in ("parquet", "csv", "json"):
        back = files.write_result(mixed.select("ts", "key", "value"), f"{tmp_path}/{fmt}", fmt)
        assert compare(mixed.select("ts", "key", "value"), back).relation == "Equal"
