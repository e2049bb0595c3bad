"""Streaming and batch give the same rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from equivcheck.plans import suite
from equivcheck.plans.compare import compare
from equivcheck.plans.relations import RELATIONS, Params, origin, other
from equivcheck.sources import files
from equivcheck.streaming.bounded import Handle, Stopped, late_rows, stream_origin, stream_other

P = "(real > 0.5)"
PARAMS = Params("value", 2, 4800, 1600, expr="try_add(ts, key)")


@pytest.fixture(scope="module")
def source(spark, mixed, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stream')}/in"
    rows = mixed.select("ts", "key", "value", "real")
    rows.coalesce(1).write.parquet(path)
    return lambda: spark.readStream.schema(rows.schema).parquet(path)


def _batch(mixed):
    return mixed.select("ts", "key", "value", "real")


@pytest.mark.parametrize(
    "name,mode",
    [
        ("Filter", "union"),
        ("Map", "union"),
        ("AggCount", "union"),
        ("AggAvg", "tagged"),
        ("KeyAggMin", "tagged"),
        ("KeyAggSum", "union"),
        ("WinPartMax", "union"),
        ("WinPartAvg", "union"),
    ],
)
def test_other(spark, mixed, source, name, mode):
    rel = RELATIONS[name]
    predicate = P if rel.uses_predicate else None
    streamed = stream_other(source(), rel, PARAMS, predicate, mode)
    assert compare(origin(rel, _batch(mixed), PARAMS), streamed).relation == "Equal"


@pytest.mark.parametrize("name", ["Filter", "KeyAggAvg", "AggSum"])
def test_origin(spark, mixed, source, name):
    rel = RELATIONS[name]
    streamed = stream_origin(source(), rel, PARAMS, rocksdb=name == "AggSum")
    assert compare(streamed, other(rel, _batch(mixed), PARAMS, P)).relation == "Equal"


def test_producers_with_clocks_of_their_own(spark, mixed, tmp_path):
    """Files out of order of time, one per trigger: the delay has to cover the lag."""
    rows = mixed.select("ts", "key", "value")
    for i, part in enumerate(["key = 2", "key != 2"]):
        rows.where(part).coalesce(1).write.mode("append").option("header", True).csv(f"{tmp_path}/p/{i}")
    stream = spark.readStream.schema(rows.schema).option("header", True).option("maxFilesPerTrigger", 1)
    rel = RELATIONS["KeyAggCount"]
    expected = origin(rel, rows, PARAMS)
    got = stream_origin(stream.csv(f"{tmp_path}/p/*"), rel, PARAMS, delay="1 minute")
    assert compare(expected, got).relation == "Equal"
    whole = files.stream_producers(spark, rows.schema, f"{tmp_path}/p/*")
    assert compare(expected, stream_origin(whole, rel, PARAMS)).relation == "Equal"


def test_windows_leave_the_state_while_producers_send(spark, tmp_path):
    """Two producers whose clocks are far apart, ten files each in order of time."""
    schema, paths = "ts bigint, key bigint", [f"{tmp_path}/p/{i}" for i in range(2)]
    for step in range(10):
        for i, path in enumerate(paths):
            made = spark.range(200).selectExpr(f"{i * 40_000} + {step} * 20000 + id * 100 AS ts", "id % 3 AS key")
            made.coalesce(1).write.mode("append").option("header", True).csv(path)
    rel, params = RELATIONS["KeyAggCount"], Params(None, None, 1000, None)
    expected = origin(rel, spark.read.schema(schema).option("header", True).csv(paths), params)
    handle = Handle()
    streams = files.stream_each_producer(spark, StructType.fromDDL(schema), paths, 1)
    got = stream_origin(streams, rel, params, delay="1 second", rocksdb=False, partitions=2, handle=handle)
    assert compare(expected, got).relation == "Equal"
    assert max(handle.state_rows.values()) < got.count() / 2
    # one watermark over both takes the slower producer's rows as late
    one = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 1)
    with pytest.raises(ValueError, match="came later"):
        stream_origin(one.csv(f"{tmp_path}/p/*"), rel, params, delay="1 second", rocksdb=False, partitions=2)
    # a producer that is empty holds windows back, and loses none
    spark.createDataFrame([], schema).coalesce(1).write.option("header", True).csv(f"{tmp_path}/none")
    more = files.stream_each_producer(spark, streams[0].schema, [paths[0], f"{tmp_path}/none"], 5)
    alone = origin(rel, spark.read.schema(schema).option("header", True).csv(paths[0]), params)
    quiet = stream_origin(more, rel, params, delay="1 second", rocksdb=False, partitions=2)
    assert compare(alone, quiet).relation == "Equal"


def test_provider_setting_is_restored(spark):
    assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_last_window_is_out(spark, mixed, source):
    rel = RELATIONS["AggCount"]
    streamed = stream_origin(source(), rel, PARAMS)
    total = streamed.agg(F.sum("count")).first()[0]
    assert total == mixed.count()


def test_late_rows_count_over_all_triggers(spark, tmp_path):
    """More triggers than Spark keeps reports of; the late row comes in the third."""
    path = f"{tmp_path}/in"
    times = [100_000, 200_000, 5, *range(300_000, 300_000 + 27 * 1000, 1000)]
    for ts in times:
        spark.createDataFrame([(ts, 1)], "ts bigint, key bigint").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts bigint, key bigint").option("maxFilesPerTrigger", 1)
    rel, params = RELATIONS["AggCount"], Params(None, None, 1000, None)
    with pytest.raises(ValueError, match="1 rows came later"):
        stream_origin(stream.parquet(path), rel, params, delay="1 second", rocksdb=False, partitions=1)
    whole = stream_origin(stream.parquet(path), rel, params, rocksdb=False, partitions=1)
    assert whole.agg(F.sum("count")).first()[0] == len(times)


class _Reports:
    """A query that ends after some looks, with the reports that are kept at each of them."""

    def __init__(self, looks):
        self.looks, self.at = looks, -1

    def awaitTermination(self, timeout):
        self.at += 1
        return self.at == len(self.looks) - 1

    @property
    def recentProgress(self):
        return [{"batchId": i, "stateOperators": [{"numRowsDroppedByWatermark": n}]} for i, n in self.looks[self.at]]


def test_reports_that_are_kept_no_more():
    looks = [[(0, 0), (1, 0), (2, 4)], [(2, 4), (3, 0), (4, 1)], [(4, 1), (5, 0), (6, 0)]]
    assert late_rows(_Reports(looks), kept=3) == 5
    with pytest.raises(ValueError, match="missing"):
        late_rows(_Reports([looks[0], looks[2]]), kept=3)


def test_a_run_is_stopped(spark, source):
    handle = Handle()
    handle.stop()
    with pytest.raises(Stopped):
        stream_origin(source(), RELATIONS["AggCount"], PARAMS, handle=handle)


def test_suite_over_a_stream(spark, mixed, source, tmp_path):
    config = suite.SuiteConfig(relations=("Filter", "KeyAggCount"), reps=1, others=1, seed=2, time_scale=10)
    rows = suite.SuiteSource("s", _batch(mixed), {"value": 2}, stream=source())
    got = suite.run_suite(spark, [rows], config, str(tmp_path)).collect()
    assert [(r.strategy, r.relation) for r in got] == [("Filter", "Equal"), ("KeyAggCount", "Equal")]
    assert got[0].left_rows == mixed.count()
    late = suite.replace(config, timeout_s=0.01)
    suite.run_suite(spark, [rows], late, str(tmp_path), run_id=1)
    execs = suite.read_table(spark, suite.run_dir(str(tmp_path), 1), "test_set_execs").collect()
    assert {r.status for r in execs} <= {"TimedOut", "Skipped"}
