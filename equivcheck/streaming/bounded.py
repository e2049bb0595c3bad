"""Running a relation over a bounded stream until every window is out.

Append mode withholds a window until the watermark passes its end, so a stream
that simply stops keeps its last windows.  A run therefore has two steps over one
checkpoint: all available input, then a single end-of-stream row in the far
future, which arrives after every real row and so makes none of them late.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from equivcheck.operators.split import union_all
from equivcheck.operators.windows import stream_time
from equivcheck.plans.relations import Params, Relation, origin, other
from equivcheck.session import new_dir

# 9999-12-31 23:59:59.999 UTC.  The window it falls into never closes.
END_OF_STREAM_MS = 253_402_300_799_999

# Longer than any bounded input spans: no row is late, however many triggers take the input and
# in whatever order.  The end-of-stream row is far enough away to close all windows all the same.
WHOLE_SPAN = "365000 days"

# Streams that start at the same time must not undo each other's settings.
_starting = threading.Lock()

_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEPT, KEPT_REPORTS = "spark.sql.streaming.numRecentProgressUpdates", 1000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, delay: str = WHOLE_SPAN) -> DataFrame:
    """Add the watermarked event time to a streaming source with ``ts`` in epoch ms.

    A shorter ``delay`` frees state earlier; it must cover how far rows may lag behind those
    of earlier triggers: producers with clocks of their own, files not in order of time.
    """
    stamped = df.withColumn("event_time", stream_time(F.col("ts")))
    return stamped.withWatermark("event_time", delay)


def run_bounded(
    source: DataFrame | Sequence[DataFrame],
    build: Callable[[DataFrame], DataFrame],
    delay: str = WHOLE_SPAN,
    windows: bool = True,
    rocksdb: bool = True,
    partitions: int | None = None,
    out: str | None = None,
    handle: Handle | None = None,
) -> DataFrame:
    """Run ``build(source)`` to its end and return what it wrote, to ``out`` if given.

    Several sources are producers with clocks of their own: each has a watermark, and windows are closed
    by the slowest of them.  A producer that keeps its own order of time needs no ``delay`` beyond its
    own lag, so windows leave the state while input arrives; ``handle.state_rows`` tells how many were
    held.  Producers that have not sent a row yet hold all windows back.

    Through ``handle`` another thread can stop the run, which then ends with ``Stopped``.

    Set ``windows=False`` for queries without aggregation: they emit every row
    at once and must not see the end-of-stream row.  State is kept in RocksDB,
    off the heap, unless told otherwise, in ``partitions`` parts per aggregation
    (the session's shuffle partitions where not given).  Rows that come later than ``delay``
    allows are an error, never dropped in silence.
    """
    producers = [source] if isinstance(source, DataFrame) else list(source)
    spark, schema = producers[0].sparkSession, producers[0].schema
    base = new_dir(spark, "stream")
    settings = {_POLICY: "min"}
    if rocksdb:
        settings[_PROVIDER] = _ROCKSDB
    if partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    end = (base, out or f"{base}/out", settings, handle or Handle())
    if not windows:
        return _run(spark, build(union_all([with_event_time(df, delay) for df in producers])), *end)

    ending = f"{base}/end"
    spark.createDataFrame([], schema).coalesce(1).write.parquet(ending)

    def ended(df: DataFrame) -> DataFrame:
        # every producer gets the last row, as every watermark has to move
        ends = spark.readStream.schema(schema).parquet(ending)
        return with_event_time(df.unionByName(ends), delay)

    query = build(union_all([ended(df) for df in producers]))
    _run(spark, query, *end)
    last = [
        F.lit(END_OF_STREAM_MS if f.name == "ts" else None).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(ending)
    return _run(spark, query, *end)


class Stopped(Exception):
    """A run that was stopped before its end."""


class Handle:
    """Stops a run from another thread, whichever of its steps it has come to.

    ``state_rows`` maps each trigger that was reported to the rows of state behind it.
    """

    def __init__(self):
        self._lock, self._query, self.stopped = threading.Lock(), None, False
        self.state_rows: dict[int, int] = {}

    def take(self, query: StreamingQuery) -> None:
        with self._lock:
            self._query = query
            if self.stopped:
                query.stop()

    def stop(self) -> None:
        with self._lock:
            self.stopped = True
            if self._query is not None:
                self._query.stop()


def late_rows(
    query: StreamingQuery, kept: int, every_s: float = 0.5, state_rows: dict[int, int] | None = None
) -> int:
    """Rows that a query dropped as late, over all of its triggers, once it has ended.

    Spark keeps the last ``kept`` reports.  They are read while the query runs, often enough to meet each
    of them; where some may have gone in between that is an error, as late rows may be behind it.  Rows of
    state by trigger are put into ``state_rows``.
    """
    dropped: dict[int, int] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(every_s)
        reports = query.recentProgress
        if dropped and len(reports) >= kept and not any(r["batchId"] in dropped for r in reports):
            raise ValueError("reports of some triggers are missing; late rows cannot be counted")
        for report in reports:
            late = sum(state["numRowsDroppedByWatermark"] for state in report["stateOperators"])
            dropped[report["batchId"]] = max(late, dropped.get(report["batchId"], 0))
            if state_rows is not None:
                state_rows[report["batchId"]] = sum(s["numRowsTotal"] for s in report["stateOperators"])
    return sum(dropped.values())


def _run(
    spark: SparkSession, query: DataFrame, base: str, out: str, settings: dict[str, str], handle: Handle
) -> DataFrame:
    if handle.stopped:
        raise Stopped
    settings = {_KEPT: str(KEPT_REPORTS)} | settings
    with _starting:
        before = {name: spark.conf.get(name, None) for name in settings}
        try:
            for name, value in settings.items():
                spark.conf.set(name, value)
            running = (
                query.writeStream.format("parquet")
                .outputMode("append")
                .option("path", out)
                .option("checkpointLocation", f"{base}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
        finally:
            # a stream keeps the settings it was started with
            for name, value in before.items():
                if value is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, value)
    handle.take(running)
    late = late_rows(running, KEPT_REPORTS, state_rows=handle.state_rows)
    if handle.stopped:
        raise Stopped
    if late:
        raise ValueError(f"{late} rows came later than the delay allows; give a longer delay")
    return spark.read.schema(query.schema).parquet(out)


def stream_origin(source: DataFrame | Sequence[DataFrame], rel: Relation, p: Params, **run) -> DataFrame:
    run.setdefault("windows", rel.agg is not None)
    return run_bounded(source, lambda df: origin(rel, df, p), **run)


def stream_other(
    source: DataFrame | Sequence[DataFrame],
    rel: Relation,
    p: Params,
    predicate: str | None = None,
    mode: str = "union",
    **run,
) -> DataFrame:
    run.setdefault("windows", rel.agg is not None)
    return run_bounded(source, lambda df: other(rel, df, p, predicate, mode), **run)
