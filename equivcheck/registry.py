"""Queries by name: each takes a session and a folder of tables and returns a frame.

The names follow the relations and operators; ``registry_sql`` holds the SQL that
gives the same rows.
"""

from __future__ import annotations

from dataclasses import asdict, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.functions import arith
from equivcheck.functions.predicates import (
    ExpressionPool,
    partition_profile,
    quantiles,
)
from equivcheck.operators.aggregates import AGGREGATES, Measure
from equivcheck.operators.windows import event_millis, millis, tumbling
from equivcheck.plans import multiset, report, suite
from equivcheck.plans.compare import compare, diff_columns, diff_rows
from equivcheck.plans.relations import RELATIONS, Params, origin, other
from equivcheck.session import new_dir
from equivcheck.sources import catalog, files, generate
from equivcheck.sources.tables import EVENTS, LINEITEM, ORDERS, TableSource
from equivcheck.streaming.bounded import run_bounded, stream_origin, stream_other

HOUR = millis(1, "hours")
DAY = millis(1, "days")

# What the registered relations run with, per table.
SETTINGS = {
    "events": Params(
        field="value",
        scale=2,
        window_ms=6 * HOUR,
        inner_ms=2 * HOUR,
        expr="try_subtract(ts, try_multiply(key, 3L))",
    ),
    "lineitem": Params(
        field="l_extendedprice",
        scale=2,
        window_ms=30 * DAY,
        inner_ms=10 * DAY,
        expr="try_cast(try_divide(ts, try_add(key, 1L)) AS BIGINT)",
    ),
}

_SQUARE = arith.arithmetic("*", "ts", "ts", T.LongType())

# Predicates of the other sides, taken in turn; most are NULL for some rows.
PREDICATES = {
    "events": [
        "(value * 2 > key + 10)",
        "(try_divide(value, CAST(try_subtract(key, 50L) AS DOUBLE)) > 0.1D)",
        "((value <= 20.5D) AND (try_mod(ts, key) < 40L))",
        f"(({_SQUARE} > 0L) OR (value > 15D))",
        "(NOT (value < 8.25D OR try_divide(key, try_subtract(key, 7L)) >= 1.2D))",
    ],
    "lineitem": [
        "(l_quantity > 25D)",
        "(try_divide(l_extendedprice, CAST(try_subtract(key, 7L) AS DOUBLE)) < 900D)",
        "((l_quantity >= 10D) AND (try_mod(ts, try_subtract(key, 3L)) != 0L))",
        f"(({_SQUARE} > 0L) OR (l_extendedprice > 30000D))",
        "(NOT (l_extendedprice < 20000D OR try_divide(key, try_subtract(key, 9L)) >= 1.1D))",
    ],
}

# Predicates whose split is profiled; DuckDB forms are in ``registry_sql``.
PROFILED = [
    "(l_quantity > 25D)",
    "(l_extendedprice <= 30000.5D)",
    "((l_quantity < 10D) AND (key > 50L))",
    "((l_quantity < 10D) OR (key != 50L))",
    "(NOT (l_extendedprice >= 1000D))",
    "(try_divide(l_extendedprice, CAST(try_subtract(key, 7L) AS DOUBLE)) < 900D)",
    "(try_mod(ts, key) = 0L)",
    f"({_SQUARE} > 0L)",
]

PRODUCERS = 5
CLOCKS_APART_MS, CLOCK_FILES = 9 * 3_600_000, 4


def _predicate(table: str, name: str) -> str:
    choices = PREDICATES[table]
    return choices[list(RELATIONS).index(name) % len(choices)]


def relation_key(name: str) -> str:
    """Query name of a relation: KeyAggSum is keyagg_sum."""
    rel = RELATIONS[name]
    return f"{rel.family}_{rel.agg}" if rel.agg else rel.family


def _relations(source: TableSource, prefix: str) -> dict:
    table = source.table
    p = SETTINGS[table]
    out = {}
    for name, rel in RELATIONS.items():
        predicate = _predicate(table, name)

        def left(spark, sf_dir, rel=rel):
            return origin(rel, source.read(spark, sf_dir), p)

        def right(spark, sf_dir, rel=rel, predicate=predicate, mode="union"):
            return other(rel, source.read(spark, sf_dir), p, predicate, mode)

        def one_scan(spark, sf_dir, right=right):
            return right(spark, sf_dir, mode="tagged")

        key = prefix + relation_key(name)
        out[f"{key}_origin"] = left
        out[f"{key}_other"] = right
        if rel.family in ("agg", "keyagg"):
            out[f"{key}_tagged"] = one_scan
    return out


PLAIN = ("AggSum", "AggAvg", "KeyAggSum", "KeyAggAvg", "WinPartSum", "WinPartAvg")


def _plain_doubles() -> dict:
    """Sums and averages of doubles that are not declared to be decimals, to the last bit."""
    p = replace(SETTINGS["lineitem"], scale=None)
    out = {}
    for name in PLAIN:
        rel, predicate = RELATIONS[name], _predicate("lineitem", name)

        def left(spark, sf_dir, rel=rel):
            return origin(rel, LINEITEM.read(spark, sf_dir), p)

        def right(spark, sf_dir, rel=rel, predicate=predicate, mode="union"):
            return other(rel, LINEITEM.read(spark, sf_dir), p, predicate, mode)

        key = f"plain_{relation_key(name)}"
        out[f"{key}_origin"], out[f"{key}_other"] = left, right
        if rel.family != "winpart":
            out[f"{key}_tagged"] = partial(right, mode="tagged")
    return out


def _nested(divisor: int):
    def run(spark, sf_dir):
        p = SETTINGS["events"]
        divided = Params(p.field, p.scale, p.window_ms, p.window_ms // divisor)
        return other(RELATIONS["WinPartSum"], EVENTS.read(spark, sf_dir), divided)

    return run


# -- scalar expressions ---------------------------------------------------------


def scalar_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arithmetic operator and typed literals, on integers that overflow and zero divisors."""
    long = T.LongType()
    ts, key = arith.column("ts"), arith.column("key")
    shifted = arith.arithmetic("-", key, arith.literal(50, long), long)
    texts = {
        "added": arith.arithmetic("+", ts, key, long),
        "subtracted": arith.arithmetic("-", key, ts, long),
        "multiplied": arith.arithmetic("*", ts, key, long),
        "overflowed": arith.arithmetic("*", ts, ts, long),
        "divided": arith.arithmetic("/", ts, shifted, long),
        "remainder": arith.arithmetic("%", ts, shifted, long),
        "squared": arith.arithmetic("**", key, arith.literal(2, long), long),
        "absolute": arith.absolute(shifted, long),
        "smallest": arith.absolute(arith.literal(-(2**63), long), long),
        "tiny": arith.literal(-128, T.ByteType()),
        "real": arith.literal(0.25, T.DoubleType()),
    }
    rows = LINEITEM.read(spark, sf_dir)
    # NULLs are written as text: that keeps integers integers wherever rows are compared
    return rows.select(
        "ts", "key", *[F.expr(f"coalesce(CAST({t} AS STRING), 'null')").alias(n) for n, t in texts.items()]
    )


def predicate_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each relational and logical operator is true, per key."""
    nullable = "(try_divide(l_extendedprice, CAST(try_subtract(key, 7L) AS DOUBLE)) < 900D)"
    limit = arith.literal(25.0, T.DoubleType())
    quantity = arith.column("l_quantity")
    small = arith.relational("<", quantity, limit)
    texts = {
        "lt": small,
        "le": arith.relational("<=", quantity, limit),
        "gt": arith.relational(">", quantity, limit),
        "ge": arith.relational(">=", quantity, limit),
        "eq": arith.relational("=", quantity, limit),
        "ne": arith.relational("!=", quantity, limit),
        "both": arith.logical("AND", small, nullable),
        "either": arith.logical("OR", small, nullable),
        "neither": arith.negate(arith.logical("OR", small, nullable)),
        "unknown": arith.is_null(nullable),
    }
    rows = LINEITEM.read(spark, sf_dir)
    return rows.groupBy("key").agg(*[F.count_if(F.expr(t)).alias(n) for n, t in texts.items()])


def predicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_profile(LINEITEM.read(spark, sf_dir), PROFILED).drop("predicate")


def predicate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random predicates: the three parts of each cover every row exactly once."""
    rows = LINEITEM.read(spark, sf_dir)
    pool = ExpressionPool(rows.schema, 7, quantiles(rows))
    profile = partition_profile(rows, [pool.predicate(3) for _ in range(20)])
    covered = F.expr("n_true + n_false + n_null").alias("covered")
    return profile.select("predicate_id", covered)


def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LINEITEM.read(spark, sf_dir)
    return rows.select(F.col("key").alias("supplier"), "l_quantity", F.col("ts").alias("shipped"))


# -- windows --------------------------------------------------------------------


def window_all_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five aggregates of one window at once, each under a name of its own."""
    rows = LINEITEM.read(spark, sf_dir)
    dtype = rows.schema["l_extendedprice"].dataType
    aggs = {}
    for agg in AGGREGATES:
        (column,) = Measure(agg, "l_extendedprice", dtype, 2).direct().values()
        aggs[f"{agg}_price" if agg != "count" else "n"] = column
    return tumbling(rows, 7 * DAY, aggs)


def window_in_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time and window length given in minutes."""
    rows = EVENTS.read(spark, sf_dir)
    minute = F.floor(F.col("ts") / F.lit(millis(1, "minutes")))
    in_ms = rows.withColumn("ts", event_millis(minute, "minutes"))
    return tumbling(in_ms, millis(90, "minutes"), {"n": F.count(F.lit(1))}, ["key"])


# -- sources and sinks ----------------------------------------------------------

EVENT_FIELDS = (("event_id", "INT64"), ("ts", "INT64"), ("key", "INT64"), ("value", "FLOAT64"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENTS.read(spark, sf_dir, keep=("event_id",))


def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by five producers and read back as one source of the catalogue."""
    path = new_dir(spark, "producers")
    produced = _identified(spark, sf_dir).withColumn("producer", F.col("event_id") % PRODUCERS)
    produced.write.partitionBy("producer").option("header", True).csv(path)
    declared = catalog.LogicalSource("events", EVENT_FIELDS)
    listed = catalog.parse_catalogue(catalog.catalogue_document([declared]))
    paths = [f"{path}/producer={i}" for i in range(PRODUCERS)]
    return files.read_producers(spark, listed["events"].schema, paths)


def merged_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two producers with different columns orders, united by name: no row is dropped."""
    events = EVENTS.read(spark, sf_dir).select("ts", "key", "value")
    orders = ORDERS.read(spark, sf_dir).select(F.col("o_totalprice").alias("value"), "key", "ts")
    return files.merge_producers([events, orders])


def from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "equivcheck_events"
    catalog.register(_identified(spark, sf_dir), name)
    return catalog.from_source(spark, name)


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SETTINGS["events"]
    result = origin(RELATIONS["KeyAggSum"], EVENTS.read(spark, sf_dir), p)
    return files.write_result(result, new_dir(spark, "sink"), "csv")


def typed_header_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "typed")
    files.write_typed_csv(_identified(spark, sf_dir), path, "events")
    return files.read_typed_csv(spark, path)


def declared_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of lineitem outside narrow declared types."""
    source = catalog.LogicalSource(
        "lineitem", (("l_orderkey", "INT16"), ("l_suppkey", "UINT8"), ("l_linenumber", "UINT8"))
    )
    rows = spark.read.schema("l_orderkey BIGINT, l_suppkey BIGINT, l_linenumber INT")
    return catalog.out_of_range(rows.parquet(f"{sf_dir}/lineitem.parquet"), source)


# -- generated streams ----------------------------------------------------------

GENERATOR_SEED = 11
GENERATED_FIELDS = [(f"f{i}", t) for i, t in enumerate(generate.FIELD_TYPES)]


def _event_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer for every fifth of the events, with as many records as it has events."""
    events = _identified(spark, sf_dir)
    of_event = (F.col("event_id") % PRODUCERS).alias("producer")
    return events.groupBy(of_event).agg(F.count(F.lit(1)).alias("records"))


def generated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generate.bursty_rows(_event_producers(spark, sf_dir), GENERATOR_SEED)
    return rows.select("producer", "row", "ts")


def generated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, a counter and a column of every declared type.

    Unsigned 64-bit values are given as text, other values as they are.
    """
    rows = generate.bursty_rows(_event_producers(spark, sf_dir), GENERATOR_SEED)
    filled = generate.with_fields(rows, GENERATED_FIELDS, GENERATOR_SEED)
    wide = [n for n, t in GENERATED_FIELDS if t == "UINT64"]
    return filled.withColumns(
        {n: F.col(n).cast("string") for n in wide}
        | {"n": generate.sequence(1000, F.col("row"))}
    ).drop("ts")


def generated_stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per producer: rows, distinct positions, and values outside what is declared."""
    rows = generate.bursty_rows(_event_producers(spark, sf_dir), GENERATOR_SEED)
    filled = generate.with_fields(rows, GENERATED_FIELDS, GENERATOR_SEED)
    floats = [n for n, t in GENERATED_FIELDS if t.startswith("FLOAT")]
    outside = " OR ".join(
        [f"key NOT BETWEEN 0 AND {generate.KEYS - 1}", f"ts < {generate.START_MS}"]
        + [f"{n} < 0 OR {n} >= 1" for n in floats]
    )
    per_row = filled.groupBy("producer", "row").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr(outside)).alias("outside")
    )
    return per_row.groupBy("producer").agg(
        F.sum("n").alias("records"),
        F.count(F.lit(1)).alias("positions"),
        F.sum("outside").alias("outside"),
    )


# A random source of the generator, with the types it draws for its fields.
WRITTEN = generate.random_source("written", GENERATOR_SEED)


def generated_source_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random source, as many records as there are events, written by its producers and read back."""
    records = _identified(spark, sf_dir).count() // PRODUCERS
    generated = generate.generate_source(spark, WRITTEN, GENERATOR_SEED, PRODUCERS, records)
    paths = generate.write_producers(generated, f"{new_dir(spark, 'generated')}/written", PRODUCERS)
    rows = files.read_producers(spark, WRITTEN.schema, paths)
    wide = [n for n, t in WRITTEN.fields if t == "UINT64"]
    return rows.withColumns({n: F.col(n).cast("string") for n in wide})


# -- comparison -----------------------------------------------------------------

_SHOWN = ("relation", "left_rows", "right_rows", "differing", "tolerant")
_VERDICT = (
    "relation STRING, left_rows BIGINT, right_rows BIGINT, differing BIGINT, tolerant BOOLEAN"
)


def _judged(left: DataFrame, right: DataFrame, **kwargs) -> DataFrame:
    verdict = asdict(compare(left, right, **kwargs))
    return left.sparkSession.createDataFrame([tuple(verdict[c] for c in _SHOWN)], _VERDICT)


def compare_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel, p = RELATIONS["KeyAggSum"], SETTINGS["lineitem"]
    rows = LINEITEM.read(spark, sf_dir)
    return _judged(origin(rel, rows, p), other(rel, rows, p, PREDICATES["lineitem"][1]))


def compare_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _identified(spark, sf_dir).withColumn("pos", F.col("event_id"))
    return _judged(left, left.withColumn("pos", -F.col("event_id")), pos="pos")


def compare_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LINEITEM.read(spark, sf_dir)
    return _judged(rows, rows.where("key != 7"))


def compare_doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LINEITEM.read(spark, sf_dir)
    return _judged(rows, rows.unionAll(rows.where("l_quantity = 10")))


def compare_missing_doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows on both sides: every second one is missing, the one before it doubled."""
    left = _identified(spark, sf_dir).select("event_id")
    return _judged(left, left.select(F.expr("event_id - event_id % 2").alias("event_id")))


def _shifted_values(spark: SparkSession, sf_dir: str, by: float):
    raw = spark.read.schema("event_type STRING, value DOUBLE").parquet(f"{sf_dir}/events.parquet")
    return raw, raw.withColumn("value", F.col("value") + F.lit(by))


def compare_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in five large groups of equal exact columns, all values slightly off."""
    return _judged(*_shifted_values(spark, sf_dir, 0.0004))


def compare_tolerance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with groups beyond the size that one task scans."""
    return _judged(*_shifted_values(spark, sf_dir, 0.0004), group_limit=100)


def compare_beyond_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(*_shifted_values(spark, sf_dir, 0.002))


def compare_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed column class is an error, whatever the values are."""
    left = _identified(spark, sf_dir)
    right = left.withColumn("value", F.col("value").cast("string"))
    return _judged(left, right).select("relation", "left_rows", "right_rows")


def diff_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which counts per window differ once one event type is left out."""
    raw = spark.read.schema(EVENTS.schema + ", event_type STRING")
    events = EVENTS.shaped(raw.parquet(f"{sf_dir}/events.parquet"), keep=("event_type",))
    rel, p = RELATIONS["AggCount"], SETTINGS["events"]
    rest = events.where("event_type != 'error'")
    return diff_rows(origin(rel, events, p), origin(rel, rest, p))


# -- suites and reports -----------------------------------------------------------


def _order_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Execution and verdict rows derived from all orders."""
    orders = spark.read.schema(
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderpriority STRING"
    ).parquet(f"{sf_dir}/orders.parquet")
    log = orders.select(
        (F.col("o_custkey") % 3).cast("int").alias("run_id"),
        F.col("o_orderpriority").alias("strategy"),
        F.expr(
            "CASE WHEN o_totalprice < 50000 THEN 'TimedOut' WHEN o_orderstatus = 'P' THEN 'Failed' "
            "WHEN o_orderkey % 10 = 0 THEN 'Skipped' ELSE 'Success' END"
        ).alias("status"),
        F.expr(
            "CASE WHEN o_totalprice >= 400000 THEN 'Diff' WHEN o_orderkey % 41 = 0 THEN 'Error' "
            "WHEN o_orderstatus = 'F' THEN 'Equal' "
            "ELSE 'Reordered' END"
        ).alias("relation"),
    )
    execs = log.select("run_id", "strategy", "status")
    return execs, log.where("status = 'Success'").select("run_id", "strategy", "relation")


def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(*_order_log(spark, sf_dir))


def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = report.summary_rollup(*_order_log(spark, sf_dir))
    return rolled.withColumn("run_id", F.coalesce("run_id", F.lit(-1)))


def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = report.summary_totals(*_order_log(spark, sf_dir))
    return totals.withColumn("run_id", F.coalesce("run_id", F.lit(-1)))


def suite_rate_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = report.rate_variance(*_order_log(spark, sf_dir))
    return spread.select(
        "strategy", *[F.round(c, 8).alias(c) for c in ("exec_variance", "eval_variance")]
    )


def _suite_sources(spark: SparkSession, sf_dir: str) -> list[suite.SuiteSource]:
    return [
        suite.SuiteSource(s.table, s.read(spark, sf_dir), s.values) for s in (EVENTS, LINEITEM)
    ]


def suite_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Others of two planned runs and their different predicates: one for each other."""
    config = suite.SuiteConfig(relations=("Filter", "AggSum", "KeyAggAvg"), reps=2, others=4, seed=3)
    planned = [
        (c.run_id, c.source, c.predicate)
        for run_id in range(2)
        for c in suite.plan_suite(_suite_sources(spark, sf_dir), config, "unused", run_id)
        if c.predicate is not None
    ]
    rows = spark.createDataFrame(planned, "run_id INT, source STRING, predicate STRING")
    different = F.count_distinct("source", "predicate")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("others"), different.alias("predicates"))


def report_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two runs of a suite, from their stored tables."""
    config = suite.SuiteConfig(
        relations=("Filter", "KeyAggSum"), reps=1, others=2, seed=5, time_scale=3600, parallel_sets=2
    )
    out = new_dir(spark, "runs")
    execs, results = suite.run_suites(spark, _suite_sources(spark, sf_dir), config, out, 2)
    return report.summary(execs, results)


def avg_bigint(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Averages of integers far beyond what doubles hold."""
    rows = LINEITEM.read(spark, sf_dir).select(
        "ts", "key", (F.col("ts") * 1_000_003 + F.col("key") * 7).alias("wide")
    )
    rel, p = RELATIONS["KeyAggAvg"], replace(SETTINGS["lineitem"], field="wide", scale=None)
    return origin(rel, rows, p) if side == "origin" else other(rel, rows, p, "key % 3 = 1 OR ts % 2 = 0")


def suite_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random suite with one set per relation: every verdict of it."""
    config = suite.SuiteConfig(reps=1, others=1, seed=5, time_scale=3600, parallel_sets=4)
    verdicts = suite.run_suite(
        spark, _suite_sources(spark, sf_dir), config, new_dir(spark, "suite")
    )
    return verdicts.select("set_id", "case_id", "strategy", "relation")


def _stored_pair(spark: SparkSession, sf_dir: str) -> tuple[str, list, suite.SuiteConfig]:
    p, base = SETTINGS["events"], new_dir(spark, "pair")
    first = suite.Case(
        0, 0, suite.ORIGIN, "KeyAggSum", "events", p.field, p.scale, p.window_ms, None, "key",
        None, None, "union", f"{base}/results/set0-Origin",
    )
    second = suite.replace(
        first,
        case_id="Other0",
        predicate=PREDICATES["events"][1],
        result_path=f"{base}/results/set0-Other0",
    )
    sources, config = _suite_sources(spark, sf_dir), suite.SuiteConfig()
    suite.run_cases(spark, sources, [first, second], config, base)
    return base, sources, config


def replay_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of a stored rewritten query, built again from its stored row."""
    base, sources, config = _stored_pair(spark, sf_dir)
    folder = new_dir(spark, "replay")
    suite.replay(spark, sources, base, 0, config, folder, case_id="Other0")
    (again,) = [c for c in suite.load_cases(spark, folder, 0, "Other0") if c.case_id == "Other0"]
    return spark.read.parquet(again.result_path)


def recheck_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results judged again, one of them changed meanwhile."""
    base, _, config = _stored_pair(spark, sf_dir)
    first, second = suite.load_cases(spark, base, 0)
    again = suite.recheck(spark, base, config, new_dir(spark, "again"))
    kept = spark.read.parquet(second.result_path).where("key != 7")
    changed = suite.replace(second, result_path=f"{second.result_path}-changed")
    kept.write.parquet(changed.result_path)
    cases = [tuple(asdict(c).values()) for c in (first, changed)]
    spark.createDataFrame(cases, suite.CASE_SCHEMA).write.mode("overwrite").parquet(f"{base}/test_sets")
    other_ = suite.recheck(spark, base, config, new_dir(spark, "again"))
    shown = [again.withColumn("changed", F.lit(False)), other_.withColumn("changed", F.lit(True))]
    return shown[0].unionByName(shown[1]).select("changed", "set_id", "case_id", "relation", "left_rows", "right_rows", "differing")


def extract_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results that differ within tolerance in all rows and beyond it in some."""
    base, _, config = _stored_pair(spark, sf_dir)
    first, second = suite.load_cases(spark, base, 0)
    left = _identified(spark, sf_dir).select("event_id", "value")
    by = F.when(F.col("event_id") % 100 == 0, 0.5).otherwise(0.0004)
    left.write.mode("overwrite").parquet(first.result_path)
    left.withColumn("value", F.col("value") + by).write.mode("overwrite").parquet(second.result_path)
    verdict = suite.judge(spark, first, second, config)
    row = (0, 0, second.case_id, second.strategy, *asdict(verdict).values())
    results = spark.createDataFrame([row], suite.RESULT_SCHEMA)
    results.write.mode("overwrite").parquet(f"{base}/test_set_results")
    folder = new_dir(spark, "diffs")
    suite.extract_diffs(spark, base, folder, config)
    return spark.read.parquet(f"{folder}/run-0/set0-Other0")


def compare_ordered_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _identified(spark, sf_dir).withColumn("pos", F.col("event_id"))
    return _judged(left, left, pos="pos")


def compare_two_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two float columns off within tolerance: the pairing goes through clusters of both."""
    raw = spark.read.schema("event_type STRING, value DOUBLE, user_id BIGINT")
    left = raw.parquet(f"{sf_dir}/events.parquet").withColumn("share", F.col("user_id") / 4).drop("user_id")
    right = left.withColumns({"value": F.col("value") + 0.0004, "share": F.col("share") - 0.0004})
    return _judged(left, right)


def compare_crossed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense groups of sixty rows: rows have partners, but not those of equal rank in either column."""
    events = _identified(spark, sf_dir).select("event_id")
    i = F.col("event_id")
    left = events.select(
        F.floor(i / 60).alias("part"), (i * 7919 % 13 * 0.0004).alias("x"), (i * 104_729 % 17 * 0.0004).alias("y"), "event_id"
    )
    off = [F.when(i % n < n / 2, 0.0009).otherwise(-0.0009) for n in (7, 11)]
    right = left.select("part", (F.col("x") + off[0]).alias("x"), (F.col("y") + off[1]).alias("y"))
    return _judged(left.drop("event_id"), right)


def compare_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags told apart by the digests that are taken while they are written."""
    rel, p = RELATIONS["Filter"], SETTINGS["lineitem"]
    rows = LINEITEM.read(spark, sf_dir)
    path = new_dir(spark, "digests")
    split = other(rel, rows, p, PREDICATES["lineitem"][1])
    digests = {
        name: multiset.write(frame, f"{path}/{name}")
        for name, frame in {"origin": origin(rel, rows, p), "split": split, "fewer": rows.where("key != 7")}.items()
    }
    first = digests["origin"]
    made = [(name, d.rows, d == first) for name, d in digests.items()]
    return spark.createDataFrame(made, "name STRING, rows BIGINT, same BOOLEAN")


# -- streaming ------------------------------------------------------------------


def _streamed(name: str, side: str, **changed):
    def run(spark, sf_dir):
        rel, p = RELATIONS[name], replace(SETTINGS["events"], **changed)
        source = EVENTS.stream(spark, sf_dir)
        if side == "origin":
            return stream_origin(source, rel, p)
        return stream_other(source, rel, p, _predicate("events", name))

    return run


STREAMED = {
    f"stream_{relation_key(name)}_{side}": (name, side)
    for name in RELATIONS
    for side in ("origin", "other")
}


def stream_many_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in six files, each over the whole span of time, two of them per trigger."""
    path = new_dir(spark, "files")
    rows = _identified(spark, sf_dir)
    dealt = rows.repartition(6, F.col("event_id") % 6)
    dealt.write.parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    p = SETTINGS["events"]
    return stream_other(source, RELATIONS["AggCount"], p, _predicate("events", "AggCount"))


def stream_producer_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed counts of five producers with a watermark each: windows close while input arrives.

    The producers' clocks are nine hours apart each.  Each writes its files in its order of time, so no
    delay is needed beyond its own.
    """
    path = new_dir(spark, "clocks")
    rows = _identified(spark, sf_dir).withColumn("producer", F.col("event_id") % PRODUCERS)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    low = first or 0
    step = ((last or 0) - low) // CLOCK_FILES + 1
    for k in range(CLOCK_FILES):
        now = rows.where(F.col("ts").between(low + k * step, low + (k + 1) * step - 1))
        told = now.withColumn("ts", F.col("ts") + F.col("producer") * F.lit(CLOCKS_APART_MS))
        told.repartition(PRODUCERS, "producer").write.mode("append").partitionBy("producer").option("header", True).csv(path)
    paths = [f"{path}/producer={i}" for i in range(PRODUCERS)]
    streams = files.stream_each_producer(spark, rows.drop("producer").schema, paths, files_per_trigger=1)
    return stream_origin(streams, RELATIONS["KeyAggCount"], SETTINGS["events"], delay="1 second")


def diff_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were changed in one column, and rows that were changed in two."""
    left = _identified(spark, sf_dir).select("event_id", "key", "value")
    odd = [F.col("event_id") % n == 0 for n in (50, 70)]
    right = left.withColumns(
        {
            "value": F.when(odd[0], F.col("value") + 1000).otherwise(F.col("value")),
            "key": F.when(odd[1], F.col("key") + 1_000_000).otherwise(F.col("key")),
        }
    )
    found = diff_columns(left, right).where("column is null or column != 'event_id'")
    return found.select(F.coalesce("left.event_id", "right.event_id").alias("event_id"), "column", "n",
                        F.coalesce("left.key", "right.key").alias("key"), F.coalesce("left.value", "right.value").alias("value"))


def suite_verdicts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random suite whose cases run as streams, judged like any other."""
    events = replace(_suite_sources(spark, sf_dir)[0], stream=EVENTS.stream(spark, sf_dir))
    config = suite.SuiteConfig(
        relations=("Filter", "AggCount", "KeyAggAvg"), reps=1, others=1, seed=5, time_scale=3600, parallel_sets=3
    )
    verdicts = suite.run_suite(spark, [events], config, new_dir(spark, "suite"))
    # Of the windows that the suite draws nothing is known beforehand.
    filtered = F.when(F.col("strategy") == "Filter", F.col("left_rows")).otherwise(0).alias("filtered")
    return verdicts.select("set_id", "case_id", "strategy", "relation", filtered)


def stream_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV by five producers and taken as a stream, row by row."""
    path = new_dir(spark, "producers")
    rows = _identified(spark, sf_dir)
    produced = rows.withColumn("producer", F.col("event_id") % PRODUCERS)
    produced.write.partitionBy("producer").option("header", True).csv(path)
    source = files.stream_producers(spark, rows.schema, f"{path}/*")
    return run_bounded(source, lambda df: df.drop("event_time"), windows=False)


OPERATORS = [
    scalar_arithmetic,
    predicate_operators,
    predicate_profile,
    predicate_pool,
    project_rename,
    window_all_aggregates,
    window_in_minutes,
    multi_source_union,
    merged_producers,
    from_source,
    csv_sink,
    typed_header_read,
    declared_ranges,
    generated_times,
    generated_stream,
    generated_stream_stats,
    generated_source_written,
    compare_equal,
    compare_reordered,
    compare_ordered_equal,
    compare_two_floats,
    compare_crossed_pairs,
    compare_by_digest,
    compare_missing,
    compare_doubled,
    compare_missing_doubled,
    compare_tolerance,
    compare_tolerance_blocks,
    compare_beyond_tolerance,
    compare_types,
    diff_of_results,
    diff_of_columns,
    extract_diffs,
    suite_summary,
    suite_rollup,
    suite_totals,
    suite_rate_variance,
    suite_predicates,
    report_of_runs,
    suite_verdicts,
    suite_verdicts_stream,
    recheck_stored,
    stream_many_triggers,
    stream_producer_clocks,
    stream_csv_source,
    replay_pair,
]


def all_queries() -> dict:
    return (
        _relations(EVENTS, "")
        | _relations(LINEITEM, "lineitem_")
        | _plain_doubles()
        | {f"winpart_sum_other_by{n}": _nested(n) for n in suite.INNER_DIVISORS}
        | {f.__name__: f for f in OPERATORS}
        | {key: _streamed(*of) for key, of in STREAMED.items()}
        | {f"stream_plain_keyagg_avg_{side}": _streamed("KeyAggAvg", side, scale=None) for side in ("origin", "other")}
        | {f"avg_bigint_{side}": partial(avg_bigint, side=side) for side in ("origin", "other")}
    )
