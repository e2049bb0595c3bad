"""Seeded synthetic streams: bursty event time, keys and full-range random columns.

Every value is a hash of (seed, column, producer, row), so the data do not
depend on partitioning and a lost partition is rebuilt unchanged.  Event time is
a running sum per producer; it is taken over *cycles* (a burst and the quiet row
after it) in blocks, so one huge producer is spread like many small ones.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.session import shuffle_partitions
from equivcheck.sources.catalog import LogicalSource
from equivcheck.types import DECLARED, is_float

# Sizing and ranges of a generated source.
SOURCES = 5
PRODUCERS = 5
RECORDS = 500
FIELDS = 10
START_MS = 100
KEYS = 21
BURST_ROWS = 5  # a burst has 1 to 5 rows
BURST_GAP_MS = (0, 500)
QUIET_GAP_MS = (500, 3000)
FIELD_TYPES = [
    "UINT8", "INT8", "UINT16", "INT16", "UINT32", "INT32", "UINT64", "INT64", "FLOAT32", "FLOAT64",
]

CYCLES_PER_BLOCK = 8_192


def column_seed(seed: int, name: str) -> int:
    """Seed of one column, a bigint."""
    digest = hashlib.sha256(f"{seed}/{name}".encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


def noise(seed: int, name: str, *position: Column) -> Column:
    """64 hashed bits for a column at a position."""
    return F.xxhash64(F.lit(column_seed(seed, name)).cast("bigint"), *position)


def uniform(bits: Column, low: int, high: int) -> Column:
    """A bigint in [low, high)."""
    return F.pmod(bits, F.lit(high - low).cast("bigint")) + F.lit(low).cast("bigint")


def full_range(bits: Column, type_name: str) -> Column:
    """A value of a declared type: integers over the whole type, floats in [0, 1)."""
    dtype = DECLARED[type_name]
    if isinstance(dtype, T.BooleanType):
        return bits < 0
    if is_float(dtype):
        digits = 24 if isinstance(dtype, T.FloatType) else 53
        top = F.shiftrightunsigned(bits, 64 - digits)
        return (top.cast("double") / F.lit(float(2**digits))).cast(dtype)
    if type_name == "UINT64":
        above = F.lit(str(2**63)).cast("decimal(20,0)")
        return (bits.cast("decimal(20,0)") + above).cast(dtype)
    width = int(type_name.lstrip("UINT"))
    if width == 64:
        return bits
    unsigned = F.shiftrightunsigned(bits, 64 - width)
    shift = 0 if type_name.startswith("U") else 2 ** (width - 1)
    return (unsigned - F.lit(shift).cast("bigint")).cast(dtype)


def sequence(start: int, row: Column) -> Column:
    """A counter: start, start + 1, ..."""
    return F.lit(start).cast("bigint") + row


def _cycles(blocks: DataFrame, *carried: str) -> DataFrame:
    """The cycles of each block, with the columns to be carried along."""
    first = F.col("block") * F.lit(CYCLES_PER_BLOCK).cast("bigint")
    last = F.least(first + F.lit(CYCLES_PER_BLOCK - 1), F.floor((F.col("records") - 1) / F.lit(2)))
    return blocks.select(
        "producer", "records", "block", *carried, F.explode(F.sequence(first, last)).alias("cycle")
    )


def _burst(seed: int) -> Column:
    return uniform(noise(seed, "burst", F.col("producer"), F.col("cycle")), 1, BURST_ROWS + 1)


def _timed(cycles: DataFrame, seed: int) -> DataFrame:
    """Add ``burst``, ``size`` in rows, ``length`` in ms and ``elapsed``, the time from start to each row."""
    where = (F.col("producer"), F.col("cycle"))
    gaps = [uniform(noise(seed, f"gap{j}", *where), *BURST_GAP_MS).alias(f"gap{j}") for j in range(BURST_ROWS)]
    quiet = uniform(noise(seed, "quiet", *where), *QUIET_GAP_MS)
    drawn = cycles.select("*", *gaps, _burst(seed).alias("burst"), quiet.alias("quiet"))
    elapsed = [F.col("gap0")]
    for j in range(1, BURST_ROWS):
        elapsed.append(elapsed[-1] + F.col(f"gap{j}"))
    whole = F.element_at(F.array(*elapsed), F.col("burst").cast("int"))
    return drawn.select(
        *cycles.columns,
        "burst",
        (F.col("burst") + F.lit(1)).alias("size"),
        (whole + F.col("quiet")).alias("length"),
        F.array(*elapsed).alias("elapsed"),
    )


def bursty_rows(producers: DataFrame, seed: int, start_ms: int = START_MS) -> DataFrame:
    """Rows ``producer, row, ts`` for a frame ``producer, records`` (both bigint).

    A cycle is a burst of 1 to 5 rows with short gaps and one row after a long
    gap.  Every producer starts at ``start_ms`` and has its own clock.
    """
    partitions = shuffle_partitions(producers.sparkSession)
    # At least two rows per cycle bounds the cycles needed, about twice as many as there are.  The sizes
    # of the bursts alone tell which blocks are: only those are expanded.  Only lists of blocks are
    # shuffled; cycles are expanded where their block lies.
    upto = F.floor((F.col("records") - 1) / F.lit(2 * CYCLES_PER_BLOCK))
    blocks = producers.where("records > 0").select(
        "producer",
        "records",
        F.explode(F.sequence(F.lit(0).cast("bigint"), upto)).alias("block"),
    )
    of_block = ["producer", "records", "block"]
    before = Window.partitionBy("producer").orderBy("block")
    before = before.rowsBetween(Window.unboundedPreceding, -1)

    def placed(listed: DataFrame) -> DataFrame:
        return listed.repartition(partitions, "producer", "block")

    def carried(name: str) -> Column:
        return F.coalesce(F.sum(f"block_{name}").over(before), F.lit(0)).alias(f"{name}_before")

    size = _burst(seed) + F.lit(1)
    sizes = _cycles(placed(blocks)).groupBy(*of_block).agg(F.sum(size).alias("block_rows"))
    needed = sizes.select(*of_block, carried("rows")).where("rows_before < records")
    lengths = (
        _timed(_cycles(placed(needed), "rows_before"), seed)
        .groupBy(*of_block, "rows_before")
        .agg(F.sum("length").alias("block_time"))
    )
    starts = lengths.select(*of_block, "rows_before", carried("time"))
    cycles = _timed(_cycles(placed(starts), "rows_before", "time_before"), seed)
    along = Window.partitionBy("producer", "block").orderBy("cycle")
    along = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = cycles.select(
        "*",
        (F.col("rows_before") + F.sum("size").over(along)).alias("rows_upto"),
        (F.col("time_before") + F.sum("length").over(along)).alias("time_upto"),
    )
    offsets = F.concat(
        F.slice("elapsed", F.lit(1), F.col("burst").cast("int")), F.array("length")
    )
    return (
        ended.where(F.col("rows_upto") - F.col("size") < F.col("records"))
        .select(
            "producer",
            "records",
            (F.col("rows_upto") - F.col("size")).alias("base_row"),
            (F.col("time_upto") - F.col("length") + F.lit(start_ms)).alias("base_ts"),
            F.posexplode(offsets).alias("j", "offset"),
        )
        .select(
            "producer",
            (F.col("base_row") + F.col("j")).alias("row"),
            (F.col("base_ts") + F.col("offset")).alias("ts"),
            "records",
        )
        .where("row < records")
        .drop("records")
    )


def with_fields(rows: DataFrame, fields, seed: int, keys: int = KEYS) -> DataFrame:
    """Add ``key`` and the random columns to ``producer, row, ts``."""
    where = (F.col("producer"), F.col("row"))
    return rows.select(
        "producer",
        "row",
        "ts",
        uniform(noise(seed, "key", *where), 0, keys).alias("key"),
        *[full_range(noise(seed, name, *where), t).alias(name) for name, t in fields],
    )


def random_source(name: str, seed: int, field_count: int = FIELDS) -> LogicalSource:
    """A source with ``ts``, ``key`` and randomly typed fields ``f0, f1, ...``."""
    rng = random.Random(f"{seed}/{name}")
    drawn = [(f"f{i}", rng.choice(FIELD_TYPES)) for i in range(field_count)]
    return LogicalSource(name, (("ts", "INT64"), ("key", "INT64"), *drawn))


@dataclass(frozen=True)
class GeneratedSource:
    source: LogicalSource
    frame: DataFrame  # producer, row, ts, key, fields


def generate_source(
    spark: SparkSession,
    source: LogicalSource,
    seed: int,
    producers: int = PRODUCERS,
    records: int = RECORDS,
) -> GeneratedSource:
    own = column_seed(seed, source.name)
    listed = spark.range(producers).select(
        F.col("id").alias("producer"), F.lit(records).cast("bigint").alias("records")
    )
    fields = [f for f in source.fields if f[0] not in ("ts", "key")]
    return GeneratedSource(source, with_fields(bursty_rows(listed, own), fields, own))


def generate_sources(
    spark: SparkSession,
    seed: int,
    count: int = SOURCES,
    producers: int = PRODUCERS,
    records: int = RECORDS,
    field_count: int = FIELDS,
) -> list[GeneratedSource]:
    """``count`` random sources, each fed by ``producers`` producers."""
    named = [random_source(f"source-{i}", seed, field_count) for i in range(count)]
    return [generate_source(spark, s, seed, producers, records) for s in named]


def write_producers(
    generated: GeneratedSource, path: str, producers: int | None = None
) -> list[str]:
    """Write one CSV folder with header per producer; returns their paths.

    The list of paths is as long as the list of producers.  With their number given they are not
    looked for in the rows.
    """
    frame = generated.frame.drop("row")
    frame.write.partitionBy("producer").option("header", True).csv(path)
    if producers is not None:
        return [f"{path}/producer={i}" for i in range(producers)]
    known = frame.select("producer").distinct().orderBy("producer").collect()
    return [f"{path}/producer={r.producer}" for r in known]
