"""SimHash fingerprints and all links within a Hamming radius, by covering LSH.

Fingerprints are made row by row.  Then only *different* fingerprints are compared, so copies cost
nothing.  Covering masks: each of the 64 bits gets a vector of r + 1 bits, ``m(i)``; table ``v``
(any non-zero vector) keeps the bits with an odd product ``<m(i), v>``.  Up to r differing bits
span at most r dimensions, so some ``v`` is orthogonal to all of them and the pair agrees in that
table: no pair within the radius is missed.

A bucket is a mask and the kept bits.  Buckets of two are compared in the aggregation that finds
them; buckets up to ``BUCKET`` fingerprints are linked inside one row; larger ones are divided
again by covering masks over the bits that are still free, until all are small.  A pair of a divided
bucket is met again in one of its parts, by the same argument.  So neither tasks nor rows grow with
a hot bucket, and links are exact at any size.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.llm.common import binary_text
from equivcheck.llm.components import components
from equivcheck.session import written

SHINGLE = 4
RADIUS = 4
SEED = 42  # of XXH64
BUCKET = 20_000  # fingerprints compared inside one row, 160 KB
CHUNK = 65_536  # shingles whose bits are counted at a time


def shingles(text: bytes, size: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text in pieces; a shorter text is one shingle, a blank one none."""
    parts = text.lower().split()  # bytes: A-Z only, and the white space of the word rule
    if not parts:
        return
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - size + 1)
    lo, hi = starts[:n].tolist(), ends[len(parts) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(lo[at : at + CHUNK], hi[at : at + CHUNK], strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of one text, signed; a bit is set if more than half of the hashes set it."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingles(text, size):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    value = 0
    for bit in np.flatnonzero(counts * 2 > n).tolist():
        value |= 1 << bit
    return value - (1 << 64) if value >> 63 else value


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE
) -> DataFrame:
    """``(id, fp)`` for every row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), size) for x in batch.column(1)]
            columns = [batch.column(0), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp"])

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_column].dataType), T.StructField("fp", T.LongType())]
    )
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), binary_text(F.col(f"`{text}`")).alias("text"))
    return narrow.mapInArrow(scan, schema)


def masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """Covering masks over 64 bits, signed.  Levels give the bits other vectors."""
    width = radius + 1
    # First level: balanced vectors.  Deeper ones: any vectors will do, as long as they differ.
    draw = random.Random(level)
    vector = [draw.randrange(1, 1 << width) if level else i % (1 << width) for i in range(64)]
    out = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i in range(64) if bin(vector[i] & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def local_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the values that a chain of steps within the radius joins.

    A search that compares each reached value with those not yet reached: in dense buckets nearly
    all are reached at once, and never are more links made than values.
    """
    rest = np.unique(values).view(np.uint64)
    heads, tails = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            reached = rest[near]
            rest = rest[~near]
            queue.extend(reached)
            tails.append(reached)
            heads.append(np.full(len(reached), root))
    if not heads:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [local_links(np.array(x.as_py(), np.int64), radius) for x in batch.column(0)]
            a = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)])
            b = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.select("fps").mapInArrow(scan, "a long, b long")


def _dealt(rows: DataFrame, kept: Column, radius: int, level: int) -> DataFrame:
    """Each fingerprint once per mask, with the bits that the bucket keeps."""
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius, level)]))
    dealt = rows.select("fp", kept.alias("kept"), mask.alias("mask"))
    bits = F.col("kept").bitwiseOR(F.col("mask"))
    return dealt.select(bits.alias("bits"), F.col("fp").bitwiseAND(bits).alias("key"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``(a, b)`` of different ``fp`` values whose closure is that of all pairs in the radius."""
    base = fps.select("fp").where("fp is not null").distinct()
    rows = _dealt(base, F.lit(0).cast("long"), radius, 0)
    found, level = [], 0
    keys = ["bits", "key"]
    while True:
        sizes = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        sizes = written(sizes.where("n > 1"), "buckets")
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        found.append(sizes.where((F.col("n") == 2) & (apart <= radius)).select("a", "b"))
        middle = sizes.where(F.col("n").between(3, bucket)).select(*keys)
        gathered = rows.join(middle, keys).groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
        found.append(_linked(gathered, radius))
        large = sizes.where(F.col("n") > bucket).select(*keys)
        if not large.take(1):
            break
        level += 1
        parts = rows.join(large, keys).select("fp", F.col("bits").alias("kept"))
        rows = written(_dealt(parts, F.col("kept"), radius, level).distinct(), "parts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    bucket: int = BUCKET,
    size: int = SHINGLE,
) -> DataFrame:
    """``(id, fp, component_id)`` of every row: the least id that links within the radius reach.

    Null, empty and blank texts have fingerprint 0 and are linked like any other.  Repeated rows
    come out as often as they come in.  A null id is never a component's name unless the component
    has no other.  An empty table gives no rows.
    """
    made = written(fingerprints(docs, id_column, text, size), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(links(classes, radius, bucket))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "component_id"), "classes")
    return made.join(named, "fp").select("id", "fp", "component_id")


def survivors(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    size: int = SHINGLE,
) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Rows without an id pass unchanged, as they cannot be named.  Where rows share the id that
    stays, the least of them by the other columns' text stays.  Columns may have any names.
    """
    groups = near_duplicates(docs, id_column, text, radius, size=size)
    stay = groups.where("id = component_id").select("id").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), whole.alias("row"))
    kept = rows.join(stay, "id", "left_semi")
    # Ids are unique but for repeated rows: only those are ordered by their content.
    digest = F.sha2(F.to_json("row").cast("binary"), 256)
    once = kept.groupBy("id").agg(F.min(F.struct(digest.alias("digest"), "row")).alias("least"))
    return once.select("least.row.*").unionByName(docs.where(F.col(f"`{id_column}`").isNull()))
