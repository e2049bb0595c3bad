"""CSV and Parquet sources and sinks, and result files whose header carries types."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from equivcheck import types
from equivcheck.operators.split import union_all


def read_producers(
    spark: SparkSession, schema: T.StructType, paths: Sequence[str], header: bool = True
) -> DataFrame:
    """A logical source fed by several CSV producers: one scan over all paths.

    A value that does not fit its declared type fails the query instead of
    turning into a NULL that would compare equal on both sides.
    """
    reader = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
    return reader.csv(list(paths))


def stream_producers(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The same as a stream over a folder that producers write CSV files to, as strict."""
    reader = spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST")
    return reader.csv(path)


def stream_each_producer(
    spark: SparkSession, schema: T.StructType, paths: Sequence[str], files_per_trigger: int | None = None
) -> list[DataFrame]:
    """A stream for each producer's folder, so that each can have a watermark of its own."""
    reader = spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return [reader.csv(path) for path in paths]


def merge_producers(frames: Sequence[DataFrame]) -> DataFrame:
    """Producers that are frames already, by column name."""
    return union_all(list(frames))


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Sink of a query, read back from where it was written."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
        return read_producers(df.sparkSession, df.schema, [path])
    writer.format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


# Form of a header field, stream$name:TYPE
_HEADER_FIELD = re.compile(r"([^$]*)\$([^:]*):(.+)")


def header_fields(columns: Sequence[str]) -> T.StructType:
    """Schema from typed header fields; a malformed field or unknown type is an error."""
    fields = []
    for column in columns:
        match = _HEADER_FIELD.fullmatch(column)
        if not match:
            raise ValueError(f"header field without stream, name and type: {column!r}")
        _, name, type_name = match.groups()
        fields.append(T.StructField(name, types.from_header(type_name)))
    return T.StructType(fields)


def read_typed_csv(
    spark: SparkSession, path: str | Sequence[str], unsigned: Sequence[str] = ()
) -> DataFrame:
    """Read result files by the types in their header.

    The header does not tell signed from unsigned: name the fields that may
    exceed a signed 64-bit integer in ``unsigned``.  A file whose header differs from that of the
    others fails the query.
    """
    paths = [path] if isinstance(path, str) else list(path)
    header = spark.read.option("header", True).csv(paths).columns
    named = header_fields(header)
    schema = T.StructType(
        [
            T.StructField(f.name, T.DecimalType(20, 0) if f.name in unsigned else f.dataType)
            for f in named
        ]
    )
    # Columns keep their header text while reading, so that each file's header is checked.
    texts = T.StructType([T.StructField(h, f.dataType) for h, f in zip(header, schema)])
    reader = spark.read.schema(texts).option("header", True).option("mode", "FAILFAST")
    return reader.option("enforceSchema", False).csv(paths).toDF(*schema.names)


def write_typed_csv(df: DataFrame, path: str, stream: str) -> None:
    """Write CSV files with a typed header."""
    typed = [f"{stream}${f.name}:{types.to_header(f.dataType)}" for f in df.schema]
    df.toDF(*typed).write.mode("overwrite").option("header", True).csv(path)
