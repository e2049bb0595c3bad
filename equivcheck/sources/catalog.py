"""The schema catalogue: declared logical sources, fixed per run and never inferred."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck import types


@dataclass(frozen=True)
class LogicalSource:
    """A named stream and its declared fields, as (name, declared type) pairs."""

    name: str
    fields: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, types.declared(t)) for n, t in self.fields])


# Keys of a catalogue document.
_SOURCES, _NAME, _FIELDS = "logicalSources", "logicalSourceName", "fields"


def parse_catalogue(doc: dict) -> dict[str, LogicalSource]:
    """Catalogue document to sources; unknown type names are rejected."""
    sources = {}
    for entry in doc[_SOURCES]:
        fields = tuple((f["name"], f["type"]) for f in entry[_FIELDS])
        source = LogicalSource(entry[_NAME], fields)
        source.schema  # rejects unknown types here rather than at first use
        sources[source.name] = source
    return sources


def catalogue_document(sources: Iterable[LogicalSource]) -> dict:
    return {
        _SOURCES: [
            {_NAME: s.name, _FIELDS: [{"name": n, "type": t} for n, t in s.fields]}
            for s in sources
        ]
    }


def read_catalogue(spark: SparkSession, path: str) -> dict[str, LogicalSource]:
    """Read a JSON catalogue from any file system Spark can reach."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return parse_catalogue(json.loads(text))


def write_catalogue(spark: SparkSession, sources: Iterable[LogicalSource], path: str) -> None:
    text = json.dumps(catalogue_document(sources))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def from_source(spark: SparkSession, name: str) -> DataFrame:
    """Root of a query: a registered source by its name."""
    return spark.table(name)


def out_of_range(df: DataFrame, source: LogicalSource) -> DataFrame:
    """Values outside the declared integer type, counted per field in one scan.

    Unsigned types are held in wider signed ones, which alone would let
    negative and too large values through.
    """
    ints = [(n, types.INT_RANGE[t]) for n, t in source.fields if t in types.INT_RANGE]
    wide = {n: F.col(n).cast("decimal(20,0)") for n, _ in ints}
    counts = df.agg(
        *[
            F.count_if(
                (wide[n] < F.lit(str(lo)).cast("decimal(20,0)"))
                | (wide[n] > F.lit(str(hi)).cast("decimal(20,0)"))
            ).alias(n)
            for n, (lo, hi) in ints
        ]
    )
    rows = [F.struct(F.lit(n).alias("field"), F.col(n).alias("outside")) for n, _ in ints]
    return counts.select(F.inline(F.array(*rows)))
