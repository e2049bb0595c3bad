"""The driver's tables as logical sources: event time in epoch milliseconds, key, values.

Each table is read with an explicit schema of the needed columns.  Their time
columns hold no zone; read as ``timestamp`` their value is the UTC instant, so
epoch milliseconds do not depend on the session's time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSource:
    """``values`` maps a value column to the decimal digits it really holds."""

    table: str
    ts: str
    key: str
    values: dict[str, int]
    extra: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> str:
        columns = [
            *self.extra,
            (self.ts, "TIMESTAMP"),
            (self.key, "BIGINT"),
            *((v, "DOUBLE") for v in self.values),
        ]
        return ", ".join(f"{name} {dtype}" for name, dtype in columns)

    def shaped(self, raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``ts`` (epoch ms), ``key`` and the value columns, and ``keep`` in front."""
        return raw.select(
            *keep,
            F.unix_millis(self.ts).alias("ts"),
            F.col(self.key).alias("key"),
            *self.values,
        )

    def read(self, spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
        raw = spark.read.schema(self.schema).parquet(f"{sf_dir}/{self.table}.parquet")
        return self.shaped(raw, keep)

    def stream(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # A pattern, as a stream source takes a folder or a pattern but no single file.
        path = f"{sf_dir}/{self.table}.parque[t]"
        return self.shaped(spark.readStream.schema(self.schema).parquet(path))


EVENTS = TableSource("events", "ts", "user_id", {"value": 2}, (("event_id", "BIGINT"),))
LINEITEM = TableSource(
    "lineitem", "l_shipdate", "l_suppkey", {"l_quantity": 2, "l_extendedprice": 2}
)
ORDERS = TableSource(
    "orders", "o_orderdate", "o_custkey", {"o_totalprice": 2}, (("o_orderkey", "BIGINT"),)
)
TABLES = {t.table: t for t in (EVENTS, LINEITEM, ORDERS)}
