"""Splitting a frame by a predicate and putting the parts together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.functions import arith


def branches(df: DataFrame, predicate: str) -> list[DataFrame]:
    """Rows where the predicate is true, false and NULL.  The three cover every row once."""
    return [
        df.where(condition)
        for condition in (predicate, arith.negate(predicate), arith.is_null(predicate))
    ]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union: every row of every frame, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def tagged(df: DataFrame, predicate: str, tag: str = "branch") -> DataFrame:
    """The same three parts as a column, so that one scan serves all of them."""
    return df.withColumn(
        tag, F.expr(f"CASE WHEN ({predicate}) THEN 0 WHEN NOT ({predicate}) THEN 1 ELSE 2 END")
    )
