"""Running sums and maxima over groups of any size.

A window function puts a whole group into one task.  Where a group may be
large, its rows also carry a ``block`` that rises with the order: rows are
scanned within their block, block totals are scanned within the group (one row
per block), and the two are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "max_before": F.max}


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, str]],
    block: str | None = None,
) -> DataFrame:
    """Add ``outputs[name] = (sum|max, column)`` as inclusive running values along ``order``.

    ``max_before`` leaves the row itself out.
    """
    along = Window.partitionBy(*group, *([block] if block else [])).orderBy(*order)

    def inner(how: str):
        last = -1 if how == "max_before" else Window.currentRow
        return along.rowsBetween(Window.unboundedPreceding, last)

    scanned = df.select(
        "*", *[_AGG[how](col).over(inner(how)).alias(name) for name, (how, col) in outputs.items()]
    )
    if block is None:
        return scanned

    totals = df.groupBy(*group, block).agg(
        *[_AGG[how](col).alias(f"{name}__total") for name, (how, col) in outputs.items()]
    )
    before = Window.partitionBy(*group).orderBy(block)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group,
        block,
        *[
            _AGG[how](f"{name}__total").over(before).alias(f"{name}__before")
            for name, (how, _) in outputs.items()
        ],
    )
    keys = [*group, block]
    renamed = carried.withColumnsRenamed({k: f"{k}__key" for k in keys})
    same = [
        scanned[k].eqNullSafe(renamed[f"{k}__key"])
        if scanned.schema[k].nullable
        else scanned[k] == renamed[f"{k}__key"]
        for k in keys
    ]
    # Totals grow with the rows, so they are merged in and never broadcast.
    joined = scanned.join(renamed.hint("merge"), same, "inner")

    def total(name: str, how: str) -> Column:
        here, earlier = F.col(name), F.col(f"{name}__before")
        return here + F.coalesce(earlier, F.lit(0)) if how == "sum" else F.greatest(here, earlier)

    return joined.select(
        *df.columns, *[total(name, how).alias(name) for name, (how, _) in outputs.items()]
    )
