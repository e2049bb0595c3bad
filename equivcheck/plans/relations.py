"""The 17 equivalence relations: a query (origin) and a rewritten form of it (other).

Both sides are built from the source on their own.  Nothing is shared or cached
between them, otherwise a comparison would prove nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.operators.aggregates import BIN, Measure
from equivcheck.operators.split import branches, tagged, union_all
from equivcheck.operators.windows import rewindow, tumbling, with_bounds


@dataclass(frozen=True)
class Relation:
    code: str
    name: str
    family: str  # filter, map, agg, keyagg or winpart
    agg: str | None = None

    @property
    def uses_predicate(self) -> bool:
        return self.family != "winpart"


# The relation names stored in specs and reports.
_NAMES = """
    Filter Map
    AggMin AggMax AggSum AggCount AggAvg
    KeyAggMin KeyAggMax KeyAggSum KeyAggCount KeyAggAvg
    WinPartMin WinPartMax WinPartSum WinPartCount WinPartAvg
""".split()


def _relation(code: str, name: str) -> Relation:
    for prefix in ("KeyAgg", "WinPart", "Agg"):
        if name.startswith(prefix):
            return Relation(code, name, prefix.lower(), name.removeprefix(prefix).lower())
    return Relation(code, name, name.lower())


RELATIONS = {name: _relation(f"R{i}", name) for i, name in enumerate(_NAMES, start=1)}


@dataclass(frozen=True)
class Params:
    """What origin and others of one set share.

    ``inner_ms`` belongs to the other side of the nested windows and has to
    divide ``window_ms``.  ``keys`` are the grouping columns of keyed relations.
    """

    field: str | None = None
    scale: int | None = None
    window_ms: int | None = None
    inner_ms: int | None = None
    keys: tuple[str, ...] = ()
    expr: str | None = None


def _measure(rel: Relation, df: DataFrame, p: Params) -> Measure:
    field = p.field if p.field else df.columns[0]
    return Measure(rel.agg, field, df.schema[field].dataType, p.scale)


def _keys(rel: Relation, p: Params) -> Sequence[str]:
    return (p.keys or ("key",)) if rel.family == "keyagg" else ()


def _mapped(df: DataFrame, p: Params) -> DataFrame:
    return df.withColumn("new_value", F.expr(p.expr))


def _visible(df: DataFrame) -> DataFrame:
    """The streaming time column is a copy of ``ts`` and no part of a result."""
    return df.drop("event_time") if df.isStreaming else df


def origin(rel: Relation, df: DataFrame, p: Params) -> DataFrame:
    if rel.family == "filter":
        return _visible(df)
    if rel.family == "map":
        return _visible(_mapped(df, p))
    measure, keys = _measure(rel, df, p), _keys(rel, p)
    if measure.binned:
        parts = tumbling(measure.with_bin(df), p.window_ms, measure.partial(), [*keys, BIN])
        whole = rewindow(parts, p.window_ms, measure.collapse(), keys)
        return with_bounds(whole, keys, measure.final())
    out = tumbling(df, p.window_ms, measure.direct(), keys)
    return with_bounds(out, keys, {measure.name: F.col(measure.name)})


def other(
    rel: Relation,
    df: DataFrame,
    p: Params,
    predicate: str | None = None,
    mode: str = "union",
) -> DataFrame:
    """The rewritten form.

    ``mode="union"`` scans the source once per branch of the predicate;
    ``mode="tagged"`` scans it once and groups by the branch as well.
    """
    if rel.family == "filter":
        return _visible(union_all(branches(df, predicate)))
    if rel.family == "map":
        return _visible(union_all([_mapped(b, p) for b in branches(df, predicate)]))

    measure, keys = _measure(rel, df, p), _keys(rel, p)
    by = [*keys, BIN] if measure.binned else keys
    if measure.binned:
        df = measure.with_bin(df)
    if rel.family == "winpart":
        if p.window_ms % p.inner_ms:
            raise ValueError(f"{p.inner_ms} ms does not divide {p.window_ms} ms")
        parts = tumbling(df, p.inner_ms, measure.partial(), by)
    elif mode == "tagged":
        parts = tumbling(tagged(df, predicate), p.window_ms, measure.partial(), ["branch", *by])
    else:
        parts = union_all(
            [tumbling(b, p.window_ms, measure.partial(), by) for b in branches(df, predicate)]
        )
    merged = rewindow(parts, p.window_ms, measure.merge(), by)
    if measure.binned:
        merged = rewindow(merged, p.window_ms, measure.collapse(), keys)
    return with_bounds(merged, keys, measure.final())
