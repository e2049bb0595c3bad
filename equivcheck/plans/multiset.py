"""Digest of a bag of rows, taken while a result is written.

The digest is the number of rows and two sums, modulo 2^64, of hashes of each row.  Sums neither
depend on the order of rows nor on how they are dealt out, and those of parts add up; equal bags have
equal digests.  Unequal bags have the same one with a chance of about 2^-128, so two written results
with equal digests need not be read again.  Different digests say nothing about *how* results differ:
they, and results that agree within tolerance only, go on to the exact comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck import types
from equivcheck.functions import exact


@dataclass(frozen=True)
class Digest:
    """``classes`` are the column classes that comparisons ask for."""

    classes: tuple
    rows: int
    sums: tuple[int, int]

    def __add__(self, other: Digest) -> Digest:
        """The digest of two bags put together."""
        if self.classes != other.classes:
            raise ValueError("column classes differ")
        sums = tuple((a + b) % 2**64 for a, b in zip(self.sums, other.sums, strict=True))
        return Digest(self.classes, self.rows + other.rows, sums)


def _values(df: DataFrame) -> list[Column]:
    """Columns in a form in which equal values of one class have equal hashes, and what is NULL."""
    values = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif types.is_float(f.dataType):
            column = column.cast("double")
        values.append(column)
    return [*values, *[v.isNull() for v in values]]  # hashes pass over NULLs


def measures(df: DataFrame) -> dict[str, Column]:
    """Aggregates of the digest: they are plain sums of longs, up to 2^42 rows."""
    values = _values(df)
    hashes = (F.xxhash64(*values), F.xxhash64(F.lit("again"), *reversed(values)))
    out = {"rows": F.count(F.lit(1))}
    for i, h in enumerate(hashes):
        out |= {f"h{i}_{k}": F.coalesce(F.sum(limb), F.lit(0)) for k, limb in enumerate(exact.limbs(h))}
    return out


def _classes(df: DataFrame) -> tuple:
    return tuple(types.value_class(f.dataType) for f in df.schema)


def _digest(classes: tuple, found: dict) -> Digest:
    sums = tuple(sum(found[f"h{i}_{k}"] << exact.BITS * k for k in range(exact.LIMBS)) % 2**64 for i in range(2))
    return Digest(classes, found["rows"], sums)


def digest(df: DataFrame) -> Digest:
    """The digest of a frame, by a pass of its own."""
    row = df.agg(*[c.alias(n) for n, c in measures(df).items()]).first()
    return _digest(_classes(df), row.asDict())


def write(df: DataFrame, path: str, mode: str = "overwrite") -> Digest | None:
    """Write ``df`` as Parquet and return its digest, both in one pass.

    Nothing where the plan was cut to one without rows, which Spark does not observe.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in measures(df).items()]).write.mode(mode).parquet(path)
    found = seen.get
    return _digest(_classes(df), found) if "rows" in found else None
