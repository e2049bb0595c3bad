"""min, max, sum, count and avg as direct aggregates and as partial, merge, final steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck import types
from equivcheck.functions import exact

AGGREGATES = ("min", "max", "sum", "count", "avg")

BIN = "value_bin"


@dataclass(frozen=True)
class Measure:
    """One aggregate over one field.

    ``scale`` says that a double field really holds decimals with that many
    digits; its sums are then exact.  Integers are always summed exactly.  Other
    doubles are ``binned``: ``with_bin`` adds a column to group by as well in the partial
    and the merging step, and ``collapse`` puts the bins of a group together before the
    final one.  Their ``direct`` form, in one step, depends on the order of rows.
    """

    agg: str
    field: str
    dtype: T.DataType
    scale: int | None = None

    def __post_init__(self):
        if self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg!r}")

    @property
    def name(self) -> str:
        return "count" if self.agg == "count" else self.field

    @property
    def _digits(self) -> int | None:
        """Scale of the bigint the field is summed as, None when it is summed as it is."""
        if isinstance(self.dtype, T.IntegralType):
            return 0
        return self.scale if types.is_float(self.dtype) else None

    @property
    def binned(self) -> bool:
        return self.agg in ("sum", "avg") and self._digits is None and types.is_float(self.dtype)

    def with_bin(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BIN, exact.bin_of(F.col(self.field).cast("double")))

    def direct(self) -> dict[str, Column]:
        """The aggregate in one step, under the name of its result."""
        col = F.col(self.field)
        if self.agg == "count":
            value = F.count(F.lit(1))
        elif self.agg == "min":
            value = F.min(col)
        elif self.agg == "max":
            value = F.max(col)
        elif self.agg == "sum":
            value = self._sum_value(list(self._sum_parts().values()))
        elif self._digits is None and not isinstance(self.dtype, T.DecimalType):
            value = F.avg(col)
        else:
            # The exact sum, divided once: avg(bigint) would add up doubles.
            sums = list(self._sum_parts().values())
            value = self._avg_value(sums, F.count(col))
        return {self.name: value}

    def partial(self) -> dict[str, Column]:
        """First step: what one part of the rows contributes."""
        if self.agg in ("min", "max", "count"):
            return self.direct()
        if self.binned:
            return self._binned_parts()
        parts = self._sum_parts()
        if self._digits is not None:
            parts = self._limbs(exact.carried(list(parts.values())))
        if self.agg == "avg":
            parts["count"] = F.count(F.col(self.field))
        return parts

    def merge(self) -> dict[str, Column]:
        """Second step: contributions put together, under the same names."""
        if self.agg == "min":
            return {self.name: F.min(F.col(self.name))}
        if self.agg == "max":
            return {self.name: F.max(F.col(self.name))}
        sums = {name: F.sum(F.col(name)) for name in self.partial()}
        if self.agg == "count" or (self._digits is None and not self.binned):
            return sums
        limbs = [c for name, c in sums.items() if name not in ("count", "special")]
        return sums | self._limbs(exact.carried(limbs))

    def collapse(self) -> dict[str, Column]:
        """Step between merging and the result of a binned measure: the bins of a group as one list."""
        parts = {name: F.sum(name) for name in ("special", "count") if name in self.partial()}
        limbs = [f"sum{i}" for i in range(exact.LIMBS + 1)]
        return {"bins": F.array_agg(F.struct(F.col(BIN).alias("bin"), *limbs))} | parts

    def final(self) -> dict[str, Column]:
        """Last step: the result from the merged columns."""
        if self.agg in ("min", "max", "count"):
            return {self.name: F.col(self.name)}
        if self.binned:
            value = F.coalesce("special", exact.total(F.col("bins")))
            return {self.name: value if self.agg == "sum" else F.try_divide(value, F.col("count"))}
        sums = [F.col(n) for n in self.partial() if n != "count"]
        if self.agg == "sum":
            return {self.name: self._sum_value(sums)}
        return {self.name: self._avg_value(sums, F.col("count"))}

    def _avg_value(self, sums: list[Column], count: Column) -> Column:
        if self._digits is None:
            return F.try_divide(sums[0].cast("double"), count)
        total = F.try_divide(exact.combine(sums, "double"), count)
        return total / F.lit(float(10**self._digits))

    def _binned_parts(self) -> dict[str, Column]:
        value = F.col(self.field).cast("double")
        cut = exact.limbs(exact.within_bin(value, F.col(BIN)))
        parts = self._limbs(exact.carried([F.sum(limb) for limb in cut]))
        # NaN and infinities: their plain sum does not depend on order.
        parts["special"] = F.sum(F.when(F.col(BIN).isNull(), value))
        if self.agg == "avg":
            parts["count"] = F.count(value)
        return parts

    def _sum_parts(self) -> dict[str, Column]:
        col = F.col(self.field)
        if self._digits is not None:
            cut = exact.limbs(exact.unscaled(col, self._digits))
            return self._limbs([F.sum(limb) for limb in cut])
        if isinstance(self.dtype, T.DecimalType):
            col = col.cast(T.DecimalType(38, self.dtype.scale))
        return {"sum": F.sum(col)}

    @staticmethod
    def _limbs(sums: list[Column]) -> dict[str, Column]:
        return {f"sum{i}": s for i, s in enumerate(sums)}

    def _sum_value(self, sums: list[Column]) -> Column:
        """Sums of parts as one value: both sides of a relation declare the same type."""
        if self._digits is None:
            is_decimal = isinstance(self.dtype, T.DecimalType)
            return sums[0].cast(T.DecimalType(38, self.dtype.scale)) if is_decimal else sums[0]
        if not types.is_float(self.dtype):
            return exact.combine(sums)
        return exact.combine(sums, "double") / F.lit(float(10**self._digits))
