"""Sums of 64-bit integers that neither overflow nor depend on row order.

A plain ``sum(bigint)`` overflows on full-range data and a decimal sum
allocates a big number per row.  Here a value is cut into three limbs whose
bigint sums stay in range for 2^42 rows per group; all of it runs on primitive
longs inside generated code, and one decimal per *group* puts the limbs back
together.  Sums that are to be merged carry over first: their lower limbs are short
again and a fourth one takes what goes beyond, so any number of parts can be
added up.

Doubles are summed the same way once they are sorted into bins of ``BIN_BITS`` binary
exponents: within its bin a double is a bigint.  A group has as many bins as its values
span, at most some 270.  Bin sums are exact, so their total, taken from the highest bin down,
is the same however the rows were split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 21
LIMBS = 3
BIN_BITS = 8
DIGITS = 53  # bits of a double's mantissa
_MASK = (1 << BITS) - 1


def unscaled(value: Column, scale: int) -> Column:
    """A double that really holds a decimal of ``scale`` digits, as a bigint."""
    if scale == 0:
        return value.cast("bigint")
    return F.rint(value * F.lit(float(10**scale))).cast("bigint")


def limbs(value: Column) -> list[Column]:
    """The three limbs of a bigint, lowest first; only the top one carries the sign."""
    mask = F.lit(_MASK).cast("bigint")
    return [
        value.bitwiseAND(mask),
        F.shiftright(value, BITS).bitwiseAND(mask),
        F.shiftright(value, 2 * BITS),
    ]


def carried(sums: list[Column]) -> list[Column]:
    """Sums of three or four limbs as four: all but the last are limbs of ``BITS`` bits again.

    They stand for the same number.  The fourth counts multiples of 2^63.
    """
    mask = F.lit(_MASK).cast("bigint")
    low, mid, top = sums[:3]
    mid = mid + F.shiftright(low, BITS)
    top = top + F.shiftright(mid, BITS)
    over = F.shiftright(top, BITS)
    return [
        low.bitwiseAND(mask),
        mid.bitwiseAND(mask),
        top.bitwiseAND(mask),
        over + sums[3] if len(sums) > 3 else over,
    ]


def combine(sums: list[Column], into: str = "decimal(38,0)") -> Column:
    """Limb sums, three or four, back to one number of type ``into``.

    Nearly every group fits a bigint; the decimal form is evaluated only for
    the ones whose estimate is not safely within its range.
    """
    low, *higher = sums
    step = F.lit(1 << BITS).cast("bigint")
    safe = F.lit(float(2**62))
    rough = F.lit(float(1 << BITS))
    factor = F.lit(1 << BITS).cast("decimal(8,0)")
    estimate, short, long = (c(higher[-1]) for c in (_double, _plain, _wide))
    for s in reversed(higher[:-1]):
        estimate = _double(s) + rough * estimate
        short = s + step * short
        long = _wide(s) + (long * factor).cast("decimal(38,0)")
    estimate = _double(low) + rough * estimate
    fits = (F.abs(estimate) < safe) & (_double(low) < safe)
    long = _wide(low) + (long * factor).cast("decimal(38,0)")
    return F.when(fits, (low + step * short).cast(into)).otherwise(long.cast("decimal(38,0)").cast(into))


def _plain(c: Column) -> Column:
    return c


def _double(c: Column) -> Column:
    return c.cast("double")


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def exact_sum(value: Column) -> Column:
    """Aggregate: exact sum of a bigint column as decimal(38,0)."""
    return combine([F.sum(limb) for limb in limbs(value)])


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _scaled(value: Column, exponent: Column) -> Column:
    """``value`` times a power of two, in two steps as the power itself may be out of range."""
    half = F.floor(exponent / F.lit(2))
    return value * _power(half) * _power(exponent - half)


def bin_of(value: Column) -> Column:
    """Bin of a finite double; NULL, NaN and infinities have none.

    The logarithm may be off by its last bit next to a power of two: bins hold one exponent more on
    either side.
    """
    size = F.abs(value)
    own = F.floor(F.log2(size) / F.lit(BIN_BITS)).cast("int")
    finite = size < F.lit(float("inf"))  # NaN is greater than all
    return F.when(finite, F.when(size == 0, F.lit(0)).otherwise(own))


def within_bin(value: Column, own: Column) -> Column:
    """A double in units of its bin: a bigint below 2^62."""
    return F.when(own.isNotNull(), _scaled(value, F.lit(DIGITS) - own * F.lit(BIN_BITS))).cast("bigint")


def total(bins: Column) -> Column:
    """Sum of ``bins``, an array of structs ``bin, sum0 .. sum3``; NULL if it has no bin.

    Adds up from the highest bin down with twice the digits of a double: the nearest double, unless
    bins cancel each other to less than 2^-50 of the greatest one.
    """
    nothing = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"))
    held = F.sort_array(F.filter(bins, lambda b: b["bin"].isNotNull()), asc=False)
    top = F.get(held, F.lit(0))["bin"]

    def terms(b: Column) -> Column:
        lower = (b["bin"] - top) * F.lit(BIN_BITS)
        return F.array(*[_double(b[f"sum{i}"]) * _power(lower + F.lit(i * BITS)) for i in range(LIMBS, -1, -1)])

    def add(so_far: Column, term: Column) -> Column:
        high = so_far["high"] + term
        kept = high - so_far["high"]
        lost = (so_far["high"] - (high - kept)) + (term - kept)
        return F.struct(high.alias("high"), (so_far["low"] + lost).alias("low"))

    added = F.aggregate(F.flatten(F.transform(held, terms)), nothing, add, lambda t: t["high"] + t["low"])
    return F.when(top.isNotNull(), _scaled(added, top * F.lit(BIN_BITS) - F.lit(DIGITS)))
