"""Scalar expressions as SQL text.

Text can be stored with a spec and turned into a column again by ``F.expr``.
Arithmetic never throws: overflow and division by zero give NULL, whatever the
session's ANSI setting, and the NULL rows are covered by the third branch of a
split.

Inside, ``try_add`` and its kin throw and catch an exception for every row that
overflows, at some 80 microseconds each.  Overflow is common with random
expressions, so it is ruled out beforehand by range checks and the checked
functions are left with results close to the limits.
"""

from __future__ import annotations

from pyspark.sql import types as T

from equivcheck import types

_TRY = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide", "%": "try_mod"}

# Operators by category.  Remainder and power are offered, but
# random expressions do not draw them.
ARITHMETIC = ["+", "-", "*", "/"]
RELATIONAL = ["<", "<=", ">", ">=", "=", "!="]
LOGICAL = ["AND", "OR"]


def column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value, dtype: T.DataType) -> str:
    """A typed literal.  Going through text keeps the extremes of every type exact."""
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return f"CAST('{text}' AS {dtype.simpleString()})"


def _limits(dtype: T.IntegralType) -> tuple[int, int]:
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[dtype.simpleString()]
    return -(2 ** (bits - 1)), 2 ** (bits - 1) - 1


def _narrowed(wide: str, below: str, above: str, dtype: T.DataType) -> str:
    """``wide`` cast to ``dtype``, NULL from ``below`` down and from ``above`` up."""
    held = f"least(greatest({wide}, {below}), {above})"
    return f"CAST(nullif(nullif({held}, {below}), {above}) AS {dtype.simpleString()})"


# Bounds for doubles cast to bigint: the first below the smallest, and 2^63 above.
_BELOW_LONG, _ABOVE_LONG = "-9223372036854777856D", "9223372036854775808D"

# A double estimate of a bigint result beyond this is certainly an overflow.
_SURE_OVERFLOW = "9223372036854800000D"

# Operands up to this length may be repeated in the text for the estimate.
_SHORT = 100


def arithmetic(op: str, left: str, right: str, dtype: T.DataType) -> str:
    """``left op right`` of one type in and the same type out."""
    name = dtype.simpleString()
    whole = isinstance(dtype, T.IntegralType)
    if op == "**":
        power = f"power({left}, {right})"
        if not whole:
            return f"try_cast({power} AS {name})"
        low, high = _limits(dtype)
        if name == "bigint":
            return _narrowed(power, _BELOW_LONG, _ABOVE_LONG, dtype)
        return _narrowed(power, f"{low - 1}D", f"{high + 1}D", dtype)
    call = f"{_TRY[op]}({left}, {right})"
    if op == "/":
        return call if name == "double" else f"try_cast({call} AS {name})"
    if op == "%" or types.is_float(dtype):
        return call
    if not whole:
        return f"try_cast({call} AS {name})"
    low, high = _limits(dtype)
    if name != "bigint":
        wide = f"(CAST({left} AS BIGINT) {op} CAST({right} AS BIGINT))"
        return _narrowed(wide, f"{low - 1}L", f"{high + 1}L", dtype)
    if len(left) + len(right) <= _SHORT:
        estimate = f"abs(CAST({left} AS DOUBLE) {op} CAST({right} AS DOUBLE))"
        return f"if({estimate} < {_SURE_OVERFLOW}, {call}, NULL)"
    # Repeating long operands would double the text at every level of nesting.
    wide = f"(CAST({left} AS DECIMAL(20,0)) {op} CAST({right} AS DECIMAL(20,0)))"
    return _narrowed(wide, f"{low - 1}BD", f"{high + 1}BD", dtype)


def relational(op: str, left: str, right: str) -> str:
    if op not in RELATIONAL:
        raise ValueError(f"not a relational operator: {op}")
    return f"({left} {op} {right})"


def logical(op: str, left: str, right: str) -> str:
    if op not in LOGICAL:
        raise ValueError(f"not a logical operator: {op}")
    return f"({left} {op} {right})"


def negate(predicate: str) -> str:
    return f"(NOT ({predicate}))"


def is_null(predicate: str) -> str:
    return f"(({predicate}) IS NULL)"


def absolute(operand: str, dtype: T.DataType) -> str:
    """Absolute value; the smallest integer of a type has none and gives NULL."""
    if isinstance(dtype, T.IntegralType):
        return f"abs(nullif({operand}, {literal(_limits(dtype)[0], dtype)}))"
    return f"abs({operand})"
