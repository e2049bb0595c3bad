"""Declared type names, the Spark types that hold them, and their comparison classes."""

from __future__ import annotations

from pyspark.sql import types as T

# Declared names of a source schema.  An unsigned type is held in
# the next wider signed one; 64 unsigned bits need a decimal.
DECLARED = {
    "BOOL": T.BooleanType(),
    "CHAR": T.StringType(),
    "TEXT": T.StringType(),
    "INT8": T.ByteType(),
    "INT16": T.ShortType(),
    "INT32": T.IntegerType(),
    "INT64": T.LongType(),
    "UINT8": T.ShortType(),
    "UINT16": T.IntegerType(),
    "UINT32": T.LongType(),
    "UINT64": T.DecimalType(20, 0),
    "FLOAT32": T.FloatType(),
    "FLOAT64": T.DoubleType(),
}

# Types named in the header of a result file.
IN_HEADER = {
    "integer(8 bits)": T.ByteType(),
    "integer(16 bits)": T.ShortType(),
    "integer(32 bits)": T.IntegerType(),
    "integer(64 bits)": T.LongType(),
    "float(32 bits)": T.FloatType(),
    "float(64 bits)": T.DoubleType(),
}

# Inclusive value range of every integer type.
INT_RANGE = {
    f"{'U' if unsigned else ''}INT{bits}": (
        (0, 2**bits - 1) if unsigned else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    )
    for bits in (8, 16, 32, 64)
    for unsigned in (False, True)
}


def declared(name: str) -> T.DataType:
    try:
        return DECLARED[name]
    except KeyError:
        raise ValueError(f"unknown declared type {name!r}") from None


def from_header(name: str) -> T.DataType:
    try:
        return IN_HEADER[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown result type {name!r}") from None


def to_header(dtype: T.DataType) -> str:
    """Header type of a column; wide integers are written as 64 bits."""
    for name, held in IN_HEADER.items():
        if held == dtype:
            return name.upper().replace("BITS", "bits")
    if is_int(dtype):
        return "INTEGER(64 bits)"
    raise ValueError(f"no header type for {dtype.simpleString()}")


def is_int(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0
    )


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def value_class(dtype: T.DataType) -> str:
    """Columns of two results may be compared when their classes agree."""
    if is_int(dtype):
        return "Int"
    if is_float(dtype):
        return "Float"
    if isinstance(dtype, T.DecimalType):
        return "Decimal"
    return dtype.simpleString()


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two columns of one class are compared."""
    if a == b:
        return a
    if is_int(a):
        wide = any(isinstance(t, T.DecimalType) for t in (a, b))
        return T.DecimalType(38, 0) if wide else T.LongType()
    if is_float(a):
        return T.DoubleType()
    if isinstance(a, T.DecimalType):
        return T.DecimalType(38, max(a.scale, b.scale))
    return a
