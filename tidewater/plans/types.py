"""The dialect's types: what two operands have in common."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import CoercionError

#: Integers by width. Spark reads unsigned Parquet integers of 8 to 32 bits as the next wider signed one.
INTEGERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
FLOAT, DOUBLE = T.FloatType(), T.DoubleType()
NUMBERS = (*INTEGERS, FLOAT, DOUBLE)
#: Points in time, from the coarsest on; a date meets a timestamp as one at midnight.
TIMES = (T.DateType(), T.TimestampNTZType(), T.TimestampType())
#: What CAST takes, besides DECIMAL(p, s).
NAMED = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": FLOAT, "REAL": FLOAT, "DOUBLE": DOUBLE,
    "VARCHAR": T.StringType(), "STRING": T.StringType(), "TEXT": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
}


def type_of(name: str) -> T.DataType:
    """The type that a CAST names."""
    head, _, sizes = name.upper().partition("(")
    if head in ("DECIMAL", "NUMERIC") and sizes:
        precision, _, scale = sizes.rstrip(")").partition(",")
        if int(precision) > 38 or int(scale or 0) > int(precision):
            raise CoercionError(f"no type {name}")
        return T.DecimalType(int(precision), int(scale or 0))
    if head not in NAMED or (sizes and head != "VARCHAR"):
        raise CoercionError(f"no type {name}")
    return NAMED[head]


def is_integer(t: T.DataType) -> bool:
    return t in INTEGERS


def is_float(t: T.DataType) -> bool:
    return t in (FLOAT, DOUBLE)


def common_type(left: T.DataType, right: T.DataType, strict: bool = False) -> T.DataType:
    """The type both operands are cast to. Integers widen; with a float, integers of up to 32 bits become floats;
    anything numeric with a double becomes double. A bigint and a float have no common type in strict mode and
    meet as doubles otherwise. NULL takes the other's type, a date with a timestamp becomes one. All other mixtures are errors."""
    if left == right:
        return left
    if T.NullType() in (left, right):
        return right if left == T.NullType() else left
    if left in TIMES and right in TIMES:
        return TIMES[max(TIMES.index(left), TIMES.index(right))]
    if is_integer(left) and is_integer(right):
        return INTEGERS[max(INTEGERS.index(left), INTEGERS.index(right))]
    if left in NUMBERS and right in NUMBERS:
        if DOUBLE in (left, right):
            return DOUBLE
        if T.LongType() not in (left, right):
            return FLOAT
        if not strict:
            return DOUBLE
    raise CoercionError(f"no common type of {left.simpleString()} and {right.simpleString()}")
