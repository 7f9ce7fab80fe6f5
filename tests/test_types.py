"""The coercion table, all pairs."""

import itertools

import pytest
from pyspark.sql import types as T

from tidewater.errors import CoercionError
from tidewater.plans.types import common_type, type_of

B, S, I, L, F, D = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
OTHERS = [T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.DecimalType(10, 2), T.BinaryType()]
EXPECTED = {
    (B, S): S, (B, I): I, (B, L): L, (S, I): I, (S, L): L, (I, L): L,
    (B, F): F, (S, F): F, (I, F): F, (L, F): D,
    (B, D): D, (S, D): D, (I, D): D, (L, D): D, (F, D): D,
}


@pytest.mark.parametrize("pair", EXPECTED)
def test_numbers(pair):
    assert common_type(*pair) == common_type(*reversed(pair)) == EXPECTED[pair]
    assert common_type(pair[0], pair[0]) == pair[0]


def test_strict():
    with pytest.raises(CoercionError):
        common_type(L, F, strict=True)
    assert common_type(I, F, strict=True) == F


TIMES = [T.DateType(), T.TimestampNTZType(), T.TimestampType()]


@pytest.mark.parametrize("pair", itertools.combinations(TIMES, 2))
def test_times(pair):
    assert common_type(*pair) == common_type(*reversed(pair)) == pair[1]


@pytest.mark.parametrize("kind", [*OTHERS, I, D])
def test_null(kind):
    assert common_type(kind, T.NullType()) == common_type(T.NullType(), kind) == kind


@pytest.mark.parametrize("name,kind", [("int", I), ("BIGINT", L), ("varchar(10)", T.StringType()), ("decimal(5,1)", T.DecimalType(5, 1)), ("numeric(5)", T.DecimalType(5, 0)), ("timestamp", T.TimestampNTZType())])
def test_named(name, kind):
    assert type_of(name) == kind


@pytest.mark.parametrize("name", ["money", "int(3)", "decimal", "decimal(39,1)", "decimal(3,5)"])
def test_not_named(name):
    with pytest.raises(CoercionError):
        type_of(name)


@pytest.mark.parametrize("pair", [*(p for p in itertools.combinations(OTHERS, 2) if not set(map(str, p)) <= set(map(str, TIMES))), *itertools.product(OTHERS, (B, I, L, F, D)), (T.DecimalType(10, 2), T.DecimalType(12, 2))])
def test_no_common_type(pair):
    with pytest.raises(CoercionError):
        common_type(*pair)


@pytest.mark.parametrize("kind", OTHERS)
def test_same(kind):
    assert common_type(kind, kind) == kind
