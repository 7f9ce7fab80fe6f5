"""Expressions of the dialect to Spark columns, with every cast spelled out.

Spark would type these operations differently (int / int is a double, int + float too, division by zero raises), so
each operation is built on operands of one known type, bottom up. Catalyst folds and compiles the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CoercionError, ColumnNotFoundError, LiteralError, PredicateTypeError
from .ir import Among, Binary, Call, Case, Cast, Expr, Like, Literal, Name, Unary
from .types import NUMBERS, common_type, is_float, is_integer, type_of

BOOLEAN, STRING = T.BooleanType(), T.StringType()
INT_RANGE, LONG_RANGE = 2**31, 2**63


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.DataType
    #: The text of a number literal, for a sign in front of it and for casts while planning.
    number: str | None = None


@dataclass(frozen=True)
class Scope:
    """The columns an expression sees: a source's, under its alias if it has one."""

    schema: T.StructType
    alias: str | None = None
    strict: bool = False

    def find(self, parts: tuple[str, ...]) -> Typed:
        if len(parts) > 2 or (len(parts) == 2 and parts[0] != self.alias):
            raise ColumnNotFoundError(f"no column {'.'.join(parts)}")
        for f in self.schema.fields:
            if f.name == parts[-1]:
                return Typed(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType)
        raise ColumnNotFoundError(f"no column {'.'.join(parts)}; there are {', '.join(self.schema.names)}")


def number(text: str) -> Typed:
    if text[-1] in "lL":
        raise LiteralError(f"{text}: numbers have no suffix")
    if "." in text:
        return Typed(F.lit(text).cast("float"), T.FloatType(), text)
    if not text.lstrip("-").isdigit() or not -LONG_RANGE <= int(text) < LONG_RANGE:
        raise LiteralError(f"{text} is not a whole number of 64 bits")
    kind = T.IntegerType() if -INT_RANGE <= int(text) < INT_RANGE else T.LongType()
    return Typed(F.lit(int(text)).cast(kind), kind, text)


def literal(e: Literal) -> Typed:
    if e.kind == "number":
        return number(e.text)
    if e.kind == "boolean":
        return Typed(F.lit(e.text == "true"), BOOLEAN)
    if e.kind == "null":
        return Typed(F.lit(None), T.NullType())
    if e.kind in ("date", "timestamp"):
        kind = T.DateType() if e.kind == "date" else T.TimestampNTZType()
        return Typed(F.lit(e.text).cast(kind), kind)
    return Typed(F.lit(e.text), STRING)


def cast(x: Typed, to: T.DataType) -> Column:
    if x.type == to:
        return x.column
    if x.number is not None and is_integer(to):
        return F.lit(int(x.number)).cast(to)
    return x.column.cast(to)


def guarded(left: Column, right: Column, at_zero: Column, otherwise: Column) -> Column:
    """Division as in IEEE 754: no error at a zero divisor."""
    return F.when(left.isNull() | right.isNull(), F.lit(None)).when(right == 0, at_zero).otherwise(otherwise)


def divide(left: Column, right: Column, kind: T.DataType) -> Column:
    if is_integer(kind):
        return F.call_function("div", left, right).cast(kind)
    at_zero = left * F.pow(right, F.lit(-1.0))  # an infinity of the zero's sign, which 0 and NaN make NaN
    return guarded(left, right, at_zero.cast(kind), (left / right).cast(kind)).cast(kind)


def remainder(left: Column, right: Column, kind: T.DataType) -> Column:
    if is_float(kind):
        return guarded(left, right, F.lit(float("nan")).cast(kind), left % right).cast(kind)
    return left % right


ARITHMETIC: dict[str, Callable[[Column, Column, T.DataType], Column]] = {
    "+": lambda a, b, _: a + b,
    "-": lambda a, b, _: a - b,
    "*": lambda a, b, _: a * b,
    "/": divide,
    "%": remainder,
}
COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b),
}
BITWISE: dict[str, Callable[[Column, Column], Column]] = {
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
}


def truth(x: Typed) -> Column:
    if x.type == BOOLEAN:
        return x.column
    if x.type in NUMBERS or x.type == T.NullType():
        return x.column.cast("boolean")
    raise CoercionError(f"AND, OR and NOT take booleans and numbers, not {x.type.simpleString()}")


def together(items: list[Typed], scope: Scope) -> tuple[list[Column], T.DataType]:
    """The columns, all of their common type."""
    kind = items[0].type
    for x in items[1:]:
        kind = common_type(kind, x.type, scope.strict)
    return [cast(x, kind) for x in items], kind


def text(x: Typed, what: str) -> Column:
    if x.type not in (STRING, T.NullType()):
        raise CoercionError(f"{what} takes strings, not {x.type.simpleString()}")
    return x.column.cast(STRING)


def call(e: Call, scope: Scope) -> Typed:
    """A function of single values, with its type."""
    name, given = e.function, [lower(a, scope) for a in e.arguments]
    least, most = {"COALESCE": (1, 1000), "CONCAT": (1, 1000), "NULLIF": (2, 2), "ROUND": (1, 2), "SUBSTR": (2, 3), "SUBSTRING": (2, 3)}.get(name, (1, 1))
    if not least <= len(given) <= most:
        raise CoercionError(f"{name} doesn't take {len(given)} arguments")
    if name == "COALESCE":
        columns, kind = together(given, scope)
        return Typed(F.coalesce(*columns), kind)
    if name == "NULLIF":
        (a, b), _ = together(given, scope)
        return Typed(F.when(a == b, F.lit(None)).otherwise(given[0].column), given[0].type)
    if name == "CONCAT":
        return Typed(F.concat(*[text(x, name) for x in given]), STRING)
    first = given[0]
    if name in ("UPPER", "LOWER", "TRIM"):
        return Typed({"UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim}[name](text(first, name)), STRING)
    if name == "LENGTH":
        return Typed(F.char_length(text(first, name)), T.IntegerType())
    if name in ("SUBSTR", "SUBSTRING"):
        if not all(is_integer(x.type) for x in given[1:]):
            raise CoercionError(f"{name} takes whole numbers after the string")
        return Typed(F.substr(text(first, name), *[x.column.cast("int") for x in given[1:]]), STRING)
    if first.type not in NUMBERS:
        raise CoercionError(f"{name} takes a number, not {first.type.simpleString()}")
    if name == "ABS":
        return Typed(F.abs(first.column), first.type)
    if is_integer(first.type):
        return first
    if name == "ROUND":
        digits = e.arguments[1] if len(e.arguments) > 1 else Literal("number", "0")
        if not isinstance(digits, Literal) or not digits.text.isdigit():
            raise CoercionError("ROUND takes a number of digits")
        return Typed(F.round(first.column, int(digits.text)).cast(first.type), first.type)
    # floor and ceil of Spark give longs, which large doubles don't fit
    whole = {"FLOOR": F.floor, "CEIL": F.ceil}[name](first.column).cast(first.type)
    return Typed(F.when(F.abs(first.column) < 2.0**52, whole).otherwise(first.column), first.type)


def lower(e: Expr, scope: Scope) -> Typed:
    if isinstance(e, Literal):
        return literal(e)
    if isinstance(e, Name):
        return scope.find(e.parts)
    if isinstance(e, Unary):
        if e.op == "-" and isinstance(e.operand, Literal) and e.operand.kind == "number":
            return number("-" + e.operand.text)
        x = lower(e.operand, scope)
        if e.op in ("IS NULL", "IS NOT NULL"):
            return Typed(x.column.isNull() if e.op == "IS NULL" else x.column.isNotNull(), BOOLEAN)
        if e.op == "NOT":
            return Typed(~truth(x), BOOLEAN)
        if x.type not in NUMBERS and not isinstance(x.type, T.DecimalType):
            raise CoercionError(f"a sign before {x.type.simpleString()}")
        return x if e.op == "+" else Typed(-x.column, x.type)
    if isinstance(e, Among):
        (operand, *items), _ = together([lower(x, scope) for x in (e.operand, *e.items)], scope)
        return Typed(operand.isin(*items), BOOLEAN)
    if isinstance(e, Like):
        match = F.ilike if e.any_case else F.like
        return Typed(match(text(lower(e.operand, scope), "LIKE"), text(lower(e.pattern, scope), "LIKE")), BOOLEAN)
    if isinstance(e, Case):
        values = [lower(v, scope) for _, v in e.branches] + ([lower(e.otherwise, scope)] if e.otherwise is not None else [])
        columns, kind = together(values, scope)
        out = F
        for (condition, _), value in zip(e.branches, columns, strict=False):
            out = out.when(truth(lower(condition, scope)), value)
        return Typed(out.otherwise(columns[-1]) if e.otherwise is not None else out, kind)
    if isinstance(e, Cast):
        kind = type_of(e.type)
        return Typed(cast(lower(e.operand, scope), kind), kind)
    if isinstance(e, Call):
        return call(e, scope)
    left, right = lower(e.left, scope), lower(e.right, scope)
    if e.op in ("AND", "OR"):
        a, b = truth(left), truth(right)
        return Typed(a & b if e.op == "AND" else a | b, BOOLEAN)
    if e.op == "XOR":
        return Typed(truth(left) != truth(right), BOOLEAN)
    if e.op == "||":
        return Typed(F.concat(text(left, "||"), text(right, "||")), STRING)
    kind = common_type(left.type, right.type, scope.strict)
    a, b = cast(left, kind), cast(right, kind)
    if e.op in COMPARISON:
        return Typed(COMPARISON[e.op](a, b), BOOLEAN)
    if e.op in BITWISE:
        if not is_integer(kind):
            raise CoercionError(f"{e.op} takes whole numbers, not {kind.simpleString()}")
        return Typed(BITWISE[e.op](a, b), kind)
    if isinstance(kind, T.DecimalType) and e.op in ("+", "-"):
        return Typed((a + b if e.op == "+" else a - b).cast(kind), kind)
    if kind not in NUMBERS:
        raise CoercionError(f"{e.op} on {kind.simpleString()}")
    return Typed(ARITHMETIC[e.op](a, b, kind).cast(kind), kind)


def predicate(e: Expr, scope: Scope) -> Column:
    x = lower(e, scope)
    if x.type != BOOLEAN:
        raise PredicateTypeError(f"WHERE takes a boolean, not {x.type.simpleString()}")
    return x.column
