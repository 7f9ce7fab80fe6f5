"""What a statement of the dialect says, before names and types are known."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    kind: str  # number, string, boolean, null, date, timestamp
    text: str


@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Unary:
    op: str  # -, +, NOT, IS NULL, IS NOT NULL
    operand: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Among:
    """operand IN (items)."""

    operand: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Like:
    operand: Expr
    pattern: Expr
    any_case: bool = False


@dataclass(frozen=True)
class Case:
    """Of conditions and their values, the first that holds."""

    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None


@dataclass(frozen=True)
class Cast:
    operand: Expr
    type: str


@dataclass(frozen=True)
class Call:
    function: str
    arguments: tuple[Expr, ...]


Expr = Literal | Name | Unary | Binary | Among | Like | Case | Cast | Call


@dataclass(frozen=True)
class Star:
    alias: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Argument:
    """Of a table function. ``name`` is set for name => value."""

    value: Expr
    name: str | None = None


@dataclass(frozen=True)
class TableCall:
    function: str
    arguments: tuple[Argument, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Star | Item, ...]
    source: TableCall | Table
    where: Expr | None = None
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int | None = None
