"""Table functions: what may stand in FROM with parentheses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import EngineError, UnknownFunctionError
from ..plans.ir import Argument


@dataclass(frozen=True)
class TableFunction:
    """``validate`` turns arguments into what ``build`` takes, or raises FunctionArgumentError; ``build`` gives the rows."""

    name: str
    validate: Callable[[tuple[Argument, ...]], object]
    build: Callable[[object, object], DataFrame]


class TableFunctions:
    def __init__(self) -> None:
        self._all: dict[str, TableFunction] = {}

    def add(self, function: TableFunction) -> None:
        if function.name in self._all:
            raise EngineError(f"a table function {function.name} exists already")
        self._all[function.name] = function

    def get(self, name: str) -> TableFunction:
        if name not in self._all:
            raise UnknownFunctionError(f"no table function {name}; there are {', '.join(sorted(self._all))}")
        return self._all[name]
