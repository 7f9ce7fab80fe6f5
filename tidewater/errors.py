"""Everything the engine raises on purpose."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package."""


class SqlSyntaxError(EngineError):
    """The text is not a statement of the dialect."""


class StatementCountError(EngineError):
    """A query text must hold exactly one statement."""


class UnsupportedError(EngineError):
    """Valid SQL that the dialect doesn't execute; ``Engine.spark_sql`` may."""


class ColumnNotFoundError(EngineError):
    """No column of that exact name (and alias) in the source."""


class LiteralError(EngineError):
    """A literal that has no value in the dialect's types."""


class CoercionError(EngineError):
    """An operation between types that have no common type."""


class PredicateTypeError(EngineError):
    """A filter whose expression isn't boolean."""


class DuplicateColumnError(EngineError):
    """A result with two columns of one name can't be written."""


class FunctionArgumentError(EngineError):
    """A table function was called with wrong arguments."""


class UnknownFunctionError(EngineError):
    """No table function of that name."""


class UnknownTableError(EngineError):
    """No table or view of that name in the session."""


class ConnectionConfigError(EngineError):
    """A connection is unknown, named twice or wrongly described."""


class QueryNotFoundError(EngineError):
    """No query of that identifier."""


class QueryFailedError(EngineError):
    """The query ended with an error; the message is the cause's."""
