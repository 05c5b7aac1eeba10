"""What can go wrong with a query or a journal."""


class QueryError(ValueError):
    """A query that names what isn't there, or compares what can't be compared."""


class UnsupportedQueryError(QueryError):
    """A construct that the engine refuses rather than ignores."""


class QlSyntaxError(QueryError):
    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"line {line}:{column} {message}")
        self.line, self.column = line, column


class EmptyResultError(QueryError):
    """first(), last() or single() found no row."""


class NotSingleError(QueryError):
    """single() found more rows than one."""


class OutOfOrderError(ValueError):
    """An append begins before the journal's last timestamp."""


class CommitConflictError(RuntimeError):
    """Another writer committed first."""
