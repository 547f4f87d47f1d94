"""Errors that are raised before any Spark action."""


class QuireError(Exception):
    """Base of all errors of this package."""


class UserError(QuireError):
    """A request that makes no sense."""


class InvalidArgument(UserError):
    """An argument that can't be read."""


class MissingArgument(UserError):
    """An argument that must be given."""


class DuplicateArgument(UserError):
    """An option that is given twice."""


class InvalidCommand(UserError):
    """A command that can't be run as it is."""


class OperationError(QuireError):
    """An operation that failed."""


class Requires(OperationError):
    """An operation that needs a library which isn't part of this package."""

    def __init__(self, operation: str, what: str):
        super().__init__(f"{operation} requires {what}, which this package doesn't have")
