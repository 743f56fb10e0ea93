"""Errors of the engine."""


class ParseError(ValueError):
    """Text that no grammar of the engine accepts."""


class InvalidOperation(ValueError):
    """An operation that the schema, the types or the registry don't allow."""


class ManagementError(ValueError):
    """A catalog operation on a table that exists already, or doesn't."""
