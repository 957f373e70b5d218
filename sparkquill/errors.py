"""Errors that callers may want to tell apart."""


class QuillError(ValueError):
    """Any misuse of an index or a query."""


class QuerySyntaxError(QuillError):
    """A query text that the grammar rejects."""


class UnknownIndexError(QuillError):
    """No index, or more than one, fits."""
