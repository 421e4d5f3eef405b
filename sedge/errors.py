"""Typed errors (ERR-1)."""


class SedgeError(Exception):
    """Base of all errors of this package."""


class IndexingError(SedgeError):
    """Cloning, scanning or storing a repository failed."""


class AskError(SedgeError):
    """A question can't be answered."""


class GraphError(SedgeError):
    """The dependency graph can't be read or written."""


class SummaryError(SedgeError):
    """A generated summary is unusable."""


class GeneratorError(SedgeError):
    """A text generator failed."""


class RequestError(SedgeError):
    """A request breaks its limits (FLT-11)."""
