"""Errors that callers can tell apart."""


class LoomError(Exception):
    """Any error that this library raises by itself."""


class InvalidArgument(LoomError, ValueError):
    """An option or a value that cannot be used."""


class OutOfRange(LoomError, IndexError):
    """A position outside a dataset."""


class ShapeMismatch(LoomError, ValueError):
    """Widths or shapes that do not fit together."""


class SourceError(LoomError, OSError):
    """A file or a record that cannot be read."""
