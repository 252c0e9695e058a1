"""Errors that callers can tell apart."""

from __future__ import annotations


class InvalidParameter(ValueError):
    """An argument is out of range or malformed."""


class Ambiguous(InvalidParameter):
    """An id stands for more than one concept."""


class NotFound(LookupError):
    """What was named doesn't exist in what the caller may see."""


class Duplicate(ValueError):
    """A row that must be unique is there already."""


def bounded(name: str, value: int | None, low: int, high: int | None = None) -> int:
    """``value`` if it is an integer from ``low`` to ``high``."""
    if value is None or isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise InvalidParameter(f"{name} must be an integer from {low} to {'any' if high is None else high}, not {value!r}")
    return value
