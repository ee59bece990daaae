"""What can go wrong, by kind."""

from __future__ import annotations


class TidewattError(Exception):
    """Base of all errors of this package; ``retryable`` ones may pass on another try."""

    retryable = False


class ConfigError(TidewattError):
    """A table's configuration does not hold together."""


class ReadOnlyError(TidewattError):
    """A statement does more than read."""


class ScopeError(TidewattError):
    """A row or relation outside a session's confinement."""


class WriteRefused(TidewattError):
    """Rows that cannot be stored as they are."""


class BoundaryMoved(TidewattError):
    """The tier boundary moved while a write was under way."""

    retryable = True


class AlreadyArchived(TidewattError):
    """A write to the recent tier below the boundary."""


class InvariantViolated(TidewattError):
    """Stored data contradicts a rule that every write keeps."""


class Quarantined(TidewattError):
    """A stored schema that the configuration cannot be reconciled with."""


class LockTimeout(TidewattError):
    """Another writer holds a table."""

    retryable = True


def is_retryable(error: BaseException) -> bool:
    """Whether the same call may pass on another try."""
    return isinstance(error, TidewattError) and error.retryable
