"""What can go wrong for a caller, one class for each observable case."""

from __future__ import annotations


class BadRequest(ValueError):
    """An invalid topic, payload or option."""


class TopicEmpty(BadRequest):
    """A message or query without a topic."""


class TopicTooLarge(BadRequest):
    """A topic above the limit of bytes."""


class PayloadEmpty(BadRequest):
    """A message without a payload."""


class PayloadTooLarge(BadRequest):
    """A payload above the limit of bytes."""


class InvalidTtl(BadRequest):
    """A ttl that is no duration, or too large."""


class Forbidden(PermissionError):
    """A request that is understood and not allowed."""


class Immutable(RuntimeError):
    """Deletes need a mutable store."""


class Locked(RuntimeError):
    """Another writer holds the store."""


class Closed(RuntimeError):
    """The store was closed."""
