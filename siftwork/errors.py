"""Errors that callers may want to tell apart."""

from __future__ import annotations


class SiftworkError(Exception):
    """Any of the below."""


class EmptyCorpusError(SiftworkError):
    """A scan found no file to keep."""


class ConfigError(SiftworkError):
    """A configuration can't be read."""


class FeedbackError(SiftworkError):
    """A session is unknown, or the feedback tables can't be used."""


class WatchError(SiftworkError):
    """A folder can't be watched."""
