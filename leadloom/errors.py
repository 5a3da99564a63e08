"""What may go wrong on purpose, by who has to act: one base class to catch at the edge."""

from __future__ import annotations


class Failure(Exception):
    """Every error this package raises deliberately."""


class BadConfig(Failure, ValueError):
    """A setting, profile or flag that can't be used."""


class SourceFailure(Failure):
    """A source gave no records. The run notes it and goes on with the others."""

    def __init__(self, source: str, message: str):
        super().__init__(f"[{source}] {message}")
        self.source = source


class Denied(SourceFailure):
    """The credentials were refused; trying again can't help."""


class SessionEnded(Denied):
    """A saved session is signed out: signing in again helps."""


class Throttled(SourceFailure):
    """The source asked to wait (``wait`` seconds, if it said so)."""

    def __init__(self, source: str, message: str, wait: float | None = None):
        super().__init__(source, message)
        self.wait = wait


class Unreachable(SourceFailure):
    """A failure of the network or the server that may pass."""


class NoSuchSource(SourceFailure):
    """The source or its file does not exist."""


class LayoutChanged(SourceFailure):
    """A part of a page without which no record can be read is gone."""


class UnusableRecord(Failure):
    """A raw record that does not fit the standard form."""


class ExportFailure(Failure):
    """The result could not be written."""


class LeakFound(Failure):
    """Something that looks like a credential is left in what was to be written."""
