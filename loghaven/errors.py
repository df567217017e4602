"""Errors of the query path and the writers, with their wire codes."""

from __future__ import annotations


class LogError(Exception):
    """An error with a JSON-RPC code."""

    code = -32000


class ScopeError(LogError):
    """The warehouse cannot answer exactly; a node can."""

    def __init__(self, reason: str):
        super().__init__(f"out of warehouse scope: {reason}")


class InvalidParams(LogError):
    code = -32602


class TooManyResults(LogError):
    def __init__(self, most: int):
        super().__init__(f"query returned more than {most} results")


class CoverageGap(LogError):
    """A write or publication would leave the covered interval with a hole."""


class Maintenance(LogError):
    """A reload is under way; reads are refused."""


class WriterBusy(LogError):
    """Another process holds the writer lock."""


class StoreError(LogError):
    """Rows that break an invariant of the store."""


class BackfillError(LogError):
    """An export does not fit its manifest or what is loaded."""


class ProviderError(Exception):
    """An error answered by the chain provider."""


class Fatal(Exception):
    """Ingestion must end; a supervisor restarts it from the stored head."""
