"""Chain providers: the protocol, an offline one over DataFrames, and how to ask politely."""

from __future__ import annotations

import errno
import functools
import random
import re
import socket
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven import schema
from loghaven.errors import ProviderError
from loghaven.functions import eventset


@dataclass(frozen=True)
class Head:
    """A header as the chain announces it (hashes in hex)."""

    number: int
    hash: str
    parent: str
    timestamp: int


class NotFound(ProviderError):
    """A height that the provider does not have; asking again does not help."""


class SingleBlockOverflow(ProviderError):
    def __init__(self, block: int, cause: Exception):
        super().__init__(f"single block {block} exceeds the provider's result cap: {cause}")
        self.block = block


class Provider(Protocol):
    """What ingestion needs of a node. Logs are DataFrames of ``schema.RAW_LOGS``."""

    def head_by_number(self, number: int) -> Head: ...

    def filter_logs(self, low: int, high: int, topics: tuple[str, ...]) -> DataFrame: ...

    def block_receipts(self, number: int) -> DataFrame: ...

    def block_number(self) -> int: ...

    def chain_id(self) -> int: ...


class Clock(Protocol):
    def now(self) -> float: ...

    def sleep(self, seconds: float) -> None: ...


class SystemClock:
    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class FrameProvider:
    """An offline provider over a frame of headers and one of raw logs."""

    def __init__(self, headers: DataFrame, logs: DataFrame, chain: int = 1, result_cap: int = 0, span_cap: int = 0):
        self._read = lambda: (headers, logs)
        self.chain, self.result_cap, self.span_cap = chain, result_cap, span_cap

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str, chain: int = 1, **caps: int) -> FrameProvider:
        """Frames of a folder that still grows: files are listed anew for every question."""
        found = cls(None, None, chain, **caps)
        found._read = lambda: (spark.read.schema(schema.HEADS).parquet(f"{path}/headers"), spark.read.schema(schema.RAW_LOGS).parquet(f"{path}/logs"))
        return found

    @property
    def headers(self) -> DataFrame:
        return self._read()[0]

    @property
    def logs(self) -> DataFrame:
        return self._read()[1]

    def head_by_number(self, number: int) -> Head:
        found = self.headers.where(F.col("number") == number).limit(1).collect()
        if not found:
            raise NotFound(f"block {number}: not found")
        r = found[0]
        return Head(r["number"], bytes(r["hash"]).hex(), bytes(r["parent_hash"]).hex(), r["timestamp"])

    def heads(self, low: int, high: int) -> list[Head]:
        """All headers of a range by one query."""
        rows = self.headers.where(F.col("number").between(low, high)).orderBy("number").collect()
        if [r["number"] for r in rows] != list(range(low, high + 1)):
            raise NotFound(f"blocks {low}-{high}: not all found")
        return [Head(r["number"], bytes(r["hash"]).hex(), bytes(r["parent_hash"]).hex(), r["timestamp"]) for r in rows]

    def filter_logs(self, low: int, high: int, topics: tuple[str, ...]) -> DataFrame:
        if self.span_cap and high - low + 1 > self.span_cap:
            raise ProviderError(f"query exceeds max block range {self.span_cap}")
        rows = self.logs.where(F.col("block_number").between(low, high) & F.get("topics", F.lit(0)).isin([F.lit(bytearray.fromhex(t)) for t in topics]))
        if self.result_cap and rows.limit(self.result_cap + 1).count() > self.result_cap:
            raise ProviderError(f"query returned more than {self.result_cap} results")
        return rows

    def block_receipts(self, number: int) -> DataFrame:
        rows = self.logs.where(F.col("block_number") == number)
        by_tx = rows.groupBy("block_number", "tx_index").agg(F.collect_list(F.struct(*rows.columns)).alias("logs"))
        return by_tx.groupBy("block_number").agg(F.collect_list(F.struct("logs")).alias("receipts"))

    def block_number(self) -> int:
        return self.headers.agg(F.max("number")).first()[0]

    def chain_id(self) -> int:
        return self.chain


# -- what an error means ------------------------------------------------------

# Phrases of public providers.
_SPAN = ("exceeds limit of", "block range limit", "exceeds max block range", "block range is too wide", "range too large", "range is too large")
_RESULTS = ("query returned more than", "too many results", "too many logs", "exceeds max results")
_RETRY = (
    "connection refused", "connection reset", "connection timed out", "query cancelled", "i/o timeout", "broken pipe", "rate limit", "too many requests", "service unavailable", "bad gateway",
    "gateway timeout", "temporarily unavailable", "econnreset", "etimedout", "eof", "internal error", "502", "503", "504",
)


def _says(error: Exception, *phrases: str) -> bool:
    text = str(error).lower()
    return any(p in text for p in phrases)


def is_span_cap(error: Exception) -> bool:
    """The provider limits the number of blocks: larger spans cannot work either."""
    invalid = getattr(error, "code", None) == -32602 and _says(error, "range", "limit")
    return invalid or _says(error, *_SPAN) or (_says(error, "limited to") and _says(error, "block range"))


def is_too_large(error: Exception) -> bool:
    """The window must be split, whatever the limit is."""
    return _says(error, *_RESULTS) or is_span_cap(error)


class Cancelled(Exception):
    """The caller gave up; nothing is tried again."""


#: System errors of a network that may come back.
_TRANSIENT = {errno.ECONNREFUSED, errno.ECONNRESET, errno.ENETUNREACH, errno.EHOSTUNREACH}


def is_retryable(error: Exception) -> bool:
    """Whether asking again may help; what is not known to pass is permanent."""
    if isinstance(error, (Cancelled, NotFound)):
        return False
    if isinstance(error, socket.gaierror):
        return error.errno == socket.EAI_AGAIN
    if isinstance(error, (ConnectionError, TimeoutError)) or (isinstance(error, OSError) and error.errno in _TRANSIENT):
        return True
    return _says(error, *_RETRY)


def redact(text: str) -> str:
    """URLs reduced to scheme and host: paths and queries carry keys."""
    return re.sub(r"\b(wss?|https?)://(?:[^\s/@\"']*@)?([^\s/?#\"']+)[^\s\"']*", r"\1://\2", text)


@dataclass
class Retry:
    """Exponential back-off: 5 s doubling to 30 s, half of it random, five minutes in all."""

    clock: Clock
    first: float = 5.0
    most: float = 30.0
    budget: float = 300.0
    jitter: float = 0.5

    def __call__(self, name: str, ask: Callable[[], object]) -> object:
        began, wait = self.clock.now(), self.first
        while True:
            try:
                return ask()
            except Exception as e:
                if not is_retryable(e):
                    raise ProviderError(f"ethereum operation {name} failed after retries: permanent error: {redact(str(e))}") from e
                pause = wait * (1 + self.jitter * (2 * random.random() - 1))
                if self.clock.now() - began + pause > self.budget:
                    raise ProviderError(f"ethereum operation {name} failed after retries: retryable error: {redact(str(e))}") from e
                self.clock.sleep(pause)
                wait = min(self.most, 2 * wait)


@dataclass
class Paginator:
    """Windows that adapt to the provider: halved when refused, doubled when served.

    A refused span lowers the ceiling for the whole walk if the provider limits spans.
    """

    filter_logs: Callable[[int, int], object]
    clock: Clock
    span_cap: int = 0
    first_step: int = 1_000_000
    pause: float = 1.0

    def walk(self, low: int, high: int, expired: Callable[[], bool] = lambda: False) -> tuple[list, bool]:
        """Results of the windows in order, and whether time ran out before the end."""
        ceiling = self.span_cap + 1 if self.span_cap else self.first_step
        step, at, found = ceiling, low, []
        while at <= high:
            if expired():
                return found, True
            top = min(high, at + step - 1)
            try:
                found.append(self.filter_logs(at, top))
            except Exception as e:
                if not is_too_large(e):
                    raise ProviderError(f"failed to get logs for range {at}-{top}: {e}") from e
                if at == top:
                    raise SingleBlockOverflow(at, e) from e
                step //= 2
                if is_span_cap(e):
                    ceiling = min(ceiling, step)
                self.clock.sleep(self.pause)
                continue
            at, step = top + 1, min(ceiling, 2 * step)
        return found, False


#: Seconds that the walk of one range may take.
WALK_DEADLINE = 1800.0


class Fetcher:
    """Raw logs of a range; a block over the cap comes from its receipts instead.

    A walk that takes longer than ``deadline`` seconds is an error: part of a range is
    never given out as the whole.
    """

    def __init__(self, provider: Provider, clock: Clock, span_cap: int = 0, topics: tuple[str, ...] = eventset.SIGNATURES, deadline: float = WALK_DEADLINE):
        self.provider, self.topics, self.clock, self.deadline = provider, topics, clock, deadline
        self.pages = Paginator(lambda a, b: provider.filter_logs(a, b, topics), clock, span_cap)

    def fetch(self, low: int, high: int) -> DataFrame | None:
        """One frame of all logs (unordered; order comes with the sort on write), or None."""
        legs: list[DataFrame] = []
        todo = [(low, high)]
        until = self.clock.now() + self.deadline
        while todo:
            a, b = todo.pop()
            try:
                found, late = self.pages.walk(a, b, lambda: self.clock.now() >= until)
                if late:
                    raise ProviderError(f"the logs of blocks {low}-{high} did not arrive within {self.deadline:g}s")
                legs += found
            except SingleBlockOverflow as e:
                legs.append(self.dense(e.block))
                todo += [(x, y) for x, y in ((a, e.block - 1), (e.block + 1, b)) if x <= y]
        return functools.reduce(DataFrame.unionByName, legs) if legs else None

    def dense(self, block: int) -> DataFrame:
        receipts = self.provider.block_receipts(block)
        logs = receipts.select(F.explode("receipts").alias("r")).select(F.explode("r.logs").alias("log")).select("log.*")
        return logs.where(F.get("topics", F.lit(0)).isin([F.lit(bytearray.fromhex(t)) for t in self.topics]))
