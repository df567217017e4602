"""Head-following ingestion: confirmation lag, reorg repair, atomic batches.

A micro-batch of heads is answered in three steps, each a comparison with the chain:
which announced head is real (``ChainView.newest``), whether the last written block is
still on the chain (else the store goes back to the fork point), and which blocks are deep
enough to be written. Nothing but the position and the last written header is kept
between batches, so there is no state that a reorganisation could leave behind.

The steps run on the driver inside ``foreachBatch``; rows are DataFrames. Truth is the
store's coverage and hashes, never the stream's checkpoint: after a restart the engine
resumes above the stored head, and a replayed micro-batch finds its heights written.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven import schema
from loghaven.errors import Fatal
from loghaven.functions import codec, eventset
from loghaven.operators import analytics
from loghaven.sources.provider import Clock, Fetcher, Head, NotFound, Provider, SystemClock
from loghaven.streaming.chainview import ChainView, first_break

log = logging.getLogger(__name__)

BATCH_BLOCKS = 10
ATTEMPTS = 3


class CatchupTooLarge(Fatal):
    """More blocks to catch up than allowed."""


class HeadsSilent(Fatal):
    """No head within the time allowed."""


class Sink(Protocol):
    """What ingestion needs of the store."""

    def write_range(self, low: int, high: int, blocks: DataFrame, logs: DataFrame) -> object: ...

    def rewind(self, to: int) -> object: ...

    def stored_hash(self, number: int) -> str | None: ...


@dataclass
class Position:
    """First unwritten height, the lowest that may be written, and the last written header."""

    next: int
    lower_bound: int
    heads: dict[int, Head] = field(default_factory=dict)

    @property
    def written(self) -> int:
        return self.next - 1

    def move_above(self, head: Head) -> None:
        self.next, self.heads = head.number + 1, {head.number: head}
        self.lower_bound = min(self.lower_bound, self.next)


def keep_raw(logs: DataFrame) -> DataFrame:
    """Raw logs (topics array) of the stored shapes."""
    count = F.coalesce(F.size("topics"), F.lit(0))
    return logs.where(eventset.keep_expr(codec.topic_at(F.col("topics"), 0), count, F.col("address")))


class Subscriber:
    """Consumes heads and writes confirmed ranges."""

    def __init__(self, spark: SparkSession, provider: Provider, sink: Sink, *, confirmations: int = 2, max_catchup: int = 50_000, batch_blocks: int = BATCH_BLOCKS, span_cap: int = 10_000, head_timeout: float = 300.0, clock: Clock | None = None):
        self.spark, self.chain, self.sink, self.clock = spark, ChainView(provider), sink, clock or SystemClock()
        self.lag, self.max_catchup, self.batch_blocks, self.head_timeout = confirmations, max_catchup, batch_blocks, head_timeout
        self.fetcher = Fetcher(provider, self.clock, span_cap)
        self.at: Position | None = None
        self.last_head = self.clock.now()

    # -- driving --------------------------------------------------------------

    def start(self, first: int) -> None:
        """Anchor at the block below ``first``, or below the fork if that block was replaced."""
        self.at = Position(first, first)
        if first:
            self._settle(self._needed(first - 1, "resume"))

    def on_heads(self, heads: Iterable[Head]) -> None:
        """One micro-batch of heads: check, repair, and write what is confirmed."""
        heads = [h for h in heads if h.number >= self.at.lower_bound]
        if heads:
            self._bounded(max(h.number for h in heads))
            tip = self.chain.newest(heads)
            if tip is not None:
                self._settle(tip)
                self._ingest(self.at.next, tip.number - self.lag)
        self.last_head = self.clock.now()

    def check_silence(self) -> None:
        if self.clock.now() - self.last_head > self.head_timeout:
            raise HeadsSilent(f"newHeads subscription is silent: no head in {self.head_timeout:g}s (last written block {self.at.written}); restarting to reconnect")

    def stream(self, heads: DataFrame, checkpoint: str, interval: str = "1 second"):
        """Start the streaming query over a stream of ``schema.HEADS``."""

        def on_batch(batch: DataFrame, _: int) -> None:
            rows = batch.collect()  # heads of one trigger, a few rows
            self.on_heads(Head(r["number"], bytes(r["hash"]).hex(), bytes(r["parent_hash"]).hex(), r["timestamp"]) for r in rows)

        return heads.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()

    # -- comparing with the chain -------------------------------------------------

    def _needed(self, number: int, purpose: str) -> Head:
        head = self.chain.head(number, f"{purpose}: read block {number}")
        if head is None:
            raise Fatal(f"{purpose}: the chain has no block {number}")
        return head

    def _bounded(self, tip: int) -> None:
        first = self.at.next
        if 0 < self.max_catchup < tip - first + 1:
            raise CatchupTooLarge(f"ingestion catch-up exceeds max_catchup_blocks: need blocks {first}-{tip} ({tip - first + 1} blocks, max {self.max_catchup}); rewind deliberately or raise ethereum.max_catchup_blocks")

    def _settle(self, tip: Head) -> None:
        """Compare the highest written block that ``tip`` can vouch for, and go back if it was replaced."""
        at = self.at
        height = min(at.written, tip.number)
        known = at.heads.get(height)
        expected = known.hash if known else self.sink.stored_hash(height) if height >= 0 else None
        if expected is None:
            if height == tip.number == at.written:
                at.heads = {height: tip}  # nothing is stored here: the tip is the anchor
            return
        if tip.number == height + 1 and tip.parent == expected:
            return
        real = tip if tip.number == height else self.chain.head(height, f"verify written block {height}")
        if real is None or real.hash != expected:
            self._go_back(height)
        elif height == at.written:
            at.heads = {height: real}

    def _go_back(self, height: int) -> None:
        """A written block was replaced: rewind to the highest one that the chain still has."""
        try:
            ancestor = self.chain.fork_point(self.sink, height)
        except Fatal as e:
            raise Fatal(f"written block {height} was replaced, deeper than the confirmation lag: {e}") from e
        log.error("block %d was replaced below the confirmation lag: rewinding to %d", height, ancestor.number)
        try:
            self.sink.rewind(ancestor.number)
        except Exception as e:
            raise Fatal(f"rewind to fork point {ancestor.number}: {e}") from e
        self.at.move_above(ancestor)

    # -- writing ------------------------------------------------------------------

    def _ingest(self, low: int, high: int) -> None:
        for first in range(low, high + 1, self.batch_blocks):
            last = self._batch(first, min(high, first + self.batch_blocks - 1))
            if last is None:
                return  # the block below moved; the next head decides
            self.at.move_above(last)

    def _batch(self, low: int, high: int) -> Head | None:
        """Write one range; its last header, or None if the block below it is no longer its parent."""
        trouble = ""
        for _ in range(ATTEMPTS):
            headers = self.chain.span(low, high, f"read headers of blocks {low}-{high}")
            gap = first_break(headers, self.at.heads.get(low - 1))
            if gap == low:
                self._below_moved(low - 1)
                return None
            if gap is not None:
                trouble = f"header {gap} does not extend its parent"
                continue
            moved = self._write(headers)
            if not moved:
                return headers[-1]
            trouble = f"blocks {moved} kept changing between log and header fetches"
        raise Fatal(f"{trouble} in batch {low}-{high} ({ATTEMPTS} attempts); the chain is unstable at the confirmation depth")

    def _below_moved(self, below: int) -> None:
        """The block below a batch has another header: go back if it is stored, else take the new one."""
        if self.sink.stored_hash(below) is not None:
            self._go_back(below)
        else:
            self.at.heads = {below: self._needed(below, "anchor anew")}

    def _write(self, headers: list[Head]) -> list[int]:
        """Fetch the logs and write the range; the heights that changed meanwhile, if any."""
        low, high = headers[0].number, headers[-1].number
        try:
            raw = self.fetcher.fetch(low, high)
        except Exception as e:
            raise Fatal(f"fetch ingestion logs for blocks {low}-{high}: {e}") from e
        if raw is None:
            raw = self.spark.createDataFrame([], schema.RAW_LOGS)
        raw = raw.where(F.col("block_number").between(low, high)).persist()
        try:
            blocks = self.spark.createDataFrame([(h.number, bytearray.fromhex(h.hash), h.timestamp) for h in headers], schema.BLOCKS)
            moved = self._moved(headers, blocks, raw)
            if not moved:
                try:
                    self.sink.write_range(low, high, blocks, keep_raw(raw))
                except Exception as e:
                    raise Fatal(f"write blocks {low}-{high}: {e}") from e
            return moved
        finally:
            raw.unpersist()

    def _moved(self, headers: list[Head], blocks: DataFrame, raw: DataFrame) -> list[int]:
        """Heights whose logs disagree with their header, or, if none, log-less ones that changed."""
        wrong = sorted(r["block_number"] for r in analytics.disagreeing(raw, blocks, F.lit(bytearray(32))).collect())
        if wrong:
            return wrong
        empty = {r["number"] for r in analytics.logless(blocks, raw).select("number").collect()}
        again = {n: self.chain.head(n, f"read block {n} again after its logs") for n in sorted(empty)}
        return [h.number for h in headers if h.number in again and (again[h.number] is None or again[h.number].hash != h.hash)]


def resolve_start(coverage_head: int | None, start_block: int | None, provider: Provider) -> int:
    """Where ingestion begins: above the stored head, at the configured block, or at the tip."""
    if coverage_head is not None:
        if start_block is not None:
            raise Fatal(f"ethereum.start_block={start_block} is set, but blocks up to {coverage_head} are stored; unset it to resume at {coverage_head + 1}, or stop the service and run `rewind -to {start_block - 1}` to ingest from it again")
        return coverage_head + 1
    return start_block if start_block is not None else provider.block_number()


def verify_chain(provider: Provider, wanted: int) -> None:
    try:
        got = provider.chain_id()
    except Exception as e:
        raise Fatal(f"read provider chain id: {e}") from e
    if got != wanted:
        raise Fatal(f"provider chain id {got} does not match configured ethereum.chain_id {wanted}")


__all__ = ["Subscriber", "Position", "Sink", "CatchupTooLarge", "HeadsSilent", "NotFound", "keep_raw", "resolve_start", "verify_chain"]
