"""The warehouse: snapshot reads, atomic range writes, rewinds and coverage."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven import schema
from loghaven.errors import CoverageGap, StoreError
from loghaven.functions import codec
from loghaven.operators import analytics
from loghaven.operators.state import Coverage, Generation, State, StateStore
from loghaven.plans.query import Query, collect_capped, filter_logs

#: Generations of a part above which neighbours of similar size are merged.
COMPACT_AFTER = 32
#: A run of neighbours is merged if no one holds more than its share of this many times the mean.
TIER = 4
_GAP = "write is not contiguous with warehouse coverage"
#: Columns that point lookups compare, with bloom filters in the files.
_BLOOM = {"topic1": 100_000, "topic2": 100_000, "topic3": 100_000, "address": 100_000, "data_word0": 100_000, "hash": 1_000_000}


def flat_logs(raw: DataFrame) -> DataFrame:
    """Stored columns of logs with a topics array (absent topics null, absent data empty)."""
    topics = [codec.topic_at(F.col("topics"), i).alias(f"topic{i}") for i in range(4)]
    data = codec.data_or_empty(F.col("data"))
    return raw.select("block_number", F.col("log_index").cast("int").alias("log_index"), F.col("tx_index").cast("int").alias("tx_index"), "tx_hash", "address", *topics, data.alias("data"), codec.word0(data).alias("data_word0"))


class View:
    """Reads of one pinned version: generations outside a range are never listed by Spark."""

    def __init__(self, store: Warehouse, state: State):
        self.store, self.state = store, state

    @property
    def coverage(self) -> Coverage | None:
        return self.state.coverage

    def frame(self, kind: str, low: int | None = None, high: int | None = None) -> DataFrame:
        wanted = [g for g in getattr(self.state, kind) if (low is None or g.high >= low) and (high is None or g.low <= high)]
        return self.store.frame(kind, wanted)

    def filter_logs(self, query: Query, most: int = 0) -> list:
        """Matching logs in chain order, or TooManyResults."""
        return collect_capped(self.logs(query), most)

    def logs(self, query: Query) -> DataFrame:
        span = (query.from_block, query.to_block)
        return filter_logs(self.frame("logs", *span), self.frame("blocks", *span), query)

    def block_by_hash(self, block_hash: str) -> int | None:
        found = self.frame("blocks").where(F.col("hash") == F.lit(bytearray.fromhex(block_hash))).select("number").limit(1).collect()
        return found[0]["number"] if found else None

    def block_hash(self, number: int) -> str | None:
        found = self.frame("blocks", number, number).where(F.col("number") == number).select("hash").limit(1).collect()
        return bytes(found[0]["hash"]).hex() if found else None


def lightest_run(own: list[Generation]) -> list[Generation]:
    """Neighbouring generations to merge: those of the lowest tier of sizes, two at least.

    Tiers are powers of ``TIER``, so a row is rewritten once for each tier that it climbs
    and the work of a growing part stays in proportion to its rows and their logarithm.
    """
    tiers = [int(math.log(max(1, g.high - g.low + 1), TIER) + 1e-9) for g in own]
    best: tuple[int, int] | None = None
    for least in sorted(set(tiers)):
        start = 0
        for i in range(len(own) + 1):
            if i == len(own) or tiers[i] > least:
                if best is None or i - start > best[1] - best[0]:
                    best = (start, i)
                start = i + 1
        if best[1] - best[0] >= max(2, len(own) // 2):
            break
    return own[best[0] : best[1]]


class Warehouse:
    """Logs and blocks below one root folder."""

    def __init__(self, spark: SparkSession, root: str, *, part_blocks: int = codec.PART_BLOCKS, lock_dir: str | None = None, compact_after: int = COMPACT_AFTER):
        self.spark, self.part_blocks, self.compact_after = spark, part_blocks, compact_after
        self.states = StateStore(spark, root, lock_dir)

    # -- reads --------------------------------------------------------------

    def frame(self, kind: str, generations: Iterable[Generation]) -> DataFrame:
        fields = schema.LOGS if kind == "logs" else schema.BLOCKS
        paths = [g.path for g in generations]
        if not paths:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(*paths)

    @contextmanager
    def read(self) -> Iterator[View]:
        """A snapshot, refused during maintenance."""
        with self.states.reader() as state:
            yield View(self, state)

    def latest(self) -> View:
        """The latest version without the maintenance gate (for the writer itself)."""
        return View(self, self.states.read())

    def stored_hash(self, number: int) -> str | None:
        return self.latest().block_hash(number)

    def hashes(self, low: int, high: int) -> dict[int, str]:
        """Hashes of the stored blocks of a range, by one query."""
        rows = self.latest().frame("blocks", low, high).where(F.col("number").between(low, high)).select("number", "hash").collect()
        return {r["number"]: bytes(r["hash"]).hex() for r in rows}

    @property
    def coverage(self) -> Coverage | None:
        return self.states.read().coverage

    # -- writes -------------------------------------------------------------

    def _parts(self, low: int, high: int) -> range:
        return range(low // self.part_blocks, high // self.part_blocks + 1)

    def _write(self, kind: str, rows: DataFrame, low: int, high: int) -> list[Generation]:
        """New generations of the rows of a range, one for each part that has rows."""
        height, order = ("block_number", ["block_number", "log_index"]) if kind == "logs" else ("number", ["number"])
        made = []
        for part in self._parts(low, high):
            a, b = max(low, part * self.part_blocks), min(high, (part + 1) * self.part_blocks - 1)
            path = self.states.new_folder(kind, part)
            inside = rows.where(F.col(height).between(a, b)).repartitionByRange(height).sortWithinPartitions(*order)
            writer = inside.write.option("compression", "snappy")
            for column, ndv in _BLOOM.items():
                if column in rows.columns:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(ndv))
            writer.parquet(path)
            n = self.spark.read.schema(rows.schema).parquet(path).count()
            if n:
                made.append(Generation(path, part, a, b, n))
        return made

    def _without(self, kind: str, generations: tuple[Generation, ...], low: int, high: int) -> list[Generation]:
        """Generations with a range taken out: those inside go, those across are rewritten."""
        height, kept = "block_number" if kind == "logs" else "number", []
        for g in generations:
            if g.high < low or g.low > high:
                kept.append(g)
            elif g.low < low or g.high > high:
                rest = self.frame(kind, [g]).where(~F.col(height).between(low, high))
                if g.low < low:
                    kept += self._write(kind, rest.where(F.col(height) < low), g.low, low - 1)
                if g.high > high:
                    kept += self._write(kind, rest.where(F.col(height) > high), high + 1, g.high)
        return kept

    def replaced(self, state: State, kind: str, rows: DataFrame, low: int, high: int) -> State:
        """The state with a range of one table replaced (files written, not committed)."""
        kept = self._without(kind, getattr(state, kind), low, high) + self._write(kind, rows, low, high)
        for part in {g.part for g in kept}:
            own = sorted((g for g in kept if g.part == part), key=lambda g: g.low)
            if len(own) > self.compact_after:
                run = lightest_run(own)
                merged = self._write(kind, self.frame(kind, run), run[0].low, run[-1].high)
                kept = [g for g in kept if g not in run] + merged
        return replace(state, **{kind: tuple(sorted(kept, key=lambda g: (g.low, g.path)))})

    def _checked(self, low: int, high: int, blocks: DataFrame, logs: DataFrame) -> None:
        """Invariants that no storage enforces for us."""
        heights = blocks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("d"), F.min("number").alias("a"), F.max("number").alias("b")).first()
        if heights["n"] != high - low + 1:
            raise StoreError(f"write range {low}-{high}: got {heights['n']} block rows, want {high - low + 1}")
        if heights["d"] != heights["n"] or heights["a"] != low or heights["b"] != high:
            raise StoreError(f"write range {low}-{high}: block rows do not cover every height once")
        zero = F.lit(bytearray(32))
        wrong = analytics.unmatched_logs(logs, blocks, zero).orderBy("block_number", "log_index").select("block_number", "log_index", "block_hash", "header_hash").limit(1).collect()
        if wrong:
            r = wrong[0]
            if r["block_hash"] is None or not any(r["block_hash"]):
                raise StoreError(f"write range {low}-{high}: log at block {r['block_number']} index {r['log_index']} carries no block hash; unverifiable logs are not stored")
            if r["header_hash"] is None:
                raise StoreError(f"write range {low}-{high}: log at block {r['block_number']} has no block row in the batch")
            raise StoreError(f"write range {low}-{high}: log at block {r['block_number']} carries block hash 0x{bytes(r['block_hash']).hex()} but the block row is 0x{bytes(r['header_hash']).hex()}")
        check_rows(flat_logs(logs))

    def write_range(self, low: int, high: int, blocks: DataFrame, raw_logs: DataFrame) -> State:
        """Replace a range of blocks and logs and extend the coverage, all or nothing.

        ``raw_logs`` has a topics array and the hash of its block (``schema.RAW_LOGS``).
        Writing the same range again gives the same state.
        """
        self._checked(low, high, blocks, raw_logs)
        state = self.states.read()
        cov = state.coverage
        if cov and (low > cov.head + 1 or high + 1 < cov.start):
            raise CoverageGap(f"{_GAP}: range {low}-{high} vs coverage {cov.start}-{cov.head} (rewind, or unset ethereum.start_block)")
        new = self.replaced(state, "blocks", blocks.select("number", "hash", "ts"), low, high)
        new = self.replaced(new, "logs", flat_logs(raw_logs), low, high)
        merged = Coverage(min(low, cov.start), max(high, cov.head)) if cov else Coverage(low, high)
        return self.states.commit(replace(new, coverage=merged))

    def rewind(self, to: int) -> State:
        """Drop everything above a block and lower the head to it."""
        state = self.states.read()
        cov = state.coverage
        if cov is None or to >= cov.head:
            raise StoreError(f"rewind to {to}: cursor is not above it (nothing to rewind)")
        if to < cov.start:
            raise CoverageGap(f"{_GAP}: rewind to {to} is below the coverage start {cov.start}")
        far = max([cov.head, *(g.high for g in (*state.logs, *state.blocks))])
        new = replace(state, logs=tuple(self._without("logs", state.logs, to + 1, far)), blocks=tuple(self._without("blocks", state.blocks, to + 1, far)))
        return self.states.commit(replace(new, coverage=Coverage(cov.start, to)))

    def set_coverage(self, start: int, head: int, **changes) -> State:
        """Publish a verified interval, merged with what is covered already."""
        state = self.states.read()
        cov = state.coverage
        if cov:
            if start > cov.head + 1 or head + 1 < cov.start:
                raise CoverageGap(f"{_GAP}: verified interval {start}-{head} vs existing coverage {cov.start}-{cov.head}")
            start, head = min(start, cov.start), max(head, cov.head)
        return self.states.commit(replace(state, coverage=Coverage(start, head), **changes))

    def set_maintenance(self, on: bool, reason: str = "") -> State:
        return self.states.commit(replace(self.states.read(), maintenance=on, reason=reason))


def check_rows(logs: DataFrame) -> None:
    """Keys unique, required columns present."""
    required = ("tx_hash", "address", "topic0")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    bad = logs.where(missing).select("block_number", "log_index").limit(1).collect()
    if bad:
        raise StoreError(f"log at block {bad[0]['block_number']} index {bad[0]['log_index']} lacks a required column")
    twice = analytics.duplicate_keys(logs).limit(1).collect()
    if twice:
        raise StoreError(f"log at block {twice[0]['block_number']} index {twice[0]['log_index']} occurs {twice[0]['count']} times")
