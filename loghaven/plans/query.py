"""The filter query: one predicate over logs, joined with blocks, in chain order, capped."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghaven.errors import TooManyResults
from loghaven.functions import eventset

OUTPUT = ["block_number", "log_index", "tx_index", "tx_hash", "address", "topic0", "topic1", "topic2", "topic3", "data", "block_hash", "block_ts"]


def as_bytes(value: str) -> Column:
    """Literal of a hex value in a store that keeps bytes."""
    return F.lit(bytearray.fromhex(value))


def as_text(value: str) -> Column:
    """Literal of a hex value in a relation that keeps hex text."""
    return F.lit(value)


@dataclass(frozen=True)
class Query:
    """A resolved filter. Values are hex without 0x; an empty position is a wildcard."""

    from_block: int
    to_block: int
    addresses: Sequence[str] = ()
    topics: Sequence[Sequence[str]] = ()
    erc1155_id: str | None = None

    literal: Callable[[str], Column] = field(default=as_bytes, compare=False)

    def predicate(self) -> Column:
        """All conditions as one column, every arm a comparison that a scan can push down."""
        c = F.col
        found = c("block_number").between(self.from_block, self.to_block)
        if self.addresses:
            found &= c("address").isin([self.literal(a) for a in dict.fromkeys(self.addresses)])
        for i, values in enumerate(self.topics):
            if not values:
                continue  # a wildcard asks nothing, not even that the topic exists
            found &= c(f"topic{i}").isin([self.literal(v) for v in dict.fromkeys(values)])
            if i == 0 and self.erc1155_id is not None:
                found &= self._token_arms(values)
        return found

    def _token_arms(self, signatures: Sequence[str]) -> Column:
        """Where each requested signature carries the token id; others pass."""
        token, topic0 = self.literal(self.erc1155_id), F.col("topic0")
        carried = {eventset.TRANSFER_SINGLE: F.col("data_word0"), eventset.URI: F.col("topic1")}
        arms = [(topic0 == self.literal(s)) & (column == token) for s, column in carried.items() if s in signatures]
        others = [self.literal(s) for s in dict.fromkeys(signatures) if s not in carried]
        if others:
            arms.append(topic0.isin(others))
        found = arms[0]
        for arm in arms[1:]:
            found |= arm
        return found


def log_scan(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Logs with hash and time of their block: the one join of the warehouse."""
    named = blocks.select(F.col("number").alias("block_number"), F.col("hash").alias("block_hash"), F.col("ts").alias("block_ts"))
    return logs.join(named, "block_number")


def filter_logs(logs: DataFrame, blocks: DataFrame, query: Query) -> DataFrame:
    """Matching logs; the block range is put on both sides of the join."""
    side = blocks.where(F.col("number").between(query.from_block, query.to_block))
    return log_scan(logs.where(query.predicate()), side).select(*OUTPUT)


def chain_order(found: DataFrame, most: int = 0) -> DataFrame:
    """Rows in chain order; with a cap one row more than it, so that excess shows."""
    ordered = found.orderBy("block_number", "log_index")
    return ordered.limit(most + 1) if most else ordered


def collect_capped(found: DataFrame, most: int) -> list:
    """Rows in chain order, or an error if there are more than ``most`` (0: no limit)."""
    rows = chain_order(found, most).collect()
    if most and len(rows) > most:
        raise TooManyResults(most)
    return rows
