"""Conversions between the stored columns and what clients and exports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32
PART_BLOCKS = 1_000_000
TOPICS = ("topic0", "topic1", "topic2", "topic3")


def topics_array(*topics: Column) -> Column:
    """Topics up to the first absent one (a later one after a gap is not shown)."""
    found = F.array(*topics)
    for n in range(len(topics) - 1, -1, -1):
        found = F.when(topics[n].isNull(), F.slice(F.array(*topics), 1, n)).otherwise(found)
    return found


def topic_at(topics: Column, i: int) -> Column:
    """A topic of an array, null when absent (plain indexing raises under ANSI)."""
    return F.get(topics, F.lit(i))


def topic_count(*topics: Column) -> Column:
    """Number of topics before the first absent one."""
    found = F.lit(len(topics))
    for n in range(len(topics) - 1, -1, -1):
        found = F.when(topics[n].isNull(), F.lit(n)).otherwise(found)
    return found


def data_or_empty(data: Column) -> Column:
    return F.coalesce(data, F.lit(bytearray()))


def word0(data: Column) -> Column:
    """The first 32 bytes of the data: the token id of a TransferSingle."""
    return F.substring(data, 1, WORD)


def hexed(value: Column) -> Column:
    """0x and lower-case hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def unhexed(text: Column) -> Column:
    """Bytes of 0x text; null where it is not hex."""
    return F.unhex(F.substring(text, 3, 1 << 30))


def quantity(number: Column) -> Column:
    """A JSON-RPC quantity: hex without leading zeros."""
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def part_of(block_number: Column, width: int = PART_BLOCKS) -> Column:
    """Number of the part that holds a block."""
    return F.call_function("div", block_number, F.lit(width)).cast("long")


def part_name(number: int | Column) -> str | Column:
    """Zero-padded text of a part number."""
    return f"{number:03d}" if isinstance(number, int) else F.format_string("%03d", number)


def log_json() -> Column:
    """One log as the JSON object of the wire (columns of a log scan with bytes)."""
    c = F.col
    return F.to_json(
        F.struct(
            hexed(c("address")).alias("address"),
            F.transform(topics_array(*(c(t) for t in TOPICS)), hexed).alias("topics"),
            hexed(c("data")).alias("data"),
            quantity(c("block_number")).alias("blockNumber"),
            hexed(c("tx_hash")).alias("transactionHash"),
            quantity(c("tx_index")).alias("transactionIndex"),
            hexed(c("block_hash")).alias("blockHash"),
            quantity(c("block_ts")).alias("blockTimestamp"),
            quantity(c("log_index")).alias("logIndex"),
            F.lit(False).alias("removed"),
        )
    )
