"""Builders shared by the tests."""

from __future__ import annotations

from loghaven import schema


def h(n) -> str:
    """A number (or hex text) as 32 bytes of hex."""
    return (f"{n:x}" if isinstance(n, int) else n).rjust(64, "0")


def a(n: int) -> str:
    return f"{n:040x}"


def b(text: str) -> bytearray:
    return bytearray.fromhex(text)


def raw_log(block: int, index: int, address: str, topics: list[str], data: bytes | None = b"", tx: int = 0, block_hash: str | None = None) -> tuple:
    return (block, index, tx, b(h(block * 1000 + index)), b(address), [b(t) for t in topics], None if data is None else bytearray(data), b(block_hash or h(block)))


def logs_frame(spark, rows):
    return spark.createDataFrame(rows, schema.RAW_LOGS)


def blocks_frame(spark, low: int, high: int, ts=lambda n: 1_700_000_000 + 12 * n, hash_of=h):
    return spark.createDataFrame([(n, b(hash_of(n)), ts(n)) for n in range(low, high + 1)], schema.BLOCKS)
