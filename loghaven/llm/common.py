"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.session import materialize, scratch_path, shared_dir, ship_package

__all__ = ["materialize", "scratch_path", "shared_dir", "ship_package", "table", "text_hash", "rows_of", "batch_of", "byte_batches", "BitmapFilter", "trim"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(column: str | Column) -> Column:
    """A 64-bit digest of a text that tells null from empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples of the named columns.

    Values are turned to Python objects a slice at a time, so that one batch of long
    texts is never held twice.
    """
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
    finally:
        release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back after a batch of a function whose end is not seen."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """An Arrow batch from Python rows."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def byte_batches(texts: pa.Array, most: int) -> Iterator[list[str | None]]:
    """Group texts so that each batch holds about ``most`` bytes of UTF-8, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield texts.slice(at, i - at).to_pylist()
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield texts.slice(at).to_pylist()


class BitmapFilter:
    """A fixed-size bitmap of hashed keys that spares rows a shuffle.

    It says no only for keys that were not put in; at most ``MOST_BITS`` bits (16 MB, as
    two million rows of 64 bits) are broadcast, whatever the number of keys. With more
    keys it lets more rows pass, which costs a larger shuffle and changes no result. The
    look-up is a broadcast join, so no Python worker sees the rows.
    """

    MOST_BITS = 1 << 27

    def __init__(self, keys: DataFrame, hashed: Column):
        n = max(1, keys.count())
        self.bits = min(self.MOST_BITS, 1 << max(10, (16 * n - 1).bit_length()))
        spots = keys.select(F.pmod(hashed, F.lit(self.bits)).alias("spot"))
        words = spots.selectExpr("shiftright(spot, 6) AS bitmap_word", "shiftleft(1L, CAST(spot % 64 AS int)) AS bit")
        self.words = materialize(words.groupBy("bitmap_word").agg(F.bit_or("bit").alias("bitmap_bits")), "bitmap")

    def marked(self, rows: DataFrame, hashed: Column, name: str) -> DataFrame:
        """Rows with a column that says whether a key with this hash may have been put in."""
        placed = rows.withColumn("bitmap_spot", F.pmod(hashed, F.lit(self.bits)))
        joined = placed.join(F.broadcast(self.words), F.shiftright("bitmap_spot", 6) == F.col("bitmap_word"), "left")
        held = F.expr("shiftrightunsigned(bitmap_bits, CAST(bitmap_spot % 64 AS int)) & 1L") == 1
        return joined.withColumn(name, F.coalesce(held, F.lit(False))).drop("bitmap_spot", "bitmap_word", "bitmap_bits")

    def kept(self, rows: DataFrame, hashed: Column) -> DataFrame:
        """The rows that may have a key."""
        return self.marked(rows, hashed, "bitmap_may").where("bitmap_may").drop("bitmap_may")
