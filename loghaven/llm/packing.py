"""Packing: best-fit decreasing over a segment tree of remaining capacities.

A document is tokenised once, ends with an end id, and is cut into full windows; what
is left over (shorter than a window) is a piece to be packed. Only one small row for
each piece goes on: its length and the CRC of its ids, never the ids. Pieces are dealt
by row number, not by document or source, into shards of a bounded size, so no key can
overload a task; each shard is packed by itself. In a shard the pieces are taken by
falling length, and a segment tree over the capacities 0..window finds the tightest
open window that still holds the piece.

The waste of a shard is a few open windows, whatever the corpus holds; shards of
``SHARD_PIECES`` pieces make that a fraction of a percent.

Defined results: a null text is an empty one (its only id is the end id); repeated
rows and null ids are packed like any other row; an empty table gives an empty
result. A sequence whose filled length is a power of two needs no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import batch_of, materialize, rows_of, ship_package, table
from loghaven.llm.tokens import default_tokenizer, encoder

#: Pieces that one task packs together.
SHARD_PIECES = 50_000
WINDOW = 2048
END_ID = 1

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A segment tree indexed by remaining capacity; a node knows if any window is below it."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = defaultdict(list)

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of least capacity that is at least ``least``."""
        node = least + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.open[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) for each length; lengths must already fall."""
    tree, opened, placed = CapacityTree(window), 0, []
    for n in lengths:
        found = tree.take_tightest(n)
        capacity, at = found or (window, opened)
        opened += found is None
        placed.append((at, window - capacity))
        if capacity > n:
            tree.add(capacity - n, at)
    return placed


def cut(ids: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc) of the full windows of a document and of its rest."""
    data = np.ascontiguousarray(ids, "<u4")
    for start in range(0, len(data), window):
        piece = data[start : start + window]
        yield start, len(piece), zlib.crc32(piece.tobytes())


def _pieces(tokenizer: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, out = encoder(tokenizer), []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = np.append(engine.ids(text), np.uint32(end_id))
            out += [(doc_id, s, n, crc, len(ids)) for s, n, crc in cut(ids, window)]
            if len(out) >= 10_000:
                yield batch_of(_PIECE, out)
                out = []
        if out:
            yield batch_of(_PIECE, out)

    return run


def _pack(window: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit_decreasing(pieces["length"].tolist(), window)
        at = np.array(placed, np.int64).reshape(-1, 2)
        # a shard holds at most 2**31 windows, so numbers of shards never meet
        pieces = pieces.assign(sequence_id=(np.int64(key[0]) << np.int64(31)) + at[:, 0], offset=at[:, 1])
        return pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{f.name} long" for f in _PIECE)
    cuts = materialize(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), window, end_id), schema), "pieces")
    # the written table fixes the numbering; the count decides how many shards there are
    shards = max(1, -(-cuts.count() // shard_pieces))
    dealt = cuts.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(window), _PLACED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
