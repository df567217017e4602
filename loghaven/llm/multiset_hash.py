"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is hashed to a wide vector; the fingerprint of a document is the sum of its
paragraphs' vectors, each lane modulo a power of two. The order of paragraphs does not
matter, and a paragraph is inserted into or deleted from a fingerprint by adding or
subtracting its vector. The vector has two parts:

* ``EXACT_LANES`` lanes modulo 2**64, drawn from a digest of the paragraph: equal
  fingerprints mean equal multisets of paragraphs;
* ``LIKE_LANES`` lanes modulo 2**16, the sum of sparse signed vectors of the
  paragraph's three-word shingles. Read as signed numbers, their normed inner product
  estimates the cosine of two documents' shingle counts, which is the likeness.

To find each document's successor, rows are dealt by ranges of (id, row number), so that
rows of one id may lie in several tasks, and each task goes once through its sorted
rows with one row in hand. Only the first and last row of each task (a few per task)
are paired afterwards. Hashes of a document's shingles are computed once; the edited
text's fingerprint comes from them by deletion and insertion, and only the two
paragraphs that the edit cuts are hashed anew.

Defined results: a null text is an empty one (0 characters, zero fingerprint); rows of
equal id are ordered by their text's digest; null ids come first; a table of one row is
its own successor; an empty table gives an empty result. Equal fingerprints have
likeness 1, an empty and a non-empty text 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import batch_of, materialize, rows_of, ship_package, table, text_hash

EXACT_LANES = 8
LIKE_LANES = 96
SHINGLE = 3
_SEED = 10
#: Bytes of text that a task should go through.
TASK_BYTES = 1 << 27

_OUT = pa.schema(
    [
        ("part", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)
_DDL = "part int, edge string, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _shingle_hashes(paragraph: str) -> np.ndarray:
    """64-bit hashes of the shingles of one paragraph, repeats included."""
    words = paragraph.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(joined, _SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(joined[a:b], _SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def _like_vector(hashes: np.ndarray) -> np.ndarray:
    """Sum of the sparse signed vectors of shingles."""
    lanes = (hashes % np.uint64(LIKE_LANES)).astype(np.int64)
    signs = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float64)
    return np.bincount(lanes, signs, LIKE_LANES).astype(np.int64)


def _exact_vector(paragraph: str) -> np.ndarray:
    """Lanes of one paragraph's digest; an empty paragraph counts too."""
    digest = hashlib.blake2b(paragraph.encode("utf-8", "surrogatepass"), digest_size=8 * EXACT_LANES).digest()
    return np.frombuffer(digest, "<u8").astype(np.uint64)


class Paragraphs:
    """A document as paragraphs with their vectors, each hashed once."""

    def __init__(self, text: str):
        self.text = text
        self.parts = text.split("\n") if text else []
        hashes = [_shingle_hashes(p) for p in self.parts]
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.hash_ends = np.cumsum([len(h) for h in hashes], dtype=np.int64)
        self.exact = np.array([_exact_vector(p) for p in self.parts], np.uint64).reshape(-1, EXACT_LANES)
        #: Code points up to the end of each paragraph, its line break not counted.
        self.ends = np.cumsum([len(p) + 1 for p in self.parts], dtype=np.int64) - 1
        self.fingerprint = Fingerprint.zero() if not self.parts else self.sum_of(len(self.parts))

    def sum_of(self, n: int) -> Fingerprint:
        """Fingerprint of the first n paragraphs."""
        if not n:
            return Fingerprint.zero()
        return Fingerprint(self.exact[:n].sum(0, dtype=np.uint64), _like_vector(self.hashes[: self.hash_ends[n - 1]]))

    def whole_before(self, chars: int) -> int:
        """Paragraphs that end, line break included, within the first ``chars`` code points."""
        return int(np.searchsorted(self.ends, chars, "left"))


class Fingerprint:
    """A pair of lane vectors that can be added and subtracted."""

    def __init__(self, exact: np.ndarray, like: np.ndarray):
        self.exact, self.like = exact, like

    @classmethod
    def zero(cls) -> Fingerprint:
        return cls(np.zeros(EXACT_LANES, np.uint64), np.zeros(LIKE_LANES, np.int64))

    @classmethod
    def of_paragraph(cls, paragraph: str) -> Fingerprint:
        return cls(_exact_vector(paragraph), _like_vector(_shingle_hashes(paragraph)))

    @classmethod
    def of_text(cls, text: str) -> Fingerprint:
        return Paragraphs(text).fingerprint

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.like - other.like)

    def hex(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.like.astype("<i2", casting="unsafe").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """From 0 to 1; 1 for equal fingerprints."""
        mine, theirs = (f.like.astype("<i2", casting="unsafe").astype(np.float64) for f in (self, other))
        if np.array_equal(self.exact, other.exact) and np.array_equal(mine, theirs):
            return 1.0
        norm = float(np.sqrt((mine @ mine) * (theirs @ theirs)))
        return min(1.0, max(0.0, float(mine @ theirs) / norm)) if norm else 0.0


def edited(own: Paragraphs, after: Paragraphs) -> tuple[str, Fingerprint]:
    """The edited text and its fingerprint, by deleting and inserting paragraphs."""
    half = len(own.text) // 2
    keep = len(own.text) - half
    head = min(half, len(after.text))
    text = own.text[:keep] + after.text[:head]
    if not text:
        return text, Fingerprint.zero()
    kept = own.whole_before(keep)
    # the middle starts where the kept whole paragraphs end and lasts to the inserted text's first break
    start = int(own.ends[kept - 1]) + 1 if kept else 0
    brk = after.text.find("\n", 0, head)
    if brk < 0:
        return text, own.sum_of(kept) + Fingerprint.of_paragraph(text[start:])
    middle = Fingerprint.of_paragraph(text[start : keep + brk])
    taken = after.whole_before(head)
    rest = int(after.ends[taken - 1]) + 1 if taken else 0
    tail = Fingerprint.of_paragraph(after.text[rest:head])
    inserted = after.sum_of(taken) - Fingerprint(after.exact[0], _like_vector(after.hashes[: after.hash_ends[0]]))
    return text, own.sum_of(kept) + middle + inserted + tail


def _finished(doc_id: int | None, own: Paragraphs, after: Paragraphs) -> tuple:
    text, print_ = edited(own, after)
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(own.text), sha, own.fingerprint.hex(), print_.hex(), own.fingerprint.likeness(print_), own.fingerprint.likeness(after.fingerprint)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish every row that has its successor in this task; give out the first and last row."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    held: tuple[int | None, Paragraphs] | None = None
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        now = Paragraphs(text or "")
        if held is None:
            out.append((part, "first", doc_id, text, *[None] * 6))
        else:
            first = _finished(held[0], held[1], now)
            out.append((part, None, first[0], None, *first[1:]))
        held = (doc_id, now)
        if len(out) >= 1000:
            yield batch_of(_OUT, out)
            out = []
    if held is not None:
        out.append((part, "last", held[0], held[1].text, *[None] * 6))
    if out:
        yield batch_of(_OUT, out)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, text, after in rows_of(batches, "doc_id", "text", "after"):
        first = _finished(doc_id, Paragraphs(text or ""), Paragraphs(after or ""))
        yield batch_of(_OUT, [(None, None, first[0], None, *first[1:])])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and their likenesses."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("digest", text_hash("text")).withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = materialize(ordered.mapInArrow(_in_order, _DDL), "fingerprints")

    # two rows a task: the last row of a task is followed by the first of the next task that has rows
    filled = [r["part"] for r in done.where(F.col("edge") == "first").select("part").orderBy("part").collect()]
    follows = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, next int")
    last = done.where(F.col("edge") == "last").select("part", "doc_id", "text").join(F.broadcast(follows), "part")
    first = done.where(F.col("edge") == "first").select(F.col("part").alias("next"), F.col("text").alias("after"))
    edges = last.join(first, "next").select("doc_id", "text", "after").mapInArrow(_pairs, _DDL)
    return done.where(F.col("edge").isNull()).select(*_RESULT).unionByName(edges.select(*_RESULT))


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
