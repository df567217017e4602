"""Quality classifier: importance resampling with hashed n-gram models, by Gumbel top-k.

Two generative models of hashed n-grams are counted: the raw one over all documents, the
target one over documents that are labelled good and not toxic. A model gives each n-gram
a rate for a document. The log ratio of a bucket is that of its target rate to its raw
rate, with ``SMOOTHING`` added to the target count and to the count that the raw model
expects of as many documents. The log importance weight of a document is the sum of the
ratios of all its n-grams, normalised to ``LENGTH`` n-grams by the square root, as their
noise grows. Documents are drawn without replacement in proportion to their weights: the
``k`` largest values of ``log weight + Gumbel noise``. The noise is a hash of the row, so
a draw can be repeated. ``k`` is ``share`` of all documents; where no share is given it is
that of the target among the labelled rows.

N-grams are words (runs of letters, digits and non-ASCII bytes, or runs of other ASCII
characters; white space parts them), the character n-grams of ``PREFIXES`` bytes with
which longer words begin, each kind in a table of its own, and one back-reference for
every word that repeats the one before it, whichever word that is.

The raw counts cover every document and the whole text. Labels are bounded: the
``LABELS`` labelled rows of least hash are used (a documented sample), so their ids can be
sent to all tasks and no text is shuffled to find the labelled ones. A task gives out its
nonzero buckets, which are summed; the model that returns to the driver has a fixed size.
Texts are read as bytes of whole Arrow batches, in bounded parts. The k-th largest value
is found exactly by repeated histograms.

Defined results: a null or empty text has weight 1; equal rows get equal values, and
values equal to the k-th are all drawn; without a labelled target all documents have
weight 1 and all are drawn; a document with labels that disagree is no target; an empty
table gives an empty result; extra columns pass through whatever their names; a run of
more than ``PART_BYTES`` bytes without white space counts as several words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import materialize, release_memory, ship_package, table, trim
from loghaven.llm.rolling import Runs, mixed

LABELS = 50_000
TABLE_BITS = 18
#: Lengths in bytes of the character n-grams that begin a word.
PREFIXES = (6, 7, 8)
SMOOTHING = 8.0
#: N-grams to which log weights are normalised.
LENGTH = 400
SEED = 6
#: Bytes of text that are hashed at once.
PART_BYTES = 1 << 18

_SIZE = 1 << TABLE_BITS
_KINDS = 1 + len(PREFIXES)
#: Places after the tables: back-references, and the number of documents.
_REPEAT = _KINDS * _SIZE
_DOCS = _REPEAT + 1
_SPACE, _LETTER, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[b for b in range(256) if b >= 128 or chr(b).isalnum() or b == ord("_")]] = _LETTER


def _places(data: np.ndarray, ends: np.ndarray, before: np.uint64 | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.uint64 | None]:
    """(number of the text, bucket) of all n-grams, kind by kind, and the hash of the last word.

    ``data`` holds the bytes of texts one after the other, ``ends`` where each ends;
    ``before`` is the hash of the word before the first one, if the first text goes on.
    """
    kinds = _CLASS[data]
    first = np.empty(len(data), bool)
    first[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    first[ends[ends < len(data)]] = True
    edges = np.append(np.flatnonzero(first), len(data))
    start, end = edges[:-1], edges[1:]
    words = kinds[start] != _SPACE
    start, end = start[words], end[words]
    if not len(start):
        return [], before
    text = np.searchsorted(ends, start, "right")
    runs = Runs(data.astype(np.uint64) + np.uint64(1))
    shift = np.uint64(64 - TABLE_BITS)
    hashes = runs(start, end)
    again = np.empty(len(text), bool)
    again[0] = before is not None and hashes[0] == before
    np.logical_and(hashes[1:] == hashes[:-1], text[1:] == text[:-1], out=again[1:])
    found = [(text, (hashes >> shift).astype(np.int64)), (text[again], np.full(np.count_nonzero(again), _REPEAT))]
    for kind, n in enumerate(PREFIXES, 1):
        longer = (end - start > n) & (kinds[start] == _LETTER)
        begin = start[longer]
        places = mixed(runs(begin, begin + n) + np.uint64(SEED)) >> shift
        found.append((text[longer], places.astype(np.int64) + kind * _SIZE))
    return found, hashes[-1]


def _parts(texts: pa.Array) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(number of the first text, whether it goes on, bytes, ends) of about ``PART_BYTES`` each.

    No text is null. A text longer than that comes alone, in parts that end at white space.
    """
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[until])
        if until > at + 1 or high - low <= PART_BYTES:
            yield at, False, data[low:high], offsets[at + 1 : until + 1] - low
        else:
            begin = low
            while low < high:
                cut = min(high, low + PART_BYTES)
                if cut < high:
                    spaces = np.flatnonzero(_CLASS[data[low:cut]] == _SPACE)
                    cut = low + int(spaces[-1]) + 1 if len(spaces) else cut
                yield at, low > begin, data[low:cut], np.array([cut - low])
                low = cut
        at = until


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of the n-grams of all texts, in bounded parts."""
    last = None
    for at, goes_on, data, ends in _parts(texts):
        found, last = _places(data, ends, last if goes_on else None)
        for text, places in found:
            yield text + at, places


def _counts(targets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(_DOCS + 1, np.int64), np.zeros(_DOCS + 1, np.int64)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            wanted = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), targets) & ids.is_valid().to_numpy(zero_copy_only=False)
            raw[_DOCS] += len(wanted)
            good[_DOCS] += np.count_nonzero(wanted)
            for text, places in ngrams(batch.column(batch.schema.get_field_index("text"))):
                np.add.at(raw, places, 1)
                np.add.at(good, places[wanted[text]], 1)
        filled = np.flatnonzero(raw)
        for at in range(0, len(filled), 50_000):
            part = filled[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(good[part])], names=["place", "raw", "good"])
        release_memory()

    return run


def log_ratios(raw: np.ndarray, good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of the target's rate by the raw one's for each bucket; 0 without a target."""
    if not good[_DOCS]:
        return np.zeros(_DOCS, np.float32)
    return np.log((good[:_DOCS] + smoothing) / (raw[:_DOCS] * (good[_DOCS] / raw[_DOCS]) + smoothing)).astype(np.float32)


def labelled(labels: DataFrame, most_labels: int = LABELS) -> tuple[np.ndarray, float | None]:
    """Ids of the target, and its share of the labelled rows (None without a target)."""
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
    drawn = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    found = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).toArrow()
    good = found["good"].to_numpy()
    return np.sort(found["doc_id"].to_numpy()[good]), float(good.mean()) if good.any() else None


def fit(docs: DataFrame, targets: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The table of log ratios: raw counts of all documents, target counts of the ids given."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a task gives out one table, so the number of tasks bounds what is shuffled
    rows = rows.coalesce(8 * spark.sparkContext.defaultParallelism)
    counted = rows.mapInArrow(_counts(targets), "place int, raw long, good long").groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    found = counted.toArrow()
    raw, good = np.zeros(_DOCS + 1, np.int64), np.zeros(_DOCS + 1, np.int64)
    places = found["place"].to_numpy()
    raw[places], good[places] = found["raw"].to_numpy(), found["good"].to_numpy()
    return log_ratios(raw, good)


def log_weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Normalised log importance weights of texts; none is null."""
    found, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for text, places in ngrams(texts):
        if len(text):
            low = int(text[0])
            sums = np.bincount(text - low, ratios[places])
            found[low : low + len(sums)] += sums
            count[low : low + len(sums)] += np.bincount(text - low)
    return found * np.sqrt(LENGTH / np.maximum(count, 1))


def weight_column(spark: SparkSession, ratios: np.ndarray, text: Column) -> Column:
    """Log importance weights as an Arrow function of a text column."""
    shared = spark.sparkContext.broadcast(ratios)  # a fixed size: 4 MB

    @F.arrow_udf("double")
    def weights(texts: pa.Array) -> pa.Array:
        found = pa.array(log_weights(texts, shared.value), pa.float64())
        trim()
        return found

    return weights(F.coalesce(text, F.lit("")))


def gumbel(*columns: Column) -> Column:
    """Standard Gumbel noise from a hash of the columns."""
    share = (F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(share))


def kth_largest(values: DataFrame, column: str, k: int, small: int = 20_000) -> float:
    """The exact k-th largest value of a column without nulls, by repeated histograms."""
    rest, above = values.select(F.col(column).alias("v")), 0
    low, high = rest.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = (high - low) / 4096
        cell = F.least(F.floor((F.col("v") - low) / width), F.lit(4095))
        cells = rest.where(F.col("v").between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for c in sorted(cells, key=lambda c: -c["cell"]):
            if above + c["n"] >= k:
                break
            above += c["n"]
        low, high = c["low"], c["high"]
        if c["n"] <= small and low < high:
            found = rest.where(F.col("v").between(low, high)).groupBy("v").count().orderBy(F.desc("v")).collect()
            for r in found:
                above += r["count"]
                if above >= k:
                    return r["v"]
    return low


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = True) -> DataFrame:
    """Rows that the sampler draws: (row struct or doc_id, log_weight, sample_key).

    ``k`` is ``share`` of all rows, rounded, at least one.
    """
    spark = docs.sparkSession
    targets, found = labelled(labels)
    ratios = fit(docs, targets, id_col=id_col, text_col=text_col)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep_columns else F.col(id_col).alias("doc_id")
    noise = gumbel(F.col(id_col).cast("long"), F.col(text_col))
    scored = docs.select(own, weight_column(spark, ratios, F.col(text_col)).alias("log_weight"), noise.alias("noise"))
    scored = materialize(scored.withColumn("sample_key", F.col("log_weight") + F.col("noise")).drop("noise"), "scored")
    share = found if share is None else share
    n = scored.count()
    if share is None or not n:
        return scored
    least = kth_largest(scored, "sample_key", min(n, max(1, math.floor(share * n + 0.5))))
    return scored.where(F.col("sample_key") >= least)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn from the whole corpus, with their weights."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_columns=False)
