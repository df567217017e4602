"""Corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; it is
written as Parquet to the shared folder and read again as the next one's input. All
stages but the last return the columns of ``documents``.

1. ``quality``: importance resampling draws the documents to keep.
2. ``near_copies``: of each group of documents linked by a similarity of 0.8 or more
   (Jaccard, sets of five-word shingles) the one with the least id stays. Candidates come
   from the SimHash tree and, beyond its radius, from minimum hashes.
3. ``passages``: repeated lines and passages go, the earliest stays; a document of which
   nothing is left goes; ``n_chars`` follows the text.
4. ``leaks``: documents that hold a benchmark item go.
5. ``pack``: what is left is packed into sequences of 2048 ids.

Defined results: a null or empty text has weight 1 in ``quality``; all such texts are one
group in ``near_copies``, of which the least id stays, and are packed as one end id. Ties:
of rows that repeat the least id of a group all stay, in ``quality`` all values equal to the
last one drawn. Rows without an id stay in every stage that compares ids. Rows that are
repeated with their id are one occurrence in ``passages``. An empty ``documents`` gives an
empty result, an empty ``labels`` rejects nothing, an empty ``benchmark`` finds no leak.
Extra columns go through all stages but the last, whatever their names.

No SQL twin: tokens, sampling noise and set similarity search are beyond SQL. ``tests/llm``
compares ``quality``, ``near_copies``, ``leaks`` and ``pack`` with plain Python versions
and ``passages`` with one that looks for repeats among all lines and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import scratch_path, table
from loghaven.llm.decontaminate import remove_leaks
from loghaven.llm.importance import resample
from loghaven.llm.line_dedup import remove_repeats
from loghaven.llm.near_copies import keep_one
from loghaven.llm.packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, table(spark, sf_dir, "labels")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(docs)
    cleaned = cleaned.where((F.size("removed") == 0) | (F.trim("text") != ""))
    named = {"text": F.col("text"), "n_chars": F.when(F.size("removed") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return cleaned.select(*[named.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("leaks", leaks), ("pack", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
