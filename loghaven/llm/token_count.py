"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts never leave the Python worker as ids: an Arrow function gets a column of
texts and gives back one integer each. Inside, texts are grouped into batches of
about equal bytes, and a long text is cut at safe boundaries (see ``tokens``), so a
worker holds the ids of one piece at a time. There is no shuffle.

Defined results: a null text counts like an empty one (0 bytes, 0 tokens); repeated
rows and rows with a null id are counted like any other; an empty table gives an
empty result; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import byte_batches, ship_package, table
from loghaven.llm.tokens import default_tokenizer, encoder

#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20


def length_function(tokenizer: str, batch_bytes: int = BATCH_BYTES):
    """An Arrow function: texts to numbers of tokens."""

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        engine = encoder(tokenizer)
        counts: list[int] = []
        for batch in byte_batches(texts, batch_bytes):
            counts += engine.lengths(batch)
        return pa.array(counts, pa.int64())

    return lengths


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), length_function(tokenizer or default_tokenizer())(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
