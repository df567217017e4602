"""Queries of the corpus operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loghaven.llm.decontaminate import op9_benchmark_leaks
from loghaven.llm.importance import op6_importance_resampling
from loghaven.llm.line_dedup import op2_substring_dedup
from loghaven.llm.multiset_hash import op10_multiset_fingerprints
from loghaven.llm.packing import op7_packing
from loghaven.llm.page_diff import op4_page_diff_text
from loghaven.llm.simhash_groups import op1_simhash_groups
from loghaven.llm.token_count import op8_token_counts
from loghaven.llm.url_rules import OP5_SQL, op5_url_filters
from loghaven.llm.warc import OP3_SQL, op3_warc_round_trip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function of (spark, folder of tables)."""
    return {f.__name__: f for f in (op1_simhash_groups, op2_substring_dedup, op3_warc_round_trip, op4_page_diff_text, op5_url_filters, op6_importance_resampling, op7_packing, op8_token_counts, op9_benchmark_leaks, op10_multiset_fingerprints)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op3_warc_round_trip": OP3_SQL, "op5_url_filters": OP5_SQL}
