"""Event logs derived from order lines: the test relation that both engines can build.

One template in SQL serves Spark and the SQL twin, so both see the same rows. Hashes and
addresses are lower-case hex text without 0x here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.functions.eventset import NAMES, PUNKS

_SIGNATURE = "CASE WHEN m <= 6 THEN '{0}' WHEN m <= 9 THEN '{1}' WHEN m <= 11 THEN '{2}' WHEN m = 12 THEN '{3}' WHEN m = 13 THEN '{4}' WHEN m <= 15 THEN '{5}' WHEN m = 16 THEN '{6}' WHEN m = 17 THEN '{7}' WHEN m = 18 THEN '{8}' ELSE lpad('abc', 64, '0') END".format(*NAMES)

LOGS_TEMPLATE = f"""
SELECT l_orderkey AS block_number, CAST(rn AS int) AS log_index, l_linenumber AS tx_index,
  @SHA(concat('tx-', CAST(l_orderkey AS varchar(20)), '-', CAST(l_linenumber AS varchar(20)))) AS tx_hash,
  CASE WHEN l_suppkey % 10 = 0 THEN '{PUNKS}' ELSE lpad(lower(hex(l_suppkey)), 40, '0') END AS address,
  {_SIGNATURE} AS topic0,
  CASE WHEN nt >= 2 THEN lpad(lower(hex(CASE WHEN m IN (14, 15) THEN (l_partkey + l_orderkey) % 200 ELSE l_suppkey END)), 64, '0') END AS topic1,
  CASE WHEN nt >= 3 THEN lpad(lower(hex(l_orderkey % 50)), 64, '0') END AS topic2,
  CASE WHEN nt >= 4 THEN lpad(lower(hex((l_partkey + l_orderkey) % 200)), 64, '0') END AS topic3,
  CASE WHEN m BETWEEN 7 AND 9 THEN concat(lpad(lower(hex((l_partkey + l_orderkey) % 200)), 64, '0'), lpad(lower(hex(CAST(l_quantity AS bigint))), 64, '0')) ELSE '' END AS data
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS rn,
        l_partkey % 20 AS m, 1 + (l_linenumber % 4) AS nt FROM lineitem l) k
"""
BLOCKS_TEMPLATE = "SELECT o_orderkey AS number, @SHA(concat('block-', CAST(o_orderkey AS varchar(20)))) AS hash, @SECONDS(o_orderdate) AS ts FROM orders"


def spark_text(template: str) -> str:
    text = re.sub(r"@SHA\((concat\((?:[^()]|\([^()]*(?:\([^()]*\))?[^()]*\))*\))\)", r"sha2(\1, 256)", template)
    return text.replace("@SECONDS(o_orderdate)", "unix_micros(cast(o_orderdate as timestamp)) div 1000000")


def duckdb_text(template: str) -> str:
    return template.replace("@SHA(", "sha256(").replace("@SECONDS(o_orderdate)", "epoch_us(o_orderdate) // 1000000")


def derived_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as text, with the token word that the store keeps as a column of its own."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(spark_text(LOGS_TEMPLATE)).withColumn("data_word0", F.substring("data", 1, 64))


def derived_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as text: number, hash, ts."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(spark_text(BLOCKS_TEMPLATE))
