"""Extraction and sizing: source rows to stored shape, counts, gaps and checks.

Every operator is declarative; aggregates combine before the shuffle, verification
queries return the offending rows rather than collecting the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghaven.functions import codec, eventset


def kept(logs: DataFrame, hexed: bool = False) -> DataFrame:
    """Logs of the stored shapes (flat topic columns)."""
    return logs.where(eventset.keep_expr(F.col("topic0"), codec.topic_count(*map(F.col, codec.TOPICS)), F.col("address"), hexed))


def drop_reason(hexed: bool = False) -> Column:
    """Why a log is not stored; null for a stored one."""
    literal = (lambda h: F.lit(h)) if hexed else (lambda h: F.lit(bytearray.fromhex(h)))
    keep = eventset.keep_expr(F.col("topic0"), codec.topic_count(*map(F.col, codec.TOPICS)), F.col("address"), hexed)
    return F.when(keep, F.lit(None)).when(F.col("topic0").isin([literal(s) for s in eventset.PUNK_SIGNATURES]), "foreign contract").when(F.col("topic0").isin([literal(s) for s in eventset.SIGNATURES]), "topic count").otherwise("unknown signature")


def event_name(topic0: Column) -> Column:
    """Name of a signature given as hex text; null for others."""
    found = F.lit(None).cast("string")
    for signature, name in eventset.NAMES.items():
        found = F.when(topic0 == signature, name).otherwise(found)
    return found


def extract(source: DataFrame, last_block: int) -> DataFrame:
    """Rows of a chain source (hex text, topics array) up to a block, in the stored shape."""
    bounded = source.where((F.col("block_number") <= last_block) & (F.coalesce(F.size("topics"), F.lit(0)) > 0))
    topics = [codec.unhexed(codec.topic_at(F.col("topics"), i)).alias(f"topic{i}") for i in range(4)]
    flat = bounded.select(
        "block_number", "log_index", F.col("transaction_index").alias("tx_index"), codec.unhexed(F.col("transaction_hash")).alias("tx_hash"), codec.unhexed(F.col("address")).alias("address"),
        *topics, codec.unhexed(F.coalesce("data", F.lit("0x"))).alias("data"),
    )
    return kept(flat)


def source_blocks(blocks: DataFrame, last_block: int) -> DataFrame:
    """Blocks of a chain source (hex text, timestamps) up to a block, in the exported shape."""
    bounded = blocks.where(F.col("number") <= last_block)
    return bounded.select("number", codec.unhexed(F.col("hash")).alias("block_hash"), F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("ts"))


def write_export(logs: DataFrame, blocks: DataFrame, path: str, parts: int, width: int = codec.PART_BLOCKS) -> None:
    """Export with one zero-padded directory for each part; a part without rows still gets one."""
    named = logs.withColumn("part", codec.part_name(codec.part_of(F.col("block_number"), width)))
    named.repartition("part").sortWithinPartitions("part", "block_number", "log_index").write.partitionBy("part").option("compression", "snappy").mode("overwrite").parquet(f"{path}/logs")
    present = {r["part"] for r in named.select("part").distinct().collect()}
    for n in range(parts):
        if codec.part_name(n) not in present:
            logs.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/logs/part={codec.part_name(n)}")
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")


def part_counts(logs: DataFrame, parts: int, width: int = codec.PART_BLOCKS) -> DataFrame:
    """Rows of each part, parts without rows as 0: ``parts`` of them, or more if rows lie beyond.

    Every log counts once: parts below 0 have rows of their own, and so has a null part
    for logs without a block number.
    """
    counted = logs.groupBy(codec.part_of(F.col("block_number"), width).alias("part")).agg(F.count(F.lit(1)).alias("n_logs"))
    last = counted.agg(F.greatest(F.max("part"), F.lit(parts - 1).cast("long")).alias("last"))
    numbers = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    name = F.when(F.col("part").isNotNull(), codec.part_name(F.col("part")))
    return numbers.join(counted, "part", "full_outer").select(name.alias("part"), F.coalesce("n_logs", F.lit(0)).alias("n_logs"))


def by_year_and_event(scanned: DataFrame, size: Column) -> DataFrame:
    """Counts and data sizes of each year and signature (rows of a log scan)."""
    year = F.year(F.timestamp_seconds("block_ts")).alias("year")
    return scanned.groupBy(year, "topic0").agg(F.count(F.lit(1)).alias("n_logs"), F.sum(size).alias("sum_len"), F.avg(size).alias("avg_len"), F.max(size).alias("max_len"))


def totals(logs: DataFrame, size: Column) -> DataFrame:
    """Global counts, sizes, distinct values and the covered range."""
    distinct = [F.count_distinct(c).alias(f"n_{c}") for c in ("address", "topic1", "topic2", "topic3")]
    return logs.agg(F.count(F.lit(1)).alias("n_logs"), F.sum(size).alias("sum_len"), *distinct, F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def densest_block(logs: DataFrame) -> DataFrame:
    """The most logs that one block holds."""
    return logs.groupBy("block_number").count().agg(F.max("count").alias("max_logs"))


def duplicate_keys(logs: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return logs.groupBy("block_number", "log_index").count().where(F.col("count") > 1)


def disagreeing(logs: DataFrame, blocks: DataFrame, zero: Column) -> DataFrame:
    """Heights whose logs name another block hash than the block row, or a zero one.

    A log without a block row is not counted here; the store refuses it later.
    """
    named = blocks.select(F.col("number").alias("block_number"), F.col("hash").alias("header_hash"))
    wrong = logs.join(named, "block_number").where(F.col("block_hash").isNull() | (F.col("block_hash") != F.col("header_hash")) | (F.col("block_hash") == zero))
    return wrong.select("block_number").distinct()


def unmatched_logs(logs: DataFrame, blocks: DataFrame, zero: Column) -> DataFrame:
    """Logs that the store must refuse: no block row, another hash, or none."""
    named = blocks.select(F.col("number").alias("block_number"), F.col("hash").alias("header_hash"))
    return logs.join(named, "block_number", "left").where(F.col("header_hash").isNull() | F.col("block_hash").isNull() | (F.col("block_hash") == zero) | (F.col("block_hash") != F.col("header_hash")))


def logless(blocks: DataFrame, logs: DataFrame) -> DataFrame:
    """Blocks without any raw log."""
    return blocks.join(logs.select(F.col("block_number").alias("number")), "number", "left_anti")


def broken_links(headers: DataFrame, boundary: Column | None = None) -> DataFrame:
    """Headers of a whole history whose parent hash is not the hash one below.

    A self-join on the height, not a window over all rows, so it distributes. With a
    ``boundary`` hash the lowest header is compared with it; otherwise it is passed.
    """
    below = headers.select((F.col("number") + 1).alias("number"), F.col("hash").alias("below"))
    joined = headers.join(below, "number", "left")
    known = F.col("below") if boundary is None else F.coalesce("below", boundary)
    return joined.where(known.isNotNull() & (F.col("parent_hash") != known)).drop("below")


def broken_links_of_batch(headers: DataFrame, boundary: Column) -> DataFrame:
    """The same for one small batch of heights, by a window in order of height."""
    return headers.withColumn("below", F.coalesce(F.lag("hash").over(W.orderBy("number")), boundary)).where(F.col("below").isNotNull() & (F.col("parent_hash") != F.col("below"))).drop("below")


def fork_point(stored: DataFrame, canonical: DataFrame, height: int, walk: int = 1024) -> DataFrame:
    """The highest stored block below ``height``, within the walk, that the chain still has."""
    near = F.col("number").between(height - walk, height - 1)
    same = stored.where(near).select("number", "hash").join(canonical.where(near).select("number", "hash"), ["number", "hash"])
    return same.agg(F.max("number").alias("ancestor"))


def interval_of(blocks: DataFrame) -> DataFrame:
    """Range and count of blocks, and whether they have no gap."""
    found = blocks.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("heights"))
    return found.select("first", "last", "n", ((F.col("n") == F.col("last") - F.col("first") + 1) & (F.col("n") == F.col("heights"))).alias("contiguous"))


def replace_range(old: DataFrame, new: DataFrame, low: int, high: int, height: str = "block_number") -> DataFrame:
    """Rows outside a range as they were, rows inside it from ``new``."""
    return old.where(~F.col(height).between(low, high)).unionByName(new.where(F.col(height).between(low, high)))


def receipts_of(logs: DataFrame) -> DataFrame:
    """Receipts of each block: an array of transactions with their logs (for offline providers)."""
    whole = F.struct(*logs.columns)
    by_tx = logs.groupBy("block_number", "tx_index").agg(F.sort_array(F.collect_list(F.struct("log_index", whole.alias("log")))).alias("l"))
    return by_tx.select("block_number", "tx_index", F.transform("l", lambda x: x["log"]).alias("logs")).groupBy("block_number").agg(F.sort_array(F.collect_list(F.struct("tx_index", "logs"))).alias("receipts"))


def logs_of_receipts(receipts: DataFrame, signatures: list[Column]) -> DataFrame:
    """Logs of uncapped receipts that have one of the signatures; anonymous logs are passed over."""
    each = receipts.select(F.explode("receipts").alias("r")).select(F.explode("r.logs").alias("log")).select("log.*")
    first = codec.topic_at(F.col("topics"), 0) if "topics" in each.columns else F.col("topic0")
    return each.where(first.isin(signatures))


def unit_fingerprint(files: DataFrame, prefix: str) -> DataFrame:
    """SHA-256 over the sorted lines path|size|md5 of the files below a prefix; null if there are none."""
    line = F.concat_ws("|", "path", F.col("size").cast("string"), "md5")
    lines = files.where(F.col("path").startswith(prefix)).select("path", F.concat(line, F.lit("\n")).alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "")
    return lines.agg(F.when(F.count("line") > 0, F.sha2(joined, 256)).alias("fingerprint"))


def file_differences(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Files that the manifest lists and the folder lacks, and the reverse, and changed ones."""
    a = listed.select("path", F.col("size").alias("listed_size"), F.col("md5").alias("listed_md5"))
    b = present.select("path", F.col("size").alias("size"), F.col("md5").alias("md5"))
    both = a.join(b, "path", "full_outer")
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("listed_size").isNull(), "unlisted").when((F.col("size") != F.col("listed_size")) | (F.col("md5") != F.col("listed_md5")), "changed")
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
