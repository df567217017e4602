"""Parquet exports: manifest, file verification, and readers by column name."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven import schema
from loghaven.errors import BackfillError
from loghaven.functions import codec
from loghaven.operators import analytics

NAME = "manifest.json"


@dataclass(frozen=True)
class Manifest:
    """The trusted description of an export."""

    export: str
    source: str
    first: int
    last: int
    block_rows: int
    log_rows: int
    parts: dict[str, int]
    files: dict[str, tuple[int, str]]

    def part_rows(self, part: int) -> int:
        name = f"{part:03d}"
        if name not in self.parts:
            raise BackfillError(f"{NAME} has no entry for logs/part={name}")
        return self.parts[name]

    def fingerprint(self, prefix: str) -> str:
        """SHA-256 over the sorted lines of the files below a prefix."""
        lines = [f"{p}|{size}|{md5}\n" for p, (size, md5) in sorted(self.files.items()) if p.startswith(prefix)]
        return hashlib.sha256("".join(lines).encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file by way of Spark's file systems; None if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_manifest(spark: SparkSession, root: str) -> Manifest:
    """Read and sanity-check the manifest of an export."""
    text = read_text(spark, f"{root}/{NAME}")
    if text is None:
        raise BackfillError(f"{NAME} is required at the export root and must come from the export's source, not from the copy")
    try:
        raw = json.loads(text)
        blocks, logs = raw["blocks"], raw["logs"]
        found = Manifest(raw.get("export", ""), raw.get("source", ""), int(blocks["first"]), int(blocks["last"]), int(blocks["rows"]), int(logs["rows"]), {k: int(v) for k, v in (logs.get("parts") or {}).items()}, {k: (int(v["size"]), v["md5"]) for k, v in (raw.get("files") or {}).items()})
    except (ValueError, KeyError, TypeError) as e:
        raise BackfillError(f"parse {NAME}: {e}") from None
    if found.last < found.first or found.block_rows != found.last - found.first + 1:
        raise BackfillError(f"{NAME}: blocks {found.first}-{found.last} with {found.block_rows} rows is not one contiguous run")
    if sum(found.parts.values()) != found.log_rows:
        raise BackfillError(f"{NAME}: partition rows sum to {sum(found.parts.values())}, logs.rows is {found.log_rows}")
    if not found.files:
        raise BackfillError(f"{NAME} lists no files")
    return found


def list_files(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """path (relative), size and base64 MD5 of the Parquet files below a prefix.

    Only files below the prefix are opened. Contents are hashed on the executors; a file
    is one row, so exports keep files at the size that a task can hold.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/{prefix.rstrip('/')}")
    except AnalysisException:
        return spark.createDataFrame([], "path string, size long, md5 string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    relative = F.substring(plain(F.col("path")), len(base.replace("file://", "").replace("file:", "")) + 2, 1 << 30)
    listed = files.select(relative.alias("path"), F.col("length").alias("size"), F.base64(F.unhex(F.md5("content"))).alias("md5"))
    return listed.where(F.col("path").startswith(prefix))


def verify_files(spark: SparkSession, root: str, manifest: Manifest, prefix: str) -> None:
    """Every listed file is there unaltered, and no other file is."""
    listed = [(p, s, m) for p, (s, m) in manifest.files.items() if p.startswith(prefix)]
    if not listed:
        raise BackfillError(f'{NAME} lists no files under "{prefix}"')
    wanted = spark.createDataFrame(listed, "path string, size long, md5 string")
    present = list_files(spark, root, prefix).persist()
    try:
        wrong = analytics.file_differences(wanted, present).orderBy(F.expr("CASE problem WHEN 'unlisted' THEN 1 ELSE 0 END"), "path").limit(1).collect()
        if not wrong:
            return
        path, problem = wrong[0]
        if problem == "missing":
            raise BackfillError(f"{path} listed in {NAME}: no such file")
        if problem == "unlisted":
            raise BackfillError(f"{path} is not listed in {NAME}; the copy holds files the export did not produce")
        size, md5 = manifest.files[path]
        got = present.where(F.col("path") == path).first()
        raise BackfillError(f"{path} differs from {NAME} (size {got['size']} vs {size}, md5 {got['md5']} vs {md5}); the copy is truncated or altered")
    finally:
        present.unpersist()


def build_manifest(spark: SparkSession, root: str, export: str, source: str, first: int, last: int, parts: dict[str, int]) -> dict:
    """A manifest of an export that lies below ``root`` (parts without rows count 0)."""
    files = {r["path"]: {"size": r["size"], "md5": r["md5"]} for kind in ("blocks", "logs") for r in list_files(spark, root, kind).collect()}
    return {"export": export, "source": source, "blocks": {"first": first, "last": last, "rows": last - first + 1}, "logs": {"rows": sum(parts.values()), "parts": parts}, "files": files}


def write_source(logs: DataFrame, blocks: DataFrame, path: str, last_block: int, width: int = codec.PART_BLOCKS) -> None:
    """Export of a chain source (hex text) up to a block: stored shapes, parts, block rows."""
    analytics.write_export(analytics.extract(logs, last_block), analytics.source_blocks(blocks, last_block), path, last_block // width + 1, width)


def source_manifest(spark: SparkSession, root: str, logs: DataFrame, blocks: DataFrame, last_block: int, export: str, source: str, width: int = codec.PART_BLOCKS) -> dict:
    """The manifest of an export with row counts from its source, not from its files."""
    counts = analytics.part_counts(analytics.extract(logs, last_block), last_block // width + 1, width)
    found = blocks.where(F.col("number") <= last_block).agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("rows")).first()
    if found["last"] != last_block:
        raise BackfillError(f"the source's blocks end at {found['last']}, not at {last_block}")
    made = build_manifest(spark, root, export, source, found["first"], last_block, {r["part"]: r["n_logs"] for r in counts.collect()})
    made["blocks"]["rows"] = found["rows"]
    return made


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{NAME}")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(manifest, indent=1).encode()))
    out.close()


def read_part(spark: SparkSession, root: str, part: int) -> DataFrame:
    """Rows of one part, columns by name, in the stored types."""
    rows = spark.read.schema(schema.EXPORT_LOGS).parquet(f"{root}/logs/part={part:03d}")
    data = F.coalesce("data", F.lit(bytearray()))
    return rows.select("block_number", F.col("log_index").cast("int").alias("log_index"), F.col("tx_index").cast("int").alias("tx_index"), "tx_hash", "address", "topic0", "topic1", "topic2", "topic3", data.alias("data"), F.substring(data, 1, 32).alias("data_word0"))


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schema.EXPORT_BLOCKS).parquet(f"{root}/blocks").select("number", F.col("block_hash").alias("hash"), "ts")


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
