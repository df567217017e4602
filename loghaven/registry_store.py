"""Registered queries that run the product itself: export, load, store, service, ingestion.

One export is written from the derived logs and loaded into a warehouse for each folder of
tables; queries that change a warehouse get one of their own that begins with the same
(immutable) generations. Every range is computed from the tables.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven import config, schema
from loghaven.engine import Engine
from loghaven.errors import WriterBusy
from loghaven.functions import codec, eventset
from loghaven.functions.eventset import PUNKS, SIGNATURES, TRANSFER, TRANSFER_SINGLE, URI
from loghaven.operators import analytics as A
from loghaven.operators.backfill import Backfill
from loghaven.operators.state import State
from loghaven.operators.store import Warehouse
from loghaven.plans import criteria as C
from loghaven.plans.query import Query
from loghaven.registry import _CTE, _KEEP, _NT, w
from loghaven.session import materialize, scratch_path
from loghaven.sources import export as X
from loghaven.sources import provider as P
from loghaven.sources.derived import derived_blocks, derived_logs
from loghaven.streaming import subscriber as S

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_H = "(SELECT max(number) FROM b)"
_STORED = "block_number, log_index, tx_index, tx_hash, address, topic0, topic1, topic2, topic3, data"
_SCAN = f"{_STORED}, block_hash, block_ts"
_KEPT = f"k AS (SELECT * FROM s WHERE {_KEEP})"
_WIDTH = "(SELECT (max(number) + 4) // 4 FROM b)"


class Clock:
    """Time that passes only when someone sleeps."""

    def __init__(self):
        self.t = 0.0

    def now(self) -> float:
        return self.t

    def sleep(self, seconds: float) -> None:
        self.t += seconds


class Rig:
    """Source, export and loaded warehouse of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.logs, self.blocks = (materialize(f(spark, sf_dir), "derived") for f in (derived_logs, derived_blocks))
        self.head = self.blocks.agg(F.max("number")).first()[0]
        self.width = (self.head + 4) // 4

    @functools.cached_property
    def source(self) -> tuple[DataFrame, DataFrame]:
        ox = lambda c: F.concat(F.lit("0x"), F.col(c))
        topics = F.filter(F.array(*(ox(t) for t in codec.TOPICS)), lambda t: t.isNotNull())
        logs = self.logs.select("block_number", F.col("log_index").cast("long").alias("log_index"), F.col("tx_index").cast("long").alias("transaction_index"), ox("tx_hash").alias("transaction_hash"), ox("address").alias("address"), F.when(F.col("data") != "", ox("data")).alias("data"), topics.alias("topics"))
        return logs, self.blocks.select("number", ox("hash").alias("hash"), F.timestamp_seconds("ts").alias("timestamp"))

    @functools.cached_property
    def export(self) -> str:
        path = scratch_path(self.spark, "export")
        X.write_source(*self.source, path, self.head, self.width)
        X.write_manifest(self.spark, path, X.source_manifest(self.spark, path, *self.source, self.head, "e1", "derived", self.width))
        return path

    def empty(self) -> Warehouse:
        return Warehouse(self.spark, scratch_path(self.spark, "warehouse"), part_blocks=self.width)

    @functools.cached_property
    def store(self) -> Warehouse:
        """Loaded by all stages of the backfill; queries only read it."""
        found = self.empty()
        Backfill(found, self.export).run()
        return found

    def own(self) -> Warehouse:
        """A warehouse of its own with the generations of the loaded one."""
        found = self.empty()
        found.states.commit(replace(self.store.states.read(), version=0))
        return found

    @functools.cached_property
    def raw(self) -> DataFrame:
        """Logs as a node gives them."""
        named = self.blocks.select(F.col("number").alias("block_number"), F.col("hash").alias("block_hash"))
        topics = F.transform(F.filter(F.array(*(F.col(t) for t in codec.TOPICS)), lambda t: t.isNotNull()), lambda t: F.unhex(t))
        return self.logs.join(named, "block_number").select("block_number", "log_index", F.col("tx_index").cast("int").alias("tx_index"), F.unhex("tx_hash").alias("tx_hash"), F.unhex("address").alias("address"), topics.alias("topics"), F.unhex("data").alias("data"), F.unhex("block_hash").alias("block_hash"))

    def headers(self, fork: int | None = None) -> DataFrame:
        """Headers of the chain, or of one that left it at a height."""
        name = lambda n: F.concat(F.when(n >= (fork if fork is not None else 1 << 60), "fork-").otherwise("block-"), n.cast("string"))
        n = F.col("number")
        return self.blocks.select("number", F.unhex(F.sha2(name(n), 256)).alias("hash"), F.unhex(F.sha2(name(n - 1), 256)).alias("parent_hash"), F.col("ts").alias("timestamp"))

    def provider(self, fork: int | None = None, **caps: int) -> P.FrameProvider:
        headers = self.headers(fork)
        named = headers.select(F.col("number").alias("block_number"), F.col("hash").alias("block_hash"))
        return P.FrameProvider(headers, self.raw.drop("block_hash").join(named, "block_number").select(schema.RAW_LOGS.names), **caps)

    def rows(self, rows: list[tuple], ddl: str) -> DataFrame:
        return self.spark.createDataFrame(rows, ddl)


@functools.lru_cache(maxsize=8)
def _made(spark: SparkSession, app: str, sf_dir: str) -> Rig:
    return Rig(spark, sf_dir)


def rig(spark: SparkSession, sf_dir: str) -> Rig:
    """The one rig of a session and a folder."""
    return _made(spark, spark.sparkContext.applicationId, sf_dir)


def _query(name: str, sql: str, cte: bool = True):
    def put(f: Callable[[Rig], DataFrame]):
        _Q[name] = lambda spark, sf_dir: f(rig(spark, sf_dir))
        _SQL[name] = f"{_CTE}, {_KEPT} {sql}" if cte else sql
        return f

    return put


def _text(rows: DataFrame, *columns: str) -> DataFrame:
    """Byte columns as hex text."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.lower(F.hex(c)).alias(c) if kinds[c] == "binary" else F.col(c) for c in columns])


def _outcome(ask: Callable[[], object]) -> str:
    """What a call gives, or its error text up to its first line."""
    try:
        return str(ask())
    except Exception as e:
        return f"{type(e).__name__}: {str(e).splitlines()[0]}"


def _values(rows: list[tuple], names: str) -> str:
    """A SQL query of constant rows."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


# -- export and its manifest -------------------------------------------------------


@_query("export_read_by_name", f"SELECT {_STORED} FROM k")
def _(rig):
    parts = [X.read_part(rig.spark, rig.export, n) for n in range(rig.head // rig.width + 1)]
    return _text(functools.reduce(DataFrame.unionByName, parts), *_STORED.split(", "))


@_query("export_read_blocks", "SELECT number, hash, ts FROM b")
def _(rig):
    return _text(X.read_blocks(rig.spark, rig.export), "number", "hash", "ts")


@_query("export_row_groups", f"SELECT block_number // {_WIDTH} AS part, count(*) AS n_logs, CAST(sum(log_index) AS bigint) AS n_index FROM k GROUP BY ALL")
def _(rig):
    """Files of many row groups, and files without rows, read like any other."""
    path = scratch_path(rig.spark, "row-groups")
    rows = rig.spark.read.schema(schema.EXPORT_LOGS).parquet(f"{rig.export}/logs")
    rows.coalesce(1).write.option("parquet.block.size", "65536").parquet(path)
    rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    again = rig.spark.read.schema(schema.EXPORT_LOGS).parquet(path)
    return again.groupBy(codec.part_of(F.col("block_number"), rig.width).alias("part")).agg(F.count(F.lit(1)).alias("n_logs"), F.sum("log_index").alias("n_index"))


@_query("export_files", f"SELECT 'logs/part=' || lpad(CAST(p AS varchar), 3, '0') AS unit, true AS listed, true AS fits FROM range({_H} // {_WIDTH} + 1) r(p) UNION ALL SELECT 'blocks', true, true")
def _(rig):
    """Every unit has files, and size and MD5 of each are those of the manifest."""
    manifest = X.read_manifest(rig.spark, rig.export)
    listed = rig.rows([(p, s, m) for p, (s, m) in manifest.files.items()], "path string, size long, md5 string")
    present = X.list_files(rig.spark, rig.export, "logs/").unionByName(X.list_files(rig.spark, rig.export, "blocks/"))
    both = present.join(listed.toDF("path", "listed_size", "listed_md5"), "path", "full_outer")
    same = (F.col("size") == F.col("listed_size")) & (F.col("md5") == F.col("listed_md5"))
    return both.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("unit")).agg((F.count(F.lit(1)) > 0).alias("listed"), F.bool_and(F.coalesce(same, F.lit(False))).alias("fits"))


@_query("export_footer_counts", f"SELECT lpad(CAST(p AS varchar), 3, '0') AS part, count(k.block_number) AS n_logs FROM range({_H} // {_WIDTH} + 1) r(p) LEFT JOIN k ON k.block_number // {_WIDTH} = p GROUP BY p")
def _(rig):
    return rig.rows([(f"{n:03d}", rig.spark.read.schema(schema.EXPORT_LOGS).parquet(f"{rig.export}/logs/part={n:03d}").count()) for n in range(rig.head // rig.width + 1)], "part string, n_logs long")


@_query("manifest_rows", f"SELECT lpad(CAST(p AS varchar), 3, '0') AS part, count(k.block_number) AS n_logs, (SELECT count(*) FROM k) AS total, {_H} AS last, {_H} + 1 AS block_rows FROM range({_H} // {_WIDTH} + 1) r(p) LEFT JOIN k ON k.block_number // {_WIDTH} = p GROUP BY p")
def _(rig):
    m = X.read_manifest(rig.spark, rig.export)
    return rig.rows([(p, n, m.log_rows, m.last, m.block_rows) for p, n in m.parts.items()], "part string, n_logs long, total long, last long, block_rows long")


_BAD = [("blocks", "rows", 1, "is not one contiguous run"), ("logs", "rows", -1, "logs.rows is -1"), (None, "files", {}, "lists no files"), (None, "blocks", None, "parse manifest.json")]


@_query("manifest_refusals", _values([(f"{section or ''}/{key}", 1) for section, key, _, _ in _BAD], "changed, refused"), cte=False)
def _(rig):
    whole = json.loads(X.read_text(rig.spark, f"{rig.export}/{X.NAME}"))
    found = []
    for section, key, value, text in _BAD:
        path, bad = scratch_path(rig.spark, "manifest"), json.loads(json.dumps(whole))
        (bad[section] if section else bad)[key] = value
        X.write_manifest(rig.spark, path, bad)
        found.append((f"{section or ''}/{key}", int(text in _outcome(lambda p=path: X.read_manifest(rig.spark, p)))))
    return rig.rows(found, "changed string, refused int")


@_query("export_damage", _values([("listed file is gone", 1), ("file is not listed", 1), ("file was altered", 1), ("untouched", 0)], "damage, refused"), cte=False)
def _(rig):
    m = X.read_manifest(rig.spark, rig.export)
    first = min(p for p in m.files if p.startswith("logs/"))
    without = {p: f for p, f in m.files.items() if p != first}
    kinds = {"listed file is gone": ({**m.files, "logs/part=000/gone.parquet": (1, "x")}, "no such file"), "file is not listed": (without, "is not listed"), "file was altered": ({**m.files, first: (m.files[first][0], "x")}, "truncated or altered"), "untouched": (m.files, "lists no")}
    return rig.rows([(name, int(text in _outcome(lambda f=files: X.verify_files(rig.spark, rig.export, replace(m, files=f), "logs/")))) for name, (files, text) in kinds.items() if files], "damage string, refused int")


# -- load -----------------------------------------------------------------------------


@_query("loaded_logs", f"SELECT {_STORED}, substr(data, 1, 64) AS data_word0 FROM k")
def _(rig):
    return _text(rig.store.latest().frame("logs"), *_STORED.split(", "), "data_word0")


@_query("loaded_blocks", "SELECT number, hash, ts FROM b")
def _(rig):
    return _text(rig.store.latest().frame("blocks"), "number", "hash", "ts")


@_query("load_ledger", f"SELECT 'logs/part=' || lpad(CAST(p AS varchar), 3, '0') AS unit, count(k.block_number) AS n_rows FROM range({_H} // {_WIDTH} + 1) r(p) LEFT JOIN k ON k.block_number // {_WIDTH} = p GROUP BY p UNION ALL SELECT 'blocks', count(*) FROM b")
def _(rig):
    return rig.rows([(unit, r["rows_loaded"]) for unit, r in rig.store.states.read().units.items()], "unit string, n_rows long")


@_query("published_interval", "SELECT min(number) AS start, max(number) AS head FROM b")
def _(rig):
    cov = rig.store.coverage
    return rig.rows([(cov.start, cov.head)], "start long, head long")


@_query("load_again", "SELECT 0 AS new_versions, count(*) AS n_logs FROM k")
def _(rig):
    """Stages that find their unit loaded write nothing."""
    own = rig.own()
    before = own.states.read().version
    load = Backfill(own, rig.export)
    for stage in ("prepare", "logs", "blocks"):
        load.run(stage)
    return own.latest().frame("logs").agg(F.lit(own.states.read().version - before).alias("new_versions"), F.count(F.lit(1)).alias("n_logs"))


@_query("load_order", _values([("finish first", "no blocks loaded"), ("finish without logs", "run the logs stage"), ("unknown stage", "unknown stage"), ("far tail", "the export covers blocks"), ("busy", "another writer holds")], "attempt, answer"), cte=False)
def _(rig):
    empty, tail, busy = rig.empty(), rig.empty(), rig.empty()
    tail.set_coverage(rig.head + 100, rig.head + 200)
    load = Backfill(empty, rig.export)

    def while_busy():
        with busy.states.writer():
            Backfill(busy, rig.export).run("prepare")

    asked = [("finish first", lambda: load.run("finish"), "no blocks loaded"), ("finish without logs", lambda: (load.run("blocks"), load.run("finish")), "run the logs stage"), ("unknown stage", lambda: load.run("x"), "unknown stage"), ("far tail", lambda: Backfill(tail, rig.export).run(), "the export covers blocks"), ("busy", while_busy, "another writer holds")]
    return rig.rows([(name, text if text in (got := _outcome(ask)) else got) for name, ask, text in asked], "attempt string, answer string")


@_query("maintenance_gate", "SELECT 'read' AS what, 'refused' AS answer UNION ALL SELECT 'head', 'refused' UNION ALL SELECT 'health', '503' UNION ALL SELECT 'after', CAST(max(number) AS varchar) FROM b")
def _(rig):
    own = rig.own()
    engine = Engine(own)
    own.set_maintenance(True, "test")
    text = json.dumps({"id": 1, "method": "eth_getLogs", "params": [{"topics": ["0x" + TRANSFER]}]})
    refused = lambda answer: "refused" if "under maintenance" in answer else answer
    found = [("read", refused(engine.answer(text))), ("head", refused(engine.answer('{"id":1,"method":"eth_blockNumber"}'))), ("health", str(engine.health()[0]))]
    own.set_maintenance(False)
    return rig.rows([*found, ("after", str(int(engine.block_number(), 16)))], "what string, answer string")


# -- store ------------------------------------------------------------------------------


def _stored(name: str, where: str, **kw) -> None:
    """A filter query over the loaded warehouse."""

    @_query(f"store_{name}", f"SELECT {_SCAN} FROM k WHERE {where}")
    def _(rig):
        return _text(rig.store.latest().logs(Query(**({"from_block": 0, "to_block": rig.head} | kw))), *_SCAN.split(", "))


_stored("scan", "true")
_stored("contract", f"topic0 = '{TRANSFER}' AND address = '{PUNKS}'", addresses=[PUNKS], topics=[[TRANSFER]])
_stored("token", f"topic0 = '{TRANSFER}' AND topic3 = '{w(23)}'", topics=[[TRANSFER], [], [], [w(23)]])
_stored("owner", f"topic0 IN ({', '.join(f"'{s}'" for s in SIGNATURES)}) AND topic2 IN ('{w(7)}', '{w(8)}')", topics=[list(SIGNATURES), [], [w(7), w(8)]])
_stored("erc1155", f"((topic0 = '{TRANSFER_SINGLE}' AND substr(data, 1, 64) = '{w(54)}') OR (topic0 = '{URI}' AND topic1 = '{w(54)}'))", topics=[[TRANSFER_SINGLE, URI]], erc1155_id=w(54))


@_query("store_block_by_hash", "SELECT number, hash FROM b WHERE number IN (0, (SELECT max(number) // 2 FROM b), (SELECT max(number) FROM b))")
def _(rig):
    view = rig.store.latest()
    hashes = [view.block_hash(n) for n in (0, rig.head // 2, rig.head)]
    return rig.rows([(view.block_by_hash(h), h) for h in hashes], "number long, hash string")


@_query("store_hash_by_height", f"SELECT number, hash FROM b WHERE number IN (0, {_H}) UNION ALL SELECT {_H} + 1, NULL")
def _(rig):
    return rig.rows([(n, rig.store.stored_hash(n)) for n in (0, rig.head, rig.head + 1)], "number long, hash string")


@_query("store_rewind", f"SELECT block_number // {_WIDTH} AS part, count(*) AS n_logs, {_H} * 5 // 8 AS head FROM k WHERE block_number <= {_H} * 5 // 8 GROUP BY ALL")
def _(rig):
    own, to = rig.own(), rig.head * 5 // 8
    own.rewind(to)
    return own.latest().frame("logs").groupBy(codec.part_of(F.col("block_number"), rig.width).alias("part")).agg(F.count(F.lit(1)).alias("n_logs")).withColumn("head", F.lit(own.coverage.head))


@_query("store_write_range", f"SELECT block_number, log_index, topic0 FROM k WHERE block_number NOT BETWEEN {_H} // 3 AND {_H} // 2 OR log_index <= 1")
def _(rig):
    """A range across parts is written again with fewer logs; the rest stays."""
    own, low, high = rig.own(), rig.head // 3, rig.head // 2
    inside = lambda c: F.col(c).between(low, high)
    blocks = rig.headers().where(inside("number")).select("number", "hash", F.col("timestamp").alias("ts"))
    own.write_range(low, high, blocks, S.keep_raw(rig.raw).where(inside("block_number") & (F.col("log_index") <= 1)))
    return _text(own.latest().frame("logs"), "block_number", "log_index", "topic0")


@_query("store_write_refusals", _values([("missing block", "block rows"), ("no block row", "no block row"), ("other hash", "carries block hash"), ("gap", "not contiguous"), ("twice", "occurs 2 times")], "attempt, answer"), cte=False)
def _(rig):
    own, empty = rig.own(), rig.empty()
    empty.set_coverage(0, 1)
    blocks = rig.headers().where(F.col("number") <= 9).select("number", "hash", F.col("timestamp").alias("ts"))
    logs = S.keep_raw(rig.raw).where(F.col("block_number") <= 9)
    tries = [
        ("missing block", lambda: own.write_range(0, 10, blocks, logs), "block rows"),
        ("no block row", lambda: own.write_range(0, 4, blocks.where("number < 5"), logs), "no block row"),
        ("other hash", lambda: own.write_range(0, 9, blocks.withColumn("hash", F.unhex(F.lit(w(1)))), logs), "carries block hash"),
        ("gap", lambda: empty.write_range(5, 9, blocks.where("number > 4"), logs.where("block_number > 4")), "not contiguous"),
        ("twice", lambda: own.write_range(0, 9, blocks, logs.unionByName(logs)), "occurs 2 times"),
    ]
    return rig.rows([(name, text if text in (got := _outcome(ask)) else got) for name, ask, text in tries], "attempt string, answer string")


@_query("store_snapshot", f"SELECT 'before' AS version, count(*) AS n_logs FROM k UNION ALL SELECT 'after', count(*) FROM k WHERE block_number <= {_H} // 2")
def _(rig):
    """A pinned view keeps its rows while the store is rewound."""
    own = rig.own()
    pinned = own.latest()
    own.rewind(rig.head // 2)
    count = lambda view, name: view.frame("logs").agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("n_logs"))
    return count(pinned, "before").unionByName(count(own.latest(), "after"))


@_query("store_coverage", _values([(1, 50, 300), (2, 50, 500), (3, 10, 500), (4, 10, 500)], "step, start, head"), cte=False)
def _(rig):
    own, found = rig.empty(), []
    for step, (a, b) in enumerate(((50, 300), (250, 500), (10, 49), (502, 600)), 1):
        _outcome(lambda a=a, b=b: own.set_coverage(a, b))  # the last leaves a hole and is refused
        found.append((step, own.coverage.start, own.coverage.head))
    return rig.rows(found, "step int, start long, head long")


@_query("store_locks", _values([("second writer", "WriterBusy"), ("stale commit", "WriterBusy"), ("reader beside writer", "read")], "attempt, answer"), cte=False)
def _(rig):
    own = rig.own()

    def second() -> None:
        with own.states.writer(), own.states.writer():
            pass

    def stale() -> None:
        own.states.commit(State())

    def beside() -> str:
        with own.states.writer(), own.read():
            return "read"

    return rig.rows([(name, _outcome(ask).split(":")[0]) for name, ask in (("second writer", second), ("stale commit", stale), ("reader beside writer", beside))], "attempt string, answer string")


# -- service -------------------------------------------------------------------------------


_ANSWER = "address, block_number, block_hash, block_timestamp, tx_hash, tx_index, log_index, topics, data, removed"
_TOPICS = "concat_ws(',', '0x' || topic0, '0x' || topic1, '0x' || topic2, '0x' || topic3)"


@_query("eth_get_logs", f"SELECT '0x' || address AS address, '0x' || lower(hex(block_number)) AS block_number, '0x' || block_hash AS block_hash, '0x' || lower(hex(block_ts)) AS block_timestamp, '0x' || tx_hash AS tx_hash, '0x' || lower(hex(tx_index)) AS tx_index, '0x' || lower(hex(log_index)) AS log_index, {_TOPICS} AS topics, '0x' || data AS data, false AS removed FROM k WHERE topic0 = '{TRANSFER}' AND address = '{PUNKS}' AND topic3 = '{w(23)}'")
def _(rig):
    """The wire answer of a token's provenance, all ten fields."""
    wanted = {"fromBlock": "0x0", "toBlock": "latest", "address": "0x" + PUNKS, "topics": ["0x" + TRANSFER, None, None, "0x" + w(23)]}
    answer = json.loads(Engine(rig.store).answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "eth_getLogs", "params": [wanted]})))
    names = ("address", "blockNumber", "blockHash", "blockTimestamp", "transactionHash", "transactionIndex", "logIndex", "topics", "data", "removed")
    return rig.rows([tuple(",".join(x[n]) if n == "topics" else x[n] for n in names) for x in answer["result"]], ", ".join(f"{c} {'boolean' if c == 'removed' else 'string'}" for c in _ANSWER.split(", ")))


@_query("eth_heads", f"SELECT 'eth_blockNumber' AS method, '0x' || lower(hex({_H})) AS result UNION ALL SELECT 'eth_chainId', '0x1' UNION ALL SELECT 'health', CAST({_H} AS varchar) UNION ALL SELECT 'batch', '2' UNION ALL SELECT 'unknown', '-32601' UNION ALL SELECT 'cap', 'query returned more than 1 results' UNION ALL SELECT 'parse', '-32700'")
def _(rig):
    engine = Engine(rig.store, max_results=1)
    ask = lambda body: json.loads(engine.answer(json.dumps(body) if not isinstance(body, str) else body))
    call = lambda method, *params: ask({"jsonrpc": "2.0", "id": 1, "method": method, "params": list(params)})
    found = [
        ("eth_blockNumber", call("eth_blockNumber")["result"]), ("eth_chainId", call("eth_chainId")["result"]), ("health", str(engine.health()[1]["head"])),
        ("batch", str(len(ask([{"jsonrpc": "2.0", "id": i, "method": "eth_chainId"} for i in (1, 2)])))), ("unknown", str(call("eth_call")["error"]["code"])),
        ("cap", call("eth_getLogs", {"fromBlock": "0x0", "topics": ["0x" + TRANSFER]})["error"]["message"]), ("parse", str(ask("{")["error"]["code"])),
    ]
    return rig.rows(found, "method string, result string")


_FILTERS = [
    ("no topics", {}, "out of warehouse scope: filter must name at least one warehouse event signature in topics[0]"),
    ("foreign signature", {"topics": ["0x" + w(1)]}, f"out of warehouse scope: topic0 0x{w(1)} is not a warehouse event signature"),
    ("bare number", {"fromBlock": 5}, "hex string without 0x prefix"),
    ("empty number", {"fromBlock": "0x"}, 'hex string "0x"'),
    ("leading zero", {"fromBlock": "0x01"}, "hex number with leading zero digits"),
    ("sign", {"toBlock": "0x-5"}, "invalid hex string"),
    ("large", {"toBlock": "0x8000000000000000"}, "block number larger than int64"),
    ("short address", {"address": "0x01"}, "invalid address: hex has invalid length 1 after decoding; expected 20 for address"),
    ("number as address", {"address": [1]}, "non-string address at index 0"),
    ("five topics", {"topics": [None] * 5}, "exceed max topics"),
    ("hash and range", {"blockHash": "0x" + w(1), "toBlock": "0x1"}, "cannot specify both BlockHash and FromBlock/ToBlock, choose one or the other"),
    ("odd hex", {"topics": ["0x123"]}, "hex string of odd length"),
    ("good", {"topics": [["0x" + TRANSFER, "0x" + URI], None], "address": "0x" + PUNKS}, "scope"),
]


@_query("criteria", _values([(name, text) for name, _, text in _FILTERS], "filter, answer"), cte=False)
def _(rig):
    def ask(raw: dict) -> str:
        try:
            C.check_scope(C.decode(json.dumps(raw)).topics)
            return "scope"
        except Exception as e:
            return str(e)

    return rig.rows([(name, ask(raw)) for name, raw, _ in _FILTERS], "filter string, answer string")


_RANGES = [("earliest", "earliest", "latest"), ("default", None, None), ("backwards", "0x5", "0x2"), ("safe", "safe", "latest"), ("pending", "0x1", "pending"), ("half", "head/2", "latest"), ("above", "0x0", "head+1")]


@_query("range_resolution", f"SELECT * FROM (SELECT 'earliest' AS range, '0-' || {_H} AS answer UNION ALL SELECT 'default', {_H} || '-' || {_H} UNION ALL SELECT 'backwards', 'invalid block range params' UNION ALL SELECT 'safe', 'out of warehouse scope: safe and finalized block tags are not served' UNION ALL SELECT 'pending', 'pending logs are not supported' UNION ALL SELECT 'half', ({_H} // 2) || '-' || {_H} UNION ALL SELECT 'above', 'out of warehouse scope: blocks 0-' || ({_H} + 1) || ' extend above the warehouse head ' || {_H} UNION ALL SELECT 'by hash', ({_H} // 2) || '-' || ({_H} // 2) UNION ALL SELECT 'unknown hash', 'unknown block')")
def _(rig):
    view = rig.store.latest()
    numbers = {"head/2": hex(rig.head // 2), "head+1": hex(rig.head + 1)}

    def ask(raw: dict) -> str:
        try:
            found = C.resolve(C.decode(raw), 0, rig.head, view.block_by_hash)
            return f"{found.from_block}-{found.to_block}"
        except Exception as e:
            return str(e).split(" (the")[0]

    found = [(name, ask({k: numbers.get(v, v) for k, v in (("fromBlock", a), ("toBlock", b)) if v})) for name, a, b in _RANGES]
    found += [("by hash", ask({"blockHash": "0x" + view.block_hash(rig.head // 2)})), ("unknown hash", ask({"blockHash": "0x" + w(1)}))]
    return rig.rows(found, "range string, answer string")


@_query("settings", _values([("server_port", "9000"), ("rpc_query_timeout", "90.0"), ("ethereum_head_timeout", "300.0"), ("ethereum_rpc_timeout", "0.25"), ("server_idle_timeout", "5400.0"), ("refused", "ethereum.chain_id must be 1")], "setting, value"), cte=False)
def _(rig):
    env = {"WAREHOUSE_ROOT": "/w", "ETHEREUM_INGESTION_ENABLED": "false", "SERVER_PORT": "9000", "RPC_QUERY_TIMEOUT": "90s", "ETHEREUM_HEAD_TIMEOUT": "5m", "ETHEREUM_RPC_TIMEOUT": "250ms", "SERVER_IDLE_TIMEOUT": "1h30m"}
    put = lambda more: config.load(env={config.PREFIX + k: v for k, v in (env | more).items()})
    names = ("server_port", "rpc_query_timeout", "ethereum_head_timeout", "ethereum_rpc_timeout", "server_idle_timeout")
    found = put({})
    return rig.rows([(n, str(getattr(found, n))) for n in names] + [("refused", _outcome(lambda: put({"ETHEREUM_CHAIN_ID": "5"})).split(": ")[1])], "setting string, value string")


# -- providers -------------------------------------------------------------------------------


@_query("provider_logs", f"SELECT block_number, log_index, {_NT} AS n_topics FROM s WHERE topic0 IN ({', '.join(f"'{s}'" for s in SIGNATURES)})")
def _(rig):
    """All logs of the event set by windows that the provider's result cap halves."""
    cap = rig.logs.count() // 3
    found = P.Fetcher(rig.provider(result_cap=cap), Clock()).fetch(0, rig.head)
    return found.select("block_number", "log_index", F.size("topics").alias("n_topics"))


@_query("provider_heads", f"SELECT number, hash, sha256('block-' || (number - 1)) AS parent, ts FROM b WHERE number > {_H} - 100 UNION ALL SELECT 0, sha256('block-0'), sha256('block--1'), ts FROM b WHERE number = 0")
def _(rig):
    node = rig.provider()
    return rig.rows([(h.number, h.hash, h.parent, h.timestamp) for h in [*node.heads(rig.head - 99, rig.head), node.head_by_number(0)]], "number long, hash string, parent string, ts long")


@_query("provider_tip", f"SELECT {_H} AS tip, 1 AS chain, 'NotFound: block ' || ({_H} + 1) || ': not found' AS beyond")
def _(rig):
    node = rig.provider()
    return rig.rows([(node.block_number(), node.chain_id(), _outcome(lambda: node.head_by_number(rig.head + 1)))], "tip long, chain int, beyond string")


@_query("provider_dense_block", f"SELECT block_number, log_index, topic0 FROM s WHERE topic0 IN ({', '.join(f"'{s}'" for s in SIGNATURES)}) AND block_number = (SELECT min(block_number) FROM (SELECT block_number, count(*) AS n FROM s GROUP BY ALL) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY block_number)))")
def _(rig):
    """The densest block, over the cap: its logs come from its receipts."""
    sizes = rig.logs.groupBy("block_number").count()
    top = sizes.orderBy(F.desc("count"), "block_number").first()
    found = P.Fetcher(rig.provider(result_cap=1), Clock()).fetch(top["block_number"], top["block_number"])
    return found.select("block_number", "log_index", F.lower(F.hex(codec.topic_at(F.col("topics"), 0))).alias("topic0"))


@_query("walk_windows", f"SELECT f AS from_block, least(f + 1000, {_H}) AS to_block FROM (SELECT unnest(range(0, {_H} + 1, 1001)) AS f)")
def _(rig):
    return rig.rows(P.Paginator(lambda a, b: (a, b), Clock(), span_cap=1000).walk(0, rig.head)[0], "from_block long, to_block long")


@_query("walk_deadline", _values([("late", "did not arrive within 5s")], "walk, answer"), cte=False)
def _(rig):
    clock = Clock()

    class Slow(P.FrameProvider):
        def filter_logs(self, low, high, topics):
            clock.sleep(3)
            return super().filter_logs(low, high, topics)

    node = rig.provider()
    slow = Slow(node.headers, node.logs)
    got = _outcome(lambda: P.Fetcher(slow, clock, span_cap=max(1, rig.head // 8), deadline=5.0).fetch(0, rig.head))
    return rig.rows([("late", "did not arrive within 5s" if "did not arrive within 5s" in got else got)], "walk string, answer string")


_ERRORS = [
    ("query returned more than 10000 results", 0, "split"), ("block range is too wide", 0, "span"), ("invalid range", -32602, "span"), ("503 Service Unavailable", 0, "again"), ("unexpected EOF", 0, "again"),
    ("execution reverted", 0, "permanent"), ("TimeoutError", 0, "again"), ("gaierror:temporary", 0, "again"), ("gaierror:unknown", 0, "permanent"), ("unreachable", 0, "again"), ("cancelled", 0, "permanent"),
]


@_query("error_classes", _values([(t, c) for t, _, c in _ERRORS], "error, class"), cte=False)
def _(rig):
    import errno
    import socket

    made = {"TimeoutError": TimeoutError(), "gaierror:temporary": socket.gaierror(socket.EAI_AGAIN, "x"), "gaierror:unknown": socket.gaierror(socket.EAI_NONAME, "x"), "unreachable": OSError(errno.EHOSTUNREACH, "x"), "cancelled": P.Cancelled("i/o timeout")}

    def kind(text: str, code: int) -> str:
        error = made.get(text) or P.ProviderError(text)
        error.code = code
        return "span" if P.is_span_cap(error) else "split" if P.is_too_large(error) else "again" if P.is_retryable(error) else "permanent"

    return rig.rows([(t, kind(t, c)) for t, c, _ in _ERRORS], "error string, class string")


@_query("retry_and_redaction", _values([("third answer", "ok"), ("sleeps", "2"), ("budget", "1"), ("permanent", "1"), ("url", "wss://host.example:1 no")], "what, value"), cte=False)
def _(rig):
    clock, tries = Clock(), []

    def flaky() -> str:
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionResetError
        return "ok"

    def fail(text: str) -> None:
        raise P.ProviderError(text)

    first = P.Retry(clock)("x", flaky)
    over = Clock()
    late = _outcome(lambda: P.Retry(over)("x", lambda: fail("502")))
    bad = _outcome(lambda: P.Retry(Clock())("x", lambda: fail("denied")))
    found = [("third answer", first), ("sleeps", str(len(tries) - 1)), ("budget", str(int("retryable error" in late and over.t <= 300))), ("permanent", str(int("permanent error" in bad))), ("url", P.redact("wss://u:p@host.example:1/v3/KEY?x no"))]
    return rig.rows(found, "what string, value string")


# -- ingestion -----------------------------------------------------------------------------------


def _feed(engine: S.Subscriber, *numbers: int) -> None:
    for n in numbers:
        engine.on_heads([engine.chain.provider.head_by_number(n)])


@_query("ingest_tail", f"SELECT {_STORED}, block_hash, {_H} - 25 AS start, {_H} - 2 AS head FROM k WHERE block_number BETWEEN {_H} - 25 AND {_H} - 2")
def _(rig):
    """Heads with holes and repeats: every confirmed block is written once, in batches."""
    own = rig.empty()
    engine = S.Subscriber(rig.spark, rig.provider(), own, confirmations=2, clock=Clock())
    engine.start(rig.head - 25)
    _feed(engine, rig.head - 12, rig.head - 12, rig.head)
    cov = own.coverage
    found = own.latest().logs(Query(cov.start, cov.head))
    return _text(found, *_STORED.split(", "), "block_hash").withColumn("start", F.lit(cov.start)).withColumn("head", F.lit(cov.head))


_CHAIN = f"SELECT number, CASE WHEN number >= {_H} - 6 THEN sha256('fork-' || number) ELSE hash END AS hash, {_H} - 2 AS head FROM b WHERE number BETWEEN {_H} - 14 AND {_H} - 2"


@_query("ingest_deep_reorg", _CHAIN)
def _(rig):
    """Blocks below the lag are replaced: back to the fork point, then on along the new chain."""
    own = rig.empty()
    engine = S.Subscriber(rig.spark, rig.provider(), own, confirmations=2, clock=Clock())
    engine.start(rig.head - 14)
    _feed(engine, rig.head - 1)
    forked = S.Subscriber(rig.spark, rig.provider(rig.head - 6), own, confirmations=2, clock=Clock())
    forked.at = engine.at
    _feed(forked, rig.head)
    return _text(own.latest().frame("blocks"), "number", "hash").withColumn("head", F.lit(own.coverage.head))


@_query("ingest_resume", _CHAIN)
def _(rig):
    """The same after a restart: the resume point itself was replaced."""
    own = rig.empty()
    engine = S.Subscriber(rig.spark, rig.provider(), own, confirmations=2, clock=Clock())
    engine.start(rig.head - 14)
    _feed(engine, rig.head - 1)
    node = rig.provider(rig.head - 6)
    again = S.Subscriber(rig.spark, node, own, confirmations=2, clock=Clock())
    again.start(S.resolve_start(own.coverage.head, None, node))
    _feed(again, rig.head)
    return _text(own.latest().frame("blocks"), "number", "hash").withColumn("head", F.lit(own.coverage.head))


@_query("ingest_stale_heads", f"SELECT {_H} - 10 AS start, {_H} - 6 AS head")
def _(rig):
    """Heads of a branch that the chain does not have move nothing."""
    own = rig.empty()
    engine = S.Subscriber(rig.spark, rig.provider(), own, confirmations=2, clock=Clock())
    engine.start(rig.head - 10)
    _feed(engine, rig.head - 4)
    stale = rig.provider(rig.head - 3)
    engine.on_heads([stale.head_by_number(n) for n in (rig.head - 1, rig.head)])
    return rig.rows([(own.coverage.start, own.coverage.head)], "start long, head long")


@_query("ingest_limits", f"SELECT 'catch-up' AS what, 'need blocks ' || ({_H} - 50) || '-' || {_H} || ' (51 blocks, max 10)' AS answer UNION ALL SELECT 'silence', 'no head in 300s' UNION ALL SELECT 'chain id', 'does not match configured' UNION ALL SELECT 'start', 'start_block=5 is set' UNION ALL SELECT 'tip', CAST({_H} AS varchar) UNION ALL SELECT 'below coverage', 'the fork reaches below warehouse coverage' UNION ALL SELECT 'unstable', 'kept changing'")
def _(rig):
    node, clock = rig.provider(), Clock()
    bounded = S.Subscriber(rig.spark, node, rig.empty(), confirmations=2, max_catchup=10, clock=clock)
    bounded.start(rig.head - 50)

    def silence() -> None:
        clock.sleep(301)
        bounded.check_silence()

    def below() -> None:
        own = rig.empty()
        first = S.Subscriber(rig.spark, node, own, confirmations=0, clock=Clock())
        first.start(rig.head - 1)
        _feed(first, rig.head - 1)
        other = S.Subscriber(rig.spark, rig.provider(rig.head - 3), own, confirmations=0, clock=Clock())
        other.at = first.at
        _feed(other, rig.head)

    def unstable() -> None:
        wrong = P.FrameProvider(node.headers, node.logs.withColumn("block_hash", F.unhex(F.lit(w(1)))))
        last = rig.logs.agg(F.max("block_number")).first()[0]
        engine = S.Subscriber(rig.spark, wrong, rig.empty(), confirmations=0, clock=Clock())
        engine.start(last)
        _feed(engine, last)

    asked = [
        ("catch-up", lambda: _feed(bounded, rig.head), f"need blocks {rig.head - 50}-{rig.head} (51 blocks, max 10)"), ("silence", silence, "no head in 300s"), ("chain id", lambda: S.verify_chain(node, 2), "does not match configured"),
        ("start", lambda: S.resolve_start(9, 5, node), "start_block=5 is set"), ("tip", lambda: S.resolve_start(None, None, node), str(rig.head)), ("below coverage", below, "the fork reaches below warehouse coverage"), ("unstable", unstable, "kept changing"),
    ]
    return rig.rows([(name, text if text in (got := _outcome(ask)) else got) for name, ask, text in asked], "what string, answer string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function of (spark, folder of tables)."""
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query here."""
    return dict(_SQL)
