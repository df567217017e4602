"""python -m loghaven.cli serve | backfill | rewind | export | manifest."""

from __future__ import annotations

import argparse
import sys
import threading

from loghaven import config as settings
from loghaven.engine import Engine
from loghaven.operators.backfill import Backfill
from loghaven.operators.store import Warehouse
from loghaven.server import make_server
from loghaven.session import build_session
from loghaven.sources import export
from loghaven.sources.node import NodeClient, NodeHeads, NodeProvider
from loghaven.sources.provider import FrameProvider
from loghaven.streaming.heads import HeadLog
from loghaven.streaming.subscriber import Subscriber, resolve_start, verify_chain


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loghaven")
    parser.add_argument("--config")
    parser.add_argument("--env", default="config", help="folder of .env and .env.local")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("serve", help="answer queries and follow the chain")
    load = commands.add_parser("backfill", help="load a Parquet export")
    load.add_argument("-dir", "--dir", required=True)
    load.add_argument("-stage", "--stage", default="all")
    back = commands.add_parser("rewind", help="drop everything above a block")
    back.add_argument("-to", "--to", type=int, required=True)
    out = commands.add_parser("export", help="write logs and blocks of a chain source as an export")
    out.add_argument("-source", "--source", required=True, help="folder with logs and blocks as Parquet (hex text)")
    out.add_argument("-dir", "--dir", required=True)
    out.add_argument("-end", "--end", type=int, required=True, help="last block")
    made = commands.add_parser("manifest", help="describe an export from the row counts of its source")
    made.add_argument("-dir", "--dir", required=True)
    made.add_argument("-source", "--source", required=True)
    made.add_argument("-end", "--end", type=int, required=True)
    made.add_argument("-name", "--name", default="")
    return parser


def serve(c: settings.Config, warehouse: Warehouse) -> None:
    """Serve until ingestion ends, which ends the process."""
    spark = warehouse.spark
    server = make_server(Engine(warehouse, chain=c.ethereum_chain_id, max_results=c.rpc_max_results, query_timeout=c.rpc_query_timeout), c.server_host, c.server_port, max(c.server_read_timeout, c.server_write_timeout, c.server_idle_timeout))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        if not c.ethereum_ingestion_enabled:
            threading.Event().wait()
            return
        with warehouse.states.writer():
            # ethereum.url is a node, or a folder that a node adapter fills: headers, logs and the head log
            online = c.ethereum_url.startswith(("http://", "https://"))
            if online:
                provider = NodeProvider(spark, NodeClient(c.ethereum_url, timeout=c.ethereum_rpc_timeout))
            else:
                provider = FrameProvider.of_folder(spark, c.ethereum_url, c.ethereum_chain_id, span_cap=c.ethereum_getlogs_span_cap)
            verify_chain(provider, c.ethereum_chain_id)
            start = c.ethereum_start_block if c.ethereum_start_block >= 0 else None
            engine = Subscriber(spark, provider, warehouse, confirmations=c.ethereum_confirmation_blocks, max_catchup=c.ethereum_max_catchup_blocks, span_cap=c.ethereum_getlogs_span_cap, head_timeout=c.ethereum_head_timeout)
            coverage = warehouse.coverage
            engine.start(resolve_start(coverage.head if coverage else None, start, provider))
            if online:
                spark.dataSource.register(NodeHeads)
                heads = spark.readStream.format("node_heads").option("url", c.ethereum_url).option("timeout", str(c.ethereum_rpc_timeout)).load()
            else:
                spark.dataSource.register(HeadLog)
                heads = spark.readStream.format("head_log").option("path", f"{c.ethereum_url}/heads.jsonl").load()
            query = engine.stream(heads, f"{c.warehouse_root}/_stream")
            while query.isActive:
                if not query.status["isTriggerActive"]:
                    engine.check_silence()
                query.awaitTermination(1)
            if query.exception():
                raise query.exception()
    finally:
        server.shutdown()


def main(args: list[str] | None = None) -> int:
    options = _parser().parse_args(args)
    try:
        if options.command in ("export", "manifest"):
            spark = build_session()
            logs, blocks = (spark.read.parquet(f"{options.source}/{kind}") for kind in ("logs", "blocks"))
            if options.command == "export":
                export.write_source(logs, blocks, options.dir, options.end)
            else:
                export.write_manifest(spark, options.dir, export.source_manifest(spark, options.dir, logs, blocks, options.end, options.name, options.source))
            return 0
        c = settings.load(options.config, env_dir=options.env)
        warehouse = Warehouse(build_session(), c.warehouse_root, lock_dir=c.warehouse_lock_dir or None)
        if options.command == "serve":
            serve(c, warehouse)
        elif options.command == "backfill":
            Backfill(warehouse, options.dir).run(options.stage)
        else:
            with warehouse.states.writer():
                warehouse.rewind(options.to)
    except Exception as e:
        print(f"{options.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
