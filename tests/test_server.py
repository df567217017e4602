"""The wire: a real HTTP server over a small store."""

import json
import threading
import time
import urllib.request

import pytest

from loghaven import config
from loghaven.engine import Engine
from loghaven.functions.eventset import TRANSFER
from loghaven.operators.store import Warehouse
from loghaven.server import make_server
from tests.helpers import a, b, h, logs_frame, raw_log
from loghaven import schema

T, OWNER = "0x" + TRANSFER, "0x" + h(0xEE)


@pytest.fixture(scope="module")
def wire(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("w")))
    rows = [
        raw_log(5, 1, a(0xC0), [TRANSFER, h(1), h(0xEE), h(9)], tx=2, block_hash=h(0x55)),
        raw_log(6, 0, a(0xC0), [TRANSFER, h(0xEE), h(2)], block_hash=h(0x66)),
        raw_log(6, 1, a(0xC0), [TRANSFER, h(3), h(4), h(9)], block_hash=h(0x66)),
    ]
    w.write_range(5, 6, spark.createDataFrame([(5, b(h(0x55)), 1000), (6, b(h(0x66)), 1012)], schema.BLOCKS), logs_frame(spark, rows))
    server = make_server(Engine(w, max_results=2), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield w, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def post(url, body):
    data = body if isinstance(body, bytes) else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"})) as answer:
        return json.loads(answer.read())


def call(url, method, *params):
    return post(url, {"jsonrpc": "2.0", "id": 1, "method": method, "params": list(params)})


def logs(url, topics, low="0x5", high="0x6"):
    return call(url, "eth_getLogs", {"fromBlock": low, "toBlock": high, "topics": topics})


def places(answer):
    return [(int(x["blockNumber"], 16), int(x["logIndex"], 16)) for x in answer["result"]]


def test_logs(wire):
    _, url = wire
    first = logs(url, [T, None, OWNER, None])
    assert places(first) == [(5, 1)]
    one = first["result"][0]
    assert one["topics"] == [T, "0x" + h(1), OWNER, "0x" + h(9)] and one["blockHash"] == "0x" + h(0x55) and one["blockTimestamp"] == "0x3e8" and one["transactionIndex"] == "0x2" and one["data"] == "0x" and one["removed"] is False
    assert places(logs(url, [T, "0x" + h(3), None, None])) == [(6, 1)]
    assert places(logs(url, [T, None, None, "0x" + h(9)])) == [(5, 1), (6, 1)]
    assert places(call(url, "eth_getLogs", {"blockHash": "0x" + h(0x66), "topics": [T]})) == [(6, 0), (6, 1)]
    assert logs(url, [T], "0x6", "0x0")["result"] == []


def test_refusals(wire):
    _, url = wire
    text = lambda answer: (answer["error"]["code"], answer["error"]["message"])
    assert text(logs(url, [T, None, None, None])) == (-32000, "query returned more than 2 results")
    assert text(logs(url, [T], "0x5", "0x7")) == (-32000, "out of warehouse scope: blocks 5-7 extend above the warehouse head 6")
    assert text(logs(url, [T], "0x0", "0x6")) == (-32000, "out of warehouse scope: blocks 0-6 extend below the warehouse coverage start 5")
    assert text(call(url, "eth_call"))[0] == -32601
    code, message = text(logs(url, ["0x01"]))
    assert code == -32602 and message.startswith("invalid argument 0: ")
    assert text(post(url, b"{"))[0] == -32700


def test_the_rest(wire):
    w, url = wire
    assert call(url, "eth_blockNumber")["result"] == "0x6" and call(url, "eth_chainId")["result"] == "0x1"
    batch = post(url, [{"jsonrpc": "2.0", "id": i, "method": "eth_chainId"} for i in (1, 2)])
    assert [x["id"] for x in batch] == [1, 2]
    with urllib.request.urlopen(f"{url}/health") as answer:
        assert json.loads(answer.read()) == {"status": "ok", "head": 6, "coverage_start": 5, "empty": False, "chain_id": 1}
    w.set_maintenance(True)
    try:
        assert call(url, "eth_blockNumber")["error"]["message"] == "out of warehouse scope: warehouse is under maintenance (a backfill is reloading it); ask a node"
        status, body = Engine(w).health()
        assert status == 503 and body["status"] == "maintenance" and "maintenance" in body["error"] and "backfill" in body["hint"]
        assert logs(url, ["0x" + h(1)])["error"]["message"].endswith("is not a warehouse event signature")  # before any state
    finally:
        w.set_maintenance(False)


def test_empty_store(spark, tmp_path):
    engine = Engine(Warehouse(spark, str(tmp_path)))
    assert engine.call({"id": 1, "method": "eth_getLogs", "params": [{"topics": [T]}]})["error"]["message"] == "out of warehouse scope: warehouse is empty"
    assert engine.health() == (200, {"status": "ok", "head": 0, "coverage_start": 0, "empty": True, "chain_id": 1})


@pytest.mark.parametrize(
    ("env", "text"),
    [
        ({"WAREHOUSE_ROOT": ""}, "missing required config: warehouse.root"),
        ({"ETHEREUM_CONFIRMATION_BLOCKS": "9", "ETHEREUM_MAX_CATCHUP_BLOCKS": "9"}, "must be below"),
        ({"ETHEREUM_CHAIN_ID": "5"}, "ethereum.chain_id must be 1"),
        ({"RPC_MAX_RESULTS": "-1"}, "rpc.max_results must be >= 0"),
        ({"RPC_QUERY_TIMEOUT": "0"}, "rpc.query_timeout must be > 0"),
        ({"ETHEREUM_INGESTION_ENABLED": "true"}, "missing required config: ethereum.url"),
    ],
)
def test_config(env, text):
    good = {"WAREHOUSE_ROOT": "/w", "ETHEREUM_INGESTION_ENABLED": "false"}
    assert config.load(env={config.PREFIX + k: v for k, v in good.items()}).rpc_max_results == 100_000
    with pytest.raises(ValueError, match=text):
        config.load(env={config.PREFIX + k: v for k, v in (good | env).items()})


def test_durations_and_env_files(tmp_path):
    (tmp_path / ".env").write_text("# a comment\nLOGHAVEN_WAREHOUSE_ROOT='/w'\nexport LOGHAVEN_RPC_QUERY_TIMEOUT=90s\nLOGHAVEN_DEBUG=true # yes\n")
    (tmp_path / ".env.local").write_text("LOGHAVEN_RPC_QUERY_TIMEOUT=1h30m\nLOGHAVEN_SERVER_IDLE_TIMEOUT=250ms\n")
    c = config.load(env={"LOGHAVEN_ETHEREUM_INGESTION_ENABLED": "false", "LOGHAVEN_RPC_QUERY_TIMEOUT": "1"}, env_dir=str(tmp_path))
    assert (c.warehouse_root, c.rpc_query_timeout, c.server_idle_timeout, c.debug) == ("/w", 5400.0, 0.25, True)
    for bad in ("5x", "s", "1h 5m"):
        with pytest.raises(ValueError, match="invalid duration"):
            config.seconds(bad)


def test_slow_state_reads_end(spark, tmp_path):
    engine = Engine(Warehouse(spark, str(tmp_path)), query_timeout=0.2)
    engine.warehouse.read = lambda: time.sleep(2)
    began = time.monotonic()
    assert engine.health() == (503, {"status": "error", "error": "the warehouse did not answer within 0.2s"})
    assert engine.call({"id": 1, "method": "eth_blockNumber"})["error"]["message"].startswith("the warehouse did not answer") and time.monotonic() - began < 1.5
