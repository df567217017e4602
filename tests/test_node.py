"""A node client against a local stub server: answers, caps, failures, slowness."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loghaven.errors import ProviderError
from loghaven.functions import eventset as E
from loghaven.operators.state import Coverage
from loghaven.operators.store import Warehouse
from loghaven.sources import node as N
from loghaven.sources import provider as P
from loghaven.streaming import subscriber as S
from tests.helpers import a, h
from tests.test_provider import FakeClock


class Stub:
    """A chain of linked blocks with one log each, behind a real HTTP server."""

    def __init__(self):
        self.tip, self.cap, self.fail, self.slow, self.asked = 20, 0, [], 0.0, []
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                stub.asked.append(body)
                time.sleep(stub.slow)
                status = stub.fail.pop(0) if stub.fail else 200
                answer = json.dumps([stub.answer(x) for x in body] if isinstance(body, list) else stub.answer(body)).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(answer)))
                self.end_headers()
                self.wfile.write(answer)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/v3/SECRET"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def log(self, n, i=0):
        return {"blockNumber": hex(n), "logIndex": hex(i), "transactionIndex": "0x0", "transactionHash": "0x" + h(n), "address": "0x" + a(1), "topics": ["0x" + E.URI, "0x" + h(n)], "data": "0x01", "blockHash": "0x" + h(n + 1), "removed": False}

    def answer(self, call):
        method, params = call["method"], call["params"]
        result = error = None
        if method == "eth_getBlockByNumber":
            n = int(params[0], 16)
            result = {"number": hex(n), "hash": "0x" + h(n + 1), "parentHash": "0x" + h(n), "timestamp": hex(1000 + n)} if n <= self.tip else None
        elif method == "eth_getLogs":
            low, high = int(params[0]["fromBlock"], 16), int(params[0]["toBlock"], 16)
            if self.cap and high - low + 1 > self.cap:
                error = {"code": -32005, "message": "query returned more than 10000 results"}
            else:
                result = [self.log(n) for n in range(low, min(high, self.tip) + 1)]
        elif method == "eth_getBlockReceipts":
            result = [{"logs": [self.log(int(params[0], 16), i)]} for i in range(2)]
        elif method == "eth_blockNumber":
            result = hex(self.tip)
        elif method == "eth_chainId":
            result = "0x1"
        return {"jsonrpc": "2.0", "id": call["id"], **({"error": error} if error else {"result": result})}


@pytest.fixture
def stub():
    made = Stub()
    yield made
    made.server.shutdown()


def provider(spark, stub, **kw):
    return N.NodeProvider(spark, N.NodeClient(stub.url, clock=FakeClock(), **kw))


def test_answers(spark, stub):
    node = provider(spark, stub)
    assert (node.block_number(), node.chain_id()) == (20, 1)
    assert node.head_by_number(3) == P.Head(3, h(4), h(3), 1003)
    stub.asked.clear()
    assert [x.number for x in node.heads(0, 20)] == list(range(21)) and len(stub.asked) == 1  # one request for all
    with pytest.raises(P.NotFound):
        node.head_by_number(21)
    assert sorted(r["block_number"] for r in node.filter_logs(5, 8, (E.URI,)).collect()) == [5, 6, 7, 8]
    assert stub.asked[-1]["params"][0]["topics"] == [["0x" + E.URI]]
    assert P.Fetcher(node, FakeClock(), topics=(E.URI,)).dense(7).count() == 2


def test_capped_windows_are_halved(spark, stub):
    stub.cap = 4
    assert P.Fetcher(provider(spark, stub), FakeClock(), span_cap=15).fetch(0, 20).count() == 21


def test_failures_are_tried_again_and_slow_answers_end(spark, stub):
    node = provider(spark, stub)
    stub.fail = [503, 502]
    assert node.block_number() == 20 and len(node.client.retry.clock.slept) == 2
    stub.fail = [403]
    with pytest.raises(ProviderError, match="permanent error: 403") as found:
        node.block_number()
    assert "SECRET" not in str(found.value)
    quick = provider(spark, stub, timeout=0.2)
    stub.slow = 1.0
    with pytest.raises(ProviderError, match="failed after retries: retryable error"):
        quick.chain_id()
    assert quick.client.retry.clock.t > 200  # every attempt has its own deadline
    gone = N.NodeClient("http://127.0.0.1:9/SECRET", clock=FakeClock())
    with pytest.raises(ProviderError, match="retryable error") as found:
        gone.call("eth_chainId")
    assert "SECRET" not in str(found.value)


def test_ingestion_from_a_node(spark, stub, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    spark.dataSource.register(N.NodeHeads)
    engine = S.Subscriber(spark, provider(spark, stub), w, confirmations=2)
    engine.start(15)
    heads = spark.readStream.format("node_heads").option("url", stub.url).load()
    query = engine.stream(heads, str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert w.coverage == Coverage(15, 18) and w.latest().frame("logs").count() == 4
