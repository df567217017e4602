"""A provider over JSON-RPC: a chain node asked by HTTP, with retries and a deadline for each attempt."""

from __future__ import annotations

import itertools
import json
import socket
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from loghaven import schema
from loghaven.errors import ProviderError
from loghaven.sources.provider import Clock, Head, NotFound, Retry, SystemClock, redact

#: Calls that one HTTP request carries.
BATCH_CALLS = 100


class RpcError(ProviderError):
    """An error object that the node answered."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _bytes(text: str | None) -> bytearray | None:
    return None if text is None else bytearray.fromhex(text.removeprefix("0x"))


class NodeClient:
    """JSON-RPC calls; every call runs under ``Retry``, every attempt under ``timeout``."""

    def __init__(self, url: str, *, timeout: float = 60.0, clock: Clock | None = None, retry: Retry | None = None):
        self.url, self.timeout = url, timeout
        self.retry = retry or Retry(clock or SystemClock())
        self._ids = itertools.count(1)

    def _post(self, body: object) -> object:
        """One attempt. Errors carry no more of the URL than scheme and host."""
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise ProviderError(f"{e.code} {e.reason}") from None
        except urllib.error.URLError as e:
            raise e.reason if isinstance(e.reason, OSError) else ProviderError(redact(str(e.reason))) from None
        except socket.timeout:
            raise TimeoutError(f"no answer within {self.timeout:g}s") from None
        except ValueError:
            raise ProviderError("unexpected EOF or no JSON in the answer") from None

    @staticmethod
    def _result(answer: object) -> object:
        if not isinstance(answer, dict):
            raise ProviderError("the answer is no JSON-RPC object")
        if error := answer.get("error"):
            raise RpcError(error.get("code", 0), redact(str(error.get("message", ""))))
        return answer.get("result")

    def call(self, method: str, *params: object) -> object:
        def ask() -> object:
            return self._result(self._post({"jsonrpc": "2.0", "id": next(self._ids), "method": method, "params": list(params)}))

        return self.retry(method, ask)

    def calls(self, method: str, many: list[list]) -> list:
        """Results of one method for many parameter lists, in order, in few requests."""
        found: list = []
        for at in range(0, len(many), BATCH_CALLS):
            part = many[at : at + BATCH_CALLS]

            def ask(part: list[list] = part) -> list:
                body = [{"jsonrpc": "2.0", "id": next(self._ids), "method": method, "params": params} for params in part]
                answers = self._post(body)
                if not isinstance(answers, list):
                    return [self._result(answers)] * len(part)  # an error for the whole batch
                by_id = {a.get("id"): a for a in answers if isinstance(a, dict)}
                return [self._result(by_id.get(b["id"])) for b in body]

            found += self.retry(method, ask)
        return found


class NodeProvider:
    """What ingestion needs of a node, by JSON-RPC."""

    def __init__(self, spark: SparkSession, client: NodeClient):
        self.spark, self.client = spark, client

    @staticmethod
    def _head(number: int, raw: dict | None) -> Head:
        if raw is None:
            raise NotFound(f"block {number}: not found")
        return Head(int(raw["number"], 16), raw["hash"][2:], raw["parentHash"][2:], int(raw["timestamp"], 16))

    def head_by_number(self, number: int) -> Head:
        return self._head(number, self.client.call("eth_getBlockByNumber", hex(number), False))

    def heads(self, low: int, high: int) -> list[Head]:
        numbers = range(low, high + 1)
        return [self._head(n, raw) for n, raw in zip(numbers, self.client.calls("eth_getBlockByNumber", [[hex(n), False] for n in numbers]), strict=True)]

    @staticmethod
    def _log(raw: dict) -> tuple:
        number = lambda k: int(raw[k], 16)
        return (number("blockNumber"), number("logIndex"), number("transactionIndex"), _bytes(raw["transactionHash"]), _bytes(raw["address"]), [_bytes(t) for t in raw["topics"]], _bytes(raw.get("data")), _bytes(raw.get("blockHash")))

    def filter_logs(self, low: int, high: int, topics: tuple[str, ...]) -> DataFrame:
        """Logs of a window; the node's result cap bounds what one call brings to the driver."""
        found = self.client.call("eth_getLogs", {"fromBlock": hex(low), "toBlock": hex(high), "topics": [["0x" + t for t in topics]]})
        return self.spark.createDataFrame([self._log(x) for x in found or [] if not x.get("removed")], schema.RAW_LOGS)

    def block_receipts(self, number: int) -> DataFrame:
        found = self.client.call("eth_getBlockReceipts", hex(number))
        if found is None:
            raise NotFound(f"receipts of block {number}: not found")
        rows = self.spark.createDataFrame([self._log(x) for r in found for x in r["logs"]], schema.RAW_LOGS)
        by_tx = rows.groupBy("block_number", "tx_index").agg(F.collect_list(F.struct(*rows.columns)).alias("logs"))
        return by_tx.groupBy("block_number").agg(F.collect_list(F.struct("logs")).alias("receipts"))

    def block_number(self) -> int:
        return int(self.client.call("eth_blockNumber"), 16)

    def chain_id(self) -> int:
        return int(self.client.call("eth_chainId"), 16)


class NodeHeads(DataSource):
    """New heads of a node (``url``, ``timeout``), by asking for its tip at every trigger.

    The offset is the last height given out. A replayed range gives the headers that the
    chain has now, which is what ingestion compares with.
    """

    @classmethod
    def name(cls) -> str:
        return "node_heads"

    def schema(self) -> str:
        return "number long, hash binary, parent_hash binary, timestamp long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Heads(self.options["url"], float(self.options.get("timeout", "60")))


class _Heads(SimpleDataSourceStreamReader):
    #: Headers of one trigger; older ones are read by ingestion itself.
    MOST = 50

    def __init__(self, url: str, timeout: float):
        self.url, self.timeout = url, timeout

    def _provider(self) -> NodeProvider:
        return NodeProvider(None, NodeClient(self.url, timeout=self.timeout))

    def initialOffset(self) -> dict:
        return {"number": -1}

    def _rows(self, low: int, high: int) -> list[tuple]:
        found = self._provider().heads(max(low, high - self.MOST + 1), high) if high >= low else []
        return [(h.number, bytes.fromhex(h.hash), bytes.fromhex(h.parent), h.timestamp) for h in found]

    def read(self, start: dict):
        tip = self._provider().block_number()
        if tip <= start["number"]:
            return iter([]), start
        return iter(self._rows(start["number"] + 1, tip)), {"number": tip}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start["number"] + 1, end["number"]))
