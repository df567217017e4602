"""The query engine behind the wire: eth_getLogs and friends over a warehouse."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from loghaven.errors import InvalidParams, LogError, Maintenance, ScopeError, TooManyResults
from loghaven.functions import codec
from loghaven.operators.state import Coverage
from loghaven.operators.store import Warehouse
from loghaven.plans import criteria as C
from loghaven.plans.query import chain_order

_MAINTENANCE = "warehouse is under maintenance (a backfill is reloading it); ask a node"


class Engine:
    """Answers exactly or refuses; never partially."""

    def __init__(self, warehouse: Warehouse, *, chain: int = 1, max_results: int = 100_000, query_timeout: float = 60.0):
        self.warehouse, self.chain, self.max_results, self.query_timeout = warehouse, chain, max_results, query_timeout
        self._reads = ThreadPoolExecutor(8, "state-read")

    def _bounded(self, read: Callable[[], object]) -> object:
        """Run a read; its Spark jobs are cancelled when the time is over."""
        context = self.warehouse.spark.sparkContext
        tag = f"read-{threading.get_ident()}"
        context.addJobTag(tag)
        timer = threading.Timer(self.query_timeout, context.cancelJobsWithTag, [tag])
        timer.start()
        try:
            return read()
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def get_logs(self, filter_: str | dict) -> list[dict]:
        """Logs of a filter object as JSON-ready objects, in chain order."""
        found = C.decode(filter_)
        C.check_scope(found.topics)

        def read() -> list[dict]:
            try:
                with self.warehouse.read() as view:
                    if view.coverage is None:
                        raise ScopeError("warehouse is empty")
                    query = C.resolve(found, view.coverage.start, view.coverage.head, view.block_by_hash)
                    if query is None:
                        return []
                    rows = chain_order(view.logs(query), self.max_results).select(codec.log_json().alias("j")).collect()
            except Maintenance:
                raise ScopeError(_MAINTENANCE) from None
            if self.max_results and len(rows) > self.max_results:
                raise TooManyResults(self.max_results)
            return [json.loads(r["j"]) for r in rows]

        return self._bounded(read)

    def _coverage(self) -> Coverage | None:
        """The covered interval; the state file is read in a thread that is not waited for beyond the time."""

        def read() -> Coverage | None:
            with self.warehouse.read() as view:
                return view.coverage

        found = self._reads.submit(read)
        try:
            return found.result(self.query_timeout)
        except TimeoutError:
            raise LogError(f"the warehouse did not answer within {self.query_timeout:g}s") from None

    def block_number(self) -> str:
        try:
            coverage = self._coverage()
        except Maintenance:
            raise ScopeError(_MAINTENANCE) from None
        if coverage is None:
            raise ScopeError("warehouse is empty")
        return hex(coverage.head)

    def chain_id(self) -> str:
        return hex(self.chain)

    def health(self) -> tuple[int, dict]:
        """HTTP status and body."""
        try:
            cov = self._coverage()
        except Maintenance as e:
            return 503, {"status": "maintenance", "error": str(e), "hint": "a backfill reloads what is published, or was stopped before it was verified; run its remaining stages and finish"}
        except Exception as e:
            return 503, {"status": "error", "error": str(e)}
        return 200, {"status": "ok", "head": cov.head if cov else 0, "coverage_start": cov.start if cov else 0, "empty": cov is None, "chain_id": self.chain}

    # -- JSON-RPC -----------------------------------------------------------

    def call(self, request: object) -> dict | None:
        """One JSON-RPC request; None for a notification."""
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return _failed(None, -32600, "invalid request")
        method, params, id_ = request["method"], request.get("params") or [], request.get("id")
        try:
            if method == "eth_getLogs":
                if not params:
                    raise InvalidParams("missing value for required argument 0")
                try:
                    result: object = self.get_logs(params[0] if isinstance(params, list) else params)
                except InvalidParams as e:
                    raise InvalidParams(f"invalid argument 0: {e}") from None
            elif method == "eth_blockNumber":
                result = self.block_number()
            elif method == "eth_chainId":
                result = self.chain_id()
            else:
                return _failed(id_, -32601, f"the method {method} does not exist/is not available")
        except LogError as e:
            return _failed(id_, e.code, str(e))
        except Exception as e:
            return _failed(id_, -32000, str(e).splitlines()[0])
        return {"jsonrpc": "2.0", "id": id_, "result": result} if "id" in request else None

    def answer(self, body: bytes | str) -> str:
        """The response text of a request or batch."""
        try:
            request = json.loads(body)
        except ValueError:
            return json.dumps(_failed(None, -32700, "parse error"))
        if isinstance(request, list):
            if not request:
                return json.dumps(_failed(None, -32600, "empty batch"))
            return json.dumps([a for a in map(self.call, request) if a is not None])
        answer = self.call(request)
        return json.dumps(answer) if answer is not None else ""


def _failed(id_: object, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
