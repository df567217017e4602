"""Scripted head sequences: writes, rewinds and fatal ends."""

import json

import pytest

from loghaven import schema
from loghaven.errors import Fatal
from loghaven.functions import eventset as E
from loghaven.operators.state import Coverage
from loghaven.operators.store import Warehouse
from loghaven.sources.provider import Head, NotFound
from loghaven.streaming import subscriber as S
from loghaven.streaming.heads import HeadLog
from tests.helpers import a, b, h, logs_frame, raw_log
from tests.test_provider import FakeClock


def hash_of(branch: str, n: int) -> str:
    return h(f"{ord(branch):x}{n:08x}")


class Chain:
    """Linked heads; a branch leaves its parent branch at a height."""

    def __init__(self):
        self.branches = {"a": (None, 0)}
        self.canonical = "a"

    def fork(self, name, parent, at):
        self.branches[name] = (parent, at)

    def hash(self, branch, n):
        parent, at = self.branches[branch]
        return hash_of(branch, n) if parent is None or n >= at else self.hash(parent, n)

    def head(self, n, branch=None):
        branch = branch or self.canonical
        return Head(n, self.hash(branch, n), self.hash(branch, n - 1) if n else h(0), 1000 + n)


class FakeProvider:
    def __init__(self, spark, chain, logs=(), tip=10**9):
        self.spark, self.chain, self.logs, self.tip, self.lookups, self.before = spark, chain, list(logs), tip, [], None

    def head_by_number(self, n):
        self.lookups.append(n)
        if n > self.tip:
            raise NotFound(f"block {n}: not found")
        if self.before:
            self.before(n)
        return self.chain.head(n)

    def filter_logs(self, low, high, topics):
        rows = [x if len(x) > 7 else x for x in self.logs if low <= x[0] <= high]
        return logs_frame(self.spark, rows)

    def chain_id(self):
        return 1

    def block_number(self):
        return self.tip


class FakeSink:
    def __init__(self, stored=None):
        self.events, self.stored, self.kept, self.fail = [], dict(stored or {}), {}, None

    def write_range(self, low, high, blocks, logs):
        if self.fail and low >= self.fail:
            raise RuntimeError("disk full")
        self.events.append((low, high))
        self.stored |= {r["number"]: bytes(r["hash"]).hex() for r in blocks.collect()}
        self.kept[low] = sorted((r["block_number"], r["log_index"]) for r in logs.collect())

    def rewind(self, to):
        self.events.append(("rewind", to))
        self.stored = {n: x for n, x in self.stored.items() if n <= to}

    def stored_hash(self, n):
        return self.stored.get(n)


@pytest.fixture
def rig(spark):
    def make(first, lag=0, stored=(), logs=(), **kw):
        chain = Chain()
        provider, sink = FakeProvider(spark, chain, logs), FakeSink({n: hash_of(branch, n) for n, branch in stored})
        engine = S.Subscriber(spark, provider, sink, confirmations=lag, clock=FakeClock(), **kw)
        engine.start(first)
        return chain, provider, sink, engine

    return make


def feed(engine, chain, *heads):
    for n, branch in heads:
        engine.on_heads([chain.head(n, branch)])


@pytest.mark.parametrize(
    ("lag", "first", "batches", "writes"),
    [
        (0, 100, [[100], [101]], [(100, 100), (101, 101)]),
        (0, 100, [[105], [106]], [(100, 105), (106, 106)]),
        (0, 100, [[125]], [(100, 109), (110, 119), (120, 125)]),
        (0, 100, [[100, 101, 102]], [(100, 102)]),
        (2, 100, [[100, 101, 102], [103]], [(100, 100), (101, 101)]),
        (0, 100, [[100], [100], [101]], [(100, 100), (101, 101)]),
        (0, 500, [[400], [401], [500], [501]], [(500, 500), (501, 501)]),
        (0, 100, [[300]], [(n, min(n + 9, 300)) for n in range(100, 301, 10)]),
    ],
)
def test_plain_sequences(rig, lag, first, batches, writes):
    chain, _, sink, engine = rig(first, lag)
    for batch in batches:
        engine.on_heads([chain.head(n) for n in batch])
    assert sink.events == writes


def test_shapes_are_filtered(rig):
    logs = [raw_log(100, 0, a(1), [E.TRANSFER, h(1), h(2)], block_hash=hash_of("a", 100)), raw_log(100, 1, a(1), [E.TRANSFER, h(1), h(2), h(3)], block_hash=hash_of("a", 100))]
    chain, _, sink, engine = rig(100, logs=logs)
    feed(engine, chain, (100, "a"))
    assert sink.kept == {100: [(100, 1)]}


def test_reorg_inside_the_lag(rig):
    chain, _, sink, engine = rig(100, 2)
    chain.fork("b", "a", 102)
    feed(engine, chain, (100, "a"), (101, "a"), (102, "a"))
    chain.canonical = "b"
    feed(engine, chain, (102, "b"), (103, "b"))
    assert sink.events == [(100, 100), (101, 101)] and sink.stored[101] == hash_of("a", 101)


def test_reorg_announced_by_a_descendant(rig):
    chain, _, sink, engine = rig(100, 2)
    chain.fork("b", "a", 101)
    feed(engine, chain, (100, "a"), (101, "a"), (102, "a"))
    chain.canonical = "b"
    feed(engine, chain, (103, "b"))
    assert sink.events == [(100, 100), (101, 101)] and sink.stored[101] == hash_of("b", 101)


def test_stale_branch_is_dropped(rig):
    chain, _, sink, engine = rig(100, 2)
    chain.fork("b", "a", 101)
    feed(engine, chain, (100, "a"), (101, "a"), (102, "a"), (103, "b"))
    assert sink.events == [(100, 100)]
    feed(engine, chain, (103, "a"))
    assert sink.events == [(100, 100), (101, 101)] and sink.stored[101] == hash_of("a", 101)


def test_written_block_replaced(rig):
    chain, _, sink, engine = rig(100, 0, [(99, "a")])
    chain.fork("b", "a", 100)
    feed(engine, chain, (100, "a"))
    chain.canonical = "b"
    feed(engine, chain, (101, "b"))
    assert sink.events == [(100, 100), ("rewind", 99), (100, 101)] and sink.stored[100] == hash_of("b", 100)


def test_late_fork_below_the_lag(rig):
    chain, _, sink, engine = rig(100, 2, [(99, "a")])
    feed(engine, chain, (105, "a"))
    chain.fork("b", "a", 103)
    chain.canonical = "b"
    feed(engine, chain, (106, "b"))
    assert sink.events == [(100, 103), ("rewind", 102), (103, 104)]


def test_stale_head_at_written_height(rig):
    chain, _, sink, engine = rig(100, 0, [(99, "a")])
    chain.fork("b", "a", 100)
    feed(engine, chain, (100, "a"), (100, "b"), (101, "a"))
    assert sink.events == [(100, 100), (101, 101)]


@pytest.mark.parametrize(("branch", "events"), [("a", [(101, 101)]), ("x", [("rewind", 99), (100, 101)])])
def test_restart(rig, branch, events):
    chain, _, sink, engine = rig(101, 0, [(99, "a"), (100, branch)])
    feed(engine, chain, (101, "a"))
    assert sink.events == events


def test_fork_below_coverage_is_fatal(rig):
    chain, _, sink, engine = rig(100, 0)
    chain.fork("b", "a", 100)
    feed(engine, chain, (100, "a"))
    chain.canonical = "b"
    with pytest.raises(Fatal, match="block 99 is not stored, the fork reaches below warehouse coverage"):
        feed(engine, chain, (101, "b"))


@pytest.mark.parametrize(("lag", "first", "most", "head", "text"), [(0, 1, 50_000, 1_000_000, "need blocks 1-1000000"), (2, 100, 10, 111, r"\(12 blocks, max 10\)"), (0, 100, 100, 5000, "need blocks")])
def test_catch_up_bound(rig, lag, first, most, head, text):
    chain, provider, sink, engine = rig(first, lag, max_catchup=most)
    provider.lookups.clear()
    with pytest.raises(S.CatchupTooLarge, match=text):
        feed(engine, chain, (head, "a"))
    assert sink.events == [] and provider.lookups == []


def test_logs_that_never_agree(rig):
    logs = [raw_log(100, 0, a(1), [E.URI, h(1)], block_hash=h("ff"))]
    chain, _, sink, engine = rig(100, logs=logs)
    with pytest.raises(Fatal, match=r"blocks \[100\] kept changing .* \(3 attempts\)"):
        feed(engine, chain, (100, "a"))
    assert sink.events == []


def test_logless_block_moved(rig):
    chain, provider, sink, engine = rig(100, 1)
    chain.fork("b", "a", 100)
    engine.on_heads([chain.head(100, "a")])
    chain.canonical = "b"
    engine.on_heads([Head(101, hash_of("b", 101), hash_of("a", 100), 1101)])
    assert sink.events == [(100, 100)] and sink.stored[100] == hash_of("b", 100)


def test_write_failure_and_silence(rig):
    chain, _, sink, engine = rig(100)
    sink.fail = 106
    feed(engine, chain, (105, "a"))
    with pytest.raises(Fatal, match="write blocks 106-106: disk full"):
        feed(engine, chain, (106, "a"))
    engine.clock.t += 301
    with pytest.raises(S.HeadsSilent, match="newHeads subscription is silent"):
        engine.check_silence()


def test_pruning_and_start(rig):
    chain, provider, sink, engine = rig(100)
    feed(engine, chain, (159, "a"))
    assert len(sink.events) == 6 and list(engine.at.heads) == [159]
    provider.tip = 77
    assert (S.resolve_start(9, None, provider), S.resolve_start(None, 5, provider), S.resolve_start(None, None, provider)) == (10, 5, 77)
    with pytest.raises(Fatal, match="start_block=5 is set"):
        S.resolve_start(9, 5, provider)
    with pytest.raises(Fatal, match="does not match"):
        S.verify_chain(provider, 2)


def test_stream_into_the_store(spark, tmp_path):
    chain = Chain()
    logs = [raw_log(n, 0, a(1), [E.URI, h(1)], block_hash=hash_of("a", n)) for n in range(1, 9)]
    w = Warehouse(spark, str(tmp_path / "w"))
    path = tmp_path / "heads.jsonl"
    path.write_text("".join(json.dumps({"number": n, "hash": chain.hash("a", n), "parent_hash": chain.hash("a", n - 1), "timestamp": 1000 + n}) + "\n" for n in range(1, 9)))
    spark.dataSource.register(HeadLog)
    engine = S.Subscriber(spark, FakeProvider(spark, chain, logs), w, confirmations=2)
    engine.start(1)
    query = engine.stream(spark.readStream.format("head_log").option("path", str(path)).load(), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert w.coverage == Coverage(1, 6) and w.latest().frame("logs").count() == 6
    assert schema.HEADS.names == ["number", "hash", "parent_hash", "timestamp"] and b(h(1))
