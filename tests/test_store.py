import os
import threading

import pytest

from loghaven.errors import CoverageGap, Maintenance, StoreError, TooManyResults, WriterBusy
from loghaven.operators.state import Coverage, Generation, State
from loghaven.operators.store import Warehouse
from loghaven.plans.query import Query
from tests.helpers import a, b, blocks_frame, h, logs_frame, raw_log

A = raw_log(11, 0, a(1), [h(0xA)], None)
B = raw_log(12, 3, a(2), [h(0xA), h(0xB)], b"\x01\x02", tx=7)


def write(w, spark, low, high, logs=()):
    return w.write_range(low, high, blocks_frame(spark, low, high), logs_frame(spark, list(logs)))


@pytest.fixture
def w(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "w"), part_blocks=1000)


def test_life_of_a_store(spark, w):
    write(w, spark, 10, 12, [A, B])
    found = w.latest().filter_logs(Query(10, 12))
    assert [(r["block_number"], r["log_index"]) for r in found] == [(11, 0), (12, 3)]
    assert bytes(found[0]["data"]) == b"" and bytes(found[1]["data"]) == b"\x01\x02" and found[1]["tx_index"] == 7
    write(w, spark, 11, 12, [A])
    assert len(w.latest().filter_logs(Query(10, 12))) == 1
    with pytest.raises(StoreError, match="write range 13-14: got 1 block rows, want 2"):
        w.write_range(13, 14, blocks_frame(spark, 13, 13), logs_frame(spark, []))
    w.rewind(10)
    assert w.coverage == Coverage(10, 10) and w.latest().filter_logs(Query(10, 12)) == []
    assert w.latest().block_by_hash(h(11)) is None and w.latest().block_by_hash(h(10)) == 10
    with pytest.raises(StoreError, match="rewind to 10: cursor is not above it"):
        w.rewind(10)
    with pytest.raises(CoverageGap):
        w.rewind(9)
    write(w, spark, 11, 12, [A, B])
    with pytest.raises(TooManyResults):
        w.latest().filter_logs(Query(10, 12), 1)
    assert len(w.latest().filter_logs(Query(10, 12), 2)) == 2


def test_coverage(spark, w):
    write(w, spark, 100, 102)
    for low, high in ((104, 104), (90, 98)):
        with pytest.raises(CoverageGap, match=f"range {low}-{high} vs coverage 100-102"):
            write(w, spark, low, high)
    write(w, spark, 103, 103)
    write(w, spark, 97, 99)
    write(w, spark, 100, 101)
    assert w.coverage == Coverage(97, 103)
    w.rewind(100)
    assert w.coverage == Coverage(97, 100)


def test_publication_merges(w):
    w.set_coverage(10, 20)
    w.set_coverage(21, 25)
    w.set_coverage(10, 20)
    assert w.coverage == Coverage(10, 25)
    w.set_coverage(5, 9)
    assert w.coverage == Coverage(5, 25)
    with pytest.raises(CoverageGap, match="verified interval 40-50 vs existing coverage 5-25"):
        w.set_coverage(40, 50)


def test_parts_and_straddling_generations(spark, w):
    write(w, spark, 998, 1001, [raw_log(n, 0, a(1), [h(0xA)]) for n in range(998, 1002)])
    assert {g.part for g in w.states.read().logs} == {0, 1}
    write(w, spark, 999, 1000)
    assert [r["block_number"] for r in w.latest().filter_logs(Query(998, 1001))] == [998, 1001]
    w.rewind(999)
    assert {g.part for g in w.states.read().blocks} == {0}


def test_versions_are_never_overwritten(spark, w):
    write(w, spark, 1, 1)
    before = w.states.read()
    write(w, spark, 2, 2)
    with pytest.raises(WriterBusy):
        w.states.commit(before)
    folder = f"{w.states.root}/_state"
    open(f"{folder}/v{w.states.read().version + 1:08d}.json", "w").close()  # a writer that ended while writing
    assert w.coverage == Coverage(1, 2)
    write(w, spark, 3, 3)
    assert w.coverage == Coverage(1, 3)


def test_merges_rewrite_little(spark, tmp_path, monkeypatch):
    """Rows rewritten per block stay logarithmic while a part fills."""
    w = Warehouse(spark, str(tmp_path), compact_after=16)
    written = []

    def count(kind, rows, low, high):
        if kind == "blocks":
            written.append(high - low + 1)
        return [Generation(f"g{len(written)}", 0, low, high, 1)]

    monkeypatch.setattr(w, "_write", count)
    monkeypatch.setattr(w, "frame", lambda kind, generations: None)
    state = State()
    for n in range(1000):
        state = w.replaced(state, "blocks", None, n, n)
        assert len(state.blocks) <= 17
    assert [(x.low, y.low) for x, y in zip(state.blocks, state.blocks[1:], strict=False) if x.high + 1 != y.low] == []
    assert state.blocks[0].low == 0 and state.blocks[-1].high == 999
    assert sum(written) < 1000 * 6  # the whole part, each time there are 17, would be some 31,000


def test_compaction_and_vacuum(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), compact_after=3)
    for n in range(1, 7):
        write(w, spark, n, n, [raw_log(n, 0, a(1), [h(0xA)])])
    assert len(w.states.read().logs) <= 3
    assert w.states.vacuum(keep_versions=1) > 0
    assert len(w.latest().filter_logs(Query(1, 6))) == 6


@pytest.mark.parametrize(
    ("block_hash", "text"),
    [("00" * 32, "carries no block hash; unverifiable logs are not stored"), ("ff" * 32, "but the block row is 0x")],
)
def test_unverifiable_logs(spark, w, block_hash, text):
    with pytest.raises(StoreError, match=text):
        write(w, spark, 5, 5, [raw_log(5, 0, a(1), [h(0xA)], block_hash=block_hash)])
    assert w.coverage is None


def test_keys_and_required_columns(spark, w):
    with pytest.raises(StoreError, match="occurs 2 times"):
        write(w, spark, 5, 5, [raw_log(5, 0, a(1), [h(0xA)])] * 2)
    with pytest.raises(StoreError, match="lacks a required column"):
        write(w, spark, 5, 5, [raw_log(5, 0, a(1), [])])


def test_snapshot_outlives_a_rewind(spark, w):
    write(w, spark, 1, 3, [raw_log(3, 0, a(1), [h(0xA)])])
    with w.read() as view:
        w.rewind(1)
        assert len(view.filter_logs(Query(1, 3))) == 1
    assert w.latest().filter_logs(Query(1, 3)) == []


def test_locks_and_maintenance(w):
    with w.states.writer(), pytest.raises(WriterBusy), w.states.writer():
        pass
    with w.states.maintenance_lock(), pytest.raises(Maintenance), w.read():
        pass
    with w.read(), pytest.raises(Maintenance, match="did not drain"), w.states.maintenance_lock(wait=0.2):
        pass
    w.set_maintenance(True, "reload")
    with pytest.raises(Maintenance), w.read():
        pass
    w.set_maintenance(False)
    with w.read() as view:
        assert view.coverage is None


def test_lost_race_and_crash_before_the_pointer(spark, w, monkeypatch):
    state = write(w, spark, 1, 1)
    w.states.commit(state)
    with pytest.raises(WriterBusy):
        w.states.commit(state)
    monkeypatch.setattr(w.states, "commit", lambda s: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        write(w, spark, 2, 2, [raw_log(2, 0, a(1), [h(0xA)])])
    monkeypatch.undo()
    assert w.coverage == Coverage(1, 1) and w.latest().filter_logs(Query(1, 2)) == []


def test_threads_share_readers(w):
    seen = []

    def read():
        with w.read() as view:
            seen.append(view.coverage)

    threads = [threading.Thread(target=read) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == [None] * 4 and os.listdir(w.states.lock_dir)
