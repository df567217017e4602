"""400 random filters against a plain reference, over one store."""

import random

import pytest

from loghaven.errors import TooManyResults
from loghaven.functions import eventset as E
from loghaven.operators.store import Warehouse
from loghaven.plans.query import Query
from tests.helpers import a, b, blocks_frame, h, logs_frame, raw_log

POOL = [h(0xA), h(0xB), h(0xC), h(0xD)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(42)
    rows = []
    for n in range(1, 41):
        for i in range(rng.randint(0, 5)):
            rows.append((n, i, a(rng.randint(1, 3)), [rng.choice(POOL) for _ in range(rng.randint(1, 4))], bytes([n, i]) if rng.random() < 0.5 else b""))
    w = Warehouse(spark, str(tmp_path_factory.mktemp("w")), part_blocks=15)
    w.write_range(1, 40, blocks_frame(spark, 1, 40), logs_frame(spark, [raw_log(n, i, address, topics, data) for n, i, address, topics, data in rows]))
    return w, rows


def expected(rows, q):
    def fits(row):
        n, _, address, topics, _ = row
        ok = q.from_block <= n <= q.to_block and (not q.addresses or address in q.addresses)
        return ok and all(not values or (i < len(topics) and topics[i] in values) for i, values in enumerate(q.topics))

    return sorted(r[:2] for r in rows if fits(r))


def test_differential(spark, stored):
    w, rows = stored
    rng = random.Random(7)
    queries = []
    for _ in range(400):
        low = rng.randint(0, 41)
        topics = [[[], [rng.choice(POOL)], [rng.choice(POOL), rng.choice(POOL)]][rng.randint(0, 2)] for _ in range(rng.randint(0, 4))]
        queries.append(Query(low, low + rng.randint(0, 39), [a(rng.randint(1, 3)) for _ in range(rng.randint(0, 2))], topics))
    view = w.latest()
    # all predicates over one pass, and a tenth of the queries through the whole path
    frame = view.frame("logs").select("block_number", "log_index", *[q.predicate().alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    for i, q in enumerate(queries):
        assert sorted((r["block_number"], r["log_index"]) for r in frame if r[f"q{i}"]) == expected(rows, q)
    for q in queries[::40]:
        got = view.filter_logs(q)
        assert [(r["block_number"], r["log_index"]) for r in got] == expected(rows, q)
        assert all(r["block_ts"] == 1_700_000_000 + 12 * r["block_number"] for r in got)


def test_cap(stored):
    w, rows = stored
    with pytest.raises(TooManyResults, match="query returned more than 3 results"):
        w.latest().filter_logs(Query(1, 40), 3)
    assert len(w.latest().filter_logs(Query(1, 40), len(rows))) == len(rows)


def test_token_arms(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    token, other = h(42), h(43)
    rows = [
        raw_log(1, 0, a(1), [E.TRANSFER_SINGLE, h(1), h(2), h(3)], bytes.fromhex(token + h(1))),
        raw_log(1, 1, a(1), [E.TRANSFER_SINGLE, h(1), h(2), h(3)], bytes.fromhex(other + h(1))),
        raw_log(1, 2, a(1), [E.URI, token]),
        raw_log(1, 3, a(1), [E.URI, other]),
        raw_log(1, 4, a(1), [E.TRANSFER_BATCH, h(1), h(2), h(3)], b"\0" * 64),
    ]
    w.write_range(1, 1, blocks_frame(spark, 1, 1), logs_frame(spark, rows))
    index = lambda signatures: [r["log_index"] for r in w.latest().filter_logs(Query(1, 1, topics=[signatures], erc1155_id=token))]
    assert index([E.TRANSFER_SINGLE]) == [0]
    assert index([E.TRANSFER_SINGLE, E.URI]) == [0, 2]
    assert index([E.TRANSFER_SINGLE, E.TRANSFER_BATCH]) == [0, 4]
    assert index([E.URI]) == [2]


def test_pushdown(spark, stored):
    w, _ = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = w.latest().logs(Query(3, 9, [a(1)], [[h(0xA)]], None))._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("(block_number,3)" in x and "(address," in x and "(topic0," in x for x in pushed), pushed
    assert any("GreaterThanOrEqual(number,3)" in x for x in pushed)  # the range reaches the blocks side too
