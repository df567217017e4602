import pytest

from loghaven.errors import InvalidParams, LogError, ScopeError
from loghaven.functions.eventset import PUNKS, TRANSFER
from loghaven.plans import criteria as C
from tests.helpers import h

T, P = "0x" + TRANSFER, "0x" + PUNKS
BAD = [
    ({"blockHash": "0x" + "ab" * 32, "fromBlock": "0x1"}, "cannot specify both BlockHash and FromBlock/ToBlock, choose one or the other"),
    ({"topics": [None] * 5}, "exceed max topics"),
    ({"topics": [["0x" + "00" * 32] * 1001]}, "exceed max topics"),
    ({"topics": [1]}, "invalid topic(s)"),
    ({"topics": [[1]]}, "invalid topic(s)"),
    ({"topics": ["0x01"]}, "hex has invalid length 1 after decoding; expected 32 for topic"),
    ({"address": "0x01"}, "invalid address: hex has invalid length 1 after decoding; expected 20 for address"),
    ({"address": ["0x01"]}, "invalid address at index 0: hex has invalid length 1 after decoding; expected 20 for address"),
    ({"address": [1]}, "non-string address at index 0"),
    ({"address": [None, P]}, "non-string address at index 0"),
    ({"address": {}}, "invalid addresses in query"),
    ({"fromBlock": 5}, "hex string without 0x prefix"),
    ({"fromBlock": "5"}, "hex string without 0x prefix"),
    ({"fromBlock": ""}, "empty hex string"),
    ({"fromBlock": "0x"}, 'hex string "0x"'),
    ({"fromBlock": "0x1_0"}, "invalid hex string"),
    ({"fromBlock": "0x+1"}, "invalid hex string"),
    ({"toBlock": "0x-5"}, "invalid hex string"),
    ({"toBlock": "0x010"}, "hex number with leading zero digits"),
    ({"toBlock": "0x8000000000000000"}, "block number larger than int64"),
    ({"toBlock": "0x10000000000000000"}, "hex number > 64 bits"),
    ({"erc1155Id": "0x2a"}, "hex string has length 2, want 64 for common.Hash"),
]


@pytest.mark.parametrize(("raw", "text"), BAD)
def test_bad_filters(raw, text):
    with pytest.raises(InvalidParams, match="^" + text.replace("(", r"\(").replace(")", r"\)") + "$"):
        C.decode(raw)


def test_good_filters():
    c = C.decode({"fromBlock": "0x10", "toBlock": "0x20", "address": P, "topics": [T, None, [T, T]]})
    assert (c.from_block, c.to_block, c.addresses, [len(t) for t in c.topics]) == (16, 32, [PUNKS], [1, 0, 2])
    c = C.decode('{"fromBlock":"earliest","toBlock":"latest"}')
    assert (c.from_block, c.to_block) == (C.Tag.EARLIEST, C.Tag.LATEST)
    assert C.decode({"topics": [[T, None, 1]]}).topics == [[]]  # what follows a null is not looked at
    assert C.decode({"topics": [T], "erc1155Id": "0x" + h(42)}).erc1155_id == h(42)
    assert C.decode({"topics": []}).topics == []


def resolve(low=None, high=None, start=0, head=100, **kw):
    return C.resolve(C.Criteria(from_block=low, to_block=high, topics=[[TRANSFER]], **kw), start, head, {h(7): 7}.get)


def test_resolution():
    q = resolve()
    assert (q.from_block, q.to_block) == (100, 100)
    q = resolve(C.Tag.EARLIEST, 50)
    assert (q.from_block, q.to_block) == (0, 50)
    assert resolve(60, 0) is None  # an explicit zero is no positive bound
    assert resolve(C.Tag.LATEST, 5) is None
    q = resolve(block_hash=h(7))
    assert (q.from_block, q.to_block) == (7, 7)


@pytest.mark.parametrize(
    ("kw", "error", "text"),
    [
        ({"low": 20, "high": 10}, LogError, "invalid block range params"),
        ({"low": C.Tag.PENDING}, LogError, "pending logs are not supported"),
        ({"low": -7}, LogError, "negative block number"),
        ({"high": C.Tag.SAFE}, ScopeError, "out of warehouse scope: safe and finalized block tags are not served (the warehouse head is only confirmation_blocks deep); ask a node"),
        ({"low": 5, "high": 101}, ScopeError, "out of warehouse scope: blocks 5-101 extend above the warehouse head 100"),
        ({"low": 5, "high": 60, "start": 50}, ScopeError, "out of warehouse scope: blocks 5-60 extend below the warehouse coverage start 50"),
        ({"block_hash": h(9)}, LogError, "unknown block"),
        ({"block_hash": h(7), "start": 50}, ScopeError, f"out of warehouse scope: block 7 (0x{h(7)}) is outside the warehouse coverage 50-100"),
    ],
)
def test_refusals(kw, error, text):
    with pytest.raises(error) as found:
        resolve(**kw)
    assert str(found.value) == text


def test_scope():
    for topics, text in (([], "filter must name at least one warehouse event signature in topics[0]"), ([[h(1)]], f"topic0 0x{h(1)} is not a warehouse event signature")):
        with pytest.raises(ScopeError) as found:
            C.check_scope(topics)
        assert str(found.value) == f"out of warehouse scope: {text}"
        assert not any(word in str(found.value) for word in ("range", "limit", "too many"))
