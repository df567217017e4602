"""Decoding of filter objects and resolution of their range, with the exact error texts."""

from __future__ import annotations

import enum
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from loghaven.errors import InvalidParams, LogError, ScopeError
from loghaven.functions import eventset
from loghaven.plans.query import Query

MAX_TOPICS = 4
MAX_SUB_TOPICS = 1000


class Tag(enum.Enum):
    EARLIEST = "earliest"
    LATEST = "latest"
    PENDING = "pending"
    SAFE = "safe"
    FINALIZED = "finalized"


Bound = int | Tag


@dataclass
class Criteria:
    """A decoded filter; hex values without 0x."""

    block_hash: str | None = None
    from_block: Bound | None = None
    to_block: Bound | None = None
    addresses: list[str] = field(default_factory=list)
    topics: list[list[str]] = field(default_factory=list)
    erc1155_id: str | None = None


def _bytes(text: str) -> bytes:
    """Strict 0x hex."""
    if not text:
        raise InvalidParams("empty hex string")
    if text[:2] not in ("0x", "0X"):
        raise InvalidParams("hex string without 0x prefix")
    body = text[2:]
    if len(body) % 2:
        raise InvalidParams("hex string of odd length")
    if not all(c in "0123456789abcdefABCDEF" for c in body):
        raise InvalidParams("invalid hex string")
    return bytes.fromhex(body)


def _sized(text: str, size: int, what: str) -> str:
    raw = _bytes(text)
    if len(raw) != size:
        raise InvalidParams(f"hex has invalid length {len(raw)} after decoding; expected {size} for {what}")
    return raw.hex()


def _fixed_hash(value: object) -> str | None:
    """A typed 32-byte field, checked while the JSON is read."""
    if value is None:
        return None
    if not isinstance(value, str):
        raise InvalidParams("json: cannot unmarshal non-string into Go value of type common.Hash")
    if value[:2] not in ("0x", "0X"):
        raise InvalidParams("json: cannot unmarshal hex string without 0x prefix into Go value of type common.Hash")
    body = value[2:]
    if len(body) != 64:
        raise InvalidParams(f"hex string has length {len(body)}, want 64 for common.Hash")
    return _bytes(value).hex()


def _bound(value: object) -> Bound | None:
    """A block number as nodes read it: a tag, or 0x and hex digits without leading zeros."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value)
    if text in [t.value for t in Tag]:
        return Tag(text)
    if not text:
        raise InvalidParams("empty hex string")
    if text[:2] not in ("0x", "0X"):
        raise InvalidParams("hex string without 0x prefix")
    body = text[2:]
    if not body:
        raise InvalidParams('hex string "0x"')
    if len(body) > 1 and body[0] == "0":
        raise InvalidParams("hex number with leading zero digits")
    if not set(body) <= set("0123456789abcdefABCDEF"):
        raise InvalidParams("invalid hex string")
    number = int(body, 16)
    if number >= 1 << 64:
        raise InvalidParams("hex number > 64 bits")
    if number >= 1 << 63:
        raise InvalidParams("block number larger than int64")
    return number


def _addresses(raw: object) -> list[str]:
    if raw is None:
        return []
    if isinstance(raw, str):
        try:
            return [_sized(raw, 20, "address")]
        except InvalidParams as e:
            raise InvalidParams(f"invalid address: {e}") from None
    if not isinstance(raw, list):
        raise InvalidParams("invalid addresses in query")
    found = []
    for i, one in enumerate(raw):
        if not isinstance(one, str):
            raise InvalidParams(f"non-string address at index {i}")
        try:
            found.append(_sized(one, 20, "address"))
        except InvalidParams as e:
            raise InvalidParams(f"invalid address at index {i}: {e}") from None
    return found


def _position(raw: object) -> list[str]:
    """Alternatives of one topic position; an empty list is a wildcard."""
    if raw is None:
        return []
    if isinstance(raw, str):
        return [_sized(raw, 32, "topic")]
    if not isinstance(raw, list):
        raise InvalidParams("invalid topic(s)")
    if len(raw) > MAX_SUB_TOPICS:
        raise InvalidParams("exceed max topics")
    found = []
    for one in raw:
        if one is None:
            return []  # what follows is not looked at
        if not isinstance(one, str):
            raise InvalidParams("invalid topic(s)")
        found.append(_sized(one, 32, "topic"))
    return found


def decode(raw: str | dict) -> Criteria:
    """A filter object from JSON, in the order of checks that clients can see."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise InvalidParams(str(e)) from None
    if not isinstance(raw, dict):
        raise InvalidParams("non-object filter")
    block_hash, low, high, token = _fixed_hash(raw.get("blockHash")), _bound(raw.get("fromBlock")), _bound(raw.get("toBlock")), _fixed_hash(raw.get("erc1155Id"))
    topics = raw.get("topics")
    if topics is not None and not isinstance(topics, list):
        raise InvalidParams("invalid topic(s)")
    if block_hash is not None and (low is not None or high is not None):
        raise InvalidParams("cannot specify both BlockHash and FromBlock/ToBlock, choose one or the other")
    addresses = _addresses(raw.get("address"))
    if topics and len(topics) > MAX_TOPICS:
        raise InvalidParams("exceed max topics")
    return Criteria(block_hash, low, high, addresses, [_position(t) for t in topics or []], token)


def check_scope(topics: list[list[str]]) -> None:
    """topic0 must name stored signatures only; nothing else could be answered whole."""
    if not topics or not topics[0]:
        raise ScopeError("filter must name at least one warehouse event signature in topics[0]")
    for signature in topics[0]:
        if not eventset.is_signature(signature):
            raise ScopeError(f"topic0 0x{signature} is not a warehouse event signature")


def _height(bound: Bound, head: int) -> int:
    if bound is Tag.LATEST:
        return head
    if bound is Tag.EARLIEST:
        return 0
    if bound in (Tag.SAFE, Tag.FINALIZED):
        raise ScopeError("safe and finalized block tags are not served (the warehouse head is only confirmation_blocks deep); ask a node")
    if not isinstance(bound, int) or bound < 0:
        raise LogError("negative block number")
    return bound


def resolve(criteria: Criteria, start: int, head: int, block_number_of: Callable[[str], int | None]) -> Query | None:
    """The query of a filter inside the covered interval; None for a range that is empty."""
    def query(low: int, high: int) -> Query:
        return Query(low, high, criteria.addresses, criteria.topics, criteria.erc1155_id)

    if criteria.block_hash is not None:
        number = block_number_of(criteria.block_hash)
        if number is None:
            raise LogError("unknown block")
        if not start <= number <= head:
            raise ScopeError(f"block {number} (0x{criteria.block_hash}) is outside the warehouse coverage {start}-{head}")
        return query(number, number)
    low = Tag.LATEST if criteria.from_block is None else criteria.from_block
    high = Tag.LATEST if criteria.to_block is None else criteria.to_block
    if isinstance(low, int) and isinstance(high, int) and low > 0 and high > 0 and low > high:
        raise LogError("invalid block range params")
    if Tag.PENDING in (low, high):
        raise LogError("pending logs are not supported")
    first, last = _height(low, head), _height(high, head)
    if first > last:
        return None
    if last > head:
        raise ScopeError(f"blocks {first}-{last} extend above the warehouse head {head}")
    if first < start:
        raise ScopeError(f"blocks {first}-{last} extend below the warehouse coverage start {start}")
    return query(first, last)
