"""The stored event set: signatures, shapes and the predicate that keeps a log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keccak-256 of the event signatures and the contract they name.
TRANSFER = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SINGLE = "c3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH = "4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"
METADATA_UPDATE = "f8e1a15aba9398e019f0b49df1a4fde98ee17ae345cb5f6b5e2c27f5033e8ce7"
BATCH_METADATA_UPDATE = "6bd5c950a8d8df17f772f5af37cb3655737899cbf903264b9795592da439661c"
URI = "6bb7ff708619ba0610cba295a58592e0451dee2622938c8755667688daf3529b"
PUNK_TRANSFER = "05af636b70da6819000c49f85b21fa82081c632069bb626f30932034099107d8"
PUNK_ASSIGN = "8a0e37b73a0d9c82e205d4d1a3ff3d0b57ce5f4d7bccf6bac03336dc101cb7ba"
PUNK_BOUGHT = "58e5d5a525e3b40bc15abaa38b5882678db1ee68befd2f60bafe3a7fd06db9e3"
PUNKS = "b47e3cd837ddf8e4c57f05d70ab865de6e193bbb"

#: Names in their stable order.
NAMES = {
    TRANSFER: "Transfer",
    TRANSFER_SINGLE: "TransferSingle",
    TRANSFER_BATCH: "TransferBatch",
    METADATA_UPDATE: "MetadataUpdate",
    BATCH_METADATA_UPDATE: "BatchMetadataUpdate",
    URI: "URI",
    PUNK_TRANSFER: "PunkTransfer",
    PUNK_ASSIGN: "Assign",
    PUNK_BOUGHT: "PunkBought",
}
SIGNATURES = tuple(NAMES)
TOPIC_COUNTS = {TRANSFER: 4, TRANSFER_SINGLE: 4, TRANSFER_BATCH: 4, METADATA_UPDATE: 1, BATCH_METADATA_UPDATE: 1, URI: 2}
PUNK_SIGNATURES = (PUNK_TRANSFER, PUNK_ASSIGN, PUNK_BOUGHT)


def is_signature(topic0: str) -> bool:
    """Whether a topic (hex, no 0x) is one of the stored signatures."""
    return topic0 in NAMES


def omitted_shapes(topic0: str) -> str:
    """What a node returns for a signature that is never stored."""
    punks = "0xb47e3cd837dDF8e4c57F05d70Ab865de6e193BBB"
    if topic0 == TRANSFER:
        return f"logs with fewer than 4 topics (ERC-20 Transfer, pre-standard NFT Transfer), except those emitted by CryptoPunks {punks}"
    if topic0 in (TRANSFER_SINGLE, TRANSFER_BATCH):
        return "logs with fewer than 4 topics (malformed emitters)"
    if topic0 in (METADATA_UPDATE, BATCH_METADATA_UPDATE):
        return "logs with more than 1 topic (nonstandard emitters with indexed arguments)"
    if topic0 == URI:
        return "logs with a topic count other than 2 (nonstandard emitters)"
    return f"logs emitted by any contract other than CryptoPunks {punks}" if topic0 in PUNK_SIGNATURES else ""


def keep(topics: list[str], address: str) -> bool:
    """The shape rule on driver-side values (hex, no 0x)."""
    if not topics:
        return False
    first = topics[0]
    if address == PUNKS and (first == TRANSFER or first in PUNK_SIGNATURES):
        return True
    return TOPIC_COUNTS.get(first) == len(topics)


def keep_expr(topic0: Column, topic_count: Column, address: Column, hexed: bool = False) -> Column:
    """The shape rule as one predicate: used by load, stream and extract alike.

    Columns hold bytes, or hex text if ``hexed``; null never keeps a log.
    """
    value = (lambda h: F.lit(h)) if hexed else (lambda h: F.lit(bytearray.fromhex(h)))
    by_count: dict[int, list[str]] = {}
    for signature, n in TOPIC_COUNTS.items():
        by_count.setdefault(n, []).append(signature)
    shaped = F.lit(False)
    for n, signatures in by_count.items():
        shaped = shaped | ((topic_count == n) & topic0.isin([value(s) for s in signatures]))
    punks = (address == value(PUNKS)) & topic0.isin([value(s) for s in (TRANSFER, *PUNK_SIGNATURES)])
    return F.coalesce(shaped | punks, F.lit(False))
