"""Declared schemas; nothing in this package infers one."""

from pyspark.sql import types as T

_L, _I, _B, _S = T.LongType(), T.IntegerType(), T.BinaryType(), T.StringType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


BLOCKS = _struct(("number", _L, False), ("hash", _B, False), ("ts", _L, False))
LOGS = _struct(
    ("block_number", _L, False), ("log_index", _I, False), ("tx_index", _I, False), ("tx_hash", _B, False), ("address", _B, False),
    ("topic0", _B, False), ("topic1", _B, True), ("topic2", _B, True), ("topic3", _B, True), ("data", _B, False), ("data_word0", _B, True),
)
EXPORT_LOGS = _struct(
    ("block_number", _L, True), ("log_index", _L, True), ("tx_index", _L, True), ("tx_hash", _B, True), ("address", _B, True),
    ("topic0", _B, True), ("topic1", _B, True), ("topic2", _B, True), ("topic3", _B, True), ("data", _B, True),
)
EXPORT_BLOCKS = _struct(("number", _L, True), ("block_hash", _B, True), ("ts", _L, True))
#: Logs as a provider gives them: any number of topics, the hash of their block.
RAW_LOGS = _struct(
    ("block_number", _L, False), ("log_index", _I, False), ("tx_index", _I, False), ("tx_hash", _B, False), ("address", _B, False),
    ("topics", T.ArrayType(_B, False), False), ("data", _B, True), ("block_hash", _B, True),
)
HEADS = _struct(("number", _L, False), ("hash", _B, False), ("parent_hash", _B, False), ("timestamp", _L, False))
SOURCE_LOGS = _struct(
    ("log_index", _L, True), ("transaction_hash", _S, True), ("transaction_index", _L, True), ("address", _S, True), ("data", _S, True),
    ("topics", T.ArrayType(_S), True), ("block_timestamp", T.TimestampType(), True), ("block_number", _L, True), ("block_hash", _S, True),
)
