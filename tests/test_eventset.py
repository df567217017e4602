import pytest
from pyspark.sql import functions as F

from loghaven.functions import codec
from loghaven.functions import eventset as E
from tests.helpers import a, b, h

X = [h(1), h(2), h(3)]
CASES = [
    ([E.TRANSFER, *X], a(1), True), ([E.TRANSFER, *X[:2]], a(1), False), ([E.TRANSFER], a(1), False), ([E.TRANSFER, *X[:2]], E.PUNKS, True), ([E.TRANSFER], E.PUNKS, True),
    ([E.TRANSFER_SINGLE, *X], a(1), True), ([E.TRANSFER_SINGLE, X[0]], a(1), False), ([E.TRANSFER_BATCH, *X], a(1), True), ([E.METADATA_UPDATE], a(1), True), ([E.METADATA_UPDATE, X[0]], a(1), False),
    ([E.BATCH_METADATA_UPDATE], a(1), True), ([E.URI, X[0]], a(1), True), ([E.URI], a(1), False), ([E.PUNK_TRANSFER, *X[:2]], E.PUNKS, True), ([E.PUNK_TRANSFER, *X[:2]], a(1), False),
    ([E.PUNK_ASSIGN, X[0]], E.PUNKS, True), ([E.PUNK_BOUGHT], E.PUNKS, True), ([h("abc")], a(1), False), ([], a(1), False),
]


@pytest.mark.parametrize(("topics", "address", "kept"), CASES)
def test_keep(topics, address, kept):
    assert E.keep(topics, address) is kept


def test_keep_expr_agrees(spark):
    rows = [(i, [b(t) for t in topics], b(address)) for i, (topics, address, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, topics array<binary>, address binary")
    found = df.select("i", E.keep_expr(codec.topic_at(F.col("topics"), 0), F.size("topics"), F.col("address")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in found} == {i: k for i, (_, _, k) in enumerate(CASES)}


def test_constants_and_descriptions():
    assert len(E.SIGNATURES) == 9 and all(len(s) == 64 for s in E.SIGNATURES)
    assert all(E.omitted_shapes(s) for s in E.SIGNATURES) and E.omitted_shapes(h(1)) == ""


def test_topics_stop_at_first_absent(spark):
    df = spark.createDataFrame([("a", "b", None, "d"), ("a", None, None, None), ("a", "b", "c", "d")], "topic0 string, topic1 string, topic2 string, topic3 string")
    got = df.select(codec.topics_array(*(F.col(t) for t in codec.TOPICS)).alias("t"), codec.topic_count(*(F.col(t) for t in codec.TOPICS)).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got] == [(["a", "b"], 2), (["a"], 1), (["a", "b", "c", "d"], 4)]
