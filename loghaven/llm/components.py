"""Connected components of a large graph by alternating stars.

Each round replaces edges by stars around smaller nodes (large star, then small star)
until nothing changes; the number of rounds grows with the logarithm of the graph. A
round is a grouped minimum, which Spark combines before the shuffle, and an equi-join,
which adaptive execution splits where a node has very many edges. Lineage is cut by
writing each round to the shared folder. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghaven.llm.common import materialize


def _toward_minimum(edges: DataFrame) -> DataFrame:
    """Both directions of the edges with the least node around each node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Node and the least node it is connected with, for every node with an edge.

    ``edges`` has columns u and v of one orderable type; loops and repeats do not matter.
    """
    now = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # the sum of hashes tells whether the set of edges is still the same
    state = _state(now)
    for _ in range(most_rounds):
        around = _toward_minimum(now)
        large = around.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
