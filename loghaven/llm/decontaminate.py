"""Benchmark decontamination with DataFrame functions only.

The method: SimHash windows of the size of each benchmark item, find windows within a
Hamming radius of an item's fingerprint by a multi-index over blocks of bits, then
verify the exact weighted similarity of the five-word shingles.

1. Words are runs of letters and digits in lower case; shingles of five words are hashed
   to 64 bits. A document of n words has n - 4 shingles, an item of L words L - 4.
2. A window that reaches the similarity must hold at least 2/(1 + 1/s) of the item's
   number of shingles from that item. Windows short of that bound are never
   fingerprinted; the bound is exact, so no pair is lost to it, and an item meets only
   windows that share its shingles, however many items there are.
3. The windows left are fingerprinted (SimHash over their shingles, repeats included);
   equal windows, for instance of a passage that a third of the corpus holds, are one.
4. 64 bits are cut into ten blocks. Two fingerprints within 19 bits agree in some block but
   for one bit at most (nine blocks with two errors would be 18, ten would be 20), so
   an item is listed under each block value and its one-bit neighbours, and windows look
   up theirs: every pair within the radius is found.
5. Candidates are verified: the shared counts of shingles over the counts of both.

The radius: at similarity 0.8 a bit differs with a probability of about 0.15, which is 9
to 10 bits of 64 with a deviation of 2.8; 0.998 of such pairs lie within 19 bits
(``tests/llm`` measures it), and nearly all of those more similar.

The first pass only joins shingle hashes with the shingles of the benchmark, which Spark
broadcasts if they are small and shuffles otherwise. Documents without enough hits do not
go on. Groups are the windows of one document; a passage that very many documents hold
loads no task, since equal windows are pre-aggregated and the join back is an equi-join
of small rows that adaptive execution splits.

Defined results: null and empty texts match nothing; items of fewer than five words match
nothing (they would match everywhere); a document shorter than an item is compared as one
window; repeated rows (same id and text) give one result; a null id is kept as null;
items of one text and different ids (null is one) are reported each, repeated rows once; empty tables give an empty result; extra columns do not
matter. Texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghaven.llm.common import materialize, table, text_hash

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
#: Widths of the ten blocks of a fingerprint.
BLOCKS = (6, 6, 6, 6, 6, 6, 7, 7, 7, 7)

_NULL_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Neighbouring projections may be merged, which would repeat the value inside a lambda
    for each element; a lambda's variable is bound once.
    """
    return F.transform(F.array(value), body)[0]


def _hashed(text: str, body) -> Column:
    """``body`` of (hashes of the words, hashes of the shingles) of a text."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))
        return F.transform(firsts, lambda x, i: F.xxhash64(x, *(w[i + k] for k in range(1, SHINGLE))))

    return _let(hashes, lambda w: _let(runs(w), lambda sh: body(w, sh)))


def shingle_hashes(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``sh``: hashes of all shingles in order."""
    return rows.select(*keep, _hashed(text, lambda w, sh: sh).alias("sh"))


def simhash(hashes: str) -> Column:
    """SimHash of an array of 64-bit hashes: a bit is set if over half of them have it."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * size(filter({hashes}, x -> (shiftright(x, b) & 1L) = 1L)) > size({hashes}), shiftleft(1L, b), 0L))")


def _block_values(fp: str) -> list[Column]:
    found, at = [], 0
    for i, width in enumerate(BLOCKS):
        found.append(F.struct(F.lit(i).alias("block"), F.expr(f"CAST(shiftrightunsigned({fp}, {at}) & {(1 << width) - 1}L AS int)").alias("value"), F.lit(width).alias("width")))
        at += width
    return found


def needed(own: str, other: str, similarity: float) -> Column:
    """Shared shingles that two multisets of these sizes need."""
    share = similarity / (1 + similarity)
    return F.ceil((F.col(own) + F.col(other)) * F.lit(share) - F.lit(1e-9)).cast("int")


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Best windows of documents that hold an item: (doc_id, k_text, item_id, start_word, n_words, similarity)."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k_id"), text_hash(text_col).alias("k_text"), F.col(text_col).alias("text")).where(F.length("text") > 0)

    named = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    bench = materialize(shingle_hashes(named, "item_text", ["item_id"]), "shingles").where(F.size("sh") > 0)
    bench = bench.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "sh")).dropDuplicates(["item"])
    bench = materialize(bench.select("item", "item_id", F.size("sh").alias("m"), "sh", simhash("sh").alias("fp")), "items")
    known = materialize(bench.select("item", "m", F.explode(F.array_distinct("sh")).alias("hash")), "known")

    # 2. where windows can reach the similarity
    spots = _hashed("text", lambda w, sh: F.transform(sh, lambda h, i: F.struct(i.alias("pos"), h.alias("hash"), F.size(sh).alias("n"))))
    seeds = keyed.select("k_id", "k_text", F.explode(spots).alias("s")).select("k_id", "k_text", "s.n", "s.pos", "s.hash").join(known, "hash")
    places = seeds.groupBy("k_id", "k_text", "item", "m").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("pos")).alias("p"))
    # a document of fewer shingles than the item is one window
    sized = places.withColumn("size", F.least("n", "m")).withColumn("t", needed("m", "size", similarity))
    starts = F.expr("array_distinct(flatten(transform(sequence(0, size(p) - t), i -> if(p[i + t - 1] - p[i] < size AND greatest(0, p[i + t - 1] - size + 1) <= least(p[i], n - size), sequence(greatest(0, p[i + t - 1] - size + 1), least(p[i], n - size)), cast(array() AS array<int>)))))")
    asked = sized.where(F.size("p") >= F.col("t")).select("k_id", "k_text", "item", "size", starts.alias("starts")).where(F.size("starts") > 0)
    asked = materialize(asked.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("item", "size", "starts")).alias("asked")), "asked")

    # 3. fingerprints of those windows
    again = shingle_hashes(keyed.join(asked, ["k_id", "k_text"]).dropDuplicates(["k_id", "k_text"]), "text", ["k_id", "k_text", "asked"])
    sizes = again.select("k_id", "k_text", "sh", F.explode("asked").alias("a")).select("k_id", "k_text", "sh", "a.item", "a.size", F.explode("a.starts").alias("start"))
    windows = sizes.select("k_id", "k_text", "item", "start", "size", F.slice("sh", F.col("start") + 1, F.col("size")).alias("ws")).withColumn("window", F.xxhash64("ws"))
    windows = materialize(windows, "windows")
    distinct = windows.groupBy("item", "window").agg(F.first("ws").alias("ws"))
    prints = materialize(distinct.withColumn("wfp", simhash("ws")), "prints")

    # 4. all pairs within the radius, by blocks
    near = F.expr("flatten(transform(blocks, b -> transform(concat(array(b.value), transform(sequence(0, b.width - 1), j -> b.value ^ shiftleft(1, j))), v -> struct(b.block AS block, v AS value))))")
    listed = bench.withColumn("blocks", F.array(*_block_values("fp"))).select("item", "fp", F.explode(near).alias("b")).select("item", "fp", "b.block", "b.value")
    looked = prints.withColumn("blocks", F.array(*_block_values("wfp"))).select("item", "window", "wfp", F.explode("blocks").alias("b")).select("item", "window", "wfp", "b.block", "b.value")
    pairs = looked.join(listed, ["item", "block", "value"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= RADIUS).select("item", "window").distinct()

    # 5. exact similarity of the shingle counts
    sides = pairs.join(prints.select("item", "window", "ws"), ["item", "window"]).join(bench.select("item", "item_id", "m", "sh"), "item")
    shared = F.expr("aggregate(array_distinct(sh), 0, (acc, h) -> acc + least(size(filter(sh, x -> x = h)), size(filter(ws, x -> x = h))))")
    scored = sides.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.col("m") + F.size("ws") - F.col("shared")))
    matches = materialize(scored.where(F.col("similarity") >= similarity - 1e-12).select("item", "window", "item_id", "similarity"), "matches")

    found = windows.drop("ws").join(matches, ["item", "window"])
    # of windows that overlap, the best one; groups are the windows of one document and item
    order = W.partitionBy("k_id", "k_text", "item").orderBy("start")
    runs = found.withColumn("new", (F.col("start") - F.coalesce(F.lag("start").over(order), F.lit(-1 << 30)) >= F.col("size")).cast("int")).withColumn("run", F.sum("new").over(order))
    best = runs.groupBy("k_id", "k_text", "item", "item_id", "run").agg(F.max_by(F.struct("start", "size", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select(F.when(F.col("k_id") != _NULL_ID, F.col("k_id")).alias("doc_id"), "k_text", "item_id", F.col("b.start").cast("long").alias("start_word"), (F.col("b.size") + SHINGLE - 1).cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def remove_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, all columns kept."""
    bad = materialize(find_leaks(docs, items, id_col=id_col, text_col=text_col).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("k_id"), "k_text").distinct(), "leaks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k_id"), text_hash(text_col).alias("k_text"))
    return whole.join(bad, ["k_id", "k_text"], "left_anti").select("row.*")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k_text")
