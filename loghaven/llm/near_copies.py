"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8.

Candidates come from two indexes and are then verified on the whole sets, in whole numbers:

* the vantage-point tree over SimHash fingerprints (see ``simhash_groups``) gives pairs
  within two bits, most copies with few edits;
* pairs of that similarity differ by up to some 14 bits, where no tree prunes, so the rest
  comes from ``BANDS`` bands of ``ROWS`` minimum hashes: two sets of similarity s meet in
  a band with probability s ** ROWS, in any of them with 0.9998 at 0.8, and more above.

Documents of one set are one point, named by a 64-bit digest, so copies never form pairs.
A bucket of a band is read in two rounds, since a group of k near copies has k * k pairs.
Round one compares each point with the hub of its bucket. Round two compares the points
that round one did not bring into one component, where their differences from the hub
share rare shingles (see ``across``): what all members of a family have in common brings
no two of them together, and no similar pair is lost. The links are joined to components.
All groups are aggregated before the shuffle or split by equi-joins.

Only a sketch of each document is kept; the sets of the documents that are asked for are
computed again from their texts, so no shingles of the others are written or shuffled.

Defined results: words are parted at white space and lower-cased (ASCII); a text of fewer
than five words is one shingle, its whole word sequence; null and empty texts, which have
none, are linked with each other; repeated rows get equal results; a null id is ignored
when the least id is taken (a component of null ids alone has a null component_id); an
empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghaven.llm.common import BitmapFilter, materialize, release_memory, rows_of, ship_package, text_hash
from loghaven.llm.components import components
from loghaven.llm.rolling import mixed
from loghaven.llm.simhash_groups import link_points

SHINGLE = 5
#: The similarity as a fraction.
PART, WHOLE = 4, 5
SEED = 42
BANDS, ROWS = 16, 4
#: Numbers that an Arrow batch should hold.
BATCH = 1 << 18

_NULL_ID = -(1 << 63)
_SKETCH = pa.schema([("k_id", pa.int64()), ("k_text", pa.int64()), ("digest", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SKETCH_DDL = "k_id long, k_text long, digest long, n int, fp long, bands array<long>"
_SETS_DDL = "digest long, shingles array<long>"
#: One odd multiplier and one offset for each minimum hash, from a counter.
_ODD = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSET = mixed(_ODD)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles of a text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set as a signed number; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):  # bounded memory for long texts
        ones += np.unpackbits(shingles[at : at + (1 << 14)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band: of its number and its minimum hashes."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        part = shingles[at : at + (1 << 12)].view(np.uint64)
        moved = part[None, :] * _ODD[:, None] + _OFFSET[:, None]
        np.minimum(least, (moved ^ (moved >> np.uint64(31))).min(1), out=least)
    found = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + row)
    return found.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for k_id, k_text, text in rows_of(batches, "k_id", "k_text", "text"):
        found = shingle_set(text)
        rows.append((k_id, k_text, set_digest(found), len(found), fingerprint(found), bands(found) if len(found) else None))
        if len(rows) >= 5000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SKETCH, strict=True)], schema=_SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: list[np.ndarray] = []
    held = 0

    def batch() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), lists], names=["digest", "shingles"])

    for (text,) in rows_of(batches, "text"):
        sets.append(shingle_set(text))
        held += len(sets[-1]) + 4
        if held >= BATCH:
            yield batch()
            sets, held = [], 0
    if sets:
        yield batch()
    release_memory()


class Texts:
    """The rows of a table with their sketches; gives the sets of asked points."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        ship_package(docs.sparkSession)
        self.rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k_id"), text_hash(text_col).alias("k_text"), F.col(text_col).alias("text"))
        self.sketches = materialize(self.rows.mapInArrow(_sketches, _SKETCH_DDL), "sketches")
        #: One row for each set: the least row that has it, and the least id.
        least_id = F.min(F.when(F.col("k_id") != _NULL_ID, F.col("k_id"))).alias("least_id")
        self.points = materialize(self.sketches.groupBy("digest").agg(F.min(F.struct("k_id", "k_text")).alias("key"), least_id, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "points")

    def sets(self, digests: DataFrame) -> DataFrame:
        """(digest, shingles) of the points asked for, and perhaps of some more."""
        asked = materialize(digests.join(self.points.select("digest", "key"), "digest").select("key.k_id", "key.k_text"), "asked")
        key = F.xxhash64("k_id", "k_text")
        return materialize(BitmapFilter(asked, key).kept(self.rows, key).select("text").mapInArrow(_sets, _SETS_DDL), "sets")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of digests whose sets reach the similarity."""
        ordered = pairs.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = materialize(ordered.distinct(), "pairs")
        sets = self.sets(pairs.select(F.col("u").alias("digest")).unionByName(pairs.select(F.col("v").alias("digest"))).distinct())
        sides = pairs.join(sets.toDF("u", "s"), "u").join(sets.toDF("v", "t"), "v")
        shared = sides.withColumn("shared", F.size(F.array_intersect("s", "t")))
        return materialize(shared.where((PART + WHOLE) * F.col("shared") >= PART * (F.size("s") + F.size("t"))).select("u", "v"), "links")


def simhash_pairs(points: DataFrame) -> DataFrame:
    """Pairs of digests whose fingerprints are equal, or linked by the vantage-point tree."""
    prints = materialize(points.groupBy("fp").agg(F.min("digest").alias("least")), "prints")
    near = link_points(prints.select("fp")).select(F.col("u").alias("fp"), "v")
    far = prints.toDF("v", "far")
    linked = near.join(prints, "fp").join(far, "v").select(F.col("least").alias("u"), F.col("far").alias("v"))
    return points.join(prints, "fp").select(F.col("digest").alias("u"), F.col("least").alias("v")).unionByName(linked)


def buckets(points: DataFrame) -> DataFrame:
    """(token, digest, n, size) of the points of all buckets that several points share."""
    rows = points.where(F.col("n") > 0).select(F.explode("bands").alias("token"), "digest", "n")
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return materialize(rows.join(sizes, "token"), "buckets")


def deltas(texts: Texts, shared: DataFrame) -> DataFrame:
    """(hub, u, n, m, d): each point beside the hub of its bucket, and the shingles that only one of the two has.

    The hub is the point that most others meet, near the middle of a family of copies, so
    the buckets of a family share it and a member stands in few groups.
    """
    score = shared.groupBy("digest").agg(F.sum("size").alias("score"))
    hubs = shared.join(score, "digest").groupBy("token").agg(F.max(F.struct("score", "digest", "n")).alias("hub"))
    groups = shared.join(hubs, "token").select(F.col("hub.digest").alias("hub"), F.col("digest").alias("u"), "n", F.col("hub.n").alias("m"))
    groups = materialize(groups.where(F.col("hub") != F.col("u")).distinct(), "groups")
    sets = texts.sets(groups.select(F.explode(F.array("hub", "u")).alias("digest")).distinct())
    # a set may come more than once, from copies of its text
    theirs = sets.join(groups.select(F.col("hub").alias("digest")).distinct(), "digest", "left_semi")
    s, t = (x.groupBy("digest").agg(F.first("shingles")) for x in (sets, theirs))
    sides = groups.join(s.toDF("u", "s"), "u").join(t.toDF("hub", "t"), "hub")
    return materialize(sides.select("hub", "u", "n", "m", F.concat(F.array_except("s", "t"), F.array_except("t", "s")).alias("d")), "deltas")


def across(delta: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of one group that may be similar and lie in different components.

    Two sets differ in as many shingles as their deltas to the hub, at most a ninth of
    both sizes; a member apart from the hub's component differs from the hub in more. So
    two members, one of them apart, share over half of either delta, corrected for their
    sizes, and meet in the rarest shingles of it: ``short`` of them, of a member apart
    ``long`` if the other one is not apart. What a family has in common is in no delta, so
    members that went different ways do not meet, however large the family is.
    """
    ninth = F.floor((F.col("n") + F.floor(F.col("n") * F.lit(WHOLE) / F.lit(PART))) / F.lit(PART + WHOLE))
    rooted = delta.join(roots.toDF("u", "root"), "u", "left").join(roots.toDF("hub", "middle"), "hub", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "u")).withColumn("apart", F.col("root") != F.coalesce("middle", "hub"))
    several = rooted.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.max("apart").alias("any")).where(F.col("any") & (F.col("members") > 1)).select("hub")
    held = materialize(rooted.join(several, "hub").select("hub", "u", "n", "m", "d", "root", "apart"), "apart")
    tokens = held.select("hub", "u", F.explode("d").alias("x"))
    often = tokens.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > 1)
    # a shingle of one delta alone joins nothing, but keeps its place at the front
    ranked = tokens.join(often, ["hub", "x"]).groupBy("hub", "u").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("ranked"))
    size = F.size("d")
    least = F.floor(((PART + WHOLE) * size + F.col("m") - F.col("n")) / F.lit(2 * (PART + WHOLE))) + 1
    rows = held.join(ranked, ["hub", "u"]).select("hub", "u", "n", "root", "apart", size.alias("size"), (size - least + 1).alias("short"), (ninth + 1).alias("long"), (size - F.size("ranked")).alias("alone"), F.posexplode("ranked").alias("at", "r"))
    placed = rows.select("hub", F.col("r.x").alias("x"), "u", "n", "root", "apart", "size", "short", "long", (F.col("at") + F.col("alone") + 1).alias("at"))
    placed = materialize(placed.where(F.col("at") <= F.when(F.col("apart"), F.greatest("short", "long")).otherwise(F.col("short"))), "placed")
    left = placed.where("apart")
    right = placed.where(F.col("at") <= F.col("short")).toDF("hub", "x", "v", "m", "other", "also", "vsize", "vshort", "vlong", "vat")
    once = F.when(F.col("also"), (F.col("at") <= F.col("short")) & (F.col("u") < F.col("v"))).otherwise(F.col("at") <= F.col("long"))
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    sized = WHOLE * F.least(n, m) >= PART * F.greatest(n, m)
    # the first shingle that both deltas hold leaves room for all that they must share
    room = 2 * (1 + F.least(F.col("size") - F.col("at"), F.col("vsize") - F.col("vat"))) >= F.col("size") + F.col("vsize") - F.floor((n + m) / F.lit(PART + WHOLE))
    rows = left.alias("l").join(right.alias("r"), (F.col("l.hub") == F.col("r.hub")) & (F.col("l.x") == F.col("r.x")) & (F.col("root") != F.col("other")) & once & sized & room)
    return rows.select("u", "v")


def links(texts: Texts) -> DataFrame:
    """Pairs (u, v) of digests that connect all sets of the similarity."""
    delta = deltas(texts, buckets(texts.points))
    to_hub = delta.where((PART + WHOLE) * F.size("d") <= F.col("n") + F.col("m")).select("u", F.col("hub").alias("v"))
    found = to_hub.unionByName(texts.similar(simhash_pairs(texts.points)))
    roots = materialize(components(found).toDF("digest", "root"), "roots")
    return found.unionByName(texts.similar(across(delta, roots)))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, k_text and the least id of its component."""
    texts = Texts(docs, id_col, text_col)
    rows = texts.sketches.select(F.when(F.col("k_id") != _NULL_ID, F.col("k_id")).alias("doc_id"), "k_text", "digest")
    roots = components(links(texts)).toDF("digest", "root")
    rooted = materialize(texts.points.select("digest", "least_id").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("digest", "component_id"), "digest").select("doc_id", "k_text", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of each group with the least id; all columns stay.

    Rows without an id stay; rows that repeat the least id of a group all stay.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col)
    gone = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("k_id"), "k_text").distinct(), "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("k_id"), text_hash(text_col).alias("k_text"))
    key = F.xxhash64("k_id", "k_text")
    marked = BitmapFilter(gone, key).marked(whole, key, "maybe")
    asked = marked.where("maybe").join(gone, ["k_id", "k_text"], "left_anti")
    return marked.where(~F.col("maybe")).select("row.*").unionByName(asked.select("row.*"))
