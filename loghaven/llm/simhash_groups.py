"""SimHash near-dedup: fingerprints partitioned by a vantage-point tree.

Fingerprints of equal value are one point, so copies never form pairs. The points are
split by a vantage-point tree: a node has a vantage point and a radius, points within
the radius go in, the others out. The upper levels are fitted on a bounded sample
(``SAMPLE`` points, the lowest by hash) and deal the points into shards; by the triangle
inequality two points within ``DISTANCE`` bits can be parted by a node only if both lie
within ``DISTANCE`` of its sphere, so besides its home shard a point visits exactly the
shards its ball reaches across such boundaries, and every close pair meets in the home
shard of one of its points. Points just inside a sphere do the visiting, which halves
the copies. In a shard the same tree goes on, in memory, down to leaves that are
compared all with all. A shard that still holds many more points than a task should
take gets a tree of its own, fitted on a bounded sample of that shard, so the number of
shards follows the corpus while the trees together stay below a fixed size.

A shard gives out one edge per point to the least point it is linked with there, never
the pairs of a group. The edges of all shards are joined to components (see
``components``), and each document takes the least document id of its component.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
a text of fewer than three words has the fingerprint of its whole word sequence;
repeated rows get equal results; a null id is ignored when the least id is taken (a
component of null ids alone has a null component_id); an empty table gives an empty
result; extra columns do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import BitmapFilter, materialize, release_memory, ship_package, table
from loghaven.llm.components import components

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Points from which the upper levels of the tree are fitted.
SAMPLE = 8192
#: Points that a shard should hold.
SHARD_POINTS = 4000
#: Sampled points below which the upper tree is not split further.
LEAF_SAMPLE = 16
#: Points that are compared all with all.
LEAF = 192

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - shingle].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 14):  # bounded memory for long texts
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


#: Bytes of text that are hashed together; a longer text goes alone, by ``simhash``.
TEXT_BYTES = 1 << 20
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: For a byte, eight counters of one byte each: its bits from the highest on.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)).view("<u8")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * _P2, 31) * _P1


def _xxh64_of_size(data: np.ndarray, eights: np.ndarray, fours: np.ndarray, at: np.ndarray, size: int, seed: np.ndarray) -> np.ndarray:
    """XXH64 of slices of one size."""
    done = 0
    if size >= 32:
        acc = [np.broadcast_to(x, at.shape) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        for done in range(0, size - 31, 32):
            acc = [_round(x, eights[at + (done + 8 * lane)]) for lane, x in enumerate(acc)]
        done += 32
        h = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
        for x in acc:
            h = (h ^ _turned(x * _P2, 31) * _P1) * _P1 + _P4
    else:
        h = np.broadcast_to(seed + _P5, at.shape)
    h = h + np.uint64(size)
    while size - done >= 8:
        h = _turned(h ^ _turned(eights[at + done] * _P2, 31) * _P1, 27) * _P1 + _P4
        done += 8
    if size - done >= 4:
        h = _turned(h ^ fours[at + done].astype(np.uint64) * _P1, 23) * _P2 + _P3
        done += 4
    while done < size:
        h = _turned(h ^ data[at + done].astype(np.uint64) * _P5, 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of ``data``, which has eight bytes more than the slices need."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    fours = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    order = np.argsort(sizes.astype(np.uint16) if sizes.max() < 1 << 16 else sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    found = np.empty(len(sizes), np.uint64)
    raw, word = memoryview(data), np.array([seed], np.uint64)
    for a, b in zip(cuts, cuts[1:]):
        size = int(sizes[a])
        if b - a < 64:
            found[a:b] = [xxhash.xxh64_intdigest(raw[x : x + size], seed) for x in starts[a:b].tolist()]
        else:
            found[a:b] = _xxh64_of_size(data, eights, fours, starts[a:b], size, word)
    out = np.empty_like(found)
    out[order] = found
    return out


def _ones(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bit, the highest first, is set in the runs of hashes that begin at ``first``."""
    ends = np.append(first[1:], len(hashes))
    steps = (ends - first + 254) // 255  # a counter of one byte holds 255
    run = np.repeat(np.arange(len(first)), steps)
    at = first[run] + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(steps) - steps, steps))
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    out = np.empty((len(first), 64), np.int64)
    for k in range(8):
        counts = np.add.reduceat(_LANES[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(counts, np.cumsum(steps) - steps, axis=0, dtype=np.int64)
    return out


def simhashes(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The values of ``simhash`` for the texts data[bounds[i]:bounds[i + 1]], all at once."""
    found = np.zeros(len(bounds) - 1, np.uint64)
    data = data[bounds[0] : bounds[-1]]
    bounds = (bounds - bounds[0]).astype(np.int64)
    inside = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    past = np.zeros(len(data) + 1, bool)  # whether the byte before is one of a word
    past[1:] = inside
    begins = np.flatnonzero(inside & (edge[:-1] | ~past[:-1]))
    if not len(begins):
        return found
    ends = np.flatnonzero(past[1:] & (edge[1:] | ~np.append(inside[1:], False))) + 1
    # lower case, and of the white space between words one space
    plain = np.where(inside, data + (data - np.uint8(65) < 26).view(np.uint8) * np.uint8(32), np.uint8(32))
    plain = np.concatenate((plain[inside | past[:-1]], np.zeros(8, np.uint8)))
    sizes = ends - begins
    gaps = np.minimum(begins[1:] - ends[:-1], 1)
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + gaps)))
    stops = starts + sizes
    words = np.searchsorted(begins, bounds)
    counts = np.diff(words)
    texts = np.flatnonzero(counts)
    counts, words = counts[texts], words[texts]
    shingles = np.maximum(counts - (shingle - 1), 1)
    first = np.cumsum(shingles) - shingles
    lead = np.arange(int(shingles.sum())) + np.repeat(words - first, shingles)
    last = lead + np.repeat(np.minimum(counts, shingle) - 1, shingles)
    hashes = xxh64(plain, starts[lead], stops[last] - starts[lead], seed)
    bits = 2 * _ones(hashes, first) > shingles[:, None]
    found[texts] = np.packbits(bits, axis=1).view(">u8").ravel()
    return found


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        fps = np.zeros(len(texts), np.uint64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TEXT_BYTES, "right")) - 1)
            if bounds[to] - bounds[at] > TEXT_BYTES:
                fps[at] = simhash(texts[at].as_py())
            else:
                fps[at:to] = simhashes(data, bounds[at : to + 1])
            at = to
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=_PRINTS)
    release_memory()


def _bits(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def _split(points: np.ndarray, distance: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that parts the points well, crossing few boundaries."""
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        counts = np.bincount(_bits(points, vantage), minlength=65)
        below = np.cumsum(counts)[:64]
        # points just inside each radius, which a visit would cross
        crossing = below - np.concatenate((np.zeros(distance, np.int64), below))[:64]
        smaller = np.minimum(below, len(points) - below)
        cost = np.where(smaller * 5 >= len(points), crossing / np.maximum(smaller, 1), np.inf)
        radius = int(cost.argmin())
        if cost[radius] < np.inf and (best is None or cost[radius] < best[0]):
            best = (cost[radius], vantage, radius)
    return best and (best[1], best[2])


class UpperTree:
    """The upper levels of the tree: nodes are (vantage, radius, inner, outer), leaves numbers."""

    def __init__(self, sample: np.ndarray, leaves: int, distance: int = DISTANCE, least: int = LEAF_SAMPLE):
        self.distance, self.shards = distance, 0
        self.least = max(least, len(sample) // max(1, leaves))
        self.root = self._grow(sample)

    def _grow(self, sample: np.ndarray) -> tuple | int:
        cut = _split(sample, self.distance) if len(sample) > self.least else None
        if cut is None:
            self.shards += 1
            return self.shards - 1
        inner = _bits(sample, cut[0]) <= cut[1]
        return cut[0], cut[1], self._grow(sample[inner]), self._grow(sample[~inner])

    def deal(self, points: np.ndarray, home: bool = True) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(shard, home?, indexes): every point's home shard and the shards it visits."""
        todo = [(self.root, home, np.arange(len(points)))]
        while todo:
            node, home, index = todo.pop()
            if not len(index):
                continue
            if not isinstance(node, tuple):
                yield node, home, index
                continue
            vantage, radius, inner, outer = node
            bits = _bits(points[index], vantage)
            inside = bits <= radius
            todo.append((inner, home, index[inside]))
            todo.append((outer, home, index[~inside]))
            # a home point crosses outward only; a visitor must meet home points on both sides
            todo.append((outer, False, index[inside & (bits > radius - self.distance)]))
            if not home:
                todo.append((inner, False, index[~inside & (bits <= radius + self.distance)]))


class Links:
    """Union-find over the points of one shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        ends = np.stack([self.parent[left], self.parent[right]])
        ends = np.unique(ends[:, ends[0] != ends[1]], axis=1)
        for a, b in ends.T.tolist():
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def search(points: np.ndarray, left: np.ndarray, right: np.ndarray | None, distance: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Report all index pairs within ``distance``: among ``left``, or between ``left`` and ``right``."""
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(left, right)]
    while todo:
        a, b = todo.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        other = a if b is None else b
        cut = _split(points[a if len(a) >= len(other) else other], distance) if max(len(a), len(other)) > LEAF else None
        if cut is None:
            for at in range(0, len(a), 512):
                part = a[at : at + 512]
                i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[other][None, :]) <= distance)
                i, j = part[i], other[j]
                keep = i < j if b is None else i != j
                found(i[keep], j[keep])
            continue
        vantage, radius = cut
        bits = _bits(points[a], vantage)
        inside = bits <= radius
        if b is None:
            todo += [(a[inside], None), (a[~inside], None)]
            todo.append((a[inside & (bits > radius - distance)], a[~inside & (bits <= radius + distance)]))
        else:
            theirs = _bits(points[b], vantage)
            within = theirs <= radius
            todo += [(a[inside], b[within]), (a[~inside], b[~within])]
            todo.append((a[inside & (bits > radius - distance)], b[~within & (theirs <= radius + distance)]))
            todo.append((a[~inside & (bits <= radius + distance)], b[within & (theirs > radius - distance)]))


def _dealt(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """One frame for a batch: a frame for each shard would cost more than the tree."""
    return pd.DataFrame(dict(zip(("shard", "home", "fp"), (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)))


def _deal(tree: UpperTree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            if len(fps):
                yield _dealt([(np.full(len(i), shard, np.int64), np.full(len(i), home), fps[i]) for shard, home, i in tree.deal(fps.view(np.uint64))])

    return run


def _deal_again(trees: dict[int, UpperTree], step: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for (shard, home), rows in batch.groupby(["shard", "home"], sort=False):
                fps = rows["fp"].to_numpy(np.int64)
                dealt = trees[shard].deal(fps.view(np.uint64), bool(home)) if shard in trees else [(0, bool(home), np.arange(len(fps)))]
                parts += [(np.full(len(i), shard * step + leaf, np.int64), np.full(len(i), at_home), fps[i]) for leaf, at_home, i in dealt]
            if parts:
                yield _dealt(parts)

    return run


def _fit_shard(distance: int, shard_points: int, least: int):
    def run(key: tuple, drawn: pd.DataFrame) -> pd.DataFrame:
        sample = np.sort(drawn["fp"].to_numpy(np.int64)).view(np.uint64)
        np.random.default_rng(SEED).shuffle(sample)
        tree = UpperTree(sample, int(drawn["points"].iloc[0]) // shard_points, distance, least)
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree)]})

    return run


def _search_shard(distance: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        fps = shard["fp"].to_numpy(np.int64)
        points, home = fps.view(np.uint64), np.flatnonzero(shard["home"].to_numpy())
        visitors = np.flatnonzero(~shard["home"].to_numpy())
        links = Links(len(points))
        search(points, home, None, distance, links.join)
        search(points, home, visitors, distance, links.join)
        root = np.array([links.find(i) for i in range(len(points))], np.int64) if len(points) else np.empty(0, np.int64)
        linked = root != np.arange(len(points))
        return pd.DataFrame({"u": fps[linked], "v": fps[root[linked]]})

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row, written to the shared folder."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_prints, "doc_id long, fp long"), "simhash")


def link_points(points: DataFrame, distance: int = DISTANCE, *, sample: int = SAMPLE, shard_points: int = SHARD_POINTS, least: int = LEAF_SAMPLE) -> DataFrame:
    """Edges (u, v) that connect all points (column fp, distinct) within ``distance`` bits."""
    drawn = np.sort(np.array([r[0] for r in points.orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64)).view(np.uint64)
    np.random.default_rng(SEED).shuffle(drawn)
    tree = UpperTree(drawn, max(1, points.count() // shard_points), distance, least)
    dealt = points.mapInPandas(_deal(tree), "shard long, home boolean, fp long")
    if tree.shards * least * 2 > sample:  # as many shards as the sample allows: some may hold too many points
        dealt = materialize(dealt, "dealt")
        sizes = dealt.groupBy("shard").count().where(F.col("count") > 4 * shard_points)
        # at most one tree for each of the first tree's shards, each from about ``sample`` points
        chosen = dealt.join(F.broadcast(sizes.select("shard", F.col("count").alias("points"))), "shard")
        chosen = chosen.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 40)) < F.lit(float((1 << 40) * sample)) / F.col("points"))
        fitted = chosen.groupBy("shard").applyInPandas(_fit_shard(distance, shard_points, least), "shard long, tree binary").collect()
        trees = {r["shard"]: pickle.loads(r["tree"]) for r in fitted}
        step = max([1, *(t.shards for t in trees.values())])
        dealt = dealt.mapInPandas(_deal_again(trees, step), "shard long, home boolean, fp long")
    return dealt.groupBy("shard").applyInPandas(_search_shard(distance), "u long, v long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and the least id of its component."""
    prints = fingerprints(docs, id_col, text_col)
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "points")
    roots = components(link_points(points.select("fp"), distance))
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of each group with the least id; all columns stay.

    Rows without an id stay; rows that repeat the least id of a group all stay.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col, distance=distance)
    gone = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("k_id")).distinct(), "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("k_id"))
    marked = BitmapFilter(gone, F.xxhash64("k_id")).marked(whole, F.xxhash64("k_id"), "maybe")
    asked = marked.where("maybe").join(gone, "k_id", "left_anti")
    return marked.where(~F.col("maybe")).select("row.*").unionByName(asked.select("row.*"))


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))
