"""Substring dedup: hashes of lines, and of word windows inside lines, grouped globally.

Units are normalised (lower case, white space joined) and hashed; of each digest the
earliest ranked occurrence (least document id, then least offset) stays and the rest go,
with their offsets in the original text kept. Units are

* lines of at least ``min_words`` words, the method's own unit;
* every window of ``window`` words, since a passage can be copied into the middle of a
  line, where no line digest finds it.

A digest has 128 bits, so that no two texts of any corpus are taken for one. Lines of
fewer than ``min_words`` words (names, greetings, headings) repeat by chance and stay.

Windows are hashed in two rounds, so that not every window of the corpus is shuffled.
Round one winnows: of the ``gram``-word hashes in each window the least is an anchor,
about one per 20 words; equal windows have equal anchors. Round two hashes only windows
around anchors that occur more than once, leaving out those inside lines that go
anyway. A window that occurs twice is always found. All digests are grouped by partial
aggregation (count and least occurrence), then joined back, which adaptive execution
splits for a passage that a third of the corpus holds.

Defined results: a null text stays null, an empty text empty; repeated rows (same id and
text) are one occurrence and get equal results; a null id ranks first; within one
document the first occurrence of a repeated window stays whole; an empty table gives an
empty result; extra columns pass through whatever their names. Texts of any length are
hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import BitmapFilter, materialize, rows_of, ship_package, table, trim
from loghaven.llm.rolling import Runs, mixed

MIN_WORDS = 5
WINDOW = 50
GRAM = 10
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_REMOVED = "array<struct<start: long, end: long, first_doc_id: long>>"


class Words:
    """Byte offsets of the words of a text, and hashes of any run of them."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[::2], turns[1::2]
        self.n = len(self.starts)
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w) for w in self.raw.lower().split()), np.uint64, self.n)
        self._runs = Runs(hashes), Runs(mixed(hashes + np.uint64(2)))
        self.breaks = np.flatnonzero(data == 10)

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words first..last (not included), the same wherever they stand."""
        return self._runs[0](first, last)

    def digests(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with 64 bits more, by which text is deleted."""
        return self._runs[0](first, last), self._runs[1](first, last)

    def lines(self, min_words: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """(digests, start, end) of the lines that have enough words; offsets leave out outer white space."""
        edges = np.searchsorted(self.starts, self.breaks)
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges, [self.n]))
        keep = last - first >= min_words
        first, last = first[keep], last[keep]
        return self.digests(first, last), self.starts[first], self.ends[last - 1]

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word number) of the winnowed grams."""
        if self.n < window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        first = np.arange(self.n - gram + 1)
        grams = self.runs(first, first + gram)
        around, chosen = window - gram + 1, []
        for at in range(0, len(grams) - around + 1, 1 << 16):  # bounded memory for long texts
            part = grams[at : at + (1 << 16) + around - 1]
            view = np.lib.stride_tricks.sliding_window_view(part, around)
            chosen.append(np.unique(view.argmin(1) + np.arange(len(view))) + at)
        at = np.unique(np.concatenate(chosen))
        return grams[at], at


def _places(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte offsets of a unit in one number that keeps their order (texts are shorter than 2**31)."""
    return start.astype(np.int64) << 32 | end.astype(np.int64)


class _Rows:
    """Columns of hashes, keys and places, given out in batches."""

    NAMES = ("hash", "more", "k_id", "k_text", "place")
    DDL = "hash long, more long, k_id long, k_text long, place long"

    def __init__(self):
        self.parts, self.n = [], 0

    def put(self, k_id: int, k_text: int, digests: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> None:
        if m := len(places):
            self.parts.append((*(x.view(np.int64) for x in digests), np.full(m, k_id, np.int64), np.full(m, k_text, np.int64), places))
            self.n += m

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.n >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.parts, strict=True)], names=self.NAMES)
            self.parts, self.n = [], 0


def _units(min_words: int, window: int, gram: int):
    """Lines, and anchors with the number -1 - word as place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for k_id, k_text, text in rows_of(batches, "k_id", "k_text", "text"):
            words = Words(text)
            hashes, starts, ends = words.lines(min_words)
            rows.put(k_id, k_text, hashes, _places(starts, ends))
            grams, at = words.anchors(window, gram)
            rows.put(k_id, k_text, (mixed(grams + np.uint64(1)), np.zeros(len(grams), np.uint64)), -1 - at.astype(np.int64))
            yield from rows.batch(50_000)
        yield from rows.batch()

    return run


def _windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for k_id, k_text, text, anchors, gone in rows_of(batches, "k_id", "k_text", "text", "anchors", "gone"):
            words = Words(text)
            starts = np.unique((np.asarray(anchors, np.int64)[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + window <= words.n)]
            left = np.ones(words.n + 1, np.int64)  # words that stay if the lines go
            for place in gone or ():
                left[np.searchsorted(words.starts, place >> 32) : np.searchsorted(words.ends, place & 0xFFFFFFFF, "right")] = 0
            sums = np.concatenate(([0], np.cumsum(left)))
            starts = starts[sums[starts + window] > sums[starts]]
            rows.put(k_id, k_text, words.digests(starts, starts + window), _places(words.starts[starts], words.ends[starts + window - 1]))
            yield from rows.batch(50_000)
        yield from rows.batch()

    return run


def cut_spans(text: str, spans: list[tuple[int, int, int | None]]) -> tuple[str, list[dict]]:
    """The text without the byte spans (start, end, first id) and what went, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    merged: list[list] = []
    for start, end, first in sorted(spans, key=lambda s: (s[0], s[1], s[2] is not None, s[2] or 0)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, first])
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    kept, at = [], 0
    for start, end, _ in merged:
        kept.append(raw[at:start])
        at = end
        whole = (start == 0 or raw[start - 1 : start] == b"\n") and raw[end : end + 1] in (b"\n", b"")
        if whole and raw[end : end + 1] == b"\n" or raw[end : end + 1] == b" " and (start == 0 or raw[start - 1 : start] in (b" ", b"\n")):
            at = end + 1  # the break of a line that went, or a second space
        elif whole and kept[-1].endswith(b"\n"):
            kept[-1] = kept[-1][:-1]
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass"), [{"start": int(points[s]), "end": int(points[e]), "first_doc_id": f} for s, e, f in merged]


def _cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, spans, strict=True):
        if not len(found):
            out.append({"text": text.as_py(), "removed": []})
            continue
        new, removed = cut_spans(text.as_py(), [(s["start"], s["end"], s["first_id"]) for s in found.as_py()])
        out.append({"text": new, "removed": removed})
    trim()
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64())])))]))


_NULL_ID = -(1 << 63)


def _others(found: DataFrame) -> DataFrame:
    """Occurrences of digests that occur more than once, with the earliest one.

    The repeated digests are written first, so that both sides of the join are plain
    shuffles, which adaptive execution can split where one digest has very many rows.
    """
    earliest = F.min(F.struct("k_id", "k_text", "place")).alias("first")
    repeated = found.groupBy("hash", "more").agg(earliest, F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return found.join(materialize(repeated.select("hash", "more", "first"), "repeated"), ["hash", "more"]).drop("hash", "more")


def _start(place: str) -> Column:
    return F.shiftright(place, 32)


def _end(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(0xFFFFFFFF))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All rows as (row struct, text cleaned, removed spans with the id of the occurrence that stays)."""
    ship_package(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_text"), F.col(text_col).alias("text"))
    keyed = whole.select("k_id", "k_text", "text").where(F.length("text") > 0)

    units = materialize(keyed.mapInArrow(_units(min_words, window, gram), _Rows.DDL), "units")
    again = materialize(_others(units), "again")
    own = (F.col("first.k_id") == F.col("k_id")) & (F.col("first.k_text") == F.col("k_text"))
    later = ~own | (F.col("first.place") != F.col("place"))
    lines = again.where((F.col("place") >= 0) & later)

    anchors = again.where(F.col("place") < 0).groupBy("k_id", "k_text").agg(F.collect_set(-1 - F.col("place")).alias("anchors"))
    gone = lines.groupBy("k_id", "k_text").agg(F.collect_set("place").alias("gone"))
    asked = materialize(anchors.join(gone, ["k_id", "k_text"], "left"), "asked")
    key = F.xxhash64("k_id", "k_text")
    near = BitmapFilter(asked, key).kept(keyed, key).join(asked, ["k_id", "k_text"])
    windows = materialize(near.mapInArrow(_windows(window, gram), _Rows.DDL), "windows")
    passages = _others(windows).where(later)
    # the first occurrence of a window that overlaps itself in one document stays whole
    cut_from = F.when(own, F.greatest(_start("place"), _end("first.place"))).otherwise(_start("place"))
    lines, passages = lines.select("*", _start("place").alias("start"), _end("place").alias("end")), passages.select("*", cut_from.alias("start"), _end("place").alias("end"))
    passages = passages.where(F.col("start") < F.col("end"))

    first_id = F.when(F.col("first.k_id") != _NULL_ID, F.col("first.k_id"))
    spans = lines.unionByName(passages).groupBy("k_id", "k_text").agg(F.collect_set(F.struct("start", "end", first_id.alias("first_id"))).alias("spans"))
    spans = materialize(spans, "spans")
    marked = BitmapFilter(spans, key).marked(whole, key, "maybe")
    none = F.array().cast(_REMOVED)
    clean = marked.where(~F.col("maybe")).select("row", "text", none.alias("removed"))
    asked_for = marked.where("maybe").join(spans, ["k_id", "k_text"], "left")
    cut = asked_for.select("row", F.arrow_udf(_cleaned, f"text string, removed {_REMOVED}")("text", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))).alias("c")).select("row", "c.text", "c.removed")
    return clean.unionByName(cut)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: text without repeats, and what was removed from where."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", F.size("removed").cast("long").alias("n_removed"), "removed")
