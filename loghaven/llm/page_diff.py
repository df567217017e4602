"""HTML extraction: nearest-URL page differencing over structured blocks.

Pages are put in order by (host, path), so the pages nearest to one by path on its host
are its neighbours in the order; the nearer one (longer common path) is its pair. Both
are read as structured blocks, the blocks are aligned by longest common subsequence, and
shared blocks are deleted. That is done for every page that has another one on its host.

A block of text is known by its text; a menu, an advert or a footer, whose words change
from page to page, by the marks of its element, so differencing finds and deletes it where
the pair has the same element. Differencing alone cannot give the article: it deletes
lines that two articles share (copied pages, common first lines) and keeps an advert that
the pair has not. So a check by mark-up follows (see ``html_blocks.deleted_pieces``):
lines of a marked article region come back, lines outside it and boilerplate that the pair
lacks go. A page alone on its host, or with no line of text beside boilerplate, has no
pair; there the check is all.

Only digests of blocks are sorted and compared; texts stay where they are. Pages of equal
lines on a host are one entry, under the least of their paths, so that copies are compared
with a page that differs; its variants (other menus around the same lines) each get their
own result. Entries are dealt by ranges of (host, path, lines): a host that holds a third
of all pages spreads over many tasks, and a task streams through its rows with three
entries in hand. The rows at the edges of tasks, two on each side, are paired in a second
small step. The numbers of deleted blocks come back to the pages by joins, where a page is
a compressed text.

Defined results: a null html gives an empty text and 0 characters; a null URL has an
empty host and path; repeated rows get equal texts; pages of equal lines tell nothing
about each other and lose the same ones; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import batch_of, materialize, rows_of, ship_package, table
from loghaven.llm.html_blocks import BOILERPLATE, blocks, deleted_pieces, pieces
from loghaven.llm.url_rules import host_of, path_of

#: Rows of digests that a task should sweep.
SWEEP_ROWS = 200_000

_LINES = pa.schema([("k_id", pa.int64()), ("k_page", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("keys", pa.list_(pa.int64()))])
_LINES_DDL = "k_id long, k_page long, host string, path string, keys array<long>"
_NAMES = ["host", "path", "same", "variants"]
_VARIANTS = pa.list_(pa.struct([pa.field("variant", pa.int64()), pa.field("keys", pa.list_(pa.int64()))]))
_ENTRY = [pa.field("host", pa.string()), pa.field("path", pa.string()), pa.field("same", pa.int64()), pa.field("variants", _VARIANTS)]
_OUT = pa.schema([pa.field("part", pa.int32()), pa.field("place", pa.int32()), *_ENTRY, pa.field("variant", pa.int64()), pa.field("gone", pa.list_(pa.int32()))])
_OUT_DDL = "part int, place int, host string, path string, same long, variants array<struct<variant: long, keys: array<long>>>, variant long, gone array<int>"
_NULL_ID = -(1 << 63)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for k_id, k_page, host, path, html in rows_of(batches, "k_id", "k_page", "host", "path", "html"):
        out.append((k_id, k_page, host, path, [p.key for p in pieces(list(blocks(html or "")))]))
        if len(out) >= 2000:
            yield batch_of(_LINES, out)
            out = []
    if out:
        yield batch_of(_LINES, out)


class _Page:
    """Pages of one host that have the same lines, under the least of their paths."""

    def __init__(self, *row):
        self.row = row
        self.host, self.path, self.same, self.variants = row


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _gone(page: _Page, before: _Page | None, after: _Page | None) -> Iterator[tuple]:
    """Numbers of the blocks that each variant of a page loses to the nearer of its neighbours."""
    near = [p for p in (before, after) if p is not None and p.host == page.host]
    if near:
        nearest = max(near, key=lambda p: _common(p.path, page.path)).variants[0]["keys"]
        for v in page.variants:
            yield None, None, page.host, None, page.same, None, v["variant"], sorted(deleted_pieces(v["keys"], nearest))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deleted blocks of all entries that have both neighbours here; the entries at the ends as they are.

    ``place`` is 0 and 1 for the first two entries of the task, -2 and -1 for the last two;
    a task of two has 0 and -1, a task of one has 0.
    """
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    held: list[_Page] = []
    n = 0
    for row in rows_of(batches, *_NAMES):
        page = _Page(*row)
        if n == 0:
            out.append((part, 0, *page.row, None, None))
        elif n == 2:
            out.append((part, 1, *held[-1].row, None, None))
        held = [*held[-2:], page]
        if n >= 2:
            out += _gone(held[1], held[0], held[2])
        n += 1
        if len(out) >= 2000:
            yield batch_of(_OUT, out)
            out = []
    if n > 2:
        out.append((part, -2, *held[-2].row, None, None))
    if n > 1:
        out.append((part, -1, *held[-1].row, None, None))
    if out:
        yield batch_of(_OUT, out)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deleted blocks of entries with their neighbours: seat 0 before, 1 the entry, 2 after."""
    for (pages,) in rows_of(batches, "pages"):
        held = {p["seat"]: _Page(*(p[c] for c in _NAMES)) for p in pages}
        if gone := list(_gone(held[1], held.get(0), held.get(2))):
            yield batch_of(_OUT, gone)


def deleted_lines(rows: DataFrame) -> DataFrame:
    """(k_id, k_page, gone): numbers of the structured blocks that pages lose; only pages that have a pair."""
    spark = rows.sparkSession
    read = materialize(rows.mapInArrow(_read, _LINES_DDL), "lines")
    # lines tell pages apart, menus and the like do not
    texts = F.transform(F.filter("keys", lambda k: k.bitwiseAND(F.lit(3)) != BOILERPLATE), lambda k: F.shiftright(k, 2))
    lines = read.where(F.exists("keys", lambda k: k.bitwiseAND(F.lit(3)) != BOILERPLATE)).withColumns({"same": F.xxhash64(texts), "variant": F.xxhash64("keys")})
    variants = F.transform(F.sort_array(F.collect_set("keys")), lambda k: F.struct(F.xxhash64(k).alias("variant"), k.alias("keys")))
    once = lines.groupBy("host", "same").agg(F.min("path").alias("path"), variants.alias("variants"))
    entries = materialize(once.select(*_NAMES), "entries")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, entries.count() // SWEEP_ROWS)
    order = ["host", "path", "same"]
    ordered = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*_NAMES)
    done = materialize(ordered.mapInArrow(_sweep, _OUT_DDL), "gone")

    # the ends of all tasks in order: a few numbers of each task come to the driver
    ends = done.where(F.col("place").isNotNull())
    row_of = [0, 1, -2, -1].index
    places = sorted(((r["part"], r["place"]) for r in ends.select("part", "place").collect()), key=lambda e: (e[0], row_of(e[1])))
    seats = []
    for i, (_, place) in enumerate(places):
        if place in (0, -1):
            seats += [(*places[j], i, j - i + 1) for j in (i - 1, i, i + 1) if 0 <= j < len(places)]
    named = spark.createDataFrame(seats, "part int, place int, boundary int, seat int")
    around = ends.join(F.broadcast(named), ["part", "place"])
    grouped = around.groupBy("boundary").agg(F.collect_list(F.struct("seat", *_NAMES)).alias("pages"))
    edges = grouped.select("pages").mapInArrow(_edges, _OUT_DDL)
    both = done.where(F.col("gone").isNotNull()).unionByName(edges)
    deleted = materialize(both.select("host", "same", "variant", "gone"), "entries-deleted")
    paired = lines.select("k_id", "k_page", "host", "same", "variant").join(deleted, ["host", "same", "variant"])
    # repeated rows share a key: the same blocks go in each
    return materialize(paired.groupBy("k_id", "k_page").agg(F.max("gone").alias("gone")), "deleted")


def _pack(pages: pa.Array) -> pa.Array:
    return pa.array([len(data := x.as_py().encode("utf-8", "surrogatepass")).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) for x in pages], pa.binary())


def _article(packed: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for data, numbers in zip(packed, gone, strict=True):
        held = data.as_py()
        html = pa.decompress(held[8:], int.from_bytes(held[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass")
        page = pieces(list(blocks(html)))
        drop = set(numbers.as_py()) if numbers.is_valid else deleted_pieces([p.key for p in page], None)
        out.append("\n".join(x for i, p in enumerate(page) if i not in drop for x in p.texts))
    return pa.array(out, pa.string())


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text of the article, and its number of code points."""
    ship_package(pages.sparkSession)
    url = F.coalesce(F.col(url_col), F.lit(""))
    html = F.coalesce(F.col(html_col), F.lit(""))
    page_id = F.col(id_col).cast("long")
    rows = pages.select(page_id.alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(page_id, F.lit(_NULL_ID)).alias("k_id"), F.xxhash64(url, html).alias("k_page"))
    deleted = deleted_lines(rows.select("k_id", "k_page", "host", "path", "html"))
    packed = rows.select("page_id", "url", "k_id", "k_page", F.arrow_udf(_pack, "binary")("html").alias("packed"))
    texts = packed.join(deleted, ["k_id", "k_page"], "left").select("page_id", "url", F.arrow_udf(_article, "string")("packed", "gone").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_page_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
