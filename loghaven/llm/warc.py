"""WARC archives: written by Spark's text writer, read back with segment reassembly.

Writing: each row becomes one HTTP response record with chunked transfer framing. A block
longer than ``segment_chars`` is cut: the first record keeps the type, the rest are
continuation records with the first one's id as origin, their segment number, and on the
last the total length. Of rows with equal payloads of at least ``least_bytes`` bytes the
one with the least id is written whole, the others as revisit records that refer to it.
Records end with CR LF CR LF, which is the text writer's line separator here, so the
archives are plain WARC/1.1 files (gzip) in any store that Spark can write.

Reading: archives come as binary files of a bounded number of bounded records and are
parsed as a stream. A record in one piece is decoded at once; continuation records are
grouped by origin id, ordered by segment number, checked for gaps and against the total
length, joined, and only then is the chunked framing decoded. Payload digests are checked.
A group is the segments of one payload, so no group grows with the corpus. A revisit gets
the size and digest of the record it refers to by an equi-join of small rows.

Finding equal payloads groups digests with partial aggregation; a bitmap of bounded size
keeps rows with a payload of their own out of the join.

Defined results: a null html is an empty payload; rows that repeat the least id of their
group are responses too; a row without id in a group with an id is a revisit, groups
without any id are responses; an empty table writes no record and reads as no row; extra
columns do not matter. A damaged archive raises an error that names the record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghaven.llm.common import BitmapFilter, batch_of, materialize, rows_of, scratch_path, ship_package, table

LEAST_BYTES = 100
SEGMENT_CHARS = 1 << 16
CHUNK_CHARS = 1 << 13
RECORDS_PER_FILE = 1_000
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

_PARSED = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_id", pa.string()), ("claimed", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("content", pa.binary()),
    ]
)
_PARSED_DDL = "record_id string, page_id long, record_type string, refers_id string, claimed string, segment int, total long, payload_bytes long, payload_digest string, content binary"


# -- writing ---------------------------------------------------------------


def chunked(payload: str, size: int = CHUNK_CHARS) -> str:
    """HTTP/1.1 chunked framing of a text in UTF-8."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts.append(f"{len(part.encode()):x}\r\n{part}\r\n")
    return "".join(parts) + "0\r\n\r\n"


def _record(fields: list[tuple[str, object]], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def records_of(record_id: str, page_id: int | None, url: str | None, html: str | None, digest: str, refers_id: str | None, segment_chars: int) -> Iterator[str]:
    """The WARC records of one row, without the closing line breaks."""
    uri = "".join(c for c in url or "" if c > " ") or None
    fields = [("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id)]
    kind = [("Content-Type", "application/http;msgtype=response")]
    if refers_id is not None:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To", refers_id), ("WARC-Profile", _PROFILE), *kind], _HTTP)
        return
    block = _HTTP + chunked(html or "")
    cuts = [block[at : at + segment_chars] for at in range(0, len(block), segment_chars)]
    if len(cuts) == 1:
        yield _record([("WARC-Type", "response"), *fields, *kind], block)
        return
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1), *kind], cuts[0])
    total = len(block.encode())
    for n, part in enumerate(cuts[1:], 2):
        own = f"{record_id[:-1]}:{n}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), fields[1], ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total if n == len(cuts) else None)], part)


def _writer(segment_chars: int):
    schema = pa.schema([("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in rows_of(batches, "record_id", "page_id", "url", "html", "digest", "refers_id"):
            for record in records_of(*row, segment_chars):
                out.append((record,))
                size += len(record)
                if size > 1 << 22:
                    yield batch_of(schema, out)
                    out, size = [], 0
        if out:
            yield batch_of(schema, out)

    return run


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, segment_chars: int = SEGMENT_CHARS, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per row (more for long payloads) below ``path``."""
    ship_package(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))

    def name(page_id, url):  # the same for equal rows only
        h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), "digest"), 256)
        return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))

    large = rows.where(F.col("size") >= least_bytes).select("digest", F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("-")).alias("url"))).alias("place"))
    firsts = large.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    firsts = materialize(firsts.select("digest", "first"), "firsts")
    marked = BitmapFilter(firsts, F.xxhash64("digest")).marked(rows, F.xxhash64("digest"), "shared")
    record_id = name(F.col("page_id"), F.col("url")).alias("record_id")
    single = marked.where(~F.col("shared")).select(record_id, "page_id", "url", "html", "digest", F.lit(None).cast("string").alias("refers_id"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    grouped = marked.where("shared").join(firsts, "digest", "left")
    grouped = grouped.select(record_id, "page_id", "url", F.when(~F.coalesce(other, F.lit(False)), F.col("html")).alias("html"), "digest", F.when(other, name(F.col("first.page_id"), F.col("first.url"))).alias("refers_id"))
    lines = single.unionByName(grouped).mapInArrow(_writer(segment_chars), "value string")
    lines.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# -- reading ---------------------------------------------------------------


def dechunk(body: bytes) -> bytes:
    """Decode chunked transfer framing; anything but a whole body is an error."""
    parts, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not size:
            break
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk ends early")
        parts.append(body[at : at + size])
        at += size + 2
    return b"".join(parts)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    stop = block.index(_END)
    chunks = any(k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked" for k, _, v in (line.partition(b":") for line in block[:stop].split(b"\r\n")[1:]))
    body = block[stop + 4 :]
    return dechunk(body) if chunks else body


class _Stream:
    """Bytes of a (perhaps gzip) archive, decompressed as they are asked for."""

    def __init__(self, content: bytes):
        self.packed, self.at, self.buffer = content, 0, bytearray()
        self.unpack = zlib.decompressobj(47) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.packed):
            return False
        part = self.packed[self.at : self.at + (1 << 18)]
        self.at += len(part)
        while self.unpack is not None and part:
            self.buffer += self.unpack.decompress(part)
            part = self.unpack.unused_data
            if self.unpack.eof and part:
                self.unpack = zlib.decompressobj(47)  # the next gzip member
            elif not self.unpack.eof:
                break
        if self.unpack is None:
            self.buffer += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (found := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a header")
                return None
        head = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("archive ends inside a record")
        block = bytes(self.buffer[:n])
        del self.buffer[:n]
        return block


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    stream = _Stream(content)
    while (head := stream.until(_END)) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != _END:
            raise ValueError(f"record {fields.get('warc-record-id')} has a wrong length")
        yield fields, block


def _digest(payload: bytes, claimed: str | None, record_id: str) -> str:
    digest = hashlib.sha256(payload).hexdigest()
    if claimed is not None and claimed != digest:
        raise ValueError(f"payload of {record_id} does not fit its digest")
    return digest


def _reader(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for f, block in parse(content.as_py()):
                    kind, own = f["warc-type"], f["warc-record-id"]
                    claimed = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    page = int(f["x-page-id"]) if "x-page-id" in f else None
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    if kind == "continuation" or number is not None:
                        total = f.get("warc-segment-total-length")
                        out.append((f.get("warc-segment-origin-id", own), page, None if kind == "continuation" else kind, None, claimed, number, int(total) if total else None, None, None, block))
                    elif kind == "revisit":
                        out.append((own, page, kind, f.get("warc-refers-to"), claimed, None, None, None, claimed, None))
                    elif kind == "response":
                        payload = payload_of(block)
                        out.append((own, page, kind, None, claimed, None, None, len(payload), _digest(payload, claimed, own), payload if keep else None))
                    size += len(out[-1][-1] or b"") + 200 if out else 0
                    if size > 1 << 22:
                        yield batch_of(_PARSED, out)
                        out, size = [], 0
                if out:
                    yield batch_of(_PARSED, out)

    return run


def _reassemble(keep: bool):
    def run(key: tuple, segments: pd.DataFrame) -> pd.DataFrame:
        copies = int((segments["segment"] == 1).sum())  # repeated rows were written repeatedly
        ordered = segments.sort_values("segment", kind="stable").drop_duplicates("segment")
        total = ordered["total"].dropna()
        block = b"".join(ordered["content"])
        if ordered["segment"].tolist() != list(range(1, len(ordered) + 1)) or len(total) != 1 or len(block) != int(total.iloc[0]):
            raise ValueError(f"segments of {key[0]} are not complete")
        first, payload = ordered.iloc[0], payload_of(block)
        page = None if pd.isna(first["page_id"]) else int(first["page_id"])
        row = (key[0], page, first["record_type"], None, first["claimed"], None, None, len(payload), _digest(payload, first["claimed"], key[0]), payload if keep else None)
        return pd.DataFrame([row] * copies, columns=_PARSED.names).astype({"page_id": "Int64", "segment": "Int32", "total": "Int64"})

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = materialize(files.mapInArrow(_reader(keep_payload), _PARSED_DDL), "records")
    whole = parsed.where(F.col("segment").isNull())
    joined = parsed.where(F.col("segment").isNotNull()).groupBy("record_id").applyInPandas(_reassemble(keep_payload), _PARSED_DDL)
    responses = whole.where(F.col("record_type") == "response").unionByName(joined)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"] + ["content"] * keep_payload
    plain = responses.select(*columns, F.lit(None).cast("long").alias("refers_to"))
    # copies of one row share a record id: the target of a revisit is one of them
    wanted = whole.where(F.col("record_type") == "revisit").select(F.col("record_id").alias("revisit_id"), F.col("page_id").alias("own_id"), F.col("refers_id").alias("record_id"), "claimed")
    targets = responses.join(wanted.select("record_id").distinct(), "record_id", "left_semi").dropDuplicates(["record_id"])
    again = wanted.join(targets.drop("claimed"), "record_id", "left")
    lost = F.raise_error(F.concat(F.lit("no matching record for "), "revisit_id"))
    bytes_ = F.when(F.col("payload_digest").eqNullSafe(F.col("claimed")), F.col("payload_bytes")).otherwise(lost.cast("long"))
    again = again.select(F.col("own_id").alias("page_id"), bytes_.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), *["content"] * keep_payload, F.col("page_id").alias("refers_to"))
    result = plain.unionByName(again)
    return result.withColumnRenamed("content", "payload") if keep_payload else result


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read them back."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
