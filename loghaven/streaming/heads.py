"""A stream of chain heads from a growing file: a replayable Python data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class HeadLog(DataSource):
    """Heads from an append-only file of JSON lines (``path``, in any store that Arrow reads).

    Line format: number, hash, parent_hash (hex) and timestamp. A node adapter appends to
    the file in order of arrival, so a replay gives the same heads.
    """

    @classmethod
    def name(cls) -> str:
        return "head_log"

    def schema(self) -> str:
        return "number long, hash binary, parent_hash binary, timestamp long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"])


class _Reader(SimpleDataSourceStreamReader):
    """Reads on from a byte offset; a line that is still being written is left for later."""

    def __init__(self, path: str):
        from pyarrow.fs import FileSystem

        self.fs, self.path = FileSystem.from_uri(path) if "://" in path else (FileSystem.from_uri("file://" + path)[0], path)

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def _rows(self, start: int, end: int | None) -> tuple[list[tuple], int]:
        with self.fs.open_input_file(self.path) as source:
            source.seek(start)
            text = source.read(None if end is None else end - start)
        whole = text[: text.rfind(b"\n") + 1]
        raw = [json.loads(x) for x in whole.splitlines()]
        return [(r["number"], bytes.fromhex(r["hash"]), bytes.fromhex(r["parent_hash"]), r["timestamp"]) for r in raw], start + len(whole)

    def read(self, start: dict) -> tuple[Iterator, dict]:
        rows, end = self._rows(start["byte"], None)
        return iter(rows), {"byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        return iter(self._rows(start["byte"], end["byte"])[0])
