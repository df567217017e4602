"""Bulk load of an export: verified against its manifest, repeatable, published at the end."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import functions as F

from loghaven.errors import BackfillError, CoverageGap
from loghaven.operators.store import Warehouse, check_rows
from loghaven.sources import export as X


class Backfill:
    """Stages prepare, logs, blocks, finish; each may be repeated."""

    STAGES = ("prepare", "logs", "blocks", "finish")

    def __init__(self, warehouse: Warehouse, root: str):
        self.w, self.spark, self.root = warehouse, warehouse.spark, root.rstrip("/")
        self.manifest = X.read_manifest(self.spark, self.root)

    # -- shared -------------------------------------------------------------

    def _preflight(self) -> None:
        """The export must touch what is published, or the load could never be joined to it."""
        m, cov = self.manifest, self.w.coverage
        if cov and (m.first > cov.head + 1 or m.last + 1 < cov.start):
            raise CoverageGap(f"write is not contiguous with warehouse coverage: the export covers blocks {m.first}-{m.last} but the warehouse already publishes {cov.start}-{cov.head} (a tail-only start); recreate the database (make clean) and run the backfill before starting ingestion")

    def _interval(self, part: int) -> tuple[int, int]:
        width = self.w.part_blocks
        return max(self.manifest.first, part * width), min(self.manifest.last, (part + 1) * width - 1)

    def _parts(self) -> range:
        return range(self.manifest.first // self.w.part_blocks, self.manifest.last // self.w.part_blocks + 1)

    def _mark(self) -> None:
        """Reads are refused from the first change until finish, if there is anything to read."""
        state = self.w.states.read()
        if state.coverage and not state.maintenance:
            self.w.set_maintenance(True, f"backfill reload from export {self.manifest.export}")

    def _loaded(self, unit: str, rows: int, now: int) -> bool:
        record = self.w.states.read().units.get(unit)
        return now == rows and record is not None and record["fingerprint"] == self.manifest.fingerprint(f"{unit}/")

    def _record(self, state, unit: str, rows: int):
        entry = {"fingerprint": self.manifest.fingerprint(f"{unit}/"), "rows_loaded": rows, "loaded_at": time.time()}
        return replace(state, units={**state.units, unit: entry})

    # -- stages -------------------------------------------------------------

    def prepare(self) -> None:
        """The preflight check; there are no indexes to drop."""
        self._preflight()

    def logs(self) -> None:
        self._preflight()
        for part in self._parts():
            self._part(part)

    def _part(self, part: int) -> None:
        want, (low, high) = self.manifest.part_rows(part), self._interval(part)
        unit = f"logs/part={part:03d}"
        X.verify_files(self.spark, self.root, self.manifest, f"{unit}/")
        now = self.w.latest().frame("logs", low, high).where(F.col("block_number").between(low, high)).count()
        if self._loaded(unit, want, now):
            return
        self._mark()
        rows = X.read_part(self.spark, self.root, part)
        counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("block_number").between(low, high)).alias("outside")).first()
        if counted["n"] != want:
            raise BackfillError(f"part {part:03d} files hold {counted['n']} rows, {X.NAME} says {want}; the copy is incomplete")
        if counted["outside"]:
            raise BackfillError(f"part {part:03d} files hold {counted['outside']} rows outside blocks {low}-{high}")
        check_rows(rows)
        state = self.w.replaced(self.w.states.read(), "logs", rows, low, high)
        self.w.states.commit(self._record(state, unit, want))

    def blocks(self) -> None:
        self._preflight()
        m = self.manifest
        X.verify_files(self.spark, self.root, m, "blocks/")
        inside = F.col("number").between(m.first, m.last)
        now = self.w.latest().frame("blocks", m.first, m.last).where(inside).count()
        if self._loaded("blocks", m.block_rows, now):
            return
        self._mark()
        rows = X.read_blocks(self.spark, self.root).where(inside)
        state = self.w.replaced(self.w.states.read(), "blocks", rows, m.first, m.last)
        self.w.states.commit(self._record(state, "blocks", m.block_rows))

    def finish(self) -> None:
        """Verify everything, then publish the interval and end the maintenance."""
        self._preflight()
        try:
            self._verify()
        except BackfillError as e:
            raise BackfillError(f"backfill is not complete, cursor not set: {e}") from None
        self.w.set_coverage(self.manifest.first, self.manifest.last, maintenance=False, reason="")

    def _verify(self) -> None:
        m, view = self.manifest, self.w.latest()
        inside = F.col("number").between(m.first, m.last)
        b = view.frame("blocks", m.first, m.last).where(inside).agg(F.min("number").alias("a"), F.max("number").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("d")).first()
        if not b["n"]:
            raise BackfillError("no blocks loaded; run the blocks stage first")
        if (b["a"], b["b"], b["n"], b["d"]) != (m.first, m.last, m.block_rows, m.block_rows):
            raise BackfillError(f"eth_blocks holds {b['n']} rows for blocks {b['a']}-{b['b']}, {X.NAME} says {m.block_rows} rows for {m.first}-{m.last}")
        self._same_unit("blocks")
        for part in self._parts():
            self._verify_part(part)
        X.verify_files(self.spark, self.root, m, "blocks/")
        for part in self._parts():
            X.verify_files(self.spark, self.root, m, f"logs/part={part:03d}/")

    def _verify_part(self, part: int) -> None:
        want, (low, high), folder = self.manifest.part_rows(part), self._interval(part), f"{self.root}/logs/part={part:03d}"
        if not X.folder_exists(self.spark, folder):
            raise BackfillError(f"export is missing logs/part={part:03d} for blocks {low}-{high}; copy the full export")
        files = self.spark.read.schema(X.schema.EXPORT_LOGS).parquet(folder).count()  # from the footers
        if files != want:
            raise BackfillError(f"part {part:03d} files hold {files} rows, {X.NAME} says {want}; the copy is incomplete")
        got = self.w.latest().frame("logs", low, high).where(F.col("block_number").between(low, high)).count()
        if got != want:
            raise BackfillError(f"part {part:03d} has {got} rows in the database, {X.NAME} says {want}; run the logs stage")
        self._same_unit(f"logs/part={part:03d}")

    def _same_unit(self, unit: str) -> None:
        record = self.w.states.read().units.get(unit)
        if record is None or record["fingerprint"] != self.manifest.fingerprint(f"{unit}/"):
            raise BackfillError(f"{unit} was loaded from a different export than {X.NAME} describes (or never recorded); rerun its stage")

    def run(self, stage: str = "all") -> None:
        """One stage or all of them, under both locks."""
        if stage != "all" and stage not in self.STAGES:
            raise BackfillError(f'backfill: unknown stage "{stage}"')
        with self.w.states.writer():
            for name in self.STAGES if stage == "all" else (stage,):
                with self.w.states.maintenance_lock():
                    getattr(self, name)()
