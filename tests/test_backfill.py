"""An export from writing to serving, with every way it can be wrong."""

import json
import os
import shutil

import pytest

from loghaven import cli, schema
from loghaven.errors import BackfillError, CoverageGap, Maintenance, WriterBusy
from loghaven.functions import eventset as E
from loghaven.operators.backfill import Backfill
from loghaven.operators.state import Coverage
from loghaven.operators.store import Warehouse
from loghaven.plans.query import Query
from loghaven.sources.export import build_manifest, list_files
from tests.helpers import a, b, blocks_frame, h, logs_frame

WIDTH = 100
FIRST, LAST = 7, 105


def log(block, index, topics, data=b"\1"):
    full = [b(t) for t in topics] + [None] * (4 - len(topics))
    return (block, index, 0, b(h(block)), b(a(1)), *full, None if data is None else bytearray(data))


def put(spark, path, rows, fields):
    spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def export(spark, tmp_path):
    root = str(tmp_path / "export")
    blocks = [(n, b(h(n)), 10 * n) for n in range(FIRST, 111)]
    put(spark, f"{root}/blocks", blocks[:50], schema.EXPORT_BLOCKS)
    put(spark, f"{root}/blocks", blocks[50:], schema.EXPORT_BLOCKS)
    put(spark, f"{root}/blocks", [], schema.EXPORT_BLOCKS)
    put(spark, f"{root}/logs/part=000", [log(12, 4, [E.TRANSFER, h(1), h(2), h(3)]), log(7, 0, [E.METADATA_UPDATE])], schema.EXPORT_LOGS)
    put(spark, f"{root}/logs/part=001", [log(105, 2, [E.URI, h(1)], None)], schema.EXPORT_LOGS)
    put(spark, f"{root}/logs/part=001", [log(101, 0, [E.METADATA_UPDATE])], schema.EXPORT_LOGS)
    put(spark, f"{root}/logs/part=001", [], schema.EXPORT_LOGS)
    describe(spark, root)
    return root


def describe(spark, root, parts=None, last=LAST):
    for folder, _, names in os.walk(root):
        for name in names:
            if not name.endswith(".parquet"):
                os.remove(os.path.join(folder, name))
    with open(f"{root}/manifest.json", "w") as out:
        json.dump(build_manifest(spark, root, "e1", "test", FIRST, last, parts or {"000": 2, "001": 2}), out)


@pytest.fixture
def w(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "w"), part_blocks=WIDTH)


def files(root, part):
    folder = f"{root}/logs/part={part}"
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".parquet"))


def test_whole_load_is_repeatable(spark, w, export):
    load = Backfill(w, export)
    with pytest.raises(BackfillError, match="backfill is not complete, cursor not set: no blocks loaded; run the blocks stage first"):
        load.run("finish")
    load.run("blocks")
    with pytest.raises(BackfillError, match="part 000 has 0 rows in the database, manifest.json says 2; run the logs stage"):
        load.run("finish")
    for _ in range(2):
        load.run()
        assert w.coverage == Coverage(FIRST, LAST)
        rows = w.latest().filter_logs(Query(FIRST, LAST))
        assert [(r["block_number"], r["log_index"]) for r in rows] == [(7, 0), (12, 4), (101, 0), (105, 2)]
        assert bytes(rows[3]["data"]) == b"" and rows[0]["block_ts"] == 70
    assert w.latest().frame("blocks").count() == LAST - FIRST + 1
    version = w.states.read().version
    load.run("logs")
    assert w.states.read().version == version  # nothing to do, nothing written


def test_reload_of_other_content(spark, w, export):
    Backfill(w, export).run()
    shutil.rmtree(f"{export}/logs/part=000")
    put(spark, f"{export}/logs/part=000", [log(12, 4, [E.TRANSFER, h(1), h(2), h(9)]), log(8, 0, [E.METADATA_UPDATE])], schema.EXPORT_LOGS)
    describe(spark, export)
    load = Backfill(w, export)
    with pytest.raises(BackfillError, match="logs/part=000 was loaded from a different export than manifest.json describes"):
        load.run("finish")
    load.run("logs")
    with pytest.raises(Maintenance), w.read():
        pass
    load.run("finish")
    with w.read() as view:
        assert [r["block_number"] for r in view.filter_logs(Query(7, 20))] == [8, 12]


def test_damage_is_refused(spark, w, export):
    first = files(export, "000")[0]
    shutil.copy(first, f"{export}/whole")
    with open(first, "ab") as out:
        out.write(b"x")
    with pytest.raises(BackfillError, match="differs from manifest.json .* truncated or altered"):
        Backfill(w, export).run("logs")
    assert w.states.read().logs == ()
    shutil.move(f"{export}/whole", first)
    describe(spark, export, {"000": 2, "001": 3})
    with pytest.raises(BackfillError, match="part 001 files hold 2 rows, manifest.json says 3; the copy is incomplete"):
        Backfill(w, export).run("logs")
    shutil.copy(first, f"{export}/logs/part=000/extra.parquet")
    with pytest.raises(BackfillError, match="extra.parquet is not listed in manifest.json"):
        Backfill(w, export).run("logs")


def test_rows_outside_and_missing_folder(spark, w, export):
    put(spark, f"{export}/logs/part=001", [log(50, 0, [E.METADATA_UPDATE])], schema.EXPORT_LOGS)
    describe(spark, export, {"000": 2, "001": 3})
    with pytest.raises(BackfillError, match="part 001 files hold 1 rows outside blocks 100-105"):
        Backfill(w, export).run("logs")
    shutil.rmtree(f"{export}/logs/part=000")
    load = Backfill(w, export)
    with pytest.raises(BackfillError, match="logs/part=000/.* listed in manifest.json: no such file"):
        load.run("logs")
    load.run("blocks")
    with pytest.raises(BackfillError, match="export is missing logs/part=000 for blocks 7-99; copy the full export"):
        load.run("finish")


def test_only_files_of_a_part_are_opened(spark, export):
    """A file of another part that cannot be read does no harm."""
    other = files(export, "001")[0]
    os.remove(other)
    os.symlink("/nowhere", other)
    found = list_files(spark, export, "logs/part=000/").collect()
    assert found and all(r["path"].startswith("logs/part=000/") for r in found)
    assert list_files(spark, export, "logs/part=007/").collect() == []


def test_source_to_export_to_manifest(spark, tmp_path):
    ox = lambda v: "0x" + v
    logs = [(n, 0, 0, ox(h(n)), ox(a(1)), None if n % 2 else "0x01", [ox(E.URI), ox(h(1))]) for n in range(12)] + [(3, 1, 0, ox(h(3)), ox(a(1)), "0x", [ox(E.URI)])]
    spark.createDataFrame(logs, "block_number long, log_index long, transaction_index long, transaction_hash string, address string, data string, topics array<string>").write.parquet(f"{tmp_path}/s/logs")
    spark.sql("SELECT id AS number, concat('0x', lpad(hex(id), 64, '0')) AS hash, timestamp_seconds(1000 + id) AS timestamp FROM range(15)").write.parquet(f"{tmp_path}/s/blocks")
    assert cli.main(["export", "--source", f"{tmp_path}/s", "--dir", f"{tmp_path}/e", "--end", "9"]) == 0
    assert cli.main(["manifest", "--source", f"{tmp_path}/s", "--dir", f"{tmp_path}/e", "--end", "9"]) == 0
    assert cli.main(["manifest", "--source", f"{tmp_path}/s", "--dir", f"{tmp_path}/e", "--end", "99"]) == 1
    w = Warehouse(spark, str(tmp_path / "w2"))
    Backfill(w, f"{tmp_path}/e").run()
    rows = w.latest().filter_logs(Query(0, 9))
    assert [r["block_number"] for r in rows] == list(range(10)) and rows[4]["block_ts"] == 1004 and bytes(rows[5]["data"]) == b""


@pytest.mark.parametrize(
    ("change", "text"),
    [
        (lambda m: m["blocks"].update(rows=3), "blocks 7-105 with 3 rows is not one contiguous run"),
        (lambda m: m["logs"].update(rows=9), "partition rows sum to 4, logs.rows is 9"),
        (lambda m: m.update(files={}), "lists no files"),
    ],
)
def test_bad_manifests(w, export, change, text):
    path = f"{export}/manifest.json"
    with open(path) as source:
        manifest = json.load(source)
    change(manifest)
    with open(path, "w") as out:
        json.dump(manifest, out)
    with pytest.raises(BackfillError, match=text):
        Backfill(w, export)
    os.remove(path)
    with pytest.raises(BackfillError, match="manifest.json is required at the export root"):
        Backfill(w, export)


def test_tail_rows_survive_and_gaps_are_refused(spark, w, export):
    w.write_range(104, 108, blocks_frame(spark, 104, 108), logs_frame(spark, []))
    Backfill(w, export).run()
    assert w.coverage == Coverage(FIRST, 108)
    other = Warehouse(spark, w.states.root + "2", part_blocks=WIDTH)
    other.write_range(500, 501, blocks_frame(spark, 500, 501), logs_frame(spark, []))
    for stage in Backfill.STAGES:
        with pytest.raises(CoverageGap, match="the export covers blocks 7-105 but the warehouse already publishes 500-501"):
            Backfill(other, export).run(stage)
    with w.states.writer(), pytest.raises(WriterBusy):
        Backfill(w, export).run()
    with pytest.raises(BackfillError, match="unknown stage"):
        Backfill(w, export).run("x")
