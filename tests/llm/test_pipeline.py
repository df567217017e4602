import corpus_pipeline
from loghaven.llm import registry
from tests.llm.test_dedup import runs


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "passages", "leaks", "pack"]
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)


def test_each_stage_takes_effect(spark, docs, corpus, tmp_path):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    leaked = next(t for i, t in corpus if i == 30).split("\n")[0]
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage-{name}")
        now = spark.read.parquet(f"{tmp_path}/stage-{name}")
        seen[name] = now.collect()
        if name != "pack":
            assert now.columns == table.columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert {0, 10, 30} <= ids["quality"] and 100 not in ids["near_copies"] and 0 in ids["near_copies"]
    windows = [w for r in seen["passages"] for w in set(runs(r["text"], 50))]
    assert len(windows) == len(set(windows)) or len({(r["doc_id"], r["text"]) for r in seen["passages"]}) < len(seen["passages"])
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["passages"])
    assert 30 in ids["passages"] and 30 not in ids["leaks"] and {10, 11} <= ids["leaks"]
    assert ids["pack"] == ids["leaks"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pack"])


def test_empty_tables_and_odd_rows(spark, tmp_path):
    """No documents, no labels, no items; then nulls, empty texts, ties and repeated rows."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "one two three four five six", "en", None, 27), (3, "a b c d e f g", None, "s", 13), (3, "a b c d e f g", None, "s", 13), (4, "a b c d e f g", "en", "s", 13)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, given in (("none", []), ("odd", rows)):
        now = spark.createDataFrame(given, ddl)
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{stage}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
        ids = sorted((r["doc_id"] or 0) for r in now.collect())
        # 1 and 2 have no words and are one group; 3 stands twice and is packed twice; 4 is a copy
        assert ids == ([] if name == "none" else [0, 1, 3, 3])
