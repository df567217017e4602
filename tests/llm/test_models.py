import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from loghaven.llm import decontaminate, importance, multiset_hash
from tests.llm.conftest import sentence

TABLES = "/root/testdata/sf0.1"

# -- fingerprints -----------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_fingerprints(spark, docs, corpus, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = multiset_hash.fingerprints(docs).collect()
        assert multiset_hash.fingerprints(docs.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t or "")) for i, t in corpus)
    prints = {t or "": multiset_hash.Fingerprint.of_text(t or "") for _, t in corpus}
    order = defaultdict(set)
    for i, t in corpus:
        order[i].add(t or "")
    ids = sorted(order, key=lambda i: (i is not None, i or 0))
    follower = {i: order[ids[(k + 1) % len(ids)]] | (order[i] if len(order[i]) > 1 or Counter(j for j, _ in corpus)[i] > 1 else set()) for k, i in enumerate(ids)}
    for r in found:
        fits = []
        for text in order[r["doc_id"]]:
            for after in follower[r["doc_id"]]:
                half = len(text) // 2
                new = text[: len(text) - half] + after[:half]
                whole = multiset_hash.Fingerprint.of_text(new)
                near = prints[text].likeness(whole), prints[text].likeness(prints[after])
                fits.append((hashlib.sha256(new.encode()).hexdigest(), prints[text].hex(), whole.hex(), *near))
        assert (r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) in fits
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_multisets_of_paragraphs():
    F_ = multiset_hash.Fingerprint
    a, b, c = "x y z w", "p q", "a b c"
    assert F_.of_text(f"{a}\n{b}\n{c}").hex() == F_.of_text(f"{c}\n{a}\n{b}").hex() != F_.of_text(f"{a}\n{b}\n{b}").hex()
    assert (F_.of_text(f"{a}\n{b}") + F_.of_paragraph(c)).hex() == F_.of_text(f"{a}\n{b}\n{c}").hex()
    assert (F_.of_text(f"{a}\n{b}\n{c}") - F_.of_paragraph(b)).hex() == F_.of_text(f"{a}\n{c}").hex()
    assert F_.of_text("").hex() != F_.of_text("\n").hex() and F_.zero().likeness(F_.of_text(a)) == 0 and F_.zero().likeness(F_.zero()) == 1


def test_likeness_follows_the_overlap():
    rng = random.Random(1)
    error = []
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for _ in range(20):
            first = [sentence(rng, 12) for _ in range(20)]
            other = first[: int(20 * share)] + [sentence(rng, 12) for _ in range(20 - int(20 * share))]
            error.append(abs(multiset_hash.Fingerprint.of_text("\n".join(first)).likeness(multiset_hash.Fingerprint.of_text("\n".join(other))) - share))
    assert np.mean(error) < 0.1


# -- benchmark leaks ---------------------------------------------------------------------


def words_of(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_leaks(docs, items):
    found = {}
    for i, text in docs:
        mine = shingles(words_of(text))
        for k, item in items:
            theirs = Counter(shingles(words_of(item)))
            m = sum(theirs.values())
            for s in range(max(1, len(mine) - m + 1)) if m and mine and theirs.keys() & set(mine) else ():
                window = Counter(mine[s : s + m])
                shared = sum((window & theirs).values())
                like = shared / (m + sum(window.values()) - shared)
                if like >= 0.8:
                    found[i, k] = max(like, found.get((i, k), 0))
    return found


def test_leaks(spark, docs, corpus, no_docs):
    rng = random.Random(8)
    items = [(k, sentence(rng, rng.randint(5, 60))) for k in range(30)] + [(100, "too few words"), (101, None), (102, "")] + [(None, sentence(rng, 20))]
    rows = []
    for k, text in items[:30]:
        words = text.split()
        for edit in range(4):
            new = list(words)
            for _ in range(edit):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice([["other"], [], [new[at], "more"]])
            rows.append((1000 + 10 * k + edit, f"{sentence(rng, rng.randint(0, 30))} {' '.join(new).upper()}, {sentence(rng, rng.randint(0, 30))}"))
        rows.append((2000 + k, " ".join(words[: int(0.95 * len(words))])))
    rows += [(3000, items[3][1] + " x " + items[3][1] + " " + items[4][1])]
    rows += [(4000 + i, f"{sentence(rng, 8)} {items[5][1]} {sentence(rng, 8)}") for i in range(50)]
    rows += [(5000, f"{sentence(rng, 8)} {items[-1][1]}")]
    rows += corpus
    table = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, hash string, n int")
    bench = spark.createDataFrame([(*x, "fp") for x in items], "item_id long, text string, fp string")
    found = decontaminate.find_leaks(table, bench)
    got = {}
    for r in found.collect():
        got[r["doc_id"], r["item_id"]] = max(r["similarity"], got.get((r["doc_id"], r["item_id"]), 0))
    assert got == pytest.approx(plain_leaks(rows, items))
    assert found.where("doc_id = 3000 AND item_id = 3").count() == 2
    kept = {r["doc_id"] for r in decontaminate.remove_leaks(table, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.find_leaks(no_docs, bench).collect() == [] and decontaminate.find_leaks(table, bench.limit(0)).collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_radius_covers_the_similarity(spark):
    """Pairs of shingle sets at 0.8: their distances, from random hashes."""
    rng = np.random.default_rng(4)
    bits = lambda h: 2 * np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) > len(h)
    found = []
    for n in (16, 40, 100, 300):
        shared = round(n * 1.6 / 1.8)
        for _ in range(500):
            hashes = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            found.append(int((bits(hashes[:n]) != bits(hashes[n - shared :])).sum()))
    assert 8.5 < np.mean(found) < 10.5 and np.mean(np.array(found) <= decontaminate.RADIUS) > 0.995


# -- importance resampling ------------------------------------------------------------------


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000 + [-40.0] * 50 + [1e9]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 500, 1200, 2500, 4000, 5051):
        assert importance.kth_largest(frame, "v", k, small=50) == sorted(values, reverse=True)[k - 1]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_held_out_recall(spark):
    """Of documents whose labels the models never saw; the README has the figures."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0
    drawn = importance.resample(docs, labels.where(~held), keep_columns=False).select("doc_id", F.lit(1).alias("kept"))
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    judged = labels.where(held).join(docs.select("doc_id"), "doc_id").join(drawn, "doc_id", "left")
    kept = {r["kind"]: r["share"] for r in judged.groupBy(kind.alias("kind")).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert kept["clean"] > 0.9 and kept["poor"] < 0.05 and kept["toxic"] < 0.25, kept


def plain_ngrams(text):
    """(kind, bytes) of every n-gram of a text."""
    last = None
    for word in regex.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\t\n\x0b\x0c\r ]+", (text or "").encode()):
        yield 0, word
        if word == last:
            yield "again", b""
        last = word
        if regex.match(rb"[0-9A-Za-z_\x80-\xff]", word):
            yield from ((kind, word[:n]) for kind, n in enumerate(importance.PREFIXES, 1) if len(word) > n)


def plain_bucket(kind, gram):
    def spread(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return x ^ x >> 32

    if kind == "again":
        return kind
    value = spread((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(gram)) + len(gram)) % 2**64)
    value = spread((value + importance.SEED) % 2**64) if kind else value
    return kind, value >> 64 - importance.TABLE_BITS


def plain_weights(rows, targets):
    buckets = [[plain_bucket(*g) for g in plain_ngrams(t)] for _, t in rows]
    raw = Counter(b for found in buckets for b in found)
    good = Counter(b for (i, _), found in zip(rows, buckets, strict=True) if i in targets for b in found)
    share = sum(i in targets for i, _ in rows) / len(rows)
    s = importance.SMOOTHING
    ratio = {b: math.log((good[b] + s) / (n * share + s)) for b, n in raw.items()}
    return [sum(ratio[b] for b in found) * math.sqrt(importance.LENGTH / max(1, len(found))) for found in buckets]


def plain_noise(doc_id, text):
    seed = 42
    for value in (doc_id, text, importance.SEED):
        if value is not None:
            raw = value.encode() if isinstance(value, str) else value.to_bytes(4 if value is importance.SEED else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    seed -= (seed >> 63) << 64
    return -math.log(-math.log((seed % 2**52 + 0.5) / 2**52))


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_weights_and_draw_equal_a_plain_version(spark, docs, corpus, monkeypatch, part_bytes):
    monkeypatch.setattr(importance, "PART_BYTES", part_bytes)
    judged = {i: (int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 408) if i % 2}
    labels = spark.createDataFrame([(i, *x, "w") for i, x in judged.items()], "doc_id long, quality int, toxic int, log_weight string")
    targets = {i for i, x in judged.items() if x == (1, 0)}
    want = plain_weights(corpus, targets)
    ratios = importance.fit(docs, np.array(sorted(targets)))
    assert importance.log_weights(pa.array([t or "" for _, t in corpus]), ratios) == pytest.approx(want, abs=1e-3)
    keys = [w + plain_noise(*row) for w, row in zip(want, corpus, strict=True)]
    k = math.floor(len(targets) / len(judged) * len(corpus) + 0.5)
    least = sorted(keys)[-k]
    found = importance.resample(docs, labels, keep_columns=False).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for (i, _), key in zip(corpus, keys, strict=True) if key >= least)
    assert len(found) >= k and importance.resample(docs, labels, share=0.1).count() >= len(corpus) // 10


def test_ties_are_all_drawn(spark):
    rows = [(1, "good words here")] + [(2, "bad rotten words")] * 5 + [(3, "good words there")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = Counter(r["doc_id"] for r in importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=3 / 7, keep_columns=False).collect())
    assert found in ({1: 1, 2: 5, 3: 1}, {1: 1, 2: 5}, {2: 5, 3: 1}, {2: 5})


def test_a_long_text_is_read_whole(spark):
    docs = spark.createDataFrame([(1, "vile " + "pax " * 100_000 + "x" * 3_000_000 + " rotten"), (2, None), (3, ""), (3, ""), (None, "a b")], "doc_id long, text string")
    long = pa.array(["vile " + "pax " * 600_000 + "rotten"])
    assert sum(len(places) for _, places in importance.ngrams(long)) == 600_002 + 599_999  # words, and back-references
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(docs, none, keep_columns=False).count() == 5  # without labels all are drawn
    assert importance.resample(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert importance.labelled(odd)[1] is None and importance.resample(docs, odd).count() == 5


def test_gumbel_noise(spark):
    g = [r[0] for r in spark.range(20_000).select(importance.gumbel(F.col("id"), F.lit("t"))).collect()]
    assert abs(np.mean(g) - 0.5772) < 0.05 and abs(np.std(g) - math.pi / math.sqrt(6)) < 0.05
