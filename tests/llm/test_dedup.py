import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loghaven.llm import line_dedup, simhash_groups
from loghaven.llm.components import components


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_groups(prints, distance):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= distance:
                parent[find(x)] = find(y)
    return {v: find(v) for v in values}


def test_groups(docs, no_docs, corpus):
    prints = [(i, plain_simhash(t)) for i, t in corpus]
    roots = plain_groups([p for _, p in prints], 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_groups.near_groups(docs).collect())
    assert got == Counter((i, f"{p:016x}", least.get(roots[p])) for i, p in prints)
    assert simhash_groups.near_groups(no_docs).collect() == []


def test_keep_one(docs):
    kept = [r["doc_id"] for r in simhash_groups.keep_one(docs).select("doc_id").collect()]
    assert not {100, 101, 102, 103, 104, 105} & set(kept) and {0, 1, 2, 3, 4, 5, 30} <= set(kept) and None in kept


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 600, dtype=np.uint64)
    near = [base]
    for k in range(1, 4):
        moved = base[:300].copy()
        for _ in range(k):
            moved ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        near.append(moved)
    ball = np.full(400, 12345, np.uint64)
    for _ in range(3):
        ball ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    return np.unique(np.concatenate([*near, ball]))


@pytest.mark.parametrize("kw", [{}, {"shard_points": 100}, {"sample": 128, "shard_points": 10, "least": 16}])
@pytest.mark.parametrize("distance", [0, 2, 4])
def test_tree_finds_every_link(spark, points, kw, distance):
    simhash_groups.ship_package(spark)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    edges = simhash_groups.link_points(frame, distance, **kw)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for v, r in plain_groups(points.tolist(), distance).items():
        want[r].add(v)
    for v, s in zip(points.tolist(), points.view(np.int64).tolist(), strict=True):
        got[root.get(s, s)].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)] + [(5, 5), (6, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# -- lines and passages ----------------------------------------------------------


def runs(text, n):
    words = (text or "").lower().split()
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_repeats_go_and_nothing_else(docs, no_docs, corpus):
    found = line_dedup.remove_repeats(docs).select("row.doc_id", "row.text", "text", "removed").toDF("doc_id", "old", "text", "removed").collect()
    assert len(found) == len(corpus)
    assert line_dedup.remove_repeats(no_docs).collect() == []
    texts = {}
    for r in found:
        old, spans = r["old"], r["removed"]
        assert (r["text"] is None) == (old is None)
        kept, at = "", 0
        for s in spans:
            kept += (old[at : s["start"]]) + " "
            at = s["end"]
        assert (kept + (old or "")[at:]).split() == (r["text"] or "").split()  # offsets are those of the original
        key = (r["doc_id"] if r["doc_id"] is not None else -1, old)
        assert texts.setdefault(key, r["text"]) == r["text"]  # repeated rows agree
    windows = Counter(w for t in texts.values() for w in set(runs(t, 50)))
    assert max(windows.values()) == 1
    lines = Counter(line for t in texts.values() for line in {" ".join(x.lower().split()) for x in (t or "").split("\n") if len(x.split()) >= 5})
    assert max(lines.values()) == 1
    # what was removed still stands somewhere: every line of the corpus that had no repeat stays whole
    all_lines = Counter(" ".join(x.lower().split()) for t in {t for _, t in corpus if t} for x in t.split("\n"))
    left = {" ".join(x.lower().split()) for t in texts.values() for x in (t or "").split("\n")}
    passage = {w for w, n in Counter(w for t in {t for _, t in corpus if t} for w in set(runs(t, 50))).items() if n > 1}
    for text in {t for _, t in corpus if t}:
        for line in (" ".join(x.lower().split()) for x in text.split("\n")):
            if line and all_lines[line] == 1 and not passage & set(runs(text, 50)) and not line.startswith("is is"):
                assert line in left
    # the earliest occurrence keeps the passage, later ones lose just it
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None and 300 <= r["doc_id"] < 305 and r["removed"]}
    assert set(by_id) >= {301, 302, 303} and all(len(r["text"].split()) == 21 for i, r in by_id.items() if i in (301, 302, 303))


def plain_spans(rows):
    """(start, end) in code points of what goes from each row, by looking at every line and window."""
    docs = {}
    for i, text in {(i, t) for i, t in rows if t}:
        raw = text.encode()
        digest = xxhash.xxh64_intdigest(raw, 42)
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw)]
        docs[i, text] = ((i is not None, i or 0, digest - (digest >> 63 << 64)), raw, words)

    def others(units):
        """Occurrences of each unit but the earliest, with the earliest."""
        by = defaultdict(list)
        for doc, unit, start, end in units:
            by[unit].append((docs[doc][0], start, end, doc))
        return [(*o, min(found)) for found in by.values() for o in found if o != min(found)]

    lines = []
    for doc, (_, raw, words) in docs.items():
        breaks = [-1, *(k for k, b in enumerate(raw) if b == 10), len(raw)]
        for a, b in zip(breaks, breaks[1:], strict=False):
            inside = [w for w in words if a < w[0] and w[1] <= b]
            if len(inside) >= 5:
                lines.append((doc, (b"line", *(w[2] for w in inside)), inside[0][0], inside[-1][1]))
    spans = defaultdict(list)
    for _, start, end, doc, _ in others(lines):
        spans[doc].append((start, end))
    windows = []
    for doc, (_, _, words) in docs.items():
        gone = [any(a <= s and e <= b for a, b in spans[doc]) for s, e, _ in words]
        for k in range(len(words) - 49):
            if not all(gone[k : k + 50]):
                windows.append((doc, tuple(w[2] for w in words[k : k + 50]), words[k][0], words[k + 49][1]))
    for _, start, end, doc, first in others(windows):
        start = max(start, first[2]) if first[3] == doc else start
        spans[doc] += [(start, end)] * (start < end)
    found = {}
    for doc, (_, raw, _) in docs.items():
        merged = []
        for start, end in sorted(spans[doc]):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        found[doc] = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in merged]
    return found


def test_repeats_equal_a_plain_version(docs, corpus):
    want = plain_spans(corpus)
    assert sum(map(bool, want.values())) > 10
    found = line_dedup.remove_repeats(docs).select("row.doc_id", "row.text", "removed").collect()
    for doc_id, text, removed in found:
        assert [(s["start"], s["end"]) for s in removed] == want.get((doc_id, text), []), doc_id


def test_windows_are_found_at_any_place():
    rng = random.Random(9)
    passage = [f"w{rng.randint(0, 999)}" for _ in range(50)]
    for _ in range(30):
        both = []
        for _ in range(2):
            before, after = ([f"x{rng.random()}" for _ in range(rng.randint(0, 70))] for _ in range(2))
            words = line_dedup.Words(" ".join([*before, *passage, *after]))
            hashes, at = words.anchors(50, 10)
            both.append({h for h, p in zip(hashes.tolist(), at.tolist(), strict=True) if len(before) <= p <= len(before) + 40})
        assert both[0] & both[1]


def test_cut_spans():
    assert line_dedup.cut_spans("é one\ntwo ñ three\nfour", [(7, 19, 3)])[0] == "é one\nfour"
    text, removed = line_dedup.cut_spans("aa bb cc dd", [(3, 5, 1), (4, 8, 2)])
    assert text == "aa dd" and removed == [{"start": 3, "end": 8, "first_doc_id": 1}]
    assert line_dedup.cut_spans("a\nb", [(2, 3, None)])[0] == "a" and line_dedup.cut_spans("a", [(0, 1, None)])[0] == ""
