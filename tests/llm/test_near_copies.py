import random
from collections import Counter

import corpus_pipeline
from loghaven.llm import near_copies
from tests.llm.conftest import sentence


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(texts):
    """Least id of the component of each row, by comparing all with all."""
    sets = [plain_set(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if similar(x, sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least.get(find(k))) for k, (i, _) in enumerate(texts)]


def edited(rng, text, edits):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randint(0, 999)}"
    return " ".join(words)


def near_rows():
    """Chains, large groups of variants, and pairs on either side of the similarity."""
    rng = random.Random(11)
    rows = []
    for k in range(40):
        base = sentence(rng, rng.randint(40, 200))
        rows += [(1000 + 10 * k, base), *((1000 + 10 * k + e, edited(rng, base, e)) for e in range(1, 6))]
    text = sentence(rng, 150)
    rows += [(3000 + i, text := edited(rng, text, 2)) for i in range(12)]
    base = sentence(rng, 120)
    rows += [(4000 + i, edited(rng, base, 2)) for i in range(80)]
    shared = sentence(rng, 60)
    rows += [(5000 + i, f"{shared} {sentence(rng, rng.randint(5, 40))}") for i in range(60)]
    return rows


def test_groups(spark, docs, no_docs, corpus):
    assert Counter((r["doc_id"], r["component_id"]) for r in near_copies.near_groups(docs).collect()) == Counter(plain_groups(corpus))
    assert near_copies.near_groups(no_docs).collect() == []
    rows = near_rows()
    found = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter(plain_groups(rows))


def test_stage_drops_all_near_copies(spark):
    rows = near_rows()
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in kept} == {i for i, least in plain_groups(rows) if i == least}


def test_one_id_on_two_texts(spark):
    rng = random.Random(12)
    base, other = sentence(rng, 80), sentence(rng, 80)
    rows = [(1, base), (2, edited(rng, base, 1)), (2, other)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[2]])


def test_a_family_is_not_compared_all_with_all(spark, monkeypatch):
    """Members of one base that are mostly less similar than 0.8 to it and to each other."""
    rng = random.Random(13)
    base = sentence(rng, 150)
    rows = [(i, edited(rng, base, rng.choice((1, 5, 5, 6, 7)))) for i in range(160)]
    compared = []
    similar_pairs = near_copies.Texts.similar

    def counted(self, pairs):
        compared.append(pairs.distinct().count())
        return similar_pairs(self, pairs)

    monkeypatch.setattr(near_copies.Texts, "similar", counted)
    found = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter(plain_groups(rows))
    assert sum(compared) < 5 * len(rows), compared
