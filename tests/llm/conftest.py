import random

import pytest

LATIN = "al be cor du en fi gra ha il jo ka lu mo ne or pi qua ro si tu".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(LATIN) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with nulls, empty and long texts, copies, near copies and repeats."""
    rng = random.Random(5)
    rows = [(i, "\n".join(sentence(rng, rng.randint(6, 40)) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)]
    for i in range(6):
        words = rows[20 + i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words)))
    passage = sentence(rng, 60)
    for i in range(5):
        rows.append((300 + i, f"{sentence(rng, 12)} {passage} {sentence(rng, 9)}"))
    rows += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "two words"), (405, "ÀÉ ñandú 漢字 🙂 <|endoftext|> it's"), (406, sentence(rng, 6000)), (407, "is " * 3000), (None, "no id here at all but some words"), (300, rows[-1][1])]
    rows += [(7, rows[7][1]), (7, rows[7][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "en", "s", len(t or "")) for i, t in corpus], "doc_id long, text string, row string, k_id long, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
