import random
import time

import numpy as np

from loghaven.llm import simhash_groups
from tests.llm.conftest import sentence


def at_once(texts):
    held = [(t or "").encode() for t in texts]
    return simhash_groups.simhashes(np.frombuffer(b"".join(held), np.uint8), np.array([0, *np.cumsum([len(b) for b in held])], np.int64))


def test_texts_at_once_have_the_values_of_each(corpus):
    rng = random.Random(3)
    texts = [t for _, t in corpus]
    texts += ["", " \t", "a", "A b", "end", " lead", "tail ", "x\x0by\x0cz\r\nw", "q" * 40, "a " * 1000, f"{'Z' * 31} {'y' * 33}  {'w' * 300} v u", "\x1fa\x1cb c\x85d e f g"]
    texts += [sentence(rng, rng.randint(1, 300)).title() for _ in range(300)]
    assert at_once(texts).tolist() == [simhash_groups.simhash(t) for t in texts]
    assert at_once([]).tolist() == [] and at_once([None, ""]).tolist() == [0, 0]


def test_texts_at_once_take_less_time():
    rng = random.Random(4)
    texts = [sentence(rng, 200) for _ in range(800)]
    at_once(texts[:50])
    took = []
    for hashed in (at_once, lambda held: [simhash_groups.simhash(t) for t in held]):
        spent = []
        for _ in range(3):
            begun = time.process_time()
            hashed(texts)
            spent.append(time.process_time() - begun)
        took.append(min(spent))
    assert 1.5 * took[0] < took[1], took
