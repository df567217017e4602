import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loghaven.llm import packing, tokens
from loghaven.llm.common import byte_batches
from loghaven.llm.token_count import count_tokens


@pytest.fixture(scope="module")
def engine():
    return tokens.TokenEncoder(tokens.default_tokenizer())


def library(engine, text):
    return engine._library.encode(text, add_special_tokens=False).ids


def test_engines_agree_on_every_code_point(engine):
    assert engine._fast is not None
    for start in range(0, 0x20000, 512):
        texts = [f"a{c}b {c}1{c} {c}{c}\n{c} !{c}" for c in map(chr, range(start, start + 512)) if not "\ud800" <= c <= "\udfff"]
        for text, want in zip(texts, engine._library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert engine._fast.encode(text, allowed_special="all") == want.ids


def test_pieces_do_not_change_ids(engine):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "é", "'s", "1", " x", "...", "<|endoftext|>"]) for _ in range(4000))
    for size in (1, 7, 64):
        assert "".join(tokens.pieces(text, size)) == text
        assert [i for p in tokens.pieces(text, size) for i in library(engine, p)] == library(engine, text)
    assert engine.ids("𠀀 漢").tolist() == library(engine, "𠀀 漢") and engine.ids(None).tolist() == []
    assert list(tokens.pieces("x" * 100, 10)) == ["x" * 100]


def test_other_libraries():
    import public_tokenizers as P

    assert tokens.TokenEncoder(P.path("piece_bpe_32k.model")).lengths(["hello world", ""])[1] == 0
    assert tokens.TokenEncoder(P.path("word_bpe_49k.json"))._fast is None
    assert tokens.TokenEncoder(P.path("byte_bpe_50k.tiktoken")).ids("hello").tolist() == tokens.encoder(tokens.default_tokenizer()).ids("hello").tolist()


def test_counts(docs, no_docs, corpus, engine):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs).collect())
    assert got == Counter((i, len((t or "").encode()), n := len(library(engine, t or "")), n > 1024) for i, t in corpus)
    assert count_tokens(no_docs).collect() == []


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_batches_are_balanced_by_bytes(engine, corpus, most):
    texts = pa.array([t for _, t in corpus] + ["漢" * 30, "𠀀 漢", "<|endoftext|>"])
    batches = list(byte_batches(texts, most))
    assert [t for b in batches for t in b] == texts.to_pylist() and list(byte_batches(texts.slice(0, 0), most)) == []
    assert all(len(b) == 1 or sum(len((t or "").encode()) for t in b) <= most for b in batches)
    assert [n for b in batches for n in engine.lengths(b)] == [len(library(engine, t or "")) for t in texts.to_pylist()]


def test_segment_tree_finds_the_tightest():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 64) for _ in range(200)), reverse=True)
        free: list[int] = []
        for n, (at, offset) in zip(lengths, packing.best_fit_decreasing(lengths, 64), strict=True):
            fits = [c for c in free if c >= n]
            if fits:
                assert free[at] == min(fits)
            else:
                assert at == len(free)
                free.append(64)
            assert offset == 64 - free[at]
            free[at] -= n


def check_packing(found, corpus, engine, window, end_id):
    texts = Counter()
    for i, t in corpus:
        texts[i, zlib.crc32(np.array([*library(engine, t or ""), end_id], "<u4").tobytes())] += 1
    ids = {k: None for k in texts}
    by_id = defaultdict(list)
    for i, t in corpus:
        by_id[i].append([*library(engine, t or ""), end_id])
    pieces = Counter()
    for i, lists in by_id.items():
        for x in lists:
            for s in range(0, len(x), window):
                pieces[i, s, len(x[s : s + window]), zlib.crc32(np.array(x[s : s + window], "<u4").tobytes()), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == pieces and ids
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    return sequences


@pytest.mark.parametrize(("window", "shard"), [(2048, 50_000), (32, 10)])
def test_packing(docs, no_docs, corpus, engine, window, shard):
    found = packing.pack(docs, window=window, shard_pieces=shard).collect()
    check_packing(found, corpus, engine, window, packing.END_ID)
    assert packing.pack(no_docs).collect() == []
