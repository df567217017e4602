"""Token ids of public tokenizer files, computed in bounded pieces.

Three kinds of file are read: ``.json`` (the ``tokenizers`` library), ``.model``
(sentencepiece) and ``.tiktoken`` ranks. A byte-level BPE ``.json`` is the common
case and gets a faster engine with the same result: its ranks are rebuilt from the
file itself and handed to tiktoken's merge loop. Two engines could classify code
points differently (other Unicode versions), so all code points of planes 0 and 1
were compared one by one (``tests/llm/test_tokens.py`` repeats it); a text with any
other code point goes to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import regex

#: Pre-token pattern of byte-level BPE (fixed value of the public file format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a long text that are encoded at once.
PIECE_CHARS = 1 << 16

#: A place where no pre-token can reach across: a letter, then a space before a letter.
_SAFE_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")

#: Code points beyond those on which the two engines were compared.
_UNCOMPARED = regex.compile("[\U00020000-\U0010ffff]")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text at safe places: ids of the pieces joined are those of the text.

    A text without a safe place is yielded whole, whatever its length.
    """
    start = 0
    while len(text) - start > size:
        found = _SAFE_CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level BPE files, by rule."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173 and not 127 <= b <= 160]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class TokenEncoder:
    """Ids of a text without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.path = path
        self._fast = self._pieces = None
        self._is_json = path.endswith(".json")
        if path.endswith(".model"):
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        elif path.endswith(".tiktoken"):
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
            self._fast = self._engine(ranks, {})
        else:
            with open(path, encoding="utf-8") as source:
                self._fast = self._from_json(json.load(source))

    @functools.cached_property
    def _library(self):
        """The ``tokenizers`` library's own encoder, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _engine(ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        return tiktoken.Encoding("public", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _from_json(self, spec: dict):
        """The fast engine, or None where the file is not plain byte-level BPE."""
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        added = spec.get("added_tokens") or []
        plain = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added)
        )
        if not plain:
            return None
        vocab = model["vocab"]
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None  # ids do not follow the order of merges
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in added}
        return self._engine({bytes(alphabet[c] for c in k): v for k, v in vocab.items() if k not in special}, special)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text as unsigned 32-bit numbers; of a null text none."""
        if not text:
            return np.empty(0, np.uint32)
        if self._pieces is not None:
            return np.asarray(self._pieces.encode(text, num_threads=1), np.uint32)
        if self._is_json and (self._fast is None or _UNCOMPARED.search(text)):
            parts = pieces(text) if self._fast is not None else (text,)
            return np.concatenate([np.asarray(self._library.encode(p, add_special_tokens=False).ids, np.uint32) for p in parts])
        parts = [np.asarray(self._fast.encode_to_numpy(p, allowed_special="all"), np.uint32) for p in pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def lengths(self, texts: list[str | None]) -> list[int]:
        """Counts of ids only: the pieces of all texts are encoded as one batch."""
        if self._pieces is not None:
            return [len(found) for found in self._pieces.encode([t or "" for t in texts], num_threads=1)]
        parts: list[str] = []
        owners: list[int] = []
        for i, text in enumerate(texts):
            for part in (pieces(text) if self._fast is not None else (text,)) if text else ():
                parts.append(part)
                owners.append(i)
        counts = [0] * len(texts)
        uncompared = [self._is_json and (self._fast is None or _UNCOMPARED.search(texts[i]) is not None) for i in owners]
        fast = [(i, p) for i, p, slow in zip(owners, parts, uncompared, strict=True) if not slow]
        slow = [(i, p) for i, p, slow in zip(owners, parts, uncompared, strict=True) if slow]
        if fast:
            for (i, _), found in zip(fast, self._fast.encode_batch([p for _, p in fast], num_threads=1, allowed_special="all"), strict=True):
                counts[i] += len(found)
        if slow:
            for (i, _), found in zip(slow, self._library.encode_batch([p for _, p in slow], add_special_tokens=False), strict=True):
                counts[i] += len(found.ids)
        return counts


_LOADED: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """The encoder of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TokenEncoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    """Place of the public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
