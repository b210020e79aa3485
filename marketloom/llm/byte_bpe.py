"""Byte-level BPE ids.

The vocabulary file is a `tokenizers` JSON; the merges run in tiktoken, whose ids are the same (tests compare
them) at about five times the speed.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: the public pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, ByteBPE] = {}


def _byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes -> id, and special token -> id, of a tokenizers BPE file. Its ids must follow the order of its merges, and
    its special tokens must be cut out of a text as they stand: otherwise tiktoken would give other ids."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters, vocab = _byte_alphabet(), file["model"]["vocab"]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file["added_tokens"]):
        raise ValueError(f"{path}: special tokens that take their surroundings are not known here")
    pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
    made = [vocab["".join(p)] for p in pairs]
    if made != sorted(made):
        raise ValueError(f"{path}: ids do not follow the merges")
    return {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in special}, special


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken

        ranks, self.special = ranks_of(path)
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers; a special token's string is that token, as in the library."""
        if any(t in text for t in self.special):
            return np.array(self.bpe.encode(text, allowed_special="all"), "<u4")
        return np.array(self.bpe.encode_ordinary(text), "<u4")


def bpe_for(path: str) -> ByteBPE:
    """One for each Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
