"""64-bit hashes of words and word windows of many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in slices of about so many bytes, longer ones cut at white space.
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        inverse = pow(int(_ODD), -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_ODD, np.uint64(inverse))]
    return _powers[0], _powers[1]


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: sum of table[byte] * odd**position, from prefix sums, then mixed."""
    b = np.frombuffer(data, np.uint8)
    white = _WHITE[b]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[b] * up[: len(b)], dtype=np.uint64)])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hash of each lower-cased word) of each text in order; null is empty. Words are cut at ASCII white space."""
    group: list[tuple[int, bytes]] = []
    size = 0

    def run() -> Iterator[tuple[int, np.ndarray]]:
        if not group:
            return
        start, h = _words_of(b"\n".join(d for _, d in group))
        ends = np.cumsum([len(d) + 1 for _, d in group])
        cuts = np.searchsorted(start, ends)
        lo = 0
        for (i, _), hi in zip(group, cuts.tolist(), strict=True):
            yield i, h[lo:hi]
            lo = hi

    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if group and size + len(data) > SLICE:
            yield from run()
            group, size = [], 0
        if len(data) > SLICE:
            yield i, _long(data)
            continue
        group.append((i, data))
        size += len(data) + 1
    yield from run()


def _long(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            cut = max(data.rfind(w, at, end) for w in (b" ", b"\n", b"\t"))
            if cut > at:
                end = cut
            else:  # one word longer than a slice
                ends = [e for w in (b" ", b"\n", b"\t") if (e := data.find(w, end)) >= 0]
                end = min(ends, default=len(data))
        out.append(_words_of(data[at:end])[1])
        at = end
    return np.concatenate(out)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; a text of 1 to n-1 words has one window of all its words, an empty one none."""
    if not len(words):
        return words
    if len(words) < n:
        return windows(np.concatenate([words, np.full(n - len(words), 1, np.uint64)]), n)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * _ODD + words[k : k + len(total)]
    return mix(total)
