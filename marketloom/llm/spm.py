"""SentencePiece encoding for merge-type (BPE) vocabularies by a score-ordered agenda.

A text becomes symbols, one a character. Every adjacent pair whose joined text is a piece is on an agenda; the
best score (ties: the leftmost) is merged and its new neighbours join the agenda, until none is left. What is no
piece falls back to its bytes. Pieces hold the space mark only in front, so a text is cut before each mark that
follows another character and each distinct word is merged once. The words of a batch share one agenda array, of
which each step takes every word's best pair; long words have a heap of their own. New words are checked
against the library.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs_again, longs_as_text

MARK = "▁"
_CUT = re.compile(rf"(?<=[^{MARK}])(?={MARK})")
MAX_WORD, MAX_CACHE = 64, 300_000
#: A batch holds so many characters at most, or one text.
BATCH_CHARS = 2_000_000
#: Words that are merged together, so that their arrays stay in the processor's cache.
WORDS_AT_ONCE, SLOT_BITS = 16_384, 20
NONE = (1 << 31) - 1  # the order of a pair that is no piece
EMPTY = -(1 << 30)  # a place without a symbol
_loaded: dict[str, MergeEncoder] = {}


class MergeEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        scores = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        place = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.order = {p: place[x] for p, x in scores.items()}  # 0 is merged first; equal scores are equal
        byte_ids = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.bytes = [byte_ids.get(b, lib.unk_id()) for b in range(256)]
        self.end = lib.eos_id()
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.fallback: dict[int, list[int]] = {}
        self._forget()
        self._tables()

    def _tables(self) -> None:
        """Numbers for the symbols (pieces, and characters of pieces), and for each pair of them that joins to a piece its order."""
        symbols = [*self.ids, *sorted({c for p in self.ids for c in p} - self.ids.keys())]
        number = {p: k for k, p in enumerate(symbols)}
        self.piece_of = np.array([self.ids[p] if p in self.ids else -ord(p) - 1 for p in symbols], np.int32)
        self.symbol_of = -np.arange(0x110000, dtype=np.int32) - 1  # -code - 1: a character of no piece
        for p, k in number.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = k
        self.stride = len(symbols)
        pairs = [(number[p[:i]] * self.stride + number[p[i:]], self.order[p], number[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        key, order, joined = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        self.pair_key, self.pair_order, self.pair_joined = np.append(key, -1), np.append(order, NONE), np.append(joined, -1).astype(np.int32)
        # Hash tables of pair numbers: what finds its slot taken goes to the next table.
        self.slots, left = [], np.arange(len(key))
        while len(left):
            table = np.full(1 << SLOT_BITS, len(key), np.int32)
            at = self._slot(key[left], len(self.slots))
            table[at[::-1]] = left[::-1]
            self.slots.append(table)
            left = left[table[at] != left]

    @staticmethod
    def _slot(key: np.ndarray, level: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E018 * level & (1 << 64) - 1)) >> np.uint64(64 - SLOT_BITS)

    def merge(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        sym = self._merge_one(list(text))
        out = list(map(self.ids.get, sym))
        if None in out:
            known = zip(sym, out, strict=True)
            out = [x for s, i in known for x in ([i] if i is not None else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")])]
        return out

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of each pair of symbols (NONE if it is no piece) and the symbol it becomes."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.stride + right)
        none = len(self.pair_key) - 1
        out, todo = np.full(len(key), none, np.int32), None
        for level, table in enumerate(self.slots):
            own = key if todo is None else key[todo]
            at = table[self._slot(own, level)]
            hit = self.pair_key[at] == own
            if todo is None:
                out = np.where(hit, at, none)
                todo = np.flatnonzero(~hit & (at != none))
            else:
                out[todo[hit]] = at[hit]
                todo = todo[~hit & (at != none)]
            if not len(todo):
                break
        return self.pair_order[out], self.pair_joined[out]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, given without the mark in front of them, end to end, and how many each has. Words of like length are merged together, long ones one by one."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        by = np.argsort(size, kind="stable")
        short = by[: np.searchsorted(size[by], MAX_WORD, "right")]
        done = []  # words, ids, how many
        for a in range(0, len(short), WORDS_AT_ONCE):
            own = short[a : a + WORDS_AT_ONCE]
            done += [(own[k], ids, n) for k, ids, n in self._merge_together([words[k] for k in own.tolist()], size[own])]
        for k in by[len(short) :].tolist():
            ids = np.array(self.merge(MARK + words[k]), np.int32)
            done.append((np.array([k]), ids, np.array([len(ids)])))
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        which, ids, n = (np.concatenate(x) for x in zip(*done, strict=True))
        back = np.argsort(which)
        return _runs(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    def _merge_together(self, words: list[str], size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A column for each word, a row for each of its places. The agenda holds the order of the pair that begins at
        each place, with the place in its low bits; each round takes the least of every column."""
        n, rows = len(words), int(size.max()) + 1  # the last row is empty
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        sym = np.full((rows, n), EMPTY, np.int32)
        sym[place, np.repeat(np.arange(n), size)] = self.symbol_of[np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)]
        order, joined = self._look_up(sym.ravel(), np.append(sym[1:].ravel(), np.full(n, EMPTY, np.int32)))
        agenda = order.reshape(rows, n) << 7 | np.arange(rows)[:, None]
        joined = joined.reshape(rows, n)
        after = np.repeat(np.arange(1, rows + 1, dtype=np.int16), n).reshape(rows, n)
        before = after - 2
        after[-2:] = rows - 1
        before[0] = rows - 1
        done, which = [], np.arange(n)
        while True:
            best = agenda.min(0)
            open_ = np.flatnonzero(best < NONE << 7)
            if 2 * len(open_) < n:
                closed = np.flatnonzero(best >= NONE << 7)
                done.append((which[closed], sym[:, closed]))
                if not len(open_):
                    break
                sym, agenda, joined, after, before = (np.ascontiguousarray(x[:, open_]) for x in (sym, agenda, joined, after, before))
                which, best, n = which[open_], best[open_], len(open_)
                open_ = np.arange(n)
            s, g, m, nx, pv = (x.ravel() for x in (sym, agenda, joined, after, before))
            i = (best[open_] & 127) * n + open_
            j = nx[i].astype(np.int64) * n + open_
            k_row = nx[j]
            k, h_row = k_row.astype(np.int64) * n + open_, pv[i]
            h = h_row.astype(np.int64) * n + open_
            s[i] = own = m[i]
            s[j], g[j], nx[i] = EMPTY, NONE << 7, k_row
            pv[k] = best[open_] & 127
            o, m[i] = self._look_up(own, s[k])
            g[i] = o << 7 | best[open_] & 127
            o, m[h] = self._look_up(s[h], own)
            g[h] = o << 7 | h_row
        for own, sym in done:
            x = sym.T
            held = x != EMPTY
            flat, n = x[held], held.sum(1)
            ids = np.where(flat < 0, flat, self.piece_of[np.maximum(flat, 0)])
            odd = np.flatnonzero(ids < 0)
            if len(odd):  # characters of no piece become their bytes
                into = [self._bytes_of(-x - 1) for x in ids[odd].tolist()]
                more = np.ones(len(ids), np.int64)
                more[odd] = list(map(len, into))
                of = np.repeat(np.arange(len(n)), n)
                start = np.cumsum(more) - more
                wide = np.empty(int(more.sum()), np.int32)
                wide[start[ids >= 0]] = ids[ids >= 0]
                wide[np.repeat(start[odd], more[odd]) + np.concatenate([np.arange(len(b)) for b in into])] = list(chain.from_iterable(into))
                ids, n = wide, np.bincount(of, more, len(n)).astype(np.int64)
            yield own, ids, n

    def _bytes_of(self, code: int) -> list[int]:
        if code not in self.fallback:
            self.fallback[code] = [self.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass")]
        return self.fallback[code]

    def _merge_one(self, sym: list[str]) -> list[str]:
        """The agenda is a heap, so that the time grows little faster than the length."""
        order = self.order
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order[p], i, p) for i, p in enumerate(map("".join, zip(sym, sym[1:], strict=False))) if p in order]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i] if sym[i] else n
            if j >= n or sym[i] + sym[j] != piece:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = piece, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + sym[k]) in order:
                    heapq.heappush(agenda, (order[p], i, p))
            h = before[i]
            if h >= 0 and (p := sym[h] + piece) in order:
                heapq.heappush(agenda, (order[p], h, p))
        return [s for s in sym if s]

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the mark in front of it."""
        if not text:
            return []
        if self.cuts and MARK not in text:
            plain = text.split(" ")
            if "" not in plain:
                return plain
        marked = MARK + text.replace(" ", MARK)
        return [w[1:] for w in _CUT.split(marked)] if self.cuts else [marked[1:]]

    def _forget(self) -> None:
        """No word is known but the end id, which is number 0."""
        self.number: defaultdict[str | None, int] = defaultdict(count(1).__next__, {None: 0})
        self.flat, self.size = np.array([self.end], np.int32), np.array([1], np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, end to end, and how many each has; new words are compared with
        the library's own ids."""
        if max(len(self.number), len(self.flat) // 8) > MAX_CACHE:
            self._forget()
        split = [[*self.words(t), None] for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        new = list(islice(self.number, known, None))
        if new:
            ids, n = self.merge_words(new)
            theirs = self.lib.encode(new, num_threads=1)
            n_theirs = np.fromiter(map(len, theirs), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(n_theirs.sum()))
            if not np.array_equal(n, n_theirs) or not np.array_equal(ids, flat):
                starts = np.cumsum(n) - n
                for w, a, m, other in zip(new, starts.tolist(), n.tolist(), theirs, strict=True):
                    if w and ids[a : a + m].tolist() != other:  # the library has no input that gives a mark alone
                        self._forget()
                        raise RuntimeError(f"the library encodes {w!r} otherwise: {other}, not {ids[a : a + m].tolist()}")
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, n])
        size = self.size[at]
        ids = _runs(self.flat, (np.cumsum(self.size) - self.size)[at], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_words)])]
        return ids, np.diff(ends)

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1) if ids else []


def _runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start, end to end."""
    return flat[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def encoder_for(path: str) -> MergeEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = MergeEncoder(path)
    return _loaded[path]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of BATCH_CHARS characters at most, or of one text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > BATCH_CHARS:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns with the ids of each text and, if asked for, what they decode to.

    Null and empty texts are the end id alone. Very long texts are batches of their own; words without a space
    take a heap agenda, so that time grows little faster than length. Repeated rows stay, each with its ids; other
    columns may have any names; an empty table gives an empty table.
    """
    d, big = longs_as_text(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")), list(keep))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields[:-1]) + f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder_for(path)
        for whole in parts:
            texts = whole["__text"].tolist()
            for a, b in _batches(texts):
                flat, size = enc.encode_batch(texts[a:b])
                got = np.split(flat, np.cumsum(size)[:-1])
                out = whole[list(keep)].iloc[a:b].assign(**{ids: got})
                yield out.assign(**{decoded: enc.decode_batch([x.tolist() for x in got])}) if decoded else out

    return longs_again(d.mapInPandas(run, schema), big)
