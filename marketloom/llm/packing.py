"""Packing token pieces into windows by minimum bin slack.

A document is cut at whole windows; what remains is one piece of 1 to W-1 tokens. Only the count of pieces of
each length (at most W numbers) reaches the driver. There, the longest remaining length opens a window and a
bitset subset-sum over the remaining multiset fills it as close to W as can be; the multiset found is used as
often as the counts allow, so the number of searches depends on W, not on the corpus. Windows that can't be
filled to the last token are laid end to end instead and cut at W, and the rest of less than one window is cut
at powers of two, so that no window needs padding; only documents with such a cut are tokenized again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import bpe_for
from .common import longs_again, longs_as_text, saved, shuffle_partitions

#: Pieces of one length are numbered in so many parts, so that no length is numbered in one task; whole windows, which
#: need no partner, in WHOLE_PARTS for each shuffle partition.
PARTS, WHOLE_PARTS = 64, 4
#: Up to so many keys of cut documents (16 bytes each) are broadcast.
BROADCAST_KEYS = 200_000


RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (length -> how many, within counts) whose sum is nearest to capacity from below.

    Bit i of a set says that i can be reached. Lengths are taken from the longest down, in groups of doubling
    size, until the capacity itself is reached; the sets kept on the way give the way back.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left, group = min(int(counts[length]), capacity // length), 1
        while left > 0:
            group = min(group, left)
            steps.append((length, group, reach))
            reach |= (reach << (length * group)) & full
            left, group = left - group, group * 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, group, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + group
            at -= length * group
    return used


@dataclass
class Plan:
    """Where the pieces of each length go, by their number within the length.

    Row j: pieces first[j] to first[j] + per[j] * times[j] - 1 of length[j] go to windows base[j] on, per[j] to
    each, the first at offset[j]. From open_from[length] on, pieces lie end to end on the tail at open_at[length].
    """

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    open_from: np.ndarray
    open_at: np.ndarray
    windows: int
    tail: int


def minimum_bin_slack(counts: np.ndarray, window: int) -> Plan:
    """counts[n]: pieces of n tokens, n from 1 to window."""
    left, used = counts.astype(np.int64).copy(), np.zeros(window + 1, np.int64)
    rows, spare, windows = [], [], 0
    for top in range(window, 0, -1):
        while left[top] > 0:
            left[top] -= 1
            fill = best_fill(left, window - top) if top < window else {}
            left[top] += 1
            fill[top] = fill.get(top, 0) + 1
            times = min(int(left[n]) // c for n, c in fill.items())
            exact = sum(n * c for n, c in fill.items()) == window
            at = 0
            for n in sorted(fill, reverse=True):
                left[n] -= fill[n] * times
                if exact:
                    rows.append((n, used[n], fill[n], windows, at))
                    used[n] += fill[n] * times
                    at += n * fill[n]
                else:
                    spare.append((n, fill[n] * times))
            windows += times if exact else 0
    loose = np.zeros(window + 1, np.int64)
    for n, c in spare:
        loose[n] += c
    size = loose * np.arange(window + 1)
    cols = np.array(rows or np.empty((0, 5)), np.int64).reshape(-1, 5)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return Plan(*cols.T, used, np.cumsum(size) - size, windows, int(size.sum()))


def tail_bounds(tail: int, window: int) -> tuple[int, list[int]]:
    """Whole windows of the tail, and the power-of-two sizes of what is left, largest first."""
    rest = tail % window
    return tail // window, [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def _tokens(path: str, text: str | None, end_id: int) -> np.ndarray:
    return np.append(bpe_for(path).encode(text or ""), np.uint32(end_id)).astype("<u4")


def pack(docs: DataFrame, vocab_path: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the kept columns.

    Null and empty texts are the end id alone; repeated rows are documents of their own; no rows give no rows.
    Every id lies in exactly one piece, sequences are gapless from 0, all hold `window` tokens but the last few,
    whose sizes are powers of two. Very long texts are encoded whole. Kept columns of the result's names get `kept_`
    in front; other columns may have any names.
    """
    # The text's digest tells rows apart that share an id; equal rows may take each other's places.
    key = F.struct(F.col(doc_id).cast("long").cast("string").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    kept = {f"_k{i}": f"kept_{c}" if c in RESULT else c for i, c in enumerate(keep)}
    d, big = longs_as_text(docs.select(key.alias("_key"), *[F.col(c).alias(n) for n, c in zip(kept, keep, strict=True)], F.col(text).alias("_text")), list(kept))
    kept_schema = "id string, h long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in kept)
    d = d.select("_key.*", *kept, "_text")
    cols = ["id", "h", *kept]
    whole_parts = WHOLE_PARTS * shuffle_partitions(docs.sparkSession)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, t in enumerate(pdf["_text"]):
                ids = _tokens(vocab_path, t, end_id)
                out += [(i, a, min(window, len(ids) - a), _crc(ids[a : a + window]), len(ids)) for a in range(0, len(ids), window)]
            n, a, size, crc, total = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5
            yield pdf[cols].iloc[n].assign(start=a, length=size, ids_crc32=crc, doc_tokens=total)

    piece = ", start long, length long, ids_crc32 long, doc_tokens long"
    parts = F.when(F.col("length") == window, F.lit(whole_parts)).otherwise(F.lit(PARTS))
    pieces = saved(d.mapInPandas(cut, kept_schema + piece).withColumn("part", F.pmod(F.xxhash64("id", "h", "start"), parts).cast("int")))
    table = pieces.groupBy("length", "part").count().toPandas()  # at most window * PARTS + whole_parts rows
    full = table["length"] == window
    by_whole, by_part = np.zeros(whole_parts, np.int64), np.zeros((window + 1, PARTS), np.int64)
    by_whole[table["part"][full]] = table["count"][full]
    by_part[table["length"][~full], table["part"][~full]] = table["count"][~full]
    sizes = by_part.sum(1)
    sizes[window] = by_whole.sum()
    plan = minimum_bin_slack(sizes, window)
    before, before_whole = np.cumsum(by_part, 1) - by_part, np.cumsum(by_whole) - by_whole
    whole, sizes = tail_bounds(plan.tail, window)
    edges = np.concatenate([[whole * window], whole * window + np.cumsum(sizes)]).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((plan, before, before_whole, edges))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, before, before_whole, _ = shared.value
        # one sorted key for the plan rows of all lengths
        order = plan.length.astype(float) * 2.0**40 + plan.first
        for pdf in parts:
            n = pdf["length"].to_numpy()
            part = pdf["part"].to_numpy()
            ahead = np.where(n == window, before_whole[part % whole_parts], before[n, part % PARTS])
            number = ahead + pdf["number"].to_numpy() - 1
            open_ = number >= plan.open_from[n]
            j = np.where(open_, 0, np.maximum(np.searchsorted(order, n * 2.0**40 + number, "right") - 1, 0))
            if len(plan.length):
                k = number - plan.first[j]
                seq, off = plan.base[j] + k // plan.per[j], plan.offset[j] + k % plan.per[j] * n
            else:
                seq, off = np.zeros_like(n), np.zeros_like(n)
            at = plan.open_at[n] + (number - plan.open_from[n]) * n
            yield pdf[[*cols, "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=np.where(open_, -1, seq), offset=np.where(open_, at, off))

    w = Window.partitionBy("length", "part").orderBy("id", "h", "start")
    numbered = pieces.withColumn("number", F.row_number().over(w))
    placed = numbered.mapInPandas(place, kept_schema + piece + ", sequence_id long, offset long")
    if plan.tail:
        placed = _cut_tail(saved(placed), d, cols, kept_schema, plan.windows, window, edges, vocab_path, end_id)
    return longs_again(placed, ["id", *big]).select(F.col("id").alias("doc_id"), *[F.col(n).alias(c) for n, c in kept.items()], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _cut_tail(placed: DataFrame, d: DataFrame, cols: list[str], kept: str, windows: int, window: int, edges: np.ndarray, vocab_path: str, end_id: int) -> DataFrame:
    """Cuts what lies end to end on the tail (sequence_id -1, offset from the tail's start) at its edges."""
    whole = int(edges[0]) // window

    def split(at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start within, length, sequence, offset) of a piece's parts."""
        out, a, end = [], at, at + length
        while a < end:
            if a < edges[0]:
                s, lo, hi = a // window, a // window * window, a // window * window + window
            else:
                j = int(np.searchsorted(edges, a, "right")) - 1
                s, lo, hi = whole + j, int(edges[j]), int(edges[j + 1])
            b = min(end, hi)
            out.append((a - at, b - a, windows + s, a - lo))
            a = b
        return out

    def recut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, (text, old) in enumerate(zip(pdf["_text"], pdf["tails"], strict=True)):
                ids = None
                for start, length, crc, total, at in (x.values() for x in old):
                    got = split(at, length)
                    if len(got) > 1 and ids is None:
                        ids = _tokens(vocab_path, text, end_id)
                    out += [(i, start + x, n, crc if len(got) == 1 else _crc(ids[start + x : start + x + n]), total, s, o) for x, n, s, o in got]
            n, *rest = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 7
            yield pdf[cols].iloc[n].assign(**dict(zip(("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), rest, strict=True)))

    tail = placed.where("sequence_id < 0")
    a, b = F.col("offset"), F.col("offset") + F.col("length") - 1
    inside: Column = (F.floor(a / window) == F.floor(b / window)) & (b < int(edges[0]))
    for lo, hi in zip(edges.tolist(), edges.tolist()[1:], strict=False):
        inside = inside | ((a >= lo) & (b < hi))
    schema = kept + ", start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    item = F.array(F.struct("start", "length", "ids_crc32", "doc_tokens", "offset")).alias("tails")
    whole_rows = tail.where(inside).select(*cols, F.lit(None).cast("string").alias("_text"), item)
    # Equal rows share a key: each text row is matched once, to all cut pieces of that key.
    cuts = tail.where(~inside).select(*cols, item)
    keys = saved(cuts.select("id", "h").distinct())  # as many as the tail has windows, at most
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    docs = d.select("id", "h", "_text")
    texts = docs.join(keys, _same(docs, keys), "left_semi").dropDuplicates(["id", "h"])
    cut_rows = cuts.join(texts, _same(cuts, texts), "left").select(*[cuts[c] for c in cols], "_text", "tails")
    return placed.where("sequence_id >= 0").unionByName(whole_rows.unionByName(cut_rows).mapInPandas(recut, schema))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
