"""Exact corpus-wide counts of hashed keys, sent back to the chunks of documents that hold the keys.

Documents are dealt to chunks by id. Each chunk sums its own keys and sends each range of the key space to one
bucket as a sorted block; buckets add up the blocks and answer each chunk. A key that every document has thus
reaches its bucket once from each chunk, and no key's documents are ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Chunks and buckets for each shuffle partition.
PER_PARTITION = 2


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are almost all zero and compress."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, or of 64-bit ones if any count needs them; the first byte says which."""
    width = 4 if int(counts.max(initial=0)) < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(counts.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()


def unpack_counts(data: bytes, channels: int) -> np.ndarray:
    width = data[0] if data else 4
    planes = np.frombuffer(data, np.uint8, offset=min(1, len(data))).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64).reshape(-1, channels)


def chunk_of(key: Column, df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PER_PARTITION * shuffle_partitions(df.sparkSession))).cast("int")


def sum_keys(parts: Iterator[tuple[np.ndarray, np.ndarray]], channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts over all (keys, counts) parts."""
    parts = list(parts)
    if not parts:
        return np.empty(0, np.uint64), np.zeros((0, channels), np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts])
    total = np.zeros((len(keys), channels), np.int64)
    for j in range(channels):  # doubles are exact up to 2**53
        total[:, j] = np.bincount(where, counts[:, j], len(keys)).astype(np.int64)
    return keys, total


def corpus_counts(d: DataFrame, own_keys: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], channels: int, answer: str, summary: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """chunk, bucket, keys, totals, stats for each chunk and bucket.

    d: rows with a column chunk; own_keys: a chunk's sorted distinct keys and counts. answer 'shared': keys that
    at least two documents hold (first channel), with their totals; 'aligned': the totals of the chunk's own keys
    in their order, without the keys. stats: what summary makes of all keys and totals of the bucket; with a summary
    every chunk hears from every bucket that has keys.
    """
    n = PER_PARTITION * shuffle_partitions(d.sparkSession)
    width = (1 << 64) // n + 1

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = own_keys(pdf)
        cuts = np.searchsorted(keys, np.array([i * width for i in range(1, n)], np.uint64))
        at = [0, *cuts.tolist(), len(keys)]
        rows = [(i, int(pdf["chunk"].iloc[0]), pack_keys(keys[a:b]), pack_counts(counts[a:b])) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        blocks = [(unpack_keys(k), unpack_counts(c, channels)) for k, c in zip(pdf["keys"], pdf["counts"], strict=True)]
        keys, totals = sum_keys(iter(blocks), channels)
        stats, out = (summary(keys, totals).tolist() if summary else []), []
        for chunk, (own, _) in zip(pdf["chunk"], blocks, strict=True):
            at = np.searchsorted(keys, own)
            if answer == "shared":
                at = at[totals[at, 0] > 1]
            out.append((chunk, pdf["bucket"].iloc[0], pack_keys(keys[at]) if answer == "shared" else b"", pack_counts(totals[at]), stats))
        if summary:
            have = set(pdf["chunk"])
            out += [(c, pdf["bucket"].iloc[0], b"", b"", stats) for c in range(n) if c not in have]
        return pd.DataFrame(out, columns=["chunk", "bucket", "keys", "totals", "stats"])

    sent = d.groupBy("chunk").applyInPandas(send, "bucket int, chunk int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(add, "chunk int, bucket int, keys binary, totals binary, stats array<double>")
