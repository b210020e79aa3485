"""Context-triggered piecewise hashing.

A hash rolling over seven bytes ends a chunk where it is -1 modulo the block size; each chunk gives one letter.
A fingerprint is the block size with the letters at that size and at twice the size. Two fingerprints are alike
by the edit distance (insertions and deletions) of letters made at the same block size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs_again, shuffle_partitions

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST_BLOCK, LENGTH, GATE = 7, 3, 64, 7


def _rolling(data: bytes) -> np.ndarray:
    c = np.frombuffer(data, np.uint8).astype(np.uint32)
    total, mixed = c * np.uint32(WINDOW + 1), c.copy()
    for k in range(1, WINDOW):
        old = c[:-k]
        total[k:] += old * np.uint32(WINDOW + 1 - k)
        mixed[k:] ^= old << np.uint32(5 * k)
    return total + mixed


def _letters(data: bytes, ends: np.ndarray, most: int) -> str:
    """A letter for each chunk; after `most - 1` chunks the rest is one."""
    cuts = [0, *ends[: most - 1].tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(LETTERS[(zlib.crc32(data[a:b]) * 0x9E3779B1 >> 24) & 63] for a, b in zip(cuts, cuts[1:], strict=False))


def fingerprint(text: str | None) -> str:
    """block size:letters:letters at twice the size. Null is empty text, whose fingerprint has no letters."""
    data = (text or "").encode("utf-8", "surrogatepass")
    roll = _rolling(data) + np.uint32(1)
    at = np.flatnonzero(roll % np.uint32(LEAST_BLOCK) == 0)
    multiple = roll[at] // np.uint32(LEAST_BLOCK)  # a chunk ends at block 3 * 2**i where 2**i divides this
    level = 0
    while (LEAST_BLOCK << level) * LENGTH < len(data):
        level += 1
    ends = lambda i: at[multiple & np.uint32((1 << i) - 1) == 0] + 1
    one = ends(level)
    while level and len(one) < LENGTH // 2:
        level -= 1
        one = ends(level)
    return f"{LEAST_BLOCK << level}:{_letters(data, one, LENGTH)}:{_letters(data, ends(level + 1), LENGTH // 2)}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - edit distance / both lengths; 0 unless they share a run of GATE letters (half of the shorter, if that is less)."""
    if not a or not b:
        return 0.0
    n = min(GATE, (min(len(a), len(b)) + 1) // 2)
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    if not any(b[i : i + n] in runs for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where no block size is common."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    m, n = int(bx), int(by)
    if m == n:
        return max(_alike(x1, y1), _alike(x2, y2))
    if m == 2 * n:
        return _alike(x1, y2)
    return _alike(x2, y1) if n == 2 * m else 0.0


def next_in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, extra, id, text such that within a bucket, by (extra, id descending, digest), each row that is not
    extra is followed by the next document, and the last document of all by the first.

    Buckets are ranges of ids, several for each shuffle partition; the first row of each is copied as an extra row
    to the bucket before it. Null ids come last; rows that share an id are ordered by a digest of the text.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("key", F.coalesce("id", F.lit(-(2**63))))
    n = 8 * shuffle_partitions(spark)
    bounds = sorted(set(d.select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)))
    ranges = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="k", outputCol="bucket") if bounds else None
    d = d.withColumn("k", F.col("key").cast("double"))
    d = (ranges.transform(d) if ranges else d.withColumn("bucket", F.lit(0.0))).drop("k")
    tops = sorted((r["bucket"], r["top"]) for r in d.groupBy("bucket").agg(F.max("key").alias("top")).collect())  # one row a bucket
    moves = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    own = d.withColumn("extra", F.lit(False))
    if not moves:
        return own
    to = F.broadcast(spark.createDataFrame(moves, "key long, _to double"))  # a row for each bucket
    first = d.join(to, "key").withColumns({"bucket": F.col("_to"), "extra": F.lit(True)}).select(own.columns)
    return own.unionByName(first)


def fingerprint_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is a copy whose last third comes from the start of the next document by descending id; after the last
    comes the first. Null texts are empty ones, whose fingerprint is that of no chunk; null ids come last; rows that share an
    id follow each other by a digest of their texts, and repeated rows each have their row, with one another as next. A
    table of one row has itself as next; an empty one gives an empty one. Texts are read whole whatever their length, a
    task holds two of them at a time besides a batch. Other columns may have any names.
    """
    rows = next_in_order(docs, doc_id, text)
    rows = rows.withColumn("digest", F.xxhash64("text")).repartition(shuffle_partitions(docs.sparkSession), "bucket")
    rows = rows.sortWithinPartitions("bucket", "extra", F.desc("key"), "digest").select("bucket", "extra", F.col("id").cast("string").alias("id"), "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its successor
        for pdf in parts:
            out = []
            for bucket, extra, i, t in zip(pdf["bucket"], pdf["extra"], pdf["id"], pdf["text"], strict=True):
                f = fingerprint(t)
                if held is not None and held[0] == bucket:
                    _, hi, ht, hf = held
                    k = len(ht) // 3
                    edited = ht[: len(ht) - k] + t[:k]
                    ef = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((hi, len(ht), sha, hf, ef, likeness(hf, ef), likeness(hf, f)))
                held = None if extra else (bucket, i, t, f)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return longs_again(rows.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"), ["doc_id"])
