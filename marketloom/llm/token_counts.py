"""Token counts by looking pre-tokens up where the texts lie.

A byte-level BPE never merges over the borders of its pre-tokens, and a space before a character that is no white space is
always such a border. So a text's count is the sum of the counts of the stretches between such spaces, and a stretch's
count follows from the stretch alone; these stretches are the pre-tokens here (mostly a word with its punctuation, found
several times as fast as the pattern's pieces). The first tier is a table of the frequent pre-tokens' counts: made from a
bounded sample of documents, broadcast as two flat buffers, and the same for all workers. The second tier is a bounded
cache in each worker, which takes what the table lacks, so that a pre-token is encoded about once in each worker. Neither
tier changes a result: what both lack is encoded. No pre-token is shuffled but the sample's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, bpe_for
from .common import saved

#: The first tier is made from about so many documents, those whose ids hash lowest, and keeps so many pre-tokens. Both
#: bound the broadcast (a few MB at most) and change speed only.
SAMPLE_DOCUMENTS, TABLE_SIZE = 20_000, 50_000
#: Pre-tokens that a worker's cache holds before it is emptied, and the longest one (in code points) that either tier holds.
CACHE_SIZE, LONGEST = 200_000, 64

#: Python's white space holds all that the vocabularies' patterns take for it; where it is wider, two stretches stay one.
_border = re.compile(r" (?=\S)")
_workers: dict[tuple[str, int], Lengths] = {}


@dataclass(frozen=True)
class Table:
    """The first tier as it is sent: the pre-tokens end to end in UTF-8, their ends, and their counts of tokens."""

    path: str
    text: bytes
    ends: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def of(path: str, pieces: list[str]) -> Table:
        bpe = bpe_for(path)
        raw = [p.encode() for p in pieces]
        return Table(path, b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.uint32), np.array([count(bpe, p) for p in pieces], np.uint16))

    def lengths(self) -> dict[str, int]:
        cuts = [0, *self.ends.tolist()]
        return {self.text[a:b].decode(): n for a, b, n in zip(cuts, cuts[1:], self.tokens.tolist(), strict=False)}


def count(bpe: ByteBPE, piece: str) -> int:
    """Tokens of a pre-token that has a space before it, which is its own."""
    return len(bpe.bpe.encode_ordinary(f" {piece}"))


class Lengths(dict):
    """Pre-token -> tokens. Holds the first tier, and beside it as many others as CACHE_SIZE allows."""

    def __init__(self, table: Table):
        self.table, self.bpe = table, bpe_for(table.path)
        super().__init__(table.lengths())
        self.base = len(self)

    def __missing__(self, piece: str) -> int:
        n = count(self.bpe, piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.base + CACHE_SIZE:
                self.clear()
                self.update(self.table.lengths())
            self[piece] = n
        return n


def split(text: str, special: dict[str, int]) -> list[str]:
    """The stretches of a text between special tokens' strings; one more than there are such tokens."""
    if not any(t in text for t in special):
        return [text]
    return re.split("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text)


def count_text(text: str, lengths: Lengths) -> int:
    """The start of a stretch between special tokens has no space before it, and is encoded as it is."""
    parts = split(text, lengths.bpe.special)
    n = len(parts) - 1
    for p in parts:
        first, *rest = _border.split(p)
        n += len(lengths.bpe.bpe.encode_ordinary(first)) + sum(map(lengths.__getitem__, rest))
    return n


def frequent_pieces(docs: DataFrame, path: str, key: Column, text: str) -> list[str]:
    """The pre-tokens that are most frequent in about SAMPLE_DOCUMENTS documents, in order: TABLE_SIZE at most, all of a count or none."""
    rows = docs.count()
    if not rows:
        return []
    share = min(1.0, SAMPLE_DOCUMENTS / rows)
    chosen = docs.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, seen = bpe_for(path).special, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for p in split(t, special):
                    seen.update(x for x in _border.split(p)[1:] if len(x) <= LONGEST)
                if len(seen) > 4 * TABLE_SIZE:
                    seen = Counter(dict(seen.most_common(2 * TABLE_SIZE)))
        out = seen.most_common(TABLE_SIZE)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in out], pa.string()), "n": pa.array([n for _, n in out], pa.int64())})

    found = saved(chosen.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    # How many pre-tokens have each count tells the least count whose pre-tokens fit; only these leave the executors.
    room, least = TABLE_SIZE, None
    for n, pieces in sorted(found.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):  # a row for each count in the sample
        if pieces > room:
            break
        room, least = room - pieces, n
    return sorted(r["piece"] for r in found.where(F.col("n") >= least).collect()) if least is not None else []


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: bytes of the text in UTF-8, its tokens, whether these are more than limit.

    Counts are the `tokenizers` library's for the byte-level BPE file at path, with no begin, end or added special tokens;
    a special token's string in a text is one token, as it is there by default. A null or empty text has no bytes and no
    tokens. Rows are kept as they are: repeated rows, repeated and null ids each give their row, ids pass unchanged at any
    size, other columns (whatever their names) take no part. A text is counted whole whatever its length; one without any
    border is encoded at once. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Table.of(path, frequent_pieces(docs, path, F.col(doc_id), text)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        at = (path, id(table))
        if at not in _workers:
            _workers.clear()
            _workers[at] = Lengths(table)
        lengths = _workers[at]
        for b in batches:
            n = pa.array([count_text(t.as_py(), lengths) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
