"""Cross-entropy difference of documents under a target and a background n-gram model.

Both are bigram models of lower-cased words with one vocabulary, order and smoothing: the background's counts
come from all documents, the target's from those marked as target. A document's own counts are taken out of a
model before it is scored, so that no document is scored by what it taught the model itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs_again
from .corpus_counts import chunk_of, corpus_counts, sum_keys, unpack_counts
from .word_hash import mix, word_hashes

#: Dirichlet weight of the unigram model in the bigram model, and what is added to every unigram count.
PRIOR, ADDED = 4.0, 0.1
_PAIR = np.uint64(0x9FB21C651E98DF25)
_START = np.array([0x5851F42D4C957F2C], np.uint64)  # even, as no word is


def _documents(pdf: pd.DataFrame) -> Iterator[tuple[object, bool, np.ndarray, np.ndarray]]:
    """(id, is target, word keys, bigram keys) of each document of a chunk; rows of null text mark target ids."""
    target = set(pdf.loc[pdf["text"].isna(), "id"])
    own = pdf[pdf["text"].notna()]
    ids = own["id"].tolist()
    for i, words in word_hashes(own["text"].tolist()):
        words = words | np.uint64(1)
        before = np.concatenate([_START, words])[:-1]
        yield ids[i], ids[i] in target, words, mix(before * _PAIR + words) & ~np.uint64(1) if len(words) else words


def _own_keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words have odd keys, bigrams and the start of a document even ones. Channels: background and target count."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for _, is_target, words, pairs in _documents(pdf):
            if len(words):
                keys, n = np.unique(np.concatenate([words, pairs, _START]), return_counts=True)
                held.append((keys, np.stack([n, n * is_target], 1)))
                size += len(keys)
            if size > 1 << 20:
                yield sum_keys(iter(held), 2)
                held, size = [], 0
        yield sum_keys(iter(held), 2)

    return sum_keys(parts(), 2)


def _summary(keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Vocabulary size, background tokens, target tokens."""
    words = keys & np.uint64(1) == 1
    return np.array([words.sum(), *totals[words].sum(0)], float)


def _loss(word: np.ndarray, pair: np.ndarray, before: np.ndarray, tokens: float, vocabulary: float) -> float:
    """Mean bits of a token, from the counts of each word, its bigram and the word before."""
    unigram = (word + ADDED) / (tokens + ADDED * (vocabulary + 1))
    return float(-np.log2((pair + PRIOR * unigram) / (before + PRIOR)).mean())


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, target_loss, background_loss, difference for every row of docs.

    target: a table with the ids of target documents in column doc_id. difference = target_loss - background_loss
    in bits a token; below 0: more like the target. Null and empty texts have no tokens and 0 for all three; null
    ids are kept, and are never targets; rows that share a target id are all targets; no rows give no rows. Very long
    texts count whole; other columns, whatever their names, take no part.
    """
    marks = target.select(F.col(doc_id).cast("long").alias("id"), F.lit(None).cast("string").alias("text")).where("id IS NOT NULL").distinct()
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).unionByName(marks)
    # Null ids are dealt by text.
    d = d.select(chunk_of(F.coalesce("id", F.xxhash64("text")), d).alias("chunk"), F.col("id").cast("string").alias("id"), "text")

    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("bucket")
        counts = np.concatenate([np.zeros((0, 2), np.int64), *[unpack_counts(t, 2) for t in answers["totals"]]])
        vocabulary, *tokens = np.sum([np.zeros(3), *answers["stats"]], axis=0)
        keys = _own_keys(pdf)[0]
        out = []
        for i, is_target, words, pairs in _documents(pdf):
            n = len(words)
            if not n:
                out.append((i, 0, 0.0, 0.0))
                continue
            own, where, times = np.unique(np.concatenate([words, pairs, _START]), return_inverse=True, return_counts=True)
            at = np.searchsorted(keys, own)
            loss = []
            for channel, member in ((1, is_target), (0, True)):
                c = (counts[at, channel] - times * member)[where]
                before = np.concatenate([c[-1:], c[: n - 1]])
                loss.append(_loss(c[:n], c[n : 2 * n], before, tokens[channel] - n * member, vocabulary))
            out.append((i, n, *loss))
        got = pd.DataFrame(out, columns=["id", "n_tokens", "target_loss", "background_loss"])
        return got.assign(difference=got["target_loss"] - got["background_loss"])

    counts = corpus_counts(d, _own_keys, 2, "aligned", _summary)
    scored = d.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(run, "id string, n_tokens long, target_loss double, background_loss double, difference double")
    return longs_again(scored, ["id"])
