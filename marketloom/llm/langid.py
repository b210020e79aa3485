"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import longs_again, longs_as_text

BITS, MAX_N, ALPHA = 16, 3, 0.5
#: The broadcast matrix holds 4 bytes for each language and bucket; with more languages there are fewer buckets.
MAX_MATRIX_MB, LEAST_BITS = 64, 8
UNKNOWN = "und"
SLICE = 1 << 20
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(text: str, bits: int = BITS, max_n: int = MAX_N) -> Iterator[np.ndarray]:
    """Bucket of every 1 to max_n character window of the lower-cased text, in slices of bounded size."""
    text = f" {text.lower()} "
    for at in range(0, max(1, len(text)), SLICE):
        own = min(SLICE, len(text) - at)
        c = np.frombuffer(text[at : at + SLICE + max_n - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(max_n):
            h = (h[: len(c) - n] ^ c[n:]) * _MUL[n % 3]
            h ^= h >> np.uint32(15)
            if len(h):
                yield (h[:own] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def batch_buckets(texts: list[str], bits: int = BITS, max_n: int = MAX_N) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of every window of many texts at a time, for each window size; numbers are sorted."""
    padded = [f" {t.lower()} " for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(padded)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the text's end
    h = np.zeros(len(c), np.uint32)
    for n in range(max_n):
        h = (h[: len(c) - n] ^ c[n:]) * _MUL[n % 3]
        h ^= h >> np.uint32(15)
        whole = left[: len(h)] > n
        yield of[: len(h)][whole], ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits))[whole]


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray
    bits: int = BITS

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log prior and likelihood of each text and language: the rows of a sparse matrix of windows times the matrix
        of log probabilities, summed by text. Texts longer than a slice are summed slice by slice."""
        out = np.tile(self.prior.astype(float), (len(texts), 1))
        if len(texts) == 1:
            for b in ngram_buckets(texts[0], self.bits):
                out[0] += self.log_prob[b].sum(0, dtype=float)
            return out
        for of, b in batch_buckets(texts, self.bits):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first):
                out[of[first]] += np.add.reduceat(self.log_prob[b], first, axis=0, dtype=float)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language (ties: first in order) of each text and its posterior; `und` and 0 without a letter or model."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        room = max(1, SLICE // max(1, len(self.langs)))
        todo, held = [], 0

        def run() -> None:
            total = self.totals([texts[i] for i in todo])
            best = total.argmax(1)
            sure = 1 / np.exp(total - total[np.arange(len(todo)), best][:, None]).sum(1)
            for i, k, p in zip(todo, best.tolist(), sure.tolist(), strict=True):
                langs[i], scores[i] = self.langs[k], p

        for i, t in enumerate(texts):
            if not self.langs or not has_letter(t):
                continue
            if todo and held + len(t) > room:
                run()
                todo, held = [], 0
            todo.append(i)
            held += len(t)
        if todo:
            run()
        return langs, scores


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> LanguageModel:
    """Counts over all given documents whose text and language are not null; no rows give a model without languages."""
    d = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("g")).where("t IS NOT NULL AND g IS NOT NULL")
    n_langs = d.select("g").distinct().count()
    while bits > LEAST_BITS and n_langs << bits + 2 > MAX_MATRIX_MB << 20:
        bits -= 1
    size = 1 << bits

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for g, s in sums.items():
                at = np.flatnonzero(s)
                yield pd.DataFrame({"g": [g], "docs": [seen[g]], "b": [at.astype(np.int32)], "n": [s[at]]})
            sums.clear()
            seen.clear()

        for pdf in parts:
            for t, g in zip(pdf["t"], pdf["g"], strict=True):
                if g not in sums:
                    if len(sums) << bits + 3 >= MAX_MATRIX_MB << 20:
                        yield from flush()
                    sums[g], seen[g] = np.zeros(size, np.int64), 0
                seen[g] += 1
                for b in ngram_buckets(t, bits):
                    if len(b) > size // 4:
                        sums[g] += np.bincount(b, minlength=size)
                    else:
                        np.add.at(sums[g], b, 1)
        yield from flush()

    parts = d.mapInPandas(count, "g string, docs long, b array<int>, n array<long>")
    rows = parts.select("g", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("b"), F.col("docs").alias("n"))), F.arrays_zip("b", "n"))).alias("x"))
    table = rows.groupBy("g", F.col("x.b").alias("b")).agg(F.sum("x.n").alias("n")).toPandas()  # a matrix of MAX_MATRIX_MB at most
    langs = sorted(table["g"].unique())
    counts, prior = np.zeros((size, len(langs))), np.zeros(len(langs))
    for i, (_, own) in enumerate(table.groupby("g", sort=True)):
        b, n = own["b"].to_numpy(), own["n"].to_numpy()
        counts[b[b >= 0], i] = n[b >= 0]
        prior[i] = n[b < 0].sum()
    log_prob = np.log(counts + ALPHA) - np.log(counts.sum(0, keepdims=True) + ALPHA * size)
    return LanguageModel(langs, log_prob.astype(np.float32), np.log(prior / max(1, prior.sum())) if len(langs) else prior, bits)


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column | str], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns with the language and its score (columns out), a row for each document, repeated rows included.

    Null, empty and letterless texts get `und`; very long texts count whole; no rows give no rows; kept columns of
    the names in `out` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*keep, F.col(text).alias("__text"))
    names = [c for c in d.columns if c != "__text" and c not in out]
    d, big = longs_as_text(d, names)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            langs, sure = shared.value.predict(pdf["__text"].tolist())
            yield pdf[names].assign(**{out[0]: langs, out[1]: sure})

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields if f.name in names)
    return longs_again(d.mapInPandas(score, f"{schema}`{out[0]}` string, `{out[1]}` double"), big)
