"""Near-duplicate documents by improved consistent weighted sampling.

A document is its multiset of five-word shingles, each weighted by its count times a damped inverse document
frequency over the distinct texts of the corpus. Weighted samples in bands bring likely pairs together; a pair
is a link if its weighted or its plain Jaccard similarity, computed exactly, is at least the threshold. Classes are the
components of the links, with exact copies joined first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, saved
from .corpus_counts import chunk_of, corpus_counts, pack_keys, sum_keys, unpack_counts, unpack_keys
from .graph import connected_components
from .word_hash import mix, windows, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of plain similarity 0.8 has a weighted one of 0.755 at least (`loose`) and shares all samples of some band
#: with probability 1 - (1 - 0.755**3)**15 = 0.9998.
BANDS, ROWS = 15, 3
#: Of such a pair, so many of the 45 samples agree at least with probability 0.9996.
AGREE = 24
#: Weight = count * (1 + IDF_SHARE * ln((1 + n) / (1 + df)) / ln(1 + n)): from 1 to 1 + IDF_SHARE.
IDF_SHARE = 0.3
#: Open texts of a bucket, and its texts, in one block.
OPEN_BLOCK, ALL_BLOCK = 1024, 4096
_BITS = 14
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_draw = np.random.default_rng(13)
_R = _draw.gamma(2, 1, 1 << _BITS)
_LN_C = np.log(_draw.gamma(2, 1, 1 << _BITS))
_BETA = _draw.random(1 << _BITS)


def loose(threshold: float) -> float:
    """The least weighted similarity of a pair whose plain one is the threshold: what is shared weighs 1, all else 1 + IDF_SHARE."""
    return threshold / (threshold + (1 - threshold) * (1 + IDF_SHARE))


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + IDF_SHARE * np.log((1 + n) / (1.0 + df)) / np.log(1.0 + max(n, 2))


def _level(ln_w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, ln a) of consistent weighted samples for log weights and rows of the table of random numbers."""
    r = _R[at]
    t = np.floor(ln_w / r + _BETA[at])
    return t, _LN_C[at] - r * (t - _BETA[at]) - r


def sample(keys: np.ndarray, weight: np.ndarray, usual: float, usual_table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each band, and 32 bits of each of its BANDS * ROWS samples; `usual` is the weight of most shingles."""
    at = ((keys[:, None] * _SEEDS) >> np.uint64(64 - _BITS)).astype(np.int32)
    t_usual, a_usual = usual_table
    a = a_usual.take(at)
    other = np.flatnonzero(weight != usual)
    if len(other):
        t_other, a[other] = _level(np.log(weight[other])[:, None], at[other])
    best = a.argmin(0)
    t = t_usual[at[best, np.arange(len(_SEEDS))]]
    if len(other):
        spot = np.searchsorted(other, best)
        hit = (spot < len(other)) & (other[np.minimum(spot, len(other) - 1)] == best)
        t = np.where(hit, t_other[np.minimum(spot, len(other) - 1), np.arange(len(_SEEDS))], t)
    each = mix(keys[best] + mix(t.astype(np.int64).astype(np.uint64) + _SEEDS)).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(31) + each[:, k])
    return out.view(np.int64), each.ravel().astype(np.uint32).view(np.int32)


def _shingles(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, keys, counts) of each text of a chunk, once, but for the rows marked by a null text: copies of a text elsewhere."""
    row = pd.MultiIndex.from_frame(pdf[["id", "node"]])
    own = pdf[pdf["text"].notna() & ~row.isin(row[pdf["text"].isna()])].sort_values("node").drop_duplicates("node")
    nodes = own["node"].tolist()
    for i, words in word_hashes(own["text"].tolist()):
        keys, counts = np.unique(windows(words, SHINGLE), return_counts=True)
        if len(keys):
            yield nodes[i], keys, counts


def _own_keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return sum_keys(((k, np.ones((len(k), 1), np.int64)) for _, k, _ in _shingles(pdf)), 1)


def signatures(d: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """id, total, size, common, keys, weights, counts, bands, samples of each distinct text that can be like another.

    d: chunk, id, node, text, and rows of null text for those that are copies; the result's id is the node. keys and weights are those of the shingles
    that other texts hold as well (counts is empty where all are 1, size counts all shingles), common is the weights' sum; only these can add to an overlap, so texts that hold too
    little of them are left out.
    """
    schema = "id long, total double, size long, common double, keys binary, weights binary, counts binary, bands array<long>, samples array<int>"
    usual, least = float(idf(np.ones(1), n)[0]), loose(threshold) - 1e-6

    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts[counts["keys"].map(len) > 0].sort_values("bucket")
        shared = np.concatenate([np.empty(0, np.uint64), *map(unpack_keys, counts["keys"])])
        df = np.concatenate([np.empty(0, np.int64), *[unpack_counts(c, 1)[:, 0] for c in counts["totals"]]])
        at = np.arange(1 << _BITS)
        table = _level(np.full(1 << _BITS, np.log(usual)), at)
        out = []
        for i, keys, tf in _shingles(docs):
            spot = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
            known = shared[spot] == keys if len(shared) else np.zeros(len(keys), bool)
            weight = tf * np.where(known, idf(df[spot], n) if len(shared) else usual, usual)
            total, common = float(weight.sum()), float(weight[known].sum())
            if common >= least * total:  # no similarity is above common / total
                bands, samples = sample(keys, weight, usual, table)
                own = tf[known]
                out.append((i, total, int(tf.sum()), common, pack_keys(keys[known]), weight[known].astype("<f4").tobytes(), own.astype("<u4").tobytes() if (own > 1).any() else b"", bands.tolist(), samples.tolist()))
        return pd.DataFrame(out, columns=["id", "total", "size", "common", "keys", "weights", "counts", "bands", "samples"])

    if d.limit(1).count() == 0:
        return d.sparkSession.createDataFrame([], schema)
    counts = corpus_counts(d, _own_keys, 1, "shared")
    return d.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(run, schema)


def _counts(x: dict, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(x["counts"], "<u4")[at] if x["counts"] else np.ones(len(at), np.uint32)


def _similarity(x: dict, y: dict) -> float:
    """The larger of the weighted and the plain Jaccard similarity of two signatures."""
    _, p, q = np.intersect1d(unpack_keys(x["keys"]), unpack_keys(y["keys"]), assume_unique=True, return_indices=True)
    low = float(np.minimum(np.frombuffer(x["weights"], "<f4")[p], np.frombuffer(y["weights"], "<f4")[q]).sum(dtype=float))
    plain = int(np.minimum(_counts(x, p), _counts(y, q)).sum())
    return max(low / (x["total"] + y["total"] - low), plain / (x["size"] + y["size"] - plain))


def _verified(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose weighted or plain Jaccard similarity reaches the threshold, and the larger of both."""
    s = sigs.select("id", F.struct("total", "size", "keys", "weights", "counts").alias("s"))
    both = pairs.join(s.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").join(s.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf[["a", "b"]].assign(similarity=[_similarity(x, y) for x, y in zip(pdf["x"], pdf["y"], strict=True)])

    return both.mapInPandas(run, "a long, b long, similarity double").where(F.col("similarity") >= threshold - 1e-6)


def _block_links(rows: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links that connect the open texts of a block with all that are like them. rows: asks (open text or partner), id, band,
    alike (to the bucket's head), and signatures.

    A pair is compared if the block is its first common band, its weights leave it possible, its samples agree as often as
    those of pairs at that similarity do, and the two are not connected yet.
    """
    one, two = rows[rows["asks"]], rows[~rows["asks"]].sort_values("id")
    if not len(one) or not len(two):
        return []
    ids, band = two["id"].to_numpy(), int(rows["band"].iloc[0])
    total, most = two["total"].to_numpy(), two["most"].to_numpy()
    samples, bands = np.stack(two["samples"].to_list()), np.stack(two["bands"].to_list())[:, :band]
    root = np.where(two["alike"].to_numpy(), -1, np.arange(len(two)))  # the head's class, or its own
    sigs, out = two[["total", "size", "keys", "weights", "counts"]].to_dict("records"), []
    for i, t, m, own, mine in zip(one["id"], one["total"], one["most"], one["samples"], one["bands"], strict=True):
        at = int(np.searchsorted(ids, i))
        here = at < len(ids) and ids[at] == i
        fits = (ids != i) & (total <= m) & (t <= most) & ((samples == own).sum(1) >= AGREE) & ~(bands == np.asarray(mine)[:band]).any(1)
        seen: set[int] = set()
        x = None
        for j in np.flatnonzero(fits).tolist():
            if (root[j] == root[at]) if here else (int(root[j]) in seen):
                continue
            if x is None:
                x = sigs[at] if here else one[one["id"] == i][["total", "size", "keys", "weights", "counts"]].to_dict("records")[0]
            if _similarity(x, sigs[j]) >= threshold - 1e-6:
                out.append((i, int(ids[j])))
                if here:
                    root[root == root[at]] = root[j]
                else:
                    seen.add(int(root[j]))
    return out


def links(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): links that connect all texts that are alike and share a bucket of some band.

    First, each bucket's head, the text that shares most of its weight with others, is compared with all others there;
    texts like it are settled. Each open text, one that isn't, is then compared with all texts of its bucket that its
    weights and samples leave possible: a similarity of s (the loose one, so that it holds for plain similarity too) needs
    an overlap of s / (1 + s) of both totals, and no overlap is above what either text holds in common with others.
    Signatures go to the blocks of a bucket, of at most OPEN_BLOCK open texts and ALL_BLOCK others, and only links
    leave them, so pairs of a large group are never rows.
    """
    factor = (1 + loose(threshold)) / loose(threshold)
    left = sigs.select("id", "total", "common", (F.col("common") * factor - F.col("total") + 1e-6 * F.col("total")).alias("most"), F.posexplode("bands").alias("band", "bucket")).dropDuplicates(["id", "bucket"])
    left = saved(left)
    heads = left.groupBy("bucket").agg(F.max_by(F.struct("id", "total", "most"), F.struct(F.col("common") / F.col("total"), -F.col("id"))).alias("h"), F.count(F.lit(1)).alias("n"))
    heads = saved(heads.where("n > 1").select("bucket", "h", "n"))
    fits = (F.col("total") <= F.col("h.most")) & (F.col("h.total") <= F.col("most"))
    size = heads.agg(F.sum("n")).first()[0] or 0
    near = saved(join_spread(left, heads, "bucket", "n", size).where("id <> h.id").select("bucket", "band", F.col("h.id").alias("a"), F.col("id").alias("b"), "most", fits.alias("fits")))
    good = saved(_verified(near.where("fits").select("a", "b").distinct(), sigs, threshold).select("a", "b").distinct())
    rest = saved(near.join(good.withColumn("alike", F.lit(True)), ["a", "b"], "left").select("bucket", "band", F.col("b").alias("id"), "most", F.col("alike").isNotNull().alias("alike")))
    # The head was compared with all others, so a bucket of two texts is done.
    large = rest.groupBy("bucket").agg(F.count_if(~F.col("alike")).alias("open"), F.count(F.lit(1)).alias("n")).where("open > 0 AND n > 1")
    large = saved(large.select("bucket", "n", F.ceil(F.col("open") / OPEN_BLOCK).cast("int").alias("p"), F.ceil(F.col("n") / ALL_BLOCK).cast("int").alias("q")))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest = join_spread(rest, large, "bucket", "n", size)
    asking = rest.where("NOT alike").select("bucket", "band", "id", "most", "alike", F.lit(True).alias("asks"), part("p").alias("p"), F.explode(every("q")).alias("q"))
    asked = rest.select("bucket", "band", "id", "most", "alike", F.lit(False).alias("asks"), F.explode(every("p")).alias("p"), part("q").alias("q"))
    full = asking.unionByName(asked).join(sigs.select("id", "total", "size", "keys", "weights", "counts", "bands", "samples"), "id")
    full = full.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for pdf in parts:
            keys = list(zip(pdf["bucket"], pdf["p"], pdf["q"], strict=True))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            out: list[tuple[int, int]] = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if key is not None and keys[lo] != key:
                        out += _block_links(pd.concat(held), threshold)
                        held = []
                    key = keys[lo]
                    held.append(pdf.iloc[lo:hi])
            yield pd.DataFrame(out, columns=["a", "b"])
        if held:
            yield pd.DataFrame(_block_links(pd.concat(held), threshold), columns=["a", "b"])

    more = full.mapInPandas(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return good.unionByName(saved(more))


def node_of(text: Column) -> Column:
    """64 bits of the text's md5 (null is empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16), 16, -10).cast("long")


#: What a null id counts as where ids are compared.
NO_ID = -(2**63)


def id_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def rows_by_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id (null as NO_ID), node, class_node for every row. A node is a distinct text; rows that share an id are rows of their own."""
    rows = saved(docs.select(id_of(F.col(doc_id)).alias("id"), node_of(F.col(text)).alias("node")))
    copies = saved(rows.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    n = rows.count() - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    gone = rows.join(copies.select("node", "rep"), "node").where("id <> rep").select("id", "node", F.lit(None).cast("string").alias("text")).distinct()
    d = docs.select(id_of(F.col(doc_id)).alias("id"), node_of(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text")).unionByName(gone)
    d = d.select(chunk_of(F.xxhash64("id", "node"), d).alias("chunk"), "id", "node", "text")
    edges = links(saved(signatures(d, n, threshold)), threshold)
    of_node = saved(connected_components(edges, "a", "b")).withColumnRenamed("node", "_node")
    return saved(rows.join(of_node, F.col("node") == F.col("_node"), "left").select("id", "node", F.coalesce("component", "node").alias("class_node")))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id (the least id of the class), class_size and class_node for every row.

    Null is empty text; empty texts are copies of each other and like nothing else. Texts of fewer than five words have
    one shingle of all their words; very long ones count whole. Rows are told apart by their texts: null ids and ids
    that several rows share link nothing; class_node, a 64-bit digest of one of its texts, names a class even then;
    class_id is null in a class without ids. No rows give no rows; other columns may have any names.
    """
    rows = rows_by_class(docs, doc_id, text, threshold).withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
    sizes = saved(rows.groupBy("class_node").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return rows.join(sizes, "class_node").select("id", "class_id", "class_size", "class_node")
