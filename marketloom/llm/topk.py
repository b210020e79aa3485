"""Exact top-k inner products with segment statistics as bounds.

A segment of w components with means a, b and deviations s, t has an inner product of at most w(ab + st), so
the sum over segments bounds a pair's score from above (its distance from below). Each query starts with the k-th
best score of a bounded sample as its floor. Rows lie in cells around centres of that sample; a cell whose segments
cannot reach the floor is never sent to the query. Within a cell, pairs go through bounds from coarse segments to
fine ones, and only those that may still reach the floor get the exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: Segments at each level, coarse to fine; cells are bounded by segments of CELL_LEVEL.
LEVELS, CELL_LEVEL = (1, 4, 16, 32), 16
#: A level that leaves more than this share of a tile's pairs is left out for the next SKIP tiles.
IDLE, SKIP = 0.9, 8
QUERY_BLOCK, ROW_BLOCK = 2048, 16384
#: The sample that gives floors and centres: so many rows, and so many components in all, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS, CENTRES = 2048, 2_000_000, 48
#: If queries need more than this share of the rows by their cells (measured on the sample), the rows are one cell.
WORTH = 0.5
#: Where more than this share of a tile's pairs is left, the tile is computed whole, as one matrix product.
DENSE = 0.5
TOP, LOW = (1 << 63) - 1, -(1 << 63)


def _cuts(size: int, n: int) -> np.ndarray:
    return np.unique(np.linspace(0, size, min(n, size) + 1).astype(int))


def _segments(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of segment means and deviations, scaled so that a dot product of two rows is the bound."""
    cuts = _cuts(x.shape[1], n)
    w = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / w
    dev = np.sqrt(np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / w - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([w, w]))


def _norms(x: np.ndarray) -> np.ndarray:
    """The length of each row's segments of CELL_LEVEL."""
    return np.sqrt(np.add.reduceat(x * x, _cuts(x.shape[1], CELL_LEVEL)[:-1], axis=1))


def _products(a: np.ndarray, b: np.ndarray, whole: float) -> np.ndarray:
    """Exact products of rows of a with rows of b; beyond 64 bits, the nearest number that fits."""
    if whole < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOW, TOP).astype(np.int64)


def _pair_products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (row a of q, row b of x), sorted by a; both hold doubles small enough to be exact."""
    if len(a) < 16 * len(q):
        return np.einsum("ij,ij->i", q[a], x[b]).astype(np.int64)
    cuts = np.searchsorted(a, np.arange(len(q) + 1)).tolist()
    return np.concatenate([x[b[lo:hi]] @ q[i] for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]).astype(np.int64)


def block_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's k best rows of one block whose score reaches its floor, and how many exact
    products that took; ties go to smaller ids; rows of its own id are left out."""
    floor = np.full(len(q), LOW) if floor is None else floor.astype(np.int64).copy()
    whole = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * x.shape[1]
    best_q, best_i, best_s = np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64)
    qf, xf = q.astype(float), x.astype(float)
    order = np.lexsort((x_ids, -np.einsum("ij,ij->i", xf, xf)))  # long vectors first: they raise the k-th score early
    levels = [(_segments(qf, n), _segments(xf, n)) for n in LEVELS]
    slack = 1 + whole * 1e-9
    done, at, step, tile = 0, 0, 64, 0
    idle = [0] * len(levels)
    while at < len(order):
        rows, at, step, tile = order[at : at + step], at + step, min(step * 4, 2048), tile + 1
        least = floor - slack
        a, b = None, None  # the pairs that are left; None: all
        for level, (qs, xs) in enumerate(levels):
            if a is None and tile >= idle[level]:
                may = qs @ xs[rows].T >= least[:, None]
                share = np.count_nonzero(may) / may.size
                if share <= DENSE:
                    a, b = np.nonzero(may)
                elif share > IDLE:
                    idle[level] = tile + SKIP
            elif a is None:
                continue
            elif len(a):
                may = np.einsum("ij,ij->i", qs[a], xs[rows[b]]) >= least[a]
                a, b = a[may], b[may]
        if a is None:
            score = _products(q, x[rows], whole)
            done += score.size
            a, b = np.nonzero((score >= floor[:, None]) & (q_ids[:, None] != x_ids[None, rows]))
            s = score[a, b]
        else:
            own = q_ids[a] != x_ids[rows[b]]
            a, b = a[own], b[own]
            done += len(a)
            if whole < 2.0**52:
                s = _pair_products(qf, xf[rows], a, b)
            else:
                s = np.array([_products(q[i][None], x[rows[j]][None], whole)[0, 0] for i, j in zip(a, b, strict=True)], np.int64)
            keep = s >= floor[a]
            a, b, s = a[keep], b[keep], s[keep]
        if not len(a):
            continue
        nq, ni, ns = np.concatenate([best_q, a]), np.concatenate([best_i, x_ids[rows[b]]]), np.concatenate([best_s, s])
        by = np.lexsort((ni, -ns, nq)) if ns.min() > LOW else np.lexsort((ni, -(ns.astype(float)), nq))
        nq, ni, ns = nq[by], ni[by], ns[by]
        rank = np.arange(len(nq)) - np.searchsorted(nq, nq)
        keep = rank < k
        best_q, best_i, best_s = nq[keep], ni[keep], ns[keep]
        last = rank == k - 1
        floor[nq[last]] = np.maximum(floor[nq[last]], ns[last])
    return best_q, best_i, best_s, done


def sample_floors(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample's rows, its own left out; the least number if there are fewer."""
    out = np.full(len(q), LOW)
    if len(x):
        whole = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * x.shape[1]
        score = _products(q, x, whole)
        score[q_ids[:, None] == x_ids[None, :]] = LOW
        if len(x) >= k:
            out = -np.partition(-score.astype(float), k - 1, axis=1)[:, k - 1] if whole >= 2.0**52 else np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
            out = np.where(out <= LOW, LOW, np.floor(out - np.abs(out) * 1e-9 - 1) if whole >= 2.0**52 else out).astype(np.int64)
    return out


def centres_of(x: np.ndarray, n: int) -> np.ndarray:
    """n centres of some rows: rows far from each other, then a few rounds of means."""
    at = [0]
    away = ((x - x[0]) ** 2).sum(1)
    while len(at) < min(n, len(x)) and away.max() > 0:
        at.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[at[-1]]) ** 2).sum(1))
    c = x[at]
    for _ in range(5):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def _need(x: np.ndarray, ids: np.ndarray, c: np.ndarray, cells: dict[int, tuple[int, int, np.ndarray]], k: int) -> float:
    """The share of rows in cells that the sample's rows would need as queries."""
    floor, xf = sample_floors(x, ids, x, ids, k), x.astype(float)
    norms = _norms(xf)
    need = sum(rows * (xf @ c[i] + norms @ away >= floor).mean() for i, (rows, _, away) in cells.items())
    return float(need) / max(1, sum(rows for rows, _, _ in cells.values()))


def _grouped(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the rows of each vector length."""
    size = pdf["v"].map(len).to_numpy()
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield n, at, np.stack(pdf["v"].iloc[at].to_list()).astype(np.int64)


def exact_topk(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query row, its own left out.

    vector: array<bigint>. Rows with a null id, a null or empty vector or a null component take no part, repeated (id,
    vector) rows count once, every row of the query's id is its own, vectors of another length than the query's are not
    compared, scores beyond 64 bits count as the nearest that fits. Ties: smaller id. No rows give no rows; other
    columns may have any names. Queries of one cell form blocks, cells are cut into blocks by hash, so that copies of a
    vector spread, and a block of rows is sent only to the query blocks that may need it.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"), is_query.alias("q"))
    v = v.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull())).withColumn("q", F.coalesce("q", F.lit(False)))
    v = saved(v.groupBy("id", "v").agg(F.max("q").alias("q")))
    widest = v.agg(F.max(F.size("v"))).first()[0] or 1
    some = v.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // widest))).select("id", "v").toPandas()
    sample = {n: (x, some["id"].to_numpy()[at], centres_of(x.astype(float), min(CENTRES, len(x) // 8 + 1))) for n, at, x in _grouped(some)}
    shared = spark.sparkContext.broadcast(sample)

    def cells_of(n: int, x: np.ndarray) -> np.ndarray:
        if n not in shared.value:
            return np.full(len(x), -1)
        c = shared.value[n][2]
        return (x.astype(float) @ c.T - (c * c).sum(1) / 2).argmax(1)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cell = np.full(len(pdf), -1)
            for n, at, x in _grouped(pdf) if len(pdf) else ():
                cell[at] = 0 if n in alone.value else cells_of(n, x)
            yield pdf.assign(n=pdf["v"].map(len).astype("int32"), cell=cell.astype("int32"))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of each cell and, by segment, the largest distance from its centre: one row a cell and task."""
        far: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for pdf in parts:
            for n, _, x in _grouped(pdf) if len(pdf) else ():
                if n in shared.value:
                    cell, c = cells_of(n, x), shared.value[n][2]
                    away = _norms(x.astype(float) - c[cell])
                    for i in np.unique(cell).tolist():
                        rows, most = far.get((n, i), (0, np.zeros(away.shape[1])))
                        far[n, i] = rows + int((cell == i).sum()), np.maximum(most, away[cell == i].max(0))
        out = [(n, i, rows, s, float(r)) for (n, i), (rows, most) in far.items() for s, r in enumerate(most)]
        yield pd.DataFrame(out, columns=["n", "cell", "rows", "segment", "away"])

    got = v.mapInPandas(measure, "n int, cell int, rows long, segment int, away double").groupBy("n", "cell", "segment").agg(F.sum("rows").alias("rows"), F.max("away").alias("away"))
    cells: dict[int, dict[int, tuple[int, int, np.ndarray]]] = {}  # rows, blocks, largest distances
    for (n, i), own in got.toPandas().sort_values("segment").groupby(["n", "cell"]):  # CENTRES cells of CELL_LEVEL segments for each length in the sample
        cells.setdefault(int(n), {})[int(i)] = (int(own["rows"].iloc[0]), -(-int(own["rows"].iloc[0]) // ROW_BLOCK), own["away"].to_numpy())
    for n, own in cells.items():
        if _need(*sample[n], own, k) > WORTH:
            rows = sum(x[0] for x in own.values())
            cells[n] = {0: (rows, -(-rows // ROW_BLOCK), np.full_like(next(iter(own.values()))[2], np.inf))}
    alone = spark.sparkContext.broadcast({n for n, own in cells.items() if len(own) == 1 and 0 in own})
    placed = v.mapInPandas(assign, "id long, v array<bigint>, q boolean, n int, cell int")
    rare, queries = placed.agg(F.count_if(F.col("cell") < 0), F.count_if("q")).first()
    blocks = {(n, i): b for n, own in cells.items() for i, (_, b, _) in own.items()}
    n_rare, n_query = max(1, -(-rare // ROW_BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    table = spark.sparkContext.broadcast((cells, n_rare))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each cell that a query needs, with the query's floor."""
        cells, n_rare = table.value
        for pdf in parts:
            out = []
            for n, at, x in _grouped(pdf) if len(pdf) else ():
                ids, own = pdf["id"].to_numpy()[at], pdf["cell"].to_numpy()[at]
                if n not in cells:
                    out.append(pd.DataFrame({"id": ids, "v": pdf["v"].iloc[at].to_list(), "floor": LOW, "n": n, "own": own, "cell": -1, "blocks": n_rare}))
                    continue
                rows, row_ids, c = shared.value[n]
                floor = sample_floors(x, ids, rows, row_ids, k)
                xf = x.astype(float)
                norms = _norms(xf)
                for i, (_, b, away) in cells[n].items():
                    most = xf @ c[i] + norms @ away if np.isfinite(away).all() else np.full(len(xf), np.inf)
                    need = np.flatnonzero(most * (1 + np.sign(most) * 1e-9) + 1 >= floor)
                    if len(need):
                        out.append(pd.DataFrame({"id": ids[need], "v": [pdf["v"].iloc[at[j]] for j in need.tolist()], "floor": floor[need], "n": n, "own": own[need], "cell": i, "blocks": b}))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("id", "v", "floor", "n", "own", "cell", "blocks")})

    asked = saved(placed.where("q").mapInPandas(ask, "id long, v array<bigint>, floor long, n int, own int, cell int, blocks int"))
    # Queries of one cell, cut by hash, are a block; it meets every block of the cells that one of them needs.
    qb = F.struct("own", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_query)).alias("part"))
    asked = asked.withColumn("qb", qb)
    pairs = asked.select("n", "cell", "qb").distinct()  # CENTRES x blocks of queries at most
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = asked.select("id", "v", "floor", "n", "cell", "qb", every.alias("xb"))
    sizes = spark.createDataFrame([(n, i, b) for (n, i), b in blocks.items()] or [(0, 0, 1)], "n int, cell int, blocks int")
    right = placed.join(F.broadcast(sizes), ["n", "cell"], "left").withColumn("xb", F.pmod(F.xxhash64("id", "v"), F.coalesce("blocks", F.lit(n_rare))).cast("int"))
    right = right.select("id", "v", "n", "cell", "xb").join(pairs, ["n", "cell"])
    right = right.select("id", "v", "n", "cell", "xb", F.struct(F.col("qb.own").alias("own"), F.col("qb.part").alias("part")).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        qi, one = left["id"].to_numpy(), np.stack(left["v"].to_list()).astype(np.int64)
        n, i, s, _ = block_topk(one, qi, np.stack(right["v"].to_list()).astype(np.int64), right["id"].to_numpy(), k, left["floor"].to_numpy())
        return pd.DataFrame({"query_id": qi[n], "vec_id": i, "score": s})

    keys = ["n", "cell", "qb", "xb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
