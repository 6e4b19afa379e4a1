"""Exact top-k by inner product: histograms of all scores, refined until each kth value is known."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tree_sum

#: Queries that are scored at once; what is broadcast and what a task holds has this bound, not the number of queries.
QUERY_BLOCK = 2048
#: Bins of a histogram in a round; queries of a row of histograms.
BINS, HIST_ROWS = 64, 64
#: Candidate vectors that a task scores at once.
TILE = 1024
SCALE = 256.0


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vid, v): each component x as floor(scale * x), in double precision; vectors that are null, empty or hold a null or
    non-finite component are left out, as are rows without an id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(True))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vid"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components, of the vectors of that dimension."""
    col = batch.column("v")
    n = np.diff(col.offsets.to_numpy())
    ids = batch.column("vid").to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return ids, flat.reshape(-1, dim)
    own = np.repeat(n == dim, n)
    return ids[n == dim], flat[own].reshape(-1, dim)


def _scores(batches: Iterator[pa.RecordBatch], q: np.ndarray):
    for batch in batches:
        for i in range(0, batch.num_rows, TILE):
            ids, m = _matrix(batch.slice(i, TILE), q.shape[1])
            if len(ids):
                yield ids, q @ m.T  # integers below 2**53 in double precision, so exact


def _block_topk(cands: DataFrame, qid: np.ndarray, q: np.ndarray, top: float, k: int) -> DataFrame:
    """The k best candidates of one block of queries; top bounds every |score|."""
    n = len(qid)
    lo = np.full(n, -top)  # the kth score of each query lies in [lo, lo + width * BINS)
    width = np.full(n, max(1.0, math.ceil((2 * top + 1) / BINS)))
    done = np.zeros(n, bool)

    while not done.all():
        at, wide = lo.copy(), width.copy()

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = np.zeros((n, BINS + 2), np.int64)
            rows = np.arange(n)[:, None] * (BINS + 2)
            for ids, s in _scores(batches, q):
                b = np.clip(np.floor((s - at[:, None]) / wide[:, None]), -1, BINS).astype(np.int64) + 1
                own = qid[:, None] == ids[None, :]
                counts = np.bincount((b + rows)[~own], minlength=hist.size)
                hist += counts.reshape(hist.shape)
            parts = range(0, n, HIST_ROWS)
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int32()), "hist": pa.array([hist[i : i + HIST_ROWS].tobytes() for i in parts], pa.binary())})

        def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.int64) for x in pdf["hist"])
            return pd.DataFrame({"part": [key[0]], "hist": [total.tobytes()]})

        got = tree_sum(cands.mapInArrow(histograms, "part int, hist binary"), "part", added, "part int, hist binary").collect()
        hist = np.concatenate([np.frombuffer(r["hist"], np.int64).reshape(-1, BINS + 2) for r in sorted(got, key=lambda r: r["part"])])
        from_top = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]  # candidates in this bin or over it
        for i in np.flatnonzero(~done):
            if hist[i].sum() < k:
                lo[i], done[i] = -top, True  # all are among the best
                continue
            b = int(np.flatnonzero(from_top[i] >= k)[-1])  # the highest bin with k candidates in it or over it
            lo[i] += (b - 1) * width[i]
            done[i] = width[i] == 1
            width[i] = max(1.0, math.ceil(width[i] / BINS))
    kth = lo.copy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All scores over the kth, at most k - 1 a query, and of those that equal it the k smallest ids of this task."""
        held: list[np.ndarray] = [np.zeros((3, 0))]
        for ids, s in _scores(batches, q):
            i, j = np.nonzero((s >= kth[:, None]) & (qid[:, None] != ids[None, :]))
            held.append(np.stack([i.astype(float), ids[j].astype(float), s[i, j]]))
            if sum(x.shape[1] for x in held) > 4 * k * n + TILE:
                held = [_least(np.concatenate(held, axis=1), k)]
        i, ids, s = _least(np.concatenate(held, axis=1), k)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[i.astype(int)], pa.int64()), "vec_id": pa.array(ids.astype(np.int64)), "score": pa.array(s.astype(np.int64))})

    return cands.mapInArrow(best, "query_id long, vec_id long, score long")


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Columns (query, id, score): each query's k best, ties to the smaller id."""
    order = np.lexsort((x[1], -x[2], x[0]))
    x = x[:, order]
    first = np.flatnonzero(np.r_[True, np.diff(x[0]) != 0]) if x.shape[1] else np.zeros(0, int)
    place = np.arange(x.shape[1]) - np.repeat(first, np.diff(np.r_[first, x.shape[1]]))
    return x[:, place < k]


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each vector whose id is divisible by `query_every`, its k highest integer inner products with all other vectors.

    Every pair's score is counted into a histogram per query; a few rounds narrow the bin that holds the kth score down to one
    value, and a last pass keeps what lies over it and, of the ties, the smallest ids. The scores are never stored. Queries go
    block by block: a block of at most about `query_block` rows is broadcast and the candidates are read in place, not shuffled.

    Result: query_id, rank (from 1), vec_id, score. Null vectors, vectors with null or non-finite components and null ids take
    no part; vectors of another length are no candidates of a query. Rows that repeat an id are all candidates, save the query's
    own id; a repeated query id is asked once, with the vector whose components are smallest. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    all_v = cut(quantised(vectors, id_col, vec_col))
    queries = all_v.where(F.col("vid") % query_every == 0).groupBy("vid").agg(F.min("v").alias("v"))
    stats = all_v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // query_block))
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vid"), F.lit(blocks)) == b).orderBy("vid").collect()
        for dim in sorted({len(r["v"]) for r in rows}):
            own = [r for r in rows if len(r["v"]) == dim]
            qid, q = np.array([r["vid"] for r in own], np.int64), np.array([r["v"] for r in own])
            parts.append(cut(_block_topk(all_v, qid, q, math.ceil(stats["norm2"]) + 1.0, k)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
