"""Exact nearest neighbours in blocks of queries, and a hashed text embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def knn(queries: DataFrame, vectors: DataFrame, k: int = 15, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, dist, rank)``: the ``k`` nearest by squared Euclidean distance, exact.

    ``queries`` (``query_id``, ``embedding``) are taken in blocks of at most ``block`` rows, so what
    is broadcast is bounded; each task scores blocks of its Arrow batches with one matrix product, takes
    exact distances of what that leaves among its best ``k`` of each query, and only those are shuffled. Ties go to the smaller id. Vectors of
    another dimension or null never match.
    """
    q = queries.select(F.col("query_id").cast("long"), "embedding").where("embedding is not null")
    total = q.count()
    n_blocks = max(1, -(-total // block))
    out = None
    for b in range(n_blocks):
        part = q if n_blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        rows = part.collect()
        ids = np.array([r[0] for r in rows], np.int64)
        mat = np.array([r[1] for r in rows], np.float64) if rows else np.empty((0, 0))
        sent = q.sparkSession.sparkContext.broadcast((ids, mat))

        def score(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, m = sent.value
            best_d = np.full((len(qid), 0), np.inf)
            best_i = np.empty((len(qid), 0), np.int64)
            for pdf in it:
                ok = pdf["e"].map(lambda v: v is not None and len(v) == m.shape[1]).to_numpy(bool)
                if not len(qid) or not ok.any():
                    continue
                x = np.stack(pdf["e"][ok].to_numpy()).astype(np.float64)
                i = pdf["i"][ok].to_numpy(np.int64)
                for s in range(0, len(x), 2048):
                    xs = x[s : s + 2048]
                    if best_d.shape[1] >= k:
                        # the product tells which can be among the best; the differences decide
                        rough = (xs * xs).sum(axis=1) - 2 * (m @ xs.T) + (m * m).sum(axis=1)[:, None]
                        row, col = np.nonzero(rough <= best_d[:, k - 1 : k] + 1e-6 * (1 + np.abs(best_d[:, k - 1 : k])))
                        d = np.full(rough.shape, np.inf)
                        d[row, col] = ((xs[col] - m[row]) ** 2).sum(axis=1)
                        some = np.flatnonzero(np.isfinite(d).any(axis=0))
                        d, at = d[:, some], i[s : s + 2048][some]
                    else:
                        # differences, not the expanded product: equal to the last bits for close vectors
                        d, at = np.stack([((xs - v) ** 2).sum(axis=1) for v in m]), i[s : s + 2048]
                    best_d = np.concatenate([best_d, d], axis=1)
                    best_i = np.concatenate([best_i, np.broadcast_to(at, d.shape)], axis=1)
                    if best_d.shape[1] > k:
                        o = np.lexsort((best_i, best_d), axis=1)[:, :k]
                        best_d, best_i = np.take_along_axis(best_d, o, 1), np.take_along_axis(best_i, o, 1)
            n = best_d.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(qid, n), "vec_id": best_i.ravel(), "dist": best_d.ravel()})

        got = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("e")).mapInPandas(score, "query_id long, vec_id long, dist double")
        out = got if out is None else out.unionByName(got)
    w = W.partitionBy("query_id").orderBy("dist", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity(dist):
    """1 / (1 + squared distance)."""
    return 1 / (1 + dist)


class _Slots(dict):
    """Word -> its slot of twice the dimension (the upper half is negative), by MD5."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16) % (2 * self.dim)
        return n


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """``(vec_id, embedding)``: signed hashing of words, scaled to length 1; stands in for a model.

    A word adds 1 to the slot that its MD5 names modulo ``dim``, or takes 1 off. A null text and one
    without words gives the zero vector. Any other source of ``array<float>`` can take its place.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = _Slots(dim)
        for pdf in it:
            texts = [(t or "").lower().split() for t in pdf["t"]]
            flat = np.fromiter((slots[w] for ws in texts for w in ws), np.int64)
            row = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
            n = np.bincount(row * 2 * dim + flat, minlength=len(texts) * 2 * dim).reshape(len(texts), 2, dim).astype(np.float64)
            v = n[:, 0] - n[:, 1]
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield pd.DataFrame({"vec_id": pdf["i"], "embedding": list((v / np.where(length == 0, 1, length)).astype(np.float32))})

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "vec_id long, embedding array<float>")
