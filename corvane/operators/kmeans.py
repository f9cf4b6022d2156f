"""Deterministic k-means: fixed rounds from the first rows, for one or many parts of a vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import matrix

#: Rounds of training; there is no other stop.
ROUNDS = 5
STEP = 4096


def nearest(rows: np.ndarray, centroids: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Each row's best centroid, the first of equals; all of them count, zero ones too."""
    product = rows @ centroids.T
    cost = (centroids**2).sum(1) - 2 * product if metric == "l2" else -product
    least = cost.min(1, keepdims=True)
    # Equals up to rounding are compared by direct sums.
    close = cost <= least + 1e-9 * (1 + np.abs(least))
    out = close.argmax(1)
    for i in np.flatnonzero(close.sum(1) > 1):
        js = np.flatnonzero(close[i])
        d = ((rows[i] - centroids[js]) ** 2).sum(1) if metric == "l2" else -(centroids[js] * rows[i]).sum(1)
        out[i] = js[d.argmin()]
    return out


def batches_of(batches: Iterator[pd.DataFrame], column: str = "embedding") -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), STEP):
            piece = batch[at : at + STEP]
            if len(piece):
                yield piece, matrix(piece[column])


def train_parts(vectors: DataFrame, k: int, parts: int = 1, metric: str = "l2", rounds: int = ROUNDS, center: np.ndarray | None = None) -> np.ndarray:
    """Centroids (parts, k, width) of each part of the vectors, all trained together.

    A part starts from the first k rows by vec_id; missing ones are zero and are
    centroids like others.  With at most one row, or k of one, the first row is
    the centroid.  An emptied cluster keeps its centroid.  ``center``: coarse
    centroids, whose nearest one is subtracted from each row first.

    A round is one pass: every task sends its clusters' sums, parts * k rows.
    """
    first = vectors.select("vec_id", "embedding").orderBy("vec_id").limit(k).collect()
    if not first:
        raise ValueError("nothing to train on")
    start = np.array([r["embedding"] for r in first], np.float64)
    if center is not None:
        start = start - center[nearest(start, center, metric)]
    dim = start.shape[1]
    width = dim // parts
    centroids = np.zeros((parts, k, width))
    centroids[:, : len(start)] = start.reshape(len(start), parts, width).transpose(1, 0, 2)
    if k <= 1 or len(first) <= 1:
        return centroids
    inner = "l2" if parts > 1 or center is not None else metric
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now = shared.value
            total, count = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for _, rows in batches_of(batches):
                if center is not None:
                    rows = rows - center[nearest(rows, center, metric)]
                for s in range(parts):
                    part = rows[:, s * width : (s + 1) * width]
                    at = nearest(part, now[s], inner)
                    np.add.at(total[s], at, part)
                    count[s] += np.bincount(at, minlength=k)
            s, c = np.nonzero(count)
            if len(s):
                yield pd.DataFrame({"part": s, "code": c, "n": count[s, c], "total": list(total[s, c])})

        each = vectors.select("embedding").mapInPandas(sums, "part int, code int, n long, total array<double>")
        added = each.groupBy("part", "code").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
        centroids = centroids.copy()
        for r in added.collect():  # parts * k rows
            centroids[r["part"], r["code"]] = [r[f"t{i}"] / r["n"] for i in range(width)]
    return centroids


def kmeans_train(vectors: DataFrame, k: int, metric: str = "l2", rounds: int = ROUNDS) -> np.ndarray:
    return train_parts(vectors, k, 1, metric, rounds)[0]


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list_id int, centroid array<double>")
