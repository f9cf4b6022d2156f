"""Exact top-k search, and the bounded top-k that all searches share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..plans.search import Index, InvalidArgument, SearchPlan

HITS = "qid long, vec_id long, distance double"
#: Bytes of queries that a job broadcasts; more go in blocks, a job each.
BLOCK_BYTES = 64 << 20
#: Queries times vectors that a task compares at once: matrices of 8 MB.
CELLS = 1 << 20
#: Pairs that are summed directly at once.
STEP = 1 << 14


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding; a wrong length, a null or a value that isn't finite fails the job."""
    e = F.col("embedding")
    bad = e.isNull() | (F.size(e) != dim) | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    guard = F.when(bad, F.raise_error(F.concat(F.lit(f"not a finite vector of {dim} dimensions: vec_id "), F.col("vec_id").cast("string"))).cast("array<float>")).otherwise(e.cast("array<float>"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), guard.alias("embedding"))


def best(qi: np.ndarray, distance: np.ndarray, tie: np.ndarray, k: int, sign: float) -> np.ndarray:
    """Positions of each query's k best, by distance (times ``sign``, less is better), then ``tie``."""
    order = np.lexsort((tie, sign * distance, qi))
    q = qi[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return order[rank < k]


def steps(which: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """``which`` in parts that make CELLS with so many rows."""
    size = max(1, CELLS // max(1, rows))
    return (which[i : i + size] for i in range(0, len(which), size))


class TopK:
    """The k best of each query so far; its size is that of its result."""

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.qids, self.k, self.metric = qids, k, metric
        self.queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300) if metric == "cosine" else queries
        self.sign = 1.0 if metric == "l2" else -1.0
        self.norms = (self.queries**2).sum(1)
        self.q, self.v, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def exact(self, qi: np.ndarray, rows: np.ndarray, vi: np.ndarray) -> np.ndarray:
        """Distances of pairs of queries and ``rows`` (all vectors at hand, ``vi`` of them), a bounded part at a time."""
        out = np.empty(len(qi))
        for at in range(0, len(qi), STEP):
            a, b = self.queries[qi[at : at + STEP]], rows[vi[at : at + STEP]]
            out[at : at + STEP] = ((a - b) ** 2).sum(1) if self.metric == "l2" else (a * b).sum(1)
        return out

    def offer(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None, earlier: bool = False) -> None:
        """Vectors for all queries, or those at ``which``; ``earlier`` leaves ids from a query's own on out."""
        which = np.arange(len(self.qids)) if which is None else which
        if not len(ids) or not len(which):
            return
        if self.metric == "cosine":
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        found = []
        for part in steps(which, len(ids)):
            qi, vi = self._near(ids, rows, part, earlier)
            d = self.exact(qi, rows, vi)
            # Equals may be many more than k.
            kept = best(qi, d, ids[vi], self.k, self.sign)
            found.append((qi[kept], ids[vi[kept]], d[kept]))
        self.take(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _near(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray]:
        """Queries and positions of vectors that may be among their best."""
        product = self.queries[which] @ rows.T
        # A matrix product finds who may be among the best; who is, the direct sums say.
        rough = self.norms[which][:, None] + (rows**2).sum(1) - 2 * product if self.metric == "l2" else -product
        if earlier:
            rough[ids[None, :] >= self.qids[which][:, None]] = np.inf
        if rough.shape[1] > self.k:
            limit = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            near = rough <= limit + 1e-9 * (1 + np.abs(limit))
        else:
            near = np.ones(rough.shape, bool)
        qi, vi = np.nonzero(near & np.isfinite(rough))
        return which[qi], vi

    def take(self, qi: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        q, v, d = np.concatenate([self.q, qi]), np.concatenate([self.v, ids]), np.concatenate([self.d, distance])
        kept = best(q, d, v, self.k, self.sign)
        self.q, self.v, self.d = q[kept], v[kept], d[kept]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.qids[self.q], "vec_id": self.v, "distance": self.d})


def ranked(hits: DataFrame, k: int, metric: str, tie: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """qid, rank, vec_id, distance of each query's k best; Spark limits each partition before the shuffle."""
    order = Window.partitionBy("qid").orderBy(V.better_first(metric, F.col("distance")), *tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries' ids and vectors on the driver, a block of bounded size at a time."""
    ids, rows, held = [], [], 0
    for r in queries.select("qid", V.double(F.col("q")).alias("q")).toLocalIterator(prefetchPartitions=True):
        ids.append(r["qid"])
        rows.append(r["q"])
        held += 8 * len(r["q"])
        if held >= block_bytes:
            yield np.array(ids, np.int64), np.array(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(rows)


def over_blocks(queries: DataFrame, search, schema: str = HITS, block_bytes: int | None = None) -> DataFrame:
    """The union of ``search(ids, rows)`` over the queries' blocks."""
    out = None
    for ids, rows in query_blocks(queries) if block_bytes is None else query_blocks(queries, block_bytes):
        found = search(ids, rows)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else queries.sparkSession.createDataFrame([], schema)


def exact_hits(vectors: DataFrame, queries: DataFrame, k: int, metric: str, earlier: bool = False) -> DataFrame:
    """Each partition's k best of each query: queries (in blocks) are broadcast, vectors stay where they are."""
    spark = vectors.sparkSession

    def search(ids: np.ndarray, rows: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, rows))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = TopK(*shared.value, k, metric)
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    piece = batch[at : at + 4096]
                    found.offer(piece["vec_id"].to_numpy(np.int64), matrix(piece["embedding"]), earlier=earlier)
            yield found.frame()

        return vectors.select("vec_id", "embedding").mapInPandas(part, HITS)

    return over_blocks(queries, search)


def native_hits(vectors: DataFrame, queries: DataFrame, metric: str, dim: int | None = None) -> DataFrame:
    """All distances of a stated query set in built-in functions; ``dim`` unrolls them.  For small query sets."""
    pairs = F.broadcast(queries.select("qid", "q")).crossJoin(vectors.select("vec_id", "embedding"))
    d = V.distance(metric, F.col("q"), F.col("embedding")) if dim is None else V.unrolled(metric, F.col("q"), F.col("embedding"), dim)
    return pairs.select("qid", "vec_id", d.alias("distance"))


# -- all distances ------------------------------------------------------------------------------

#: Rows of all distances that a task makes at once: 24 bytes each as they are sent, some 100 while they are made.
PAIRS = 1 << 18
#: Decimals of all distances.
DECIMALS = 6


def spread(df: DataFrame) -> DataFrame:
    """Dealt in turn to four tasks a core: where each row is compared with all queries, the work isn't in how the rows are stored."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def irregular(v: Column, dim: int) -> Column:
    """Whether it isn't ``dim`` finite numbers."""
    return F.coalesce(F.size(v) != dim, F.lit(True)) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | v.isNull()


def rounded(scaled: np.ndarray) -> np.ndarray:
    """Numbers times 10**DECIMALS to numbers, halves away from zero, no negative zero."""
    whole = np.rint(scaled)
    half = np.abs(scaled - np.trunc(scaled)) == 0.5
    if half.any():
        whole[half] = np.trunc(scaled[half]) + np.sign(scaled[half])
    return whole / 10**DECIMALS + 0.0


def block_distances(queries: np.ndarray, norms: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """(row, query) to distance, rounded.

    A matrix product gives them within a bound; those that the bound leaves near a
    half of the last decimal are summed directly, term by term.
    """
    scaled, sizes = rows @ queries.T, (rows**2).sum(1)
    if metric == "l2":
        scaled *= -2
        scaled += norms
        scaled += sizes[:, None]
        np.maximum(scaled, 0, out=scaled)
    scaled *= 10**DECIMALS
    # A sum of dim products is off by dim * 2**-53 of its terms' sizes; three such sums, twice over.
    bound = 10**DECIMALS * (rows.shape[1] + 4) * 2.0**-50 * (sizes[:, None].max(initial=0) + norms.max(initial=0))
    away = scaled - np.floor(scaled)
    away -= 0.5
    vi, qi = np.nonzero(np.abs(away, out=away) <= bound)
    for at in range(0, len(vi), STEP):
        v, q = vi[at : at + STEP], qi[at : at + STEP]
        terms = (queries[q] - rows[v]) ** 2 if metric == "l2" else queries[q] * rows[v]
        scaled[v, q] = np.cumsum(terms, axis=1)[:, -1] * 10**DECIMALS
    return rounded(scaled)


def all_distances(vectors: DataFrame, queries: DataFrame, metric: str, dim: int) -> DataFrame:
    """qid, vec_id, distance (rounded) of every query and vector, ``l2`` or ``ip``.

    As many rows as pairs, so its time grows by queries times vectors; what a task
    holds doesn't: a block of queries and PAIRS rows.  Vectors that aren't ``dim``
    finite numbers go through built-in functions, with all queries, and so do such
    queries.
    """
    spark, vectors = vectors.sparkSession, vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    odd, odd_q = irregular(F.col("embedding"), dim), irregular(F.col("q"), dim)

    def search(ids: np.ndarray, rows: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, rows))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows = shared.value
            wide = min(len(ids), PAIRS)
            norms, tall = (rows**2).sum(1), max(1, PAIRS // wide)
            for batch in batches:
                found = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dim)
                keys = batch["vec_id"].to_numpy(zero_copy_only=False)
                gaps = np.asarray(batch["vec_id"].is_null()) if batch["vec_id"].null_count else None
                for q in range(0, len(ids), wide):
                    for v in range(0, len(batch), tall):
                        d = block_distances(rows[q : q + wide], norms[q : q + wide], found[v : v + tall], metric)
                        hidden = None if gaps is None else np.repeat(gaps[v : v + tall], d.shape[1])
                        vec = np.repeat(keys[v : v + tall] if gaps is None else np.where(gaps[v : v + tall], 0, keys[v : v + tall]).astype(np.int64), d.shape[1])
                        yield pa.record_batch([pa.array(np.tile(ids[q : q + wide], len(d))), pa.array(vec, mask=hidden), pa.array(d.ravel())], ["qid", "vec_id", "distance"])

        return spread(vectors.where(~odd)).mapInArrow(part, HITS)

    plain = over_blocks(queries.where(~odd_q), search)
    by_terms = V.l2_by_norms if metric == "l2" else V.dot
    terms = F.round(by_terms(F.col("q"), F.col("embedding")), DECIMALS).alias("distance")
    for q, v in ((queries, vectors.where(odd)), (queries.where(odd_q), vectors.where(~odd))):
        plain = plain.unionByName(F.broadcast(q).crossJoin(v).select("qid", "vec_id", terms))
    return plain


#: The ways to compute distances, in the order that ``auto`` tries them.
KERNELS = ("numpy", "native", "unrolled")


def flat_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", kernel: str = "auto", dim: int | None = None) -> DataFrame:
    """Exact search: qid, rank, vec_id, distance.  Ties go to the smaller vec_id."""
    if k <= 0:
        raise InvalidArgument(f"k = {k}")
    if kernel in ("auto", "numpy"):
        return ranked(exact_hits(vectors, queries, k, metric), k, metric)
    if kernel not in KERNELS:
        raise InvalidArgument(f"no kernel {kernel!r}")
    if kernel == "unrolled" and dim is not None and metric in ("l2", "ip"):
        return unrolled_search(vectors, queries, k, metric, dim)
    return ranked(native_hits(vectors, queries, metric, dim if kernel == "unrolled" else None), k, metric)


#: Vectors whose k-th best bounds each query's k best of all.
FIRST = 4096


def unrolled_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    """Exact search in built-in functions: all pairs in generated code, a column for each dimension.

    Every pair is computed.  Sorted are those that aren't worse than the k-th best of
    FIRST vectors (by distance, then vec_id), which none of the k best can be.  Vectors
    that aren't ``dim`` finite numbers go through ``native_hits``, and so do such queries.
    """

    def wide(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        # No null is there; saying so leaves the checks out of the generated code.
        return df.select(key, *[F.coalesce(F.get(value, F.lit(i)).cast("double"), F.lit(float("nan"))).alias(f"{name}{i}") for i in range(dim)])

    distance = F.lit(0.0)
    for i in range(dim):
        a, b = F.col(f"q{i}"), F.col(f"e{i}")
        distance = distance + ((a - b) * (a - b) if metric == "l2" else a * b)
    odd, odd_q = irregular(F.col("embedding"), dim), irregular(F.col("q"), dim)
    v, q = wide(vectors.where(~odd), "vec_id", "embedding", "e"), wide(queries.where(~odd_q), "qid", "q", "q")
    first = spread(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(FIRST, k)))
    some = ranked(F.broadcast(q).crossJoin(first).select("qid", "vec_id", distance.alias("distance")), k, metric)
    limits = some.where(F.col("rank") == k).select("qid", F.col("vec_id").alias("last"), F.col("distance").alias("most"))
    none, last = (float("nan") if metric == "l2" else float("-inf")), (1 << 63) - 1  # NaN is Spark's greatest
    q = q.join(F.broadcast(limits), "qid", "left").withColumn("most", F.coalesce("most", F.lit(none))).withColumn("last", F.coalesce("last", F.lit(last)))
    pairs = F.broadcast(q).crossJoin(spread(v)).select("qid", "vec_id", "most", "last", distance.alias("distance"))
    d, most = F.col("distance"), F.col("most")
    tied = (d == most) & F.coalesce(F.col("vec_id") > F.col("last"), F.lit(False))
    hits = pairs.where((d <= most if metric == "l2" else d >= most) & ~tied).select("qid", "vec_id", "distance")
    for some_q, some_v in ((queries, vectors.where(odd)), (queries.where(odd_q), vectors.where(~odd))):
        hits = hits.unionByName(native_hits(some_v, some_q, metric))
    return ranked(hits, k, metric)


def rescored(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Each query's k best of its ``candidates`` (qid, vec_id) by the stored vectors' own distances.

    Codes give a short list, this its order: only the candidates' vectors are
    shuffled, and the distances are built-in functions.
    """
    pairs = candidates.select("qid", "vec_id").join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "q"), "qid")
    return ranked(pairs.select("qid", "vec_id", V.distance(metric, F.col("q"), F.col("embedding")).alias("distance")), k, metric)


def radius_search(vectors: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """All vectors nearer than ``radius``: qid, vec_id, distance."""
    spark = vectors.sparkSession

    def search(ids: np.ndarray, rows: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, rows))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = TopK(*shared.value, 1, metric)
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    piece = batch[at : at + 4096]
                    v = matrix(piece["embedding"])
                    for which in steps(np.arange(len(top.qids)), len(v)):
                        product = top.queries[which] @ v.T
                        rough = top.norms[which][:, None] + (v**2).sum(1) - 2 * product if metric == "l2" else -product
                        qi, vi = np.nonzero(rough < top.sign * radius + 1e-9)
                        qi = which[qi]
                        d = top.exact(qi, v, vi)
                        in_it = top.sign * d < top.sign * radius
                        yield pd.DataFrame({"qid": top.qids[qi[in_it]], "vec_id": piece["vec_id"].to_numpy(np.int64)[vi[in_it]], "distance": d[in_it]})

        return vectors.select("vec_id", "embedding").mapInPandas(part, HITS)

    return over_blocks(queries, search)


# -- the flat index ---------------------------------------------------------------------------


def flat_create(dim: int, metric: str = "l2") -> Index:
    return Index("flat", dim, metric)


def flat_add(index: Index, vectors: DataFrame) -> Index:
    """The index with more vectors; ids are the caller's."""
    index.expect("flat")
    more = checked(vectors, index.dim)
    have = index.tables.get("vectors")
    return index.with_tables(vectors=more if have is None else have.unionByName(more))


def flat_index_search(index: Index, queries: DataFrame, plan: SearchPlan, strict: bool = False) -> DataFrame:
    index.expect("flat")
    if plan.metric not in (None, index.metric):
        raise InvalidArgument(f"the index has metric {index.metric}, not {plan.metric}")
    rows = index.tables["vectors"].count() if "vectors" in index.tables else 0
    if not rows:
        raise InvalidArgument("the index is empty")
    return flat_search(index.tables["vectors"], queries, replace(plan).clamped(rows, strict=strict).k, index.metric)
