"""Inverted files, over whole vectors (IVF) or codes of residuals (IVFPQ), and product quantization (PQ)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.search import Index, InvalidArgument, SearchPlan
from .kmeans import batches_of, kmeans_train, nearest, train_parts
from .search import BLOCK_BYTES, HITS, TopK, checked, matrix, over_blocks, ranked

_PROBED = "qid long, vec_id long, distance double, visit long"


# -- inverted file ------------------------------------------------------------------------------


def ivf_create(dim: int, nlist: int, metric: str = "l2", nprobe: int = 1) -> Index:
    if nlist <= 0:
        raise InvalidArgument(f"nlist = {nlist}")
    return Index("ivf", dim, metric, {"nlist": nlist, "nprobe": nprobe})


def ivf_train(index: Index, vectors: DataFrame) -> Index:
    """The index with centroids and no rows."""
    index.expect("ivf")
    centroids = kmeans_train(checked(vectors, index.dim), index.params["nlist"], index.metric)
    return Index("ivf", index.dim, index.metric, {**index.params, "centroids": centroids})


def trained(index: Index) -> np.ndarray:
    if "centroids" not in index.params:
        raise InvalidArgument("the index isn't trained")
    return index.params["centroids"]


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """list_id, vec_id, embedding."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, rows in batches_of(batches):
            yield piece.assign(list_id=nearest(rows, shared.value, metric))[["list_id", "vec_id", "embedding"]]

    return vectors.select("vec_id", "embedding").mapInPandas(lists, "list_id int, vec_id long, embedding array<float>")


def ivf_add(index: Index, vectors: DataFrame) -> Index:
    more = assign(checked(vectors, index.expect("ivf").dim), trained(index), index.metric)
    have = index.tables.get("lists")
    return index.with_tables(lists=more if have is None else have.unionByName(more))


def probes(queries: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str) -> np.ndarray:
    """Each query's lists, best first; the smaller list of equals."""
    size, found = max(1, TABLE_BYTES // (8 * centroids.size)), [np.empty((0, min(nprobe, len(centroids))), np.int64)]
    for i in range(0, len(queries), size):
        asked = queries[i : i + size]
        d = ((asked[:, None] - centroids[None]) ** 2).sum(2) if metric == "l2" else -(asked @ centroids.T)
        found.append(np.argsort(d, axis=1, kind="stable")[:, :nprobe])
    return np.concatenate(found)


def ivf_search(index: Index, queries: DataFrame, plan: SearchPlan) -> DataFrame:
    """Search in each query's nearest lists.

    Lists are filtered to those that any query probes, which prunes files when
    lists are stored by list_id.  Ties go by (list_id, vec_id).
    """
    centroids = trained(index.expect("ivf"))
    nprobe = min(max(1, plan.nprobe or index.params["nprobe"]), len(centroids))
    lists, spark, metric, k = index.tables["lists"], queries.sparkSession, index.metric, plan.k

    def search(ids: np.ndarray, rows: np.ndarray) -> DataFrame:
        wanted = probes(rows, centroids, nprobe, metric)
        shared = spark.sparkContext.broadcast((ids, rows, wanted))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, rows, wanted = shared.value
            found: dict[int, TopK] = {}
            for batch in batches:
                for list_id, piece in batch.groupby("list_id"):
                    which = np.flatnonzero((wanted == list_id).any(1))
                    if len(which):
                        top = found.setdefault(list_id, TopK(ids[which], rows[which], k, metric))
                        top.offer(piece["vec_id"].to_numpy(np.int64), matrix(piece["embedding"]))
            for list_id, top in found.items():
                yield top.frame().assign(visit=list_id)

        used = lists.where(F.col("list_id").isin(np.unique(wanted).tolist())) if wanted.size <= 10_000 else lists
        return used.select("list_id", "vec_id", "embedding").mapInPandas(part, _PROBED)

    # A task holds each query, and its k best, once for each probed list.
    held = nprobe * (8 * index.dim + 24 * k) // (8 * index.dim)
    return ranked(over_blocks(queries, search, _PROBED, max(1, BLOCK_BYTES // max(1, held))), k, metric, ("visit", "vec_id"))


# -- product quantization ---------------------------------------------------------------------


def pq_create(dim: int, m: int, ksub: int = 256, metric: str = "l2") -> Index:
    if m <= 0 or dim % m:
        raise InvalidArgument(f"{dim} dimensions in {m} parts")
    if not 0 < ksub <= 256:
        raise InvalidArgument(f"ksub = {ksub}: codes are bytes")
    return Index("pq", dim, metric, {"m": m, "ksub": ksub})


def pq_train(index: Index, vectors: DataFrame) -> Index:
    """Codebooks by squared distance, whatever the metric."""
    index.expect("pq")
    return index.with_params(codebooks=train_parts(checked(vectors, index.dim), index.params["ksub"], index.params["m"]))


def pq_set_codebooks(index: Index, codebooks: np.ndarray) -> Index:
    m, ksub = index.expect("pq").params["m"], index.params["ksub"]
    if codebooks.shape != (m, ksub, index.dim // m):
        raise InvalidArgument(f"codebooks of shape {codebooks.shape}")
    return index.with_params(codebooks=codebooks.astype(np.float64))


def encode_rows(rows: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    m, _, width = codebooks.shape
    return np.stack([nearest(rows[:, s * width : (s + 1) * width], codebooks[s]) for s in range(m)], 1)


def pq_encode(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, codes: the nearest code of each part, the smaller of equals."""
    if codebooks.shape[1] > 256:
        raise InvalidArgument("codes are bytes")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, rows in batches_of(batches):
            yield pd.DataFrame({"vec_id": piece["vec_id"], "codes": list(encode_rows(rows, codebooks).astype(np.int16))})

    return vectors.select("vec_id", "embedding").mapInPandas(coded, "vec_id long, codes array<smallint>")


def decode_rows(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    if codes.size and (codes.min() < 0 or codes.max() >= codebooks.shape[1]):
        raise InvalidArgument("a code is outside the codebook")
    return np.concatenate([codebooks[s][codes[:, s]] for s in range(codebooks.shape[0])], 1)


def pq_decode(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, embedding from vec_id, codes."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"vec_id": batch["vec_id"], "embedding": list(decode_rows(np.stack(batch["codes"].to_numpy()).astype(np.int64), codebooks).astype(np.float32))})

    return codes.select("vec_id", "codes").mapInPandas(decoded, "vec_id long, embedding array<float>")


def pq_add(index: Index, vectors: DataFrame) -> Index:
    if "codebooks" not in index.expect("pq").params:
        raise InvalidArgument("the index isn't trained")
    more = pq_encode(checked(vectors, index.dim), index.params["codebooks"])
    have = index.tables.get("codes")
    return index.with_tables(codes=more if have is None else have.unionByName(more))


def lookup(queries: np.ndarray, codebooks: np.ndarray, metric: str) -> np.ndarray:
    """(query, part, code) to the part's distance."""
    m, _, width = codebooks.shape
    parts = queries.reshape(len(queries), m, 1, width)
    return ((parts - codebooks[None]) ** 2).sum(3) if metric == "l2" else (parts * codebooks[None]).sum(3)


#: Bytes of differences that a task makes at once for lookup tables.
TABLE_BYTES = 8 << 20
#: Coded vectors that a task holds, and compares with one part of the queries after the other.
CODED = 1 << 19


def query_steps(n: int, codebooks: np.ndarray) -> Iterator[slice]:
    """Queries for whose lookup tables TABLE_BYTES are enough."""
    size = max(1, TABLE_BYTES // (8 * codebooks.size))
    return (slice(i, i + size) for i in range(0, n, size))


def coded_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """list_id (0 where there is none), vec_id and codes, as bytes, of up to CODED rows and a batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        lists = batch["list_id"].to_numpy(np.int32) if "list_id" in batch else np.zeros(len(batch), np.int32)
        held.append((lists, batch["vec_id"].to_numpy(np.int64), np.stack(batch["codes"].to_numpy()).astype(np.uint8)))
        n += len(batch)
        if n >= CODED:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def pq_search(index: Index, queries: DataFrame, plan: SearchPlan) -> DataFrame:
    """All codes, by table lookups for each query.  Ties go to the smaller vec_id."""
    books, spark, metric, k = index.expect("pq").params["codebooks"], queries.sparkSession, index.metric, plan.k

    def search(ids: np.ndarray, rows: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, rows))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, rows = shared.value
            for _, keys, codes in coded_chunks(batches):
                for some in query_steps(len(ids), books):
                    out = []
                    for q, table in enumerate(lookup(rows[some], books, metric), some.start):
                        d = by_table(table, codes)
                        kept = best_of(d, keys, k, metric)
                        out.append((np.full(len(kept), q), keys[kept], d[kept]))
                    q_, v_, d_ = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"qid": ids[q_], "vec_id": v_, "distance": d_})

        return index.tables["codes"].select("vec_id", "codes").mapInPandas(part, HITS)

    return ranked(over_blocks(queries, search), k, metric)


# -- inverted file over codes of residuals --------------------------------------------------------


def ivfpq_create(dim: int, nlist: int, m: int, ksub: int = 256, metric: str = "l2", nprobe: int = 1) -> Index:
    pq_create(dim, m, ksub, metric)
    if nlist <= 0:
        raise InvalidArgument(f"nlist = {nlist}")
    return Index("ivfpq", dim, metric, {"nlist": nlist, "nprobe": nprobe, "m": m, "ksub": ksub})


def ivfpq_train(index: Index, vectors: DataFrame) -> Index:
    rows = checked(vectors, index.expect("ivfpq").dim)
    centroids = kmeans_train(rows, index.params["nlist"], index.metric)
    books = train_parts(rows, index.params["ksub"], index.params["m"], index.metric, center=centroids)
    return Index("ivfpq", index.dim, index.metric, {**index.params, "centroids": centroids, "codebooks": books})


def ivfpq_encode(vectors: DataFrame, centroids: np.ndarray, books: np.ndarray, metric: str) -> DataFrame:
    """list_id, vec_id, codes of each vector's difference to its list's centroid."""

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, rows in batches_of(batches):
            at = nearest(rows, centroids, metric)
            yield pd.DataFrame({"list_id": at, "vec_id": piece["vec_id"], "codes": list(encode_rows(rows - centroids[at], books).astype(np.int16))})

    return vectors.select("vec_id", "embedding").mapInPandas(coded, "list_id int, vec_id long, codes array<smallint>")


def ivfpq_add(index: Index, vectors: DataFrame) -> Index:
    more = ivfpq_encode(checked(vectors, index.expect("ivfpq").dim), trained(index), index.params["codebooks"], index.metric)
    have = index.tables.get("lists")
    return index.with_tables(lists=more if have is None else have.unionByName(more))


def ivfpq_search(index: Index, queries: DataFrame, plan: SearchPlan, compat: bool = False) -> DataFrame:
    """Search codes in each query's nearest lists.  Ties go by (probe rank, vec_id).

    ``ip`` is the product with centroid plus residual; ``compat`` is the product
    of the query's own residual with the coded one instead.
    """
    centroids, books = trained(index.expect("ivfpq")), index.params["codebooks"]
    nprobe = min(max(1, plan.nprobe or index.params["nprobe"]), len(centroids))
    spark, metric, k = queries.sparkSession, index.metric, plan.k

    def search(ids: np.ndarray, rows: np.ndarray) -> DataFrame:
        wanted = probes(rows, centroids, nprobe, metric)
        shared = spark.sparkContext.broadcast((ids, rows, wanted))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, rows, wanted = shared.value
            for lists, every, coded in coded_chunks(batches):
                order = np.argsort(lists, kind="stable")
                lists, every, coded = lists[order], every[order], coded[order]
                starts = np.flatnonzero(np.diff(lists, prepend=lists[0] - 1))
                for some in query_steps(len(ids), books):
                    out = []
                    for a, b in zip(starts, [*starts[1:], len(lists)], strict=True):
                        which, rank = np.nonzero(wanted[some] == lists[a])
                        if not len(which):
                            continue
                        centroid, codes, keys, which = centroids[lists[a]], coded[a:b], every[a:b], which + some.start
                        asked = rows[which]
                        if metric == "l2" or compat:
                            tables, added = lookup(asked - centroid, books, metric), np.zeros(len(asked))
                        else:
                            tables, added = lookup(asked, books, metric), asked @ centroid
                        for q, r, table, more in zip(which, rank, tables, added, strict=True):
                            d = by_table(table, codes) + more
                            kept = best_of(d, keys, k, metric)
                            out.append((np.full(len(kept), q), keys[kept], d[kept], np.full(len(kept), r)))
                    if not out:
                        continue
                    # Nothing is held from step to step: each sends its queries' k best of these rows.
                    q_, v_, d_, r_ = (np.concatenate(x) for x in zip(*out, strict=True))
                    order = np.lexsort((v_, r_, d_ if metric == "l2" else -d_, q_))
                    order = order[np.arange(len(order)) - np.searchsorted(q_[order], q_[order], side="left") < k]
                    yield pd.DataFrame({"qid": ids[q_[order]], "vec_id": v_[order], "distance": d_[order], "visit": r_[order]})

        used = index.tables["lists"].where(F.col("list_id").isin(np.unique(wanted).tolist())) if wanted.size <= 10_000 else index.tables["lists"]
        return used.select("list_id", "vec_id", "codes").mapInPandas(part, _PROBED)

    return ranked(over_blocks(queries, search, _PROBED), k, metric, ("visit", "vec_id"))


def by_table(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Each row's sum of its codes' entries."""
    at = np.arange(codes.shape[1])
    return np.concatenate([table[at, codes[i : i + 4096]].sum(1) for i in range(0, len(codes), 4096)])


def best_of(d: np.ndarray, keys: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Positions of the k best, then the smaller keys."""
    cost = d if metric == "l2" else -d
    if len(d) > 4 * k and not np.isnan(limit := np.partition(cost, k - 1)[k - 1]):
        near = np.flatnonzero(cost <= limit)
        return near[np.lexsort((keys[near], cost[near]))[:k]]
    return np.lexsort((keys, cost))[:k]
