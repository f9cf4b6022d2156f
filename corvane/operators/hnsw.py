"""A single-layer neighbour graph: exact forward edges, ordered backlinks, beam search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.search import Index, InvalidArgument, SearchPlan
from .search import checked, exact_hits, ranked

#: Bytes of graph and vectors that a search broadcasts; a larger index has to be searched in shards.
GRAPH_BYTES = 1 << 30
#: Nodes that a beam leaves at a time.
FRONT = 4


def hnsw_create(dim: int, m: int, ef_construction: int = 64, metric: str = "l2") -> Index:
    if m <= 0 or ef_construction <= 0:
        raise InvalidArgument(f"m = {m}, ef_construction = {ef_construction}")
    return Index("hnsw", dim, metric, {"m": m, "ef_search": ef_construction})


def forward_edges(vectors: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """node, slot, neighbor, distance: each vector's exact m best among smaller vec_ids."""
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return ranked(exact_hits(vectors, queries, m, metric, earlier=True), m, metric).toDF("node", "slot", "neighbor", "distance")


def with_backlinks(edges: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """node, neighbors (in slot order) once every forward edge i -> j was offered to j, i ascending.

    j takes i into a free slot, or in place of its worst neighbour (the first of
    equals) if i is strictly better.  Nodes don't depend on each other: edges are
    dealt by node and read in order, with one node's slots in memory.
    """
    own = edges.select("node", F.lit(0).alias("late"), F.col("slot").cast("long").alias("at"), "neighbor", "distance")
    back = edges.select(F.col("neighbor").alias("node"), F.lit(1).alias("late"), F.col("node").alias("at"), F.col("node").alias("neighbor"), "distance")
    dealt = own.unionByName(back).repartition("node").sortWithinPartitions("node", "late", "at")
    worse = (lambda a, b: a > b) if metric == "l2" else (lambda a, b: a < b)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, slots, costs = None, [], []
        for batch in batches:
            out = []
            for n, i, d in zip(batch["node"], batch["neighbor"], batch["distance"], strict=True):
                if n != node:
                    if node is not None:
                        out.append((node, slots))
                    node, slots, costs = n, [], []
                if i in slots:
                    continue
                if len(slots) < m:
                    slots.append(i)
                    costs.append(d)
                    continue
                last = 0
                for s in range(1, m):
                    if worse(costs[s], costs[last]):
                        last = s
                if worse(costs[last], d):
                    slots[last], costs[last] = i, d
            yield pd.DataFrame(out, columns=["node", "neighbors"])
        if node is not None:
            yield pd.DataFrame([(node, slots)], columns=["node", "neighbors"])

    return dealt.mapInPandas(fold, "node long, neighbors array<long>")


def hnsw_add(index: Index, vectors: DataFrame) -> Index:
    """The index over its vectors and these; a snapshot taken before goes on as it was."""
    more = checked(vectors, index.expect("hnsw").dim)
    have = index.tables.get("vectors")
    rows = more if have is None else have.unionByName(more)
    return index.with_tables(vectors=rows, graph=with_backlinks(forward_edges(rows, index.params["m"], index.metric), index.params["m"], index.metric))


def hnsw_snapshot(index: Index, path: str) -> Index:
    """An immutable copy at ``path``: searches read it whatever is added later."""
    spark = index.expect("hnsw").tables["graph"].sparkSession
    for name in ("vectors", "graph"):
        index.tables[name].write.parquet(f"{path}/{name}")
    return index.with_tables(**{name: spark.read.parquet(f"{path}/{name}") for name in ("vectors", "graph")})


class Beam:
    """Best-first search over a graph in memory."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, graph: dict[int, list[int]], metric: str):
        self.ids, self.rows, self.metric = ids, rows, metric
        place = {int(v): i for i, v in enumerate(ids)}
        self.next = [[place[n] for n in graph.get(int(v), [])] for v in ids]

    def cost(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        v = self.rows[at]
        return ((v - q) ** 2).sum(1) if self.metric == "l2" else -(v @ q)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[int, float]]:
        """The k best of what the beam met, from the smallest id on.

        The FRONT nearest nodes that wait are left together, so that their
        neighbours' distances are one product.  Everything is ordered by distance,
        then id.
        """
        if not len(self.ids):
            return []
        ef = min(max(k, ef), len(self.ids))
        entry = lambda cost, n: (float(cost), int(self.ids[n]), n)
        waiting, seen = [entry(self.cost(q, [0])[0], 0)], {0}
        best = [(-waiting[0][0], -waiting[0][1])]  # the worst of the ef best on top
        while waiting:
            front: list[int] = []
            while waiting and len(front) < FRONT and (len(best) < ef or waiting[0][:2] <= (-best[0][0], -best[0][1])):
                front.append(heapq.heappop(waiting)[2])
            if not front:
                break
            new = sorted({n for f in front for n in self.next[f]} - seen)
            seen.update(new)
            for found in map(entry, self.cost(q, new) if new else [], new):
                if len(best) < ef or found[:2] < (-best[0][0], -best[0][1]):
                    (heapq.heappush if len(best) < ef else heapq.heapreplace)(best, (-found[0], -found[1]))
                    heapq.heappush(waiting, found)
        sign = 1 if self.metric == "l2" else -1
        return [(v, sign * c) for c, v in sorted((-c, -v) for c, v in best)[:k]]


def hnsw_search(index: Index, queries: DataFrame, plan: SearchPlan) -> DataFrame:
    """Beam search of width ``plan.nprobe`` (the index's own if 0).

    Graph and vectors are broadcast if they are no more than GRAPH_BYTES, which
    is checked; queries stay distributed.
    """
    graph, vectors = index.expect("hnsw").tables["graph"], index.tables["vectors"]
    n = vectors.count()
    if n * 8 * (index.dim + index.params["m"]) > GRAPH_BYTES:
        raise InvalidArgument(f"{n} rows are too many to broadcast: search shards and merge their hits")
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").toPandas()
    links = {r["node"]: r["neighbors"] for r in graph.collect()}
    ids = rows["vec_id"].to_numpy(np.int64)
    matrix = np.stack(rows["embedding"].to_numpy()).astype(np.float64) if n else np.empty((0, index.dim))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix, links))
    ef, k, metric = plan.nprobe or index.params["ef_search"], max(1, plan.k), index.metric

    def beams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beam = Beam(*shared.value, metric)
        for batch in batches:
            found = [(qid, r + 1, v, d) for qid, q in zip(batch["qid"], batch["q"], strict=True) for r, (v, d) in enumerate(beam.search(np.asarray(q, np.float64), k, ef))]
            yield pd.DataFrame(found, columns=["qid", "rank", "vec_id", "distance"])

    return queries.select("qid", "q").mapInPandas(beams, "qid long, rank int, vec_id long, distance double")


def sharded_search(shards: list[Index], queries: DataFrame, plan: SearchPlan) -> DataFrame:
    """Each shard's beam search, merged: for indexes too large to broadcast whole."""
    hits = None
    for shard in shards:
        found = hnsw_search(shard, queries, plan).drop("rank")
        hits = found if hits is None else hits.unionByName(found)
    return ranked(hits, max(1, plan.k), shards[0].metric)


