"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


#: Nodes with more edges than this are hubs; rounds with more edges than HUB * HUBS raise it,
#: so that at most 2 * HUBS of them are broadcast, whatever the graph.
HUB, HUBS = 1_000, 50_000
#: Up to so many edges all nodes' minima (16 bytes each) are broadcast, and no edge is dealt to find its node's.
FEW = 500_000


def least_of(edges: DataFrame, few: bool) -> DataFrame:
    """a, m (the least b of a) and, unless ``few``, n (the edges of a).  Combined before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), *([] if few else [F.count(F.lit(1)).alias("n")]))


def with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (a, b) with m, the least b of each a, as ``least_of`` has it.

    Of up to FEW edges all minima are broadcast.  Of more, few nodes can have
    many edges: their minima are broadcast, so that a hub's edges stay where they
    are, and only the other nodes' edges are dealt by node.
    """
    if n_edges <= FEW:
        return edges.join(F.broadcast(least.select("a", "m")), "a")
    hub = max(HUB, n_edges // HUBS)
    marked = edges.join(F.broadcast(least.where(F.col("n") > hub).select("a", F.col("m").alias("hub_m"))), "a", "left")
    rest = marked.where("hub_m IS NULL").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
    return marked.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For each node of ``edges`` (a, b): node, component, the smallest node it reaches.

    Alternating large-star and small-star steps: each keeps the components and
    hangs nodes under smaller ones, so rounds grow with the logarithm of the
    longest path.  Each round's edges are written to the shared folder.  A hub's
    edges are never dealt by the hub (see ``with_least``), nor gathered into a list.
    """
    current = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(current)
    for _ in range(rounds):
        n = state[0]
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: a node's larger neighbours hang under its least neighbour, or itself.
        star = with_least(both, least_of(both, 2 * n <= FEW), 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialise(star.distinct(), "edges")
        # Small star: a node and its smaller neighbours hang under the least of them.
        low = least_of(large, n <= FEW)
        small = with_least(large, low, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        current = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    member = current.groupBy("a").agg(F.min("b").alias("component"))
    roots = member.select("component").distinct().select(F.col("component").alias("node"), "component")
    return member.select(F.col("a").alias("node"), "component").unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: equal sets have equal ones."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(a as decimal(38,0)) - b)")).first())
