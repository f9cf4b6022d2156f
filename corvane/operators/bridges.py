"""Named transforms between vector spaces, and traces replayed through a space."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..plans.search import InvalidArgument
from .search import exact_hits, ranked

Transform = Callable[[Column], Column]


def scale(by: float) -> Transform:
    return lambda v: F.transform(V.double(v), lambda x: x * by)


def shift(by: Iterable[float]) -> Transform:
    offsets = F.array(*map(F.lit, map(float, by)))
    return lambda v: F.zip_with(V.double(v), offsets, lambda x, y: x + y)


def project(matrix: np.ndarray) -> Transform:
    """A linear map: one output dimension for each row of the matrix."""
    rows = [F.array(*map(F.lit, map(float, r))) for r in matrix]
    return lambda v: F.array(*[V.dot(v, r) for r in rows])


class Bridges:
    """Transforms by name, and which chain of them leads from one space to another."""

    def __init__(self):
        self.transforms: dict[str, Transform] = {"l2": V.normalised, "none": V.double}
        self.chains: dict[tuple[str, str], tuple[str, ...]] = {}

    def register(self, name: str, transform: Transform) -> None:
        if name in self.transforms:
            raise InvalidArgument(f"there is a transform {name!r} already")
        self.transforms[name] = transform

    def connect(self, source: str, target: str, chain: Iterable[str]) -> None:
        chain = tuple(chain)
        if unknown := [n for n in chain if n not in self.transforms]:
            raise InvalidArgument(f"no transform {unknown[0]!r}")
        self.chains[source, target] = chain

    def cross(self, vectors: DataFrame, source: str, target: str) -> DataFrame:
        """vec_id, embedding in the target space."""
        if (source, target) not in self.chains:
            raise InvalidArgument(f"no bridge from {source} to {target}")
        out = F.col("embedding")
        for name in self.chains[source, target]:
            out = self.transforms[name](out)
        return vectors.select("vec_id", V.double(out).cast("array<float>").alias("embedding"))


def nearest_steps(points: DataFrame, steps: DataFrame, metric: str = "l2") -> DataFrame:
    """qid, vec_id, distance: which step (vec_id, embedding) each point (qid, q) of a path is at."""
    return ranked(exact_hits(steps, points, 1, metric), 1, metric).drop("rank")
