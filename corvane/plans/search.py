"""Plans and indexes as values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

KINDS = ("flat", "pq", "ivf", "ivfpq", "hnsw")


class InvalidArgument(ValueError):
    """An argument that no call accepts."""


class NotReady(RuntimeError):
    """A call that the object's state doesn't allow now."""


@dataclass(frozen=True)
class SearchPlan:
    """What a search asks for.  ``nprobe`` is the beam width for graph indexes; 0 takes the index's own."""

    k: int = 10
    nprobe: int = 0
    metric: str | None = None

    def clamped(self, rows: int, lists: int = 0, strict: bool = False) -> SearchPlan:
        """k within 1..rows and nprobe within 1..lists; ``strict`` rejects a k outside instead."""
        if strict and not 0 < self.k <= rows:
            raise InvalidArgument(f"k = {self.k} of {rows} rows")
        k = min(max(1, self.k), rows)
        return replace(self, k=k, nprobe=min(max(1, self.nprobe), lists) if lists else max(k, min(self.nprobe, rows)))


@dataclass(frozen=True)
class Index:
    """An index: its kind, its parameters, and its tables.  Adding gives a new one."""

    kind: str
    dim: int
    metric: str
    params: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise InvalidArgument(f"no index kind {self.kind!r}")
        if self.dim <= 0:
            raise InvalidArgument(f"dim = {self.dim}")
        if self.metric not in ("l2", "ip"):
            raise InvalidArgument(f"metric {self.metric!r}")

    def expect(self, kind: str) -> Index:
        if self.kind != kind:
            raise InvalidArgument(f"a {self.kind} index, not {kind}")
        return self

    def with_tables(self, **tables: DataFrame) -> Index:
        return replace(self, tables={**self.tables, **tables})

    def with_params(self, **params) -> Index:
        return replace(self, params={**self.params, **params})
