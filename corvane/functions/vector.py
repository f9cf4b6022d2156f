"""Vector expressions in built-in functions: distances, norms, parts of vectors.

``l2`` is the squared Euclidean distance (less is nearer), ``ip`` the inner
product (more is nearer), ``cosine`` the inner product of normalised vectors.
All arithmetic is in double precision whatever the columns hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def better_first(metric: str, distance: Column) -> Column:
    """Sort key: best first."""
    return F.asc(distance) if metric == "l2" else F.desc(distance)


def double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(double(a), double(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)))


def l2_by_norms(a: Column, b: Column) -> Column:
    """The same from norms and an inner product, clamped at zero: for blocks whose norms are at hand."""
    return F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(double(v), lambda x: x / length)).otherwise(double(v))


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"l2": l2, "ip": dot, "cosine": cosine}[metric](a, b)


def unrolled(metric: str, a: Column, b: Column, dim: int) -> Column:
    """One term for each dimension: stays inside generated code, best for few dimensions and repeated use."""
    out = F.lit(0.0)
    for i in range(dim):
        x, y = double(a)[i], double(b)[i]
        out = out + ((x - y) * (x - y) if metric == "l2" else x * y)
    return out


def residual(v: Column, centroid: Column) -> Column:
    return F.zip_with(double(v), double(centroid), lambda x, y: x - y)


def subvector(v: Column, part: int | Column, width: int) -> Column:
    """The part (from 0) of ``width`` dimensions."""
    first = part * width + 1 if isinstance(part, int) else part * F.lit(width) + 1
    return F.slice(v, first, width)
