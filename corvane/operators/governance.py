"""Contracts between vector spaces, embedders and hardware; differences between versions of a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .search import exact_hits, ranked

CLASSES = ("any", "cpu", "gpu", "npu", "hybrid")
_EMBEDDER = ("id", "version", "input_schema", "preprocess_chain", "model_hash", "config_hash", "min_ram_mb", "min_vram_mb")


def hardware_class(c: Column) -> Column:
    """Lower case without outer blanks; empty is cpu."""
    plain = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(plain == "", "cpu").otherwise(plain)


def supported(ram_mb: int, vram_mb: int, gpu: bool, npu: bool) -> Column:
    """Whether hardware runs the embedder of a row."""
    kind = hardware_class(F.col("hardware_class"))
    able = F.when(kind.isin("any", "cpu"), True).when(kind == "gpu", gpu).when(kind == "npu", npu).when(kind == "hybrid", gpu and npu).otherwise(False)
    return (F.col("min_ram_mb") <= ram_mb) & (F.col("min_vram_mb") <= vram_mb) & able


def select_embedder(contracts: DataFrame, preferred: str = "cpu", **profile) -> DataFrame:
    """The contract to use, one row or none: the first supported one of the class, else the first supported one.

    ``ord`` numbers the contracts; a contract of class any is of every class.
    """
    kind, wanted = hardware_class(F.col("hardware_class")), (preferred.strip().lower() or "cpu")
    match = (kind == wanted) | (kind == "any") | F.lit(wanted == "any")
    return contracts.where(supported(**profile)).orderBy(F.when(match, 0).otherwise(1), "ord").limit(1)


def compatible(a: str, b: str, fields: tuple[str, ...] = _EMBEDDER) -> Column:
    """Whether two aliases' embedders agree in all that decides their vectors."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def has_signature(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def dangling(uses: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Uses of a ``key`` that nothing defines."""
    return uses.join(known.select(key).distinct(), key, "left_anti")


def trace_edges(traces: DataFrame) -> DataFrame:
    """trace_id, ord, source, target: each step and the next."""
    order = Window.partitionBy("trace_id").orderBy("ord")
    steps = traces.select("trace_id", F.posexplode("steps").alias("ord", "source"))
    return steps.withColumn("target", F.lead("source").over(order)).where("target IS NOT NULL")


def layout_offsets(spaces: DataFrame, mints: DataFrame) -> DataFrame:
    """space_id, mint_id, index, offset_bytes; ``ord`` orders spaces and mints."""
    sizes = spaces.join(mints.groupBy("space_id").agg(F.count(F.lit(1)).alias("n")), "space_id", "left").withColumn("bytes", F.col("dim") * 4 * F.coalesce("n", F.lit(0)))
    placed = sizes.withColumn("start", F.coalesce(F.sum("bytes").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked_mints = mints.withColumn("index", F.row_number().over(Window.partitionBy("space_id").orderBy("ord")) - 1)
    joined = ranked_mints.join(placed.select("space_id", "dim", "start"), "space_id")
    return joined.select("space_id", "mint_id", "index", (F.col("start") + F.col("index") * F.col("dim") * 4).cast("long").alias("offset_bytes"))


def space_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """space_id, field, breaking: what differs between two versions of spaces (dim, metric, normalization break)."""
    joined = old.alias("a").join(new.alias("b"), "space_id", "full")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias("differs")) for f in ("dim", "metric", "normalization")])
    return joined.select("space_id", F.explode(fields).alias("x")).where("x.differs").select("space_id", "x.field", F.lit(True).alias("breaking"))


def invariant_violations(vectors: DataFrame, dim: int, least: float, most: float) -> DataFrame:
    """vec_id, rule of vectors of another dim or with a norm outside the bounds."""
    size = V.norm(F.col("embedding"))
    rule = F.when(F.size("embedding") != dim, "dim").when((size < least) | (size > most), "norm_bound")
    return vectors.select("vec_id", rule.alias("rule")).where("rule IS NOT NULL")


# -- differences between two versions of a space's vectors -------------------------------------------


def _by_dimension(vectors: DataFrame) -> DataFrame:
    each = vectors.select(F.posexplode(V.double(F.col("embedding"))).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def dimension_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """pos, mean_shift, variance_shift."""
    a, b = _by_dimension(old).toDF("pos", "m0", "v0"), _by_dimension(new).toDF("pos", "m1", "v1")
    return a.join(b, "pos").select("pos", (F.col("m1") - F.col("m0")).alias("mean_shift"), (F.col("v1") - F.col("v0")).alias("variance_shift"))


def centroid_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: how far the mean vector moved."""
    return dimension_shift(old, new).agg(F.sqrt(F.sum(F.col("mean_shift") * F.col("mean_shift"))).alias("drift"))


def neighborhood_churn(old: DataFrame, new: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, churn: the share of each query's k neighbours that the new version doesn't have."""

    def near(vectors: DataFrame, name: str) -> DataFrame:
        q = vectors.join(F.broadcast(queries.select(F.col("qid").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
        hits = ranked(exact_hits(vectors, q, k + 1, metric).where("qid != vec_id"), k, metric)
        return hits.groupBy("qid").agg(F.collect_list("vec_id").alias(name))

    joined = near(old, "a").join(near(new, "b"), "qid")
    return joined.select("qid", (F.size(F.array_except("a", "b")) / F.size("a")).alias("churn"))
