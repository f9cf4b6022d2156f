"""Helpers the operators share: the cluster's shared folder, settings, text rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The characters the contracts call white space: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"

_CREATED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share.

    ``spark.checkpoint.dir`` names it.  Where a session has none and one machine
    is all there is (tests, a notebook), a fresh local folder is used and
    recorded in the session; on a cluster that would be a different folder on
    each node, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex[:12]}"
    if not _CREATED:
        atexit.register(_remove_all)
    _CREATED.append((spark, path))
    return path


def _remove_all() -> None:
    for spark, path in _CREATED:
        with contextlib.suppress(Exception):  # the session may be gone by now
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    what comes after reads files that outlive the executors that wrote them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the span of a block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand texts to Python ``rows`` at a time unless the session says otherwise:
    Spark's own 10,000 long texts and their copies are what fills a worker.
    Stays set, since results are computed after the call that made them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


#: What operators keep in a worker between its tasks.
_KEPT: list[dict] = []


def kept_in_worker() -> dict:
    """A new dict that lasts from task to task, until a function that is ``tidy`` runs in the worker."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go() -> None:
    """Forget what earlier operators keep in this worker and hand freed memory back to the system."""
    import pyarrow as pa

    if any(_KEPT):
        for kept in _KEPT:
            kept.clear()
        gc.collect()  # encoders refer to themselves
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function``, for mapInPandas or mapInArrow, in a worker that holds nothing of earlier
    operators, nor of the function once it ends: workers outlive stages, and a tokenizer
    that one of them left would stand beside all that later ones need."""

    def run(batches: Iterator) -> Iterator:
        let_go()
        yield from function(batches)
        let_go()

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- rows' identities ------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns of ``docs`` in one) and _key, which tells rows apart whatever their ids.

    Rows read from files have the hash of their file's path and their number in
    it, the same whenever they are read; rows of any other origin are numbered
    and written to the shared folder first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        key = F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].cast("long").alias("at"))
        found = docs.select(*packed(docs, as_columns=True), key.alias("_key"))
        found.schema  # resolves names  # noqa: B018
        return found
    except AnalysisException:
        return materialise(packed(docs).withColumn("_key", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows")


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Of rows from ``keyed``, those whose _key isn't among ``keys`` (_key), with their own columns again."""
    kept = without(rows, keys, "_key")
    return kept.select(*[F.col("_row")[c].alias(c) for c in rows.schema["_row"].dataType.names])


def with_keys(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All ``rows`` from ``keyed`` with the other columns of ``found`` (_key and more, at most one row a
    key), null where it has none; only rows that ``found`` may have are joined."""
    bits = filter_bits(found.count())
    marked = _with_flag(rows, found, "_key", bits) if bits else packed(rows).withColumn("_flag", F.lit(True))
    more = [f for f in found.schema.fields if f.name != "_key"]
    own = [F.col("_row")["_row"].alias("_row"), F.col("_row")["_key"].alias("_key")]
    clear = marked.where("NOT _flag").select(*own, *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
    return clear.unionByName(marked.where("_flag").select(*own).join(found, "_key", "left"))


# -- membership filter -----------------------------------------------------------------------

#: Bits of the filter for each key, and the bits that are still broadcast (256 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 31


def filter_bits(n: int) -> int:
    """Bits of a filter for ``n`` keys, a power of two; 0 where it would be too large to broadcast."""
    bits = 1 << max(16, (BITS_A_KEY * max(1, n) - 1).bit_length())
    return bits if bits <= MOST_BITS else 0


def flagged(rows: DataFrame, keys: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """The rows whose ``column`` may be among ``keys``: all true members, few others.

    A bitmap, sized by the number of keys, is built with the native bitmap
    aggregate and broadcast.  It only saves the rows from a shuffle; callers join
    or group exactly afterwards.  Where it would be over 256 MB all rows pass.
    """
    bits = filter_bits(keys.count()) if bits is None else bits
    return _unpacked(_with_flag(rows, keys, column, bits).where("_flag"), rows) if bits else rows.where(F.col(column).isNotNull())


def without(rows: DataFrame, keys: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """The rows whose ``column`` isn't among ``keys``; null values stay.

    Rows that the bitmap clears, most of them, pass without a shuffle; only the
    others are joined (all of them where the bitmap would be over 256 MB).
    """
    bits = filter_bits(keys.count()) if bits is None else bits
    dropped = keys.select(F.col(column).alias("_key"))
    marked = _with_flag(rows, keys, column, bits) if bits else packed(rows).withColumn("_flag", F.lit(True))
    unclear = marked.where("_flag").withColumn("_key", F.col("_row")[column]).join(dropped, "_key", "left_anti")
    return _unpacked(marked.where("NOT _flag"), rows).unionByName(_unpacked(unclear, rows))


def packed(rows: DataFrame, as_columns: bool = False):
    """All columns in one, _row, so that names of ours can't clash with them."""
    column = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    return [column] if as_columns else rows.select(column)


def _unpacked(frame: DataFrame, rows: DataFrame) -> DataFrame:
    return frame.select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def _with_flag(rows: DataFrame, keys: DataFrame, column: str, bits: int) -> DataFrame:
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    kind = rows.schema[column].dataType
    same = F.col(column) if isinstance(kind, StructType) else F.col(column).cast(kind)  # equal hashes need equal types
    keys = keys.select(same.alias("_key")).where("_key IS NOT NULL")
    bitmap = (
        keys.select(slot(F.col("_key")).alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bitmap"))
    )
    placed = packed(rows).withColumn("_slot", slot(F.col("_row")[column]))
    hit = F.expr(
        "shiftright(cast(conv(hex(substring(_bitmap, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)), 16, 10) as int),"
        " cast(bitmap_bit_position(_slot) % 8 as int)) & 1 = 1"
    )
    joined = placed.join(F.broadcast(bitmap), F.bitmap_bucket_number(F.col("_slot")) == F.col("_bucket"), "left")
    return joined.select("_row", (F.col("_row")[column].isNotNull() & F.coalesce(hit, F.lit(False))).alias("_flag"))
