"""Exact deduplication with disk-backed keyed state.

The documents' digests pass through a streaming aggregation whose state lives
in RocksDB and never expires: by digest it keeps how many rows were seen, the
stable identifier of the row that stays, and where that row's content is (a
locator).  What the state calls a hit is then checked on full bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, documents, flagged, keyed, materialise, scratch, settings, without_keys

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def best_row() -> Column:
    """Of equal texts the one that stays: most code points, smallest doc_id (null ids last), then any one row."""
    return F.max(F.struct("n_code", F.bitwise_not("doc_id").alias("order"), "key", "locator"))


def update_registry(spark: SparkSession, arrivals: str, schema, checkpoint: str, max_bytes: int = 64 << 30) -> None:
    """Feed the digest files under ``arrivals`` that the state hasn't seen to it.

    The state is in ``checkpoint``; a later call with the same folder goes on
    where this one ended, which is how a growing corpus is deduplicated.  Rows
    are combined before they are dealt out by digest, so a digest that a third
    of all rows share reaches its state once per input task.
    """
    state = "spark.sql.streaming.stateStore"
    conf = {
        f"{state}.providerClass": ROCKSDB,
        f"{state}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{state}.rocksdb.boundedMemoryUsage": "true",
        f"{state}.rocksdb.maxMemoryUsageMB": "96",
        # Stores close when a task ends: an open one holds about 4 MB of disk and its caches.
        f"{state}.unloadOnCommit": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    with settings(spark, conf):
        seen = (
            spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(arrivals)
            .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best_row().alias("best"))
        )
        query = seen.writeStream.format("noop").outputMode("update")
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_registry(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, group_size, keep_id, keep_key, keep_locator."""
    state = spark.read.format("statestore").load(checkpoint)
    n, best = (F.col("value")[f.name] for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), n.alias("group_size"), *_kept(best))


def _kept(best: Column) -> list[Column]:
    return [F.bitwise_not(best["order"]).alias("keep_id"), best["key"].alias("keep_key"), best["locator"].alias("keep_locator")]


def classified(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``exact_dedup`` for rows from ``keyed``, with their _key too."""
    spark = rows.sparkSession
    # The locator says where a row's text is: its file, where rows come from files.
    whole = rows.select(F.col("_row")["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.col("_row")["text"], F.lit("")).alias("text"), F.col("_key").alias("key"), F.input_file_name().alias("locator"))
    digests = whole.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), F.length("text").alias("n_code"), "key", "locator")
    digests.write.parquet(arrivals := scratch(spark, "digests"))
    members = spark.read.schema(digests.schema).parquet(arrivals)
    if not members.take(1):  # nothing for a state to hold
        return members.selectExpr("doc_id", "doc_id AS keep_id", "0L AS group_size", "true AS kept", "'' AS text_sha256", "locator AS keep_locator", "key AS _key")
    update_registry(spark, arrivals, members.schema, checkpoint := scratch(spark, "state"))
    registry = materialise(read_registry(spark, checkpoint), "registry")

    # Hits on full bytes: grouping by digest and bytes compares them all; it is
    # combined before the shuffle, so copies of one text don't pile up.
    hits = flagged(
        whole.select("doc_id", F.length("text").alias("n_code"), normalised(F.col("text")).alias("bytes"), "key", "locator").withColumn("digest", digest(F.col("bytes"))),
        registry.where("group_size > 1").select("digest"), "digest",
    )
    clashing = materialise(hits.groupBy("digest", "bytes").count().groupBy("digest").count().where("count > 1").select("digest"), "clashes")
    plain = members.join(registry, "digest")
    found = plain
    if clashing.take(1):
        apart = hits.join(clashing, "digest", "left_semi")
        classes = apart.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), best_row().alias("best"))
        again = apart.join(classes.select("digest", "bytes", "group_size", *_kept(F.col("best"))), ["digest", "bytes"])
        columns = ["doc_id", "digest", "key", "keep_id", "keep_key", "group_size", "keep_locator"]
        found = plain.join(clashing, "digest", "left_anti").select(*columns).unionByName(again.select(*columns))
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("key") == F.col("keep_key")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "keep_locator", F.col("key").alias("_key"),
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal when they are the same bytes once white space is deleted; a
    null text counts as empty.  Of equal texts the one with the most code points
    stays, then the one with the smallest doc_id (null ids come last), then, of
    rows that repeat all of that, one.  So each group has exactly one kept row.
    No rows in, no rows out.

    ``digest`` may collide: rows of one digest are grouped again by full bytes
    wherever those differ.
    """
    return classified(keyed(docs), digest).drop("_key")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, one row of each group of equal texts: the one that ``exact_dedup`` keeps."""
    rows = keyed(docs)
    return without_keys(rows, materialise(classified(rows).where("NOT kept").select("_key"), "copies"))


def content_at(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """The texts that ``keep_locator`` and ``keep_id`` name, read from their files: keep_id, text.

    For registries that outlive the table they were made from; rows with null ids can't be named so.
    """
    files = [r[0] for r in kept.select("keep_locator").distinct().collect() if r[0]]  # one for each input file
    texts = spark.read.parquet(*files).select(F.col("doc_id").cast("long").alias("keep_id"), "text", F.input_file_name().alias("keep_locator"))
    return kept.select("keep_id", "keep_locator").distinct().join(texts, ["keep_id", "keep_locator"]).select("keep_id", "text")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("keep_locator")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents
), k AS (
  SELECT n, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256
FROM d JOIN k USING (n)
"""
