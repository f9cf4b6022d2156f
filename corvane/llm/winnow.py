"""Document fingerprints by winnowing, in built-in functions alone.

The k-grams of a text's UTF-8 bytes are hashed; of every ``WINDOW`` hashes in a
row the least is kept, the rightmost of equals, with its position.  Two texts
that share ``GRAM + WINDOW - 1`` bytes in a row share a kept hash.

A gram's hash (32 bits) and position sit in one long, hash * 2**31 - position - 1,
so that the smaller long is the smaller hash, further right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents

GRAM, WINDOW = 8, 32
#: Windows whose hashes are in memory at a time, whatever the text's length.
BLOCK = 1 << 15
#: Rows that lie next to each other in doc_id order in one bucket, and the most buckets.
RUN, BUCKETS = 512, 20_000

_LOW = (1 << 31) - 1
_HIGH = ((1 << 63) - 1) ^ _LOW


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _count(size: Column) -> tuple[Column, Column]:
    """Grams and windows of so many bytes; a text below GRAM bytes is one gram, fewer than WINDOW grams are one window."""
    n = F.greatest(size - (GRAM - 1), F.least(size, F.lit(1)))
    return n, F.when(n > 0, F.greatest(n - (WINDOW - 1), F.lit(1))).otherwise(F.lit(0))


def _minima(data: Column, first: Column, n: Column) -> Column:
    """The kept grams of ``n`` > 0 windows from the window ``first`` on."""
    total, _ = _count(F.length(data))
    last = F.least(first + n + (WINDOW - 2), total - 1)
    gram = lambda i: F.xxhash64(F.substr(data, i, F.lit(GRAM))).bitwiseAND(_HIGH) - i
    least = F.transform(F.sequence(first + 1, last + 1), gram)
    step = 1
    while step < WINDOW:
        least = _doubled(least, step)
        step *= 2
    return F.array_distinct(F.slice(least, 1, n))


def _doubled(least: Column, step: int) -> Column:
    """Elements that are the least of ``step`` grams to the least of twice as many."""
    ahead = lambda a: F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0)))
    return _let(least, lambda a: F.zip_with(a, ahead(a), lambda x, y: F.when(x > y, y).otherwise(x)))


def selected(data: Column, first: Column, end: Column) -> Column:
    """The kept grams of the windows from ``first`` to before ``end``, a block at a time."""
    # The bytes are bound once: reading a binary column copies it each time.
    blocks = _let(data, lambda d: F.transform(F.sequence(first, end - 1, F.lit(BLOCK)), lambda at: _minima(d, at, F.least(F.lit(BLOCK), end - at))))
    return F.when(end > first, F.flatten(blocks)).otherwise(F.array().cast("array<long>"))


def fingerprint(text: Column) -> Column:
    """The kept grams of a text, as an array of longs; empty for an empty text."""
    data = F.encode(text, "UTF-8")
    return F.array_distinct(selected(data, F.lit(0), _count(F.length(data))[1]))


def _hash(gram: Column) -> Column:
    return F.shiftright(gram + _LOW, 31)


def hashes(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, _hash))


def shown(grams: Column) -> Column:
    """hash@position (hexadecimal hash, position in bytes), comma-joined, in order of position."""
    one = lambda g: F.concat(F.lower(F.hex(_hash(g))), F.lit("@"), (F.shiftleft(_hash(g), 31) - g - 1).cast("string"))
    return F.array_join(F.transform(grams, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with bucket and follows: runs of about RUN rows in descending order of
    ``key``.  A bucket also has, marked, the first row of the one that follows
    it, so that every row finds the next in its own bucket."""
    n = docs.count()
    wanted = max(1, min(BUCKETS, n // RUN))
    if wanted > 1:
        edges = docs.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0]
        edges = sorted(set(edges))
        wide = max(1, int(len(edges) ** 0.5))
        rows = [edges[i : i + wide] for i in range(0, len(edges), wide)]
        # Two steps: rows of edges that lie wholly below, then edges of the next row.
        full = F.size(F.filter(F.array(*[F.lit(r[-1]) for r in rows]), lambda e: e <= F.col("key")))
        table = F.array(*[F.array(*map(F.lit, r)) for r in rows], F.array().cast("array<long>"))
        within = F.size(F.filter(F.element_at(table, full + 1), lambda e: e <= F.col("key")))
        placed = docs.withColumn("bucket", full * wide + within)
    else:
        placed = docs.withColumn("bucket", F.lit(0))
    heads = placed.groupBy("bucket").agg(F.max("key").alias("key"))  # a row for each bucket
    around = Window.orderBy("bucket")
    # The bucket above takes a bucket's first row; the lowest takes the very first.
    heads = heads.select("key", F.coalesce(F.lead("bucket").over(around), F.min("bucket").over(Window.partitionBy())).alias("above"))
    marked = placed.join(F.broadcast(heads), "key", "left")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("follows")), F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("follows"))))
    return marked.withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("doc_id", "key", "text", "place.*"), n


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many of the next document in descending doc_id order (the first
    follows the last).  Null texts count as empty; null doc_ids come last; rows
    that repeat a doc_id are ordered by their texts' hashes.  A lone row is its
    own next.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    placed, _ = _buckets(given)
    order = Window.partitionBy("bucket").orderBy("follows", F.desc("key"), F.desc("tie"))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    own = placed.withColumn("tie", F.xxhash64("text"))
    ahead = own.withColumn("next_text", F.lead("text").over(order)).select(
        "bucket", "follows", "key", "tie", "doc_id", n.alias("n_chars"), F.encode("text", "UTF-8").alias("data"),
        F.octet_length(F.substr("text", F.lit(1), n - cut)).alias("stays"),
        F.encode(F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut)), "UTF-8").alias("edited"),
    )
    # What windows within the unchanged part keep is computed once for both texts.
    windows, edited_windows = _count(F.length("data"))[1], _count(F.length("edited"))[1]
    shared = F.greatest(F.lit(0), F.least(F.col("stays") - (GRAM + WINDOW - 2), windows, edited_windows))
    kept = ahead.withColumn("shared", shared).withColumn("common", selected(F.col("data"), F.lit(0), F.col("shared")))
    kept = kept.withColumn("own", F.array_distinct(F.concat("common", selected(F.col("data"), F.col("shared"), windows))))
    kept = kept.withColumn("other", F.when(F.col("follows"), F.array().cast("array<long>")).otherwise(F.array_distinct(F.concat("common", selected(F.col("edited"), F.col("shared"), edited_windows)))))
    kept = kept.withColumn("own_hashes", hashes(F.col("own"))).select(
        "bucket", "follows", "key", "tie", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own_hashes",
        shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own_hashes"), hashes(F.col("other"))).alias("near_edited"),
    )
    final = kept.withColumn("next_hashes", F.lead("own_hashes").over(order)).where(~F.col("follows"))
    return final.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
