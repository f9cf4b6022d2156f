"""Near-duplicate detection with SetSketch registers.

A document's register r is the truncated logarithm, base ``BASE``, of the least
of exponentially distributed values, one for each shingle: registers of a union
are maxima of registers, and two documents' registers agree about as often as
their sets overlap.  Bands of registers give candidates; a joint likelihood
over how many registers are larger, smaller and equal, with the known set
sizes, drops the hopeless ones; the rest are confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, flagged, keyed, materialise, small_batches, tidy, without_keys

BASE, RATE, TOP = 1.001, 20.0, 65_534
ROWS = 5
#: How often a pair just at the threshold may share no band.
MISS = 1e-6
#: Shingles that one comparing task holds; larger groups of candidates go in blocks.
HELD = 2_000_000
#: A pair is dropped on its registers only when the threshold is e**-CERTAIN times as likely as the best fit.
CERTAIN = 25.0

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sets of 64-bit shingle hashes; remembers words' hashes up to a limit."""

    def __init__(self, size: int, limit: int = 500_000):
        self.size, self.limit, self.known = size, limit, {}

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(words)
            known.update((w, digest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes; empty without words."""
        words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks alone
        if not words:
            return np.empty(0, np.uint64)
        h = np.concatenate([self._word_hashes(words[i : i + 100_000]) for i in range(0, len(words), 100_000)])
        k = min(self.size, len(words))
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):  # order counts: each step scatters what came before
            out = mixed(out + h[i : i + len(out)] * _MIX[0] + _MIX[1])
        return np.unique(out)


def multipliers(m: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The document's registers, uint16.  The logarithm is monotone, so it is
    taken once of each register's least value."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(least, (part[:, None] * factors).min(0), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likelihood(jaccard: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, share_a: np.ndarray, share_b: np.ndarray) -> np.ndarray:
    """The logarithm of the joint likelihood of the register counts."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(share_a - share_b * jaccard), p(share_b - share_a * jaccard)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return larger * log(up) + smaller * log(down) + equal * log(1 - up - down)


_GRID = np.linspace(0.0, 1.0, 41)


def hopeless(larger, smaller, equal, size_a, size_b, threshold: float) -> np.ndarray:
    """Pairs whose joint likelihood rules the threshold out."""
    total = size_a + size_b
    sa, sb = size_a / total, size_b / total
    most = np.minimum(sa, sb) / np.maximum(sa, sb)  # no pair of these sizes overlaps more
    grid = np.minimum(_GRID[:, None] * np.ones_like(most), most)
    fits = likelihood(grid, larger, smaller, equal, sa, sb)
    best = fits.argmax(0)
    at = likelihood(np.minimum(threshold, most), larger, smaller, equal, sa, sb)
    return (grid[best, np.arange(len(best))] < threshold) & (fits.max(0) - at > CERTAIN)


def links(ids: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the block's documents' true links connect.

    ``side`` is 0 for all when a block is compared with itself; else only pairs
    of different sides count.  Pairs already connected aren't compared; the rest
    are compared on full sets: inter * den >= union * num.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    ids, sketches, sizes, side = ids[order], sketches[order], sizes[order], side[order]
    flat = np.concatenate([sets[i] for i in order])
    values, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), np.uint8)
    group, found = np.arange(n), []
    threshold, both = num / den, bool(side.any() and not side.all())
    for i in range(n - 1):
        end = np.searchsorted(sizes * num, sizes[i] * den, side="right")  # sizes further apart can't link
        js = np.arange(i + 1, end)
        js = js[(group[js] != group[i]) & ((side[js] != side[i]) if both else True)]
        if not len(js):
            continue
        a, b = sketches[i], sketches[js]
        larger, smaller = (a > b).sum(1), (a < b).sum(1)
        js = js[~hopeless(larger, smaller, len(a) - larger - smaller, float(sizes[i]), sizes[js].astype(float), threshold)]
        if not len(js):
            continue
        mark[flat[starts[i] : starts[i + 1]]] = 1
        for at in range(0, len(js), 512):
            part = js[at : at + 512]
            inside = np.concatenate([flat[starts[j] : starts[j + 1]] for j in part])
            shared = np.add.reduceat(mark[inside].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            for j in part[shared * den >= (sizes[i] + sizes[part] - shared) * num]:
                if group[j] != group[i]:
                    found.append((int(ids[i]), int(ids[j])))
                    group[group == group[j]] = group[i]
        mark[flat[starts[i] : starts[i + 1]]] = 0
    return found


def _dealt(rows: DataFrame) -> DataFrame:
    row, key = F.col("_row"), F.col("_key")
    return rows.select(row["doc_id"].cast("long").alias("doc_id"), F.coalesce(row["text"], F.lit("")).alias("text"), key["file"].alias("file"), key["at"].alias("at"))


def classified(rows: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``near_duplicates`` for rows from ``keyed``, with their _key too."""
    small_batches(rows.sparkSession)
    n_bands = bands_for(num / den)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle, factors = Shingler(words), multipliers(n_bands * ROWS)
        for batch in batches:
            sets = [shingle(t) for t in batch["text"]]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            found = {"n_shingles": [len(s) for s in sets], "set_id": digests, "registers": [registers(s, factors).tobytes() if len(s) else b"" for s in sets]}
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **found, "file": batch["file"], "at": batch["at"]})

    sketched = materialise(_dealt(rows).mapInPandas(tidy(sketch), "doc_id long, n_shingles long, set_id binary, registers binary, file long, at long"), "sketches")
    linked = sketched.where("n_shingles > 0")
    # A class for each set, named by its first row.  Combined before the shuffle,
    # so the copies of one set don't pile up.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at", "n_shingles", "registers"))
    heads = linked.groupBy("set_id").agg(first.alias("first")).select("set_id", "first.*")
    heads = materialise(heads.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = F.expr(f"transform(sequence(0, {n_bands - 1}), b -> xxhash64(b, substring(registers, b * {2 * ROWS} + 1, {2 * ROWS})))")
    bands = heads.select("node", F.explode(keys).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = materialise(bands.join(shared, "bucket").select("bucket", "node", "least"), "buckets")
    groups = components(members.select(F.col("node").alias("a"), F.col("least").alias("b")))
    groups = materialise(groups.join(heads.select("node", "n_shingles"), "node"), "groups")

    found = _compare(rows, heads, _blocks(groups, members), words, num, den)
    reached = components(found)
    placed = heads.join(reached, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"), "no_id", "doc_id", "file", "at")
    keep = placed.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "file", "at")).alias("keep"))
    classes = placed.join(keep, "component").select("set_id", F.col("keep.doc_id").alias("component_id"), F.col("keep.file").alias("keep_file"), F.col("keep.at").alias("keep_at"))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("at") == F.col("keep_at"))
    columns = ["doc_id", "n_shingles", "component_id", "kept", F.struct("file", "at").alias("_key")]
    named = linked.join(classes, "set_id").withColumn("kept", kept).select(*columns)
    alone = sketched.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("kept", F.lit(True)).select(*columns)
    return named.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Shingles are ``words`` words (runs without ASCII white space, A-Z lowered);
    a text with fewer is one shingle, one without words has none and links with
    nothing.  Documents link when inter * den >= union * num over their sets;
    component_id is the smallest doc_id reachable over links, the document
    itself included.  Every row is a document of its own, whether its doc_id is
    null or repeated: null ids come last (a component_id is null where all of
    its ids are), and of each component exactly one row is kept, a row with the
    smallest doc_id.

    Equal sets are one class from the start, so copies never meet in a bucket.
    A pair at the threshold is missed with a chance of about 1e-6; every link
    reported is confirmed on full sets.
    """
    return classified(keyed(docs), words, num, den).drop("_key")


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs``, same columns, one row of each component: the one that ``near_duplicates`` keeps."""
    rows = keyed(docs)
    return without_keys(rows, materialise(classified(rows, words, num, den).where("NOT kept").select("_key"), "near-copies"))


def _blocks(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Who is compared with whom: node, block, side.

    A group of candidates (what buckets connect) of at most HELD shingles is one
    block.  A larger one is compared bucket by bucket; a bucket over HELD is cut
    by hash into chunks of about half of that; each chunk is a block, and each
    pair of chunks one with two sides.  So no task holds more, and no pair is
    left out.
    """
    weight = groups.groupBy("component").agg(F.sum("n_shingles").alias("weight"))
    placed = groups.join(weight, "component")
    small = placed.where(F.col("weight") <= HELD).select("node", F.xxhash64(F.lit("group"), "component").alias("block"), F.lit(0).alias("side"))
    large = placed.where(F.col("weight") > HELD).select("node", "n_shingles")
    inside = members.join(large, "node")
    by_bucket = inside.groupBy("bucket").agg(F.sum("n_shingles").alias("weight"))
    cut = inside.join(by_bucket.select("bucket", F.ceil(F.col("weight") / (HELD // 2)).cast("int").alias("chunks")), "bucket")
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node", "bucket"), F.col("chunks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunked = pairs.select(
        "node",
        F.xxhash64(F.lit("bucket"), "bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"),
        F.when(F.col("chunk") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    return small.unionByName(chunked)


def _compare(rows: DataFrame, heads: DataFrame, blocks: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The blocks' links (a, b), confirmed on full sets made anew from the texts."""
    m = bands_for(num / den) * ROWS

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "at": batch["at"], "shingles": [shingle(t).tobytes() for t in batch["text"]]})

    def confirm(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
        sketches = np.stack([np.frombuffer(r, np.uint16) for r in block["registers"]])[:, :m]
        return pd.DataFrame(links(block["node"].to_numpy(), sketches, sets, block["side"].to_numpy(), num, den), columns=["a", "b"], dtype="int64")

    wanted = heads.join(blocks.select("node").distinct(), "node").select("node", "registers", "file", "at")
    keys = materialise(wanted.select(F.struct("file", "at").alias("_key")), "wanted")
    texts = _dealt(flagged(rows, keys, "_key"))
    sets = texts.mapInPandas(tidy(full_sets), "file long, at long, shingles binary").join(wanted, ["file", "at"])
    dealt = blocks.join(sets.select("node", "registers", "shingles"), "node")
    return dealt.groupBy("block").applyInPandas(confirm, "a long, b long")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, num=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS l
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, u.b FROM r JOIN u ON u.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
