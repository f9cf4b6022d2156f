"""Language identification with bit-sliced Bloom filters of n-grams.

One array of bytes holds the Bloom filters of all languages side by side: a slot
has a bit for each.  Looking an n-gram up reads its slots and gives, by one AND,
the set of languages that contain it.  A text's languages are counted bit by
bit, corrected for each filter's false positives, and the largest count decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, small_batches

#: N-gram lengths; slots that an n-gram has; slots of the filters for each n-gram of the language with most.
LENGTHS, HASHES, ROOM = (3, 4), 3, 16
#: Bound on what is learned from: expected rows of each language.
SAMPLE = 2_000
#: A language contains an n-gram seen this often in it, at this share of the rate of the language that has it most.
SEEN, SHARE = 5, 0.3
#: Characters of a text that are looked up at a time.
STEP = 1 << 18

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


@functools.cache
def _letters() -> np.ndarray:
    """Code point to itself for letters, to a blank for all else."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def grams(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each n-gram, whether it has letters at all), step by step; n-grams
    cover words and the blanks next to them."""
    text = f" {(text or '').lower()} "
    for at in range(0, max(1, len(text) - max(LENGTHS) + 1), STEP):
        codes = np.frombuffer(text[at : at + STEP + max(LENGTHS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _letters()[codes].astype(np.uint64)
        for n in LENGTHS:
            if len(codes) >= n:
                size = len(codes) - n + 1
                h = np.full(size, np.uint64(n), np.uint64)
                dense = np.ones(size, bool)
                for i in range(n):
                    part = codes[i : i + size]
                    h = (h ^ part) * _FACTORS[i % 4]
                    h ^= h >> np.uint64(29)
                    if 0 < i < n - 1:
                        dense &= part != 32  # no n-gram spans a blank
                yield h, dense


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # (slots, a power of two; bytes for the languages)
    wrong: np.ndarray  # each language's rate of false positives

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Filters:
        languages = sorted(members)
        size = 1 << max(16, (ROOM * max(map(len, members.values()), default=0)).bit_length())
        slots = np.zeros((size, -(-len(languages) // 8)), np.uint8)
        for k, name in enumerate(languages):
            for at in cls._places(members[name], size):
                slots[at, k // 8] |= np.uint8(1 << (k % 8))
        fill = np.unpackbits(slots, axis=1, bitorder="little")[:, : len(languages)].mean(0)
        return cls(languages, slots, fill**HASHES)

    @staticmethod
    def _places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
        mask = np.uint64(size - 1)
        second = (h >> np.uint64(40)) | np.uint64(1)
        for i in range(HASHES):
            yield ((h + np.uint64(i) * second) & mask).astype(np.int64)

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """Corrected number of the text's n-grams that each language contains, and how many there are."""
        found, total = np.zeros(len(self.languages)), 0
        for h, dense in grams(text):
            h = h[dense]
            total += len(h)
            masks = functools.reduce(np.bitwise_and, (self.slots[at] for at in self._places(h, len(self.slots))))
            if masks.shape[1] == 1:
                by_mask = np.bincount(masks[:, 0], minlength=256)
                bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
                found += (by_mask @ bits)[: len(self.languages)]
            else:
                found += np.unpackbits(masks, axis=1, bitorder="little")[:, : len(self.languages)].sum(0)
        return np.maximum(0.0, (found - self.wrong * total) / (1 - self.wrong)), total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of all languages' counts; ``und`` and 0 without a letter.

        Ties, and texts none of whose n-grams is known, go to the first language
        by name.
        """
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        found, _ = self.counts(text)
        best = int(found.argmax())
        return self.languages[best], float(found[best] / found.sum()) if found.sum() else 0.0


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from the text and lang of rows that may be learned from.

    Held out: crc32(doc_id as text) mod 4 = 2.  About ``sample`` rows of a
    language at most are read.  Every language of a row that may be learned from
    is one that texts can get, be its filter empty.
    """
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    may = may.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "lang", "text")
    sizes = may.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # a row for each language
    part = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = may.join(F.broadcast(sizes), "lang").where(part <= F.lit(float(sample)) / F.col("rows")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                h = [x[dense] for t in texts for x, dense in grams(t)]
                values, n = np.unique(np.concatenate(h) if h else np.empty(0, np.uint64), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": values.view(np.int64), "n": n})

    counted = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("lang")
    rated = counted.withColumn("rate", F.col("n") / F.sum("n").over(totals)).where(F.col("n") >= SEEN)
    shared = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most"))
    rows = shared.select("lang", "gram").toPandas()  # of the sampled rows' n-grams, those seen SEEN times
    members = {r["lang"]: np.empty(0, np.uint64) for r in sizes.collect()}
    return Filters.build(members | {lang: part["gram"].to_numpy(np.int64).view(np.uint64) for lang, part in rows.groupby("lang")})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; only texts are looked at."""

    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [filters.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [p for p, _ in found], "score": [s for _, s in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(docs, learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
