"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, letters that look like Latin ones, and digits or
signs inside words that stand for letters.  Entries of the lexicon match at the
start of a word and weigh what the labelled rows say; words of exception phrases
don't count.  The sum of weights is set against the text's length by a logistic
model of three coefficients.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialise, small_batches, tidy

#: Bounds of the labelled sample (expected rows of each label) and of the lexicon.
SAMPLE, ENTRIES = 8_000, 4_000
#: An entry needs so many different words before it in toxic rows, and this log ratio of its rate there to elsewhere.
CONTEXTS, RATIO = 6, 3.0
#: Entries are words' first letters, this many, or whole words up to the larger number.
SHORTEST, LONGEST = 4, 12
THRESHOLD = 0.7
#: How much the clean rows weigh against the toxic ones; more drops fewer clean texts.
CLEAN = 4.0

#: Entries with a weight for lack of labelled rows.
SEEDS = ("idiot", "moron", "scum", "stupid", "pathetic", "worthless", "disgusting", "loser")
#: Phrases that hold an entry and mean no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "stupid question of mine", "loser bracket", "scum line")

# Letters that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}


class _Folding(dict):
    """For str.translate: code point to folded letters; computed when first met."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(_LOOKALIKES.get(x, x) for x in c)
        self[code] = out = c if c.isalnum() or c in ("@", "$") else "!" if c == "!" else " "
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded words, a blank before and after each; signs count as letters only inside words."""
    words = (text or "").translate(_FOLDING).split()
    return f" {' '.join(map(_word, words))} "


def _word(word: str) -> str:
    if word.isalpha():
        return word
    inner = word.strip("!")  # marks at a word's end are marks
    if any(c.isalpha() for c in inner):
        inner = "".join(_SIGNS.get(c, c) for c in inner)
    return inner.replace("!", " ").replace("@", " ").replace("$", " ") or " "


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Of 1, log(1 + sum of weights), log(1 + sum of weights per 100 words).
    model: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(" " + entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(fold(phrase), (len(fold(phrase)) - 1, 0.0))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "model": self.model, "_automaton": None}

    def total(self, folded: str) -> float:
        """The sum over words of the greatest weight that matches at the word's start."""
        if not self.weights:
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton().iter(folded):
            start = end - n
            if weight:
                best[start] = max(weight, best.get(start, 0.0))
            else:
                spared.append((start, end))
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values())

    def features(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text)
        total = self.total(folded)
        return 1.0, math.log1p(total), math.log1p(100 * total / max(10, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """text and toxic of labelled rows that may be learned from, about ``bound`` of each label at most.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out.  A doc_id with
    several labels is toxic if one of them says so; null labels don't count.
    """
    may = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    may = may.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in may.groupBy("toxic").count().collect()}  # two rows
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, bound / max(bound, counts.get(1, 0))).otherwise(bound / max(bound, counts.get(0, 0)))
    return materialise(docs.select("doc_id", "text").join(F.broadcast(may.where(part <= share)), "doc_id").select("text", "toxic"), "labelled")


def learn(sample: DataFrame) -> Lexicon:
    """The lexicon and its model, from rows of text and toxic."""

    small_batches(sample.sparkSession)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                found = set()
                for text, toxic in zip(batch["text"][at : at + 200], batch["toxic"][at : at + 200], strict=True):
                    before = ""
                    for word in fold(text).split():
                        if len(word) >= SHORTEST:
                            found.add((word, hash_of(before), toxic))
                        before = word
                yield pd.DataFrame(list(found), columns=["word", "before", "toxic"])

    # Counted by different words before it: copies of one text count once.
    seen = sample.mapInPandas(tidy(words), "word string, before long, toxic int").distinct()
    by_word = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # A word is evidence for its beginnings, and for itself (marked by the blank after it).
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    entries = F.concat(F.transform(lengths, lambda n: F.substr("word", F.lit(1), n)), F.when(F.length("word") <= LONGEST, F.array(F.concat("word", F.lit(" ")))).otherwise(F.array()))
    counted = by_word.select(F.explode(entries).alias("entry"), "bad", "good").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sizes = sample.agg(F.sum(F.when(F.col("toxic") == 1, F.length("text"))), F.sum(F.when(F.col("toxic") == 0, F.length("text")))).first()
    bad_size, good_size = (float(x or 0) + 1.0 for x in sizes)
    ratio = F.log((F.col("bad") + 0.5) / bad_size) - F.log((F.col("good") + 0.5) / good_size)
    kept = counted.where(F.col("bad") >= CONTEXTS).select("entry", ratio.alias("ratio"), "bad").where(F.col("ratio") >= RATIO)
    rows = kept.orderBy(F.desc("ratio"), "entry").limit(ENTRIES).collect()
    weights = {r["entry"]: float(r["ratio"]) for r in rows} or dict.fromkeys(SEEDS, 4.0)
    lexicon = Lexicon(weights)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"a": [v[1] for v in x], "b": [v[2] for v in x], "y": batch["toxic"]})

    points = sample.mapInPandas(tidy(measured), "a double, b double, y int").toPandas()  # SAMPLE rows of each label
    if points["y"].nunique() == 2:
        lexicon.model = logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy())
    return lexicon


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode()) >> 1


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Coefficients by Newton's method; the clean class weighs CLEAN times the toxic one."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 1 / (y == 1).sum(), CLEAN / (y == 0).sum()) * len(y) / (1 + CLEAN)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (share * (y - p)) - ridge * beta
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``.

    Null and empty texts have no words and get the model's least score.  Rows
    that repeat a doc_id, and null doc_ids, are scored as they are.
    """

    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lexicon.score(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": found, "predicted": [int(s >= THRESHOLD) for s in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(rows), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, all columns as they are."""

    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(clean), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = learn(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")
