"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece goes across: letters with the blanks
before them, marks, single digits, line ends.  All distinct units of the corpus
go through the lattice: their substrings of bounded length are exploded and
joined to the piece table, the matches are grouped by unit, and a higher-order
aggregate folds them into pieces: by Viterbi where scores are log probabilities
(unigram models), by best merges where they are ranks (BPE models).

The spelling of all units is then a table.  Up to ``HELD`` units, tasks read it
whole and spell texts where they are.  Beyond that it is joined back, and texts
move as numbers: a task replaces the units of its texts by numbers in a
dictionary of its own (a chunk), as columnar files do; the dictionaries' units
are what is joined, and then each chunk's texts meet their chunk's dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, filterfalse, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialise, scratch, settings, small_batches
from .words import crc32, tokenizer_path

BLANK = "▁"
#: Units whose spelling tasks hold whole, some 25 bytes each.
HELD = 1 << 23
#: Words that a task remembers, some 250 bytes each.
WORDS = 240_000
#: Bounds of a chunk: characters of its texts, units of its dictionary.
CHARACTERS, UNITS = 1 << 25, 1 << 19
#: Units longer than this go by their digest while their substrings are matched.
SHORT = 63
#: An edge in one number, so that edges sort by rank, then start: rank, start, length, id, in 17, 22, 5 and 17 bits.
RANK, START, LENGTH, ID = 44, 22, 17, (1 << 17) - 1


class Pieces:
    """A model's pieces: text to (id, score), ids of single bytes, and how texts are cut for it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        usable = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.table = {model.id_to_piece(i): (i, model.get_score(i)) for i in usable}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.text = {i: p for p, (i, _) in self.table.items()}
        self.value = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.table))
        self.sizes = np.zeros(max(self.text, default=0) + 1, np.int64)  # of pieces, in characters
        self.sizes[list(self.text)] = [len(p) for p in self.text.values()]
        self.scores = sorted({s for _, s in self.table.values()}, reverse=True)
        rank = {s: i for i, s in enumerate(self.scores)}
        self.edges = {p: rank[s] << RANK | len(p) << LENGTH | i for p, (i, s) in self.table.items()}
        if model.vocab_size() > ID or self.longest > 31:
            raise ValueError("a model of over 131,071 pieces, or of pieces over 31 characters")
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.table):
            raise ValueError("pieces that go on after a word's end need another split into words")
        if any(c not in self.table for p in self.table for c in p):
            raise ValueError("pieces of characters that are no pieces")
        self.runs = self._runs()
        fine, coarse = rf"\n|{BLANK}*[^\W\d_²]+|\d|{BLANK}*(?:[^\w{BLANK}\n]|[_²])+|{BLANK}+", rf"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+"
        #: Cuts by the kinds of two neighbours, so a piece that it leaves whole is never cut anywhere.
        self.units = re.compile(fine if all(re.fullmatch(fine, p) for p in self.table) else coarse)

    def _runs(self) -> list[list[int]]:
        """Parts of 0, 1 .. blanks up to the longest piece of blanks, where those pieces all have one score.

        Of equals the leftmost pair is merged, whatever its length, so rank alone
        doesn't order them; but a run's pieces then depend on its length only,
        and repeat after the longest piece.  Empty if pieces of blanks have ranks.
        """
        sizes = {len(p) for p in self.table if not p.strip(BLANK) and len(p) > 1}
        if len({self.table[BLANK * n][1] for n in sizes}) != 1:
            return []
        if any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in self.table):
            raise ValueError("pieces of several blanks and other characters")

        def merged(n: int) -> list[int]:
            done: list[int] = []
            for _ in range(n):
                done.append(1)
                while len(done) > 1 and done[-2] + done[-1] in sizes:
                    done[-2:] = [done[-2] + done[-1]]
            return done

        most = max(sizes)
        if any(merged(n) != [most] * (n // most) + merged(n % most) for n in range(6 * most)):
            raise ValueError("runs of blanks that don't repeat")
        for n in sizes:
            del self.edges[BLANK * n]
        return [[n << LENGTH | self.table[BLANK * n][0] for n in merged(k)] for k in range(most + 1)]

    def check_merges(self) -> None:
        """Folding by ascending rank in one pass is right where every piece is made by merges of lesser ranks of its own."""
        longer = [e >> RANK for p, e in self.edges.items() if len(p) > 1]
        if len(set(longer)) != len(longer):
            raise ValueError("pieces of equal scores")
        for piece in self.edges:
            bounds = set(range(len(piece) + 1))
            spans = [(self.edges[piece[a:b]] >> RANK, a, b) for a in range(len(piece)) for b in range(a + 2, len(piece) + 1) if piece[a:b] in self.edges]
            for _, a, b in sorted(spans):
                if a in bounds and b in bounds and len(inner := bounds.intersection(range(a + 1, b))) == 1:
                    bounds -= inner
            if len(bounds) > 2:
                raise ValueError(f"merges don't make the piece {piece!r} in the order of their ranks")

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, edge (at 0): a row for each of the vocabulary, so small enough to broadcast."""
        return spark.createDataFrame(list(self.edges.items()), "piece string, edge long")

    @functools.cached_property
    def uncovered(self) -> re.Pattern:
        """A character that is no piece."""
        return re.compile("[^" + re.escape("".join(p for p in self.table if len(p) == 1)) + "]")

    @functools.cached_property
    def letters(self) -> bool:
        """Whether all letters of ASCII are pieces."""
        return self.uncovered.search("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") is None

    def units_of_words(self, words: Iterable[str]) -> Iterator[str]:
        """The units of words (without the blank that begins each), in no order: letters alone are one unit."""
        words = list(words)
        yield from map(BLANK.__add__, filter(str.isalpha, words))
        yield from chain.from_iterable(map(self.units.findall, map(BLANK.__add__, filterfalse(str.isalpha, words))))

    def of_character(self, c: str) -> list[int]:
        """A character that no piece covers: its bytes, or the unknown id."""
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    def spelled(self, unit: str, ids: list[int]) -> list[int]:
        """The ids of a unit from those of its pieces, bytes for characters that have none."""
        out, at, left = [], 0, iter(ids)
        while at < len(unit):
            if unit[at] in self.table:
                out.append(next(left))
                at += len(self.text[out[-1]])
            else:
                out += self.of_character(unit[at])
                at += 1
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, blanks still escaped; bytes that aren't UTF-8 become replacement characters."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.text.get(i, "⁇"))
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


@functools.cache
def loaded(path: str) -> Pieces:
    """One per Python process."""
    return Pieces(path)


def unescaped(text: str) -> str:
    return text.replace(BLANK, " ")[1:]


# -- the lattice, relationally ---------------------------------------------------------------


def unit_key(unit: Column) -> Column:
    """What a unit is grouped and joined by: itself, or where it is long its digest (a line's end is never in a unit of more)."""
    return F.when(F.length(unit) <= SHORT, unit).otherwise(F.concat(F.lit("\n"), F.sha2(unit, 256)))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """key, n (characters), edges (sorted) of distinct units (key, unit), those that no piece is in left out.

    Substrings of at most ``longest`` characters are exploded, long units window
    by window, and joined to the pieces (a table of the vocabulary's size,
    broadcast).  Nothing moves: units that are dealt by key stay so.
    """
    n = F.length("unit")
    windows = units.select("key", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(SHORT + 1))).alias("w"), "unit")
    windows = windows.select("key", "n", "w", F.substr("unit", F.col("w") + 1, F.lit(SHORT + longest)).alias("text"))
    inside = F.least(F.lit(SHORT), F.length("text") - 1)
    starts = windows.select("key", "n", "w", "text", F.explode(F.sequence(F.lit(0), inside)).alias("at"))
    cut = starts.select("key", "n", "w", "text", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("text") - F.col("at")))).alias("size"))
    # Saying that it isn't null keeps the join from cutting it a second time to see.
    piece = F.coalesce(F.substr("text", F.col("at") + 1, F.col("size")), F.lit(""))
    parts = cut.select("key", "n", (F.col("w") + F.col("at")).alias("start"), piece.alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece").select("key", "n", (F.col("edge") + F.col("start").cast("long") * (1 << START)).alias("edge"))
    return edges.groupBy("key", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


# Edges, in SQL: ``e`` is one; a span's bits among a unit's bounds are its start's,
# its end's and those between.
_START, _SIZE = f"cast(shiftrightunsigned(e, {START}) & 4194303 as int)", f"cast(shiftrightunsigned(e, {LENGTH}) & 31 as int)"
_PARTS = f"transform(sort_array(transform(filter(edges, e -> {{whole}}), e -> e & {(1 << RANK) - 1})), e -> cast(e & {(1 << START) - 1} as int))"


def _merging(span: str, cleared: str) -> str:
    """A step of the fold: a span with one bound inside loses it, as two pieces become one."""
    return f"CASE WHEN bit_count({span}) = 3 AND ({span}) & 1L = 1L AND shiftrightunsigned({span}, {_SIZE}) = 1L THEN {cleared} ELSE b END"


def fold_merges(edges: DataFrame, runs: list[list[int]] | None = None) -> DataFrame:
    """key, parts (length and id of each piece, in order) by best merges, leftmost of equals.

    Edges come by rank, then start, and each is merged if its two halves are
    pieces by then.  Bounds are bits: of one number where they fit, else of
    windows of 64 that overlap by half.  ``runs`` are the pieces of runs of
    blanks that no merge with what follows has taken (see ``Pieces``).
    """
    inner = f"(shiftleft(1L, {_SIZE} - 1) - 1L)"
    spanning = lambda bits, at: f"(shiftrightunsigned({bits}, {at}) & (shiftleft(2L, {_SIZE}) - 1L))"
    whole = lambda bits, at: f"{spanning(bits, at)} = (shiftleft(1L, {_SIZE}) | 1L)"
    i, r = f"cast({_START} div 32 as int)", f"({_START} % 32)"
    mask = f"shiftleft({inner}, {r} + 1)"
    cleared = (
        f"concat(slice(b, 1, {i}), array(element_at(b, {i} + 1) & ~shiftleft({mask}, 32), element_at(b, {i} + 2) & ~{mask}, "
        f"element_at(b, {i} + 3) & ~shiftrightunsigned({mask}, 32)), slice(b, {i} + 4, size(b)))"
    )
    windows = "concat(array(0L), transform(sequence(0, cast(n div 32 as int)), i -> shiftrightunsigned(-1L, 64 - least(64, n - 32 * i + 1))), array(0L))"
    at = f"element_at(b, {i} + 2)"
    # The pieces are read off the bounds in the fold's last step, since a column of them would be folded again for each edge.
    parts = lambda bits, at: _PARTS.format(whole=whole(bits, at))
    short = f"aggregate(edges, shiftrightunsigned(-1L, {SHORT} - n), (b, e) -> {_merging(spanning('b', _START), f'b & ~shiftleft({inner}, {_START} + 1)')}, b -> {parts('b', _START)})"
    long = f"aggregate(edges, {windows}, (b, e) -> {_merging(spanning(at, r), cleared)}, b -> {parts(at, r)})"
    folded = edges.select("key", F.expr(f"CASE WHEN n <= {SHORT} THEN {short} ELSE {long} END").alias("parts"))
    return folded.select("key", _with_runs(runs or []).alias("parts"))


def _with_runs(runs: list[list[int]]) -> Column:
    if not runs:
        return F.col("parts")
    blank, most = runs[1][0], len(runs) - 1
    found = F.array_position(F.transform("parts", lambda p: p == blank), F.lit(False)).cast("int")
    n = F.when(found == 0, F.size("parts")).otherwise(found - 1)
    table = F.array(*[F.array(*map(F.lit, run)).cast("array<int>") for run in runs])
    run = F.concat(F.array_repeat(F.lit(runs[-1][0]), (n / most).cast("int")), F.element_at(table, n % most + 1), F.slice("parts", n + 1, F.size("parts")))
    return F.when((F.get("parts", F.lit(0)) == blank) & (F.get("parts", F.lit(1)) == blank), run).otherwise(F.col("parts"))


def fold_viterbi(edges: DataFrame, scores: list[float], unknown: float = -1e6) -> DataFrame:
    """The same by the greatest sum of scores (of each rank); a character that no piece covers costs ``unknown``."""
    kind = "struct<score:double,parts:array<int>>"
    table = F.array(*map(F.lit, scores))
    start, size = (lambda e: F.shiftrightunsigned(e, START).bitwiseAND(4194303).cast("int")), (lambda e: F.shiftrightunsigned(e, LENGTH).bitwiseAND(31).cast("int"))
    score = lambda e: F.element_at(table, F.shiftrightunsigned(e, RANK).cast("int") + 1)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("parts"))).cast(f"array<{kind}>")

    def step(best: Column, stop: Column) -> Column:
        before = lambda e: F.element_at(best, start(e) + 1)
        way = lambda e: F.struct((before(e)["score"] + score(e)).alias("score"), F.concat(before(e)["parts"], F.array(e.bitwiseAND((1 << START) - 1).cast("int"))).alias("parts"))
        ways = F.transform(F.filter("edges", lambda e: start(e) + size(e) == stop), way)
        none = F.struct((F.element_at(best, stop)["score"] + unknown).alias("score"), F.element_at(best, stop)["parts"].alias("parts"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(none)))).cast(f"array<{kind}>"))

    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), first, step, lambda b: F.element_at(b, -1)["parts"])
    return edges.select("key", best.alias("parts"))


# -- texts as numbers ----------------------------------------------------------------------------


def shortened(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 in as few bytes of seven bits as each needs, the last one's high bit clear; and where each begins."""
    width = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    starts = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint8)
    for k in range(4):
        have = np.flatnonzero(width > k) if k else slice(None)
        out[starts[have] + k] = (numbers[have] >> 7 * k & 127) | np.where(width[have] > k + 1, 128, 0)
    return out, starts


def lengthened(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, 4):
        have = np.flatnonzero(ends - starts >= k)
        out[have] |= (data[starts[have] + k] & 127).astype(np.int64) << 7 * k
    return out


class _Numbers(dict):
    """Unit to number, in the order they are met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


def numbered(docs: DataFrame, model: str) -> DataFrame:
    """chunk, doc_id, codes, hash (of the text) for texts; chunk, code, unit for dictionaries; odd where bytes are needed.

    Written once, so that a chunk's texts and dictionary come from one attempt of
    one task.
    """
    small_batches(docs.sparkSession)
    columns = ["chunk", "doc_id", "codes", "hash", "code", "unit", "odd"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        own, known, held, chunk = loaded(model), _Numbers(), 0, TaskContext.get().partitionId() << 32

        def dictionary() -> pd.DataFrame:
            return pd.DataFrame({"chunk": chunk, "doc_id": pd.array([None] * len(known), "Int64"), "codes": None, "hash": pd.array([None] * len(known), "Int64"), "code": pd.array(list(known.values()), "Int32"), "unit": list(known), "odd": [own.uncovered.search(u) is not None for u in known]})[columns]

        find = own.units.findall
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch["text"]]
            while at < len(texts):
                stop, parts = at, []
                while stop < len(texts) and held < CHARACTERS and len(known) < UNITS:
                    units = find(BLANK + texts[stop].replace(" ", BLANK)) if texts[stop] else []
                    parts.append(np.fromiter(map(known.__getitem__, units), np.int64, len(units)))
                    held += len(texts[stop])
                    stop += 1
                data, starts = shortened(np.concatenate(parts)) if parts else (np.empty(0, np.uint8), np.empty(0, np.int64))
                first = np.cumsum([0, *map(len, parts)])
                bounds = np.concatenate([starts, [len(data)]])[first]
                codes = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                hashes = [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts[at:stop]]
                yield pd.DataFrame({"chunk": chunk, "doc_id": batch["doc_id"][at:stop].astype("Int64").array, "codes": codes, "hash": pd.array(hashes, "Int64"), "code": pd.array([None] * len(codes), "Int32"), "unit": None, "odd": False})[columns]
                at = stop
                if held >= CHARACTERS or len(known) >= UNITS:
                    yield dictionary()
                    known, held, chunk = _Numbers(), 0, chunk + 1
        if known:
            yield dictionary()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(given.mapInPandas(rows, "chunk long, doc_id long, codes binary, hash long, code int, unit string, odd boolean"), "numbered")


def spelling(units: DataFrame, model: str, unigram: bool) -> DataFrame:
    """key, parts of all units (unit), each once; those that no piece is in have none."""
    pieces = loaded(model)
    # Grouped by hash, then sorted: far fewer than the tasks' units, and the lattice's grouping by key finds its rows in order.
    distinct = units.select(unit_key(F.col("unit")).alias("key"), "unit").repartition("key").distinct().sortWithinPartitions("key")
    edges = lattice(distinct, pieces.frame(units.sparkSession), pieces.longest)
    return fold_viterbi(edges, pieces.scores) if unigram else fold_merges(edges, pieces.runs)


def words_of(text: str) -> list[str]:
    """The text in words at blanks, the blank that begins each (escaped: BLANK) left out; no unit goes across two words."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and BLANK + " " not in text:
        return text.split(" ")
    return [w[1:] for w in _RUNS.findall(BLANK + text.replace(" ", BLANK))]


_RUNS = re.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+")


def units_of(docs: DataFrame, model: str) -> DataFrame:
    """unit: the different units of each task's texts."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, units = loaded(model), set(), set()
        for batch in batches:
            for text in batch["text"].to_pylist():
                words.update(words_of(text or ""))
            if len(words) > 2 * WORDS:
                units.update(own.units_of_words(words))
                words = set()
            if len(units) > 2 * WORDS:
                yield pa.record_batch([pa.array(units, pa.string())], ["unit"])
                units = set()
        units.update(own.units_of_words(words))
        if units:
            yield pa.record_batch([pa.array(units, pa.string())], ["unit"])

    return docs.select("text").mapInArrow(rows, "unit string")


class Spelling:
    """The spelling of all units, from its files: hashes of keys, sorted, and their ids."""

    def __init__(self, folder: str, kind: type):
        import pyarrow.parquet as pq
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in filesystem.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        n = sum(pq.read_metadata(f, filesystem=filesystem).num_rows for f in files)
        self.hashes, self.bounds = np.empty(n, np.int64), np.zeros(n + 1, np.uint32)
        ids, at, held = [], 0, 0
        for name in files:  # in order of hashes
            with filesystem.open_input_file(name) as file:
                for batch in pq.ParquetFile(file).iter_batches(1 << 15, columns=["hash", "ids"]):
                    self.hashes[at : at + len(batch)] = batch["hash"].to_numpy()
                    ends = held + np.cumsum(batch["ids"].value_lengths().to_numpy(), dtype=np.int64)
                    ids.append(batch["ids"].flatten().to_numpy().astype(kind))
                    at, held = at + len(batch), int(ends[-1])
                    self.bounds[at - len(batch) + 1 : at + 1] = ends
        self.ids = np.concatenate(ids) if ids else np.empty(0, kind)
        pa.default_memory_pool().release_unused()

    def find(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit's ids start and how many there are; none of units without pieces."""
        import xxhash

        digest = xxhash.xxh64_intdigest  # with seed 42 it is Spark's
        keys = units if max(map(len, units), default=0) <= SHORT else [u if len(u) <= SHORT else "\n" + hashlib.sha256(u.encode()).hexdigest() for u in units]
        wanted = np.fromiter(map(digest, keys, repeat(42)), np.uint64, len(units)).view(np.int64)
        if not len(self.hashes):
            return np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        starts = self.bounds[at].astype(np.int64)
        return starts, np.where(self.hashes[at] == wanted, self.bounds[at + 1] - starts, 0)


@functools.lru_cache(maxsize=1)
def read_spelling(folder: str, kind: type) -> Spelling:
    """One per Python process."""
    return Spelling(folder, kind)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Speller:
    """Spells texts, remembering words: ids and what they decode to."""

    def __init__(self, pieces: Pieces, spelling: Spelling):
        self.pieces, self.spelling, self.known = pieces, spelling, defaultdict(count().__next__)
        self.flat, self.starts, self.shown = np.empty(0, np.int32), np.zeros(1, np.int64), []
        self.strange = np.empty(0, bool)  # words that don't decode to themselves, or have blanks of their own

    def _forget(self) -> None:
        """The words met first, which the commonest are among, stay, unless they are long."""
        keep = WORDS // 2 if len(self.flat) < 16 * WORDS else 0
        known = defaultdict(count(keep).__next__, islice(self.known.items(), keep))
        self.known, self.shown, self.strange = known, self.shown[:keep], self.strange[:keep].copy()
        self.flat, self.starts = self.flat[: self.starts[keep]].copy(), self.starts[: keep + 1].copy()

    def _learn(self, words: list[str]) -> None:
        find, odd, letters = self.pieces.units.findall, self.pieces.uncovered.search, self.pieces.letters
        marked = list(map(BLANK.__add__, words))
        alone = list(map(str.isalpha, words))  # letters are one unit
        units, each = [], []
        for m, one in zip(marked, alone, strict=True):
            if one:
                units.append(m)
                each.append(1)
            else:
                units += (theirs := find(m))
                each.append(len(theirs))
        starts, sizes = self.spelling.find(units)
        ids = self.spelling.ids[ranges(starts, sizes)].astype(np.int32)
        first = np.cumsum([0, *each])
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])
        plain = [one and letters and w.isascii() or odd(w) is None for w, one in zip(words, alone, strict=True)]
        back = self._back(marked, plain, ids, lengths)
        if not all(plain):  # characters of bytes
            spans = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            first, whole, own = first.tolist(), np.array(plain), []
            every = ids.tolist()
            for k in np.flatnonzero(~whole).tolist():
                theirs = []
                for at, u in enumerate(units[first[k] : first[k + 1]], first[k]):
                    part = every[spans[at] : spans[at + 1]]
                    theirs += part if odd(u) is None else self.pieces.spelled(u, part)
                own.append(theirs)
                back[k] = self.pieces.decode(theirs)
            kept, theirs = ids[np.repeat(whole, lengths)], np.fromiter(chain.from_iterable(own), np.int32)
            lengths[~whole] = np.fromiter(map(len, own), np.int64, len(own))
            of_whole = np.repeat(whole, lengths)
            ids = np.empty(len(of_whole), np.int32)
            ids[of_whole], ids[~of_whole] = kept, theirs
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.shown += back
        self.strange = np.concatenate([self.strange, np.array([b != m or BLANK in w for w, m, b in zip(words, marked, back, strict=True)], bool)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + bounds[1:]])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def _back(self, marked: list[str], plain: list[bool], ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """What words decode to, those that aren't plain as they are.

        If the plain words' pieces make up all plain words, one after the other, and
        each word's pieces have its length, each decodes to itself.
        """
        whole = np.array(plain, bool)
        theirs = [m for m, p in zip(marked, plain, strict=True) if p]
        kept, n = ids[np.repeat(whole, lengths)], lengths[whole]
        shown = list(map(self.pieces.text.get, kept.tolist()))
        ends = np.cumsum(n)
        made = np.diff(np.concatenate([[0], np.cumsum(self.pieces.sizes[kept])])[np.concatenate([[0], ends])])
        if np.array_equal(made, np.fromiter(map(len, theirs), np.int64, len(theirs))) and "".join(shown) == "".join(theirs):
            return list(marked)
        own = iter(["".join(shown[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)])
        return [next(own) if p else m for m, p in zip(marked, plain, strict=True)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All texts' ids, where each text's begin and the last ends, and whether they decode to the texts."""
        if len(self.known) > WORDS or len(self.flat) > 16 * WORDS:
            self._forget()
        before, number = len(self.known), self.known.__getitem__
        codes = [np.fromiter(map(number, words), np.int64, len(words)) for words in map(words_of, texts)]
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        every = np.concatenate(codes) if codes else np.empty(0, np.int64)
        sizes = self.starts[every + 1] - self.starts[every]
        ids = self.flat[ranges(self.starts[every], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, codes)])]
        # Words without blanks of their own that decode to themselves make their text; others are put together and compared.
        strange = np.concatenate([[0], np.cumsum(self.strange[every])])[np.cumsum([0, *map(len, codes)])]
        same = [not n or unescaped("".join(map(self.shown.__getitem__, c.tolist()))) == t for n, c, t in zip(np.diff(strange).tolist(), codes, texts, strict=True)]
        return ids, bounds, same


KINDS = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])
ROWS = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>"


def listed(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, same: list[bool]) -> pa.RecordBatch:
    crcs = [crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
    return pa.record_batch([doc_ids, pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_()), lists], schema=KINDS)


def encode_pieces(docs: DataFrame, model: str | None = None, unigram: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (whether decoding gives the text), ids for each row of ``docs``.

    ``unigram`` says that the model's scores are log probabilities.  Null texts
    count as empty and have no ids.  Repeated rows and null doc_ids get a row
    each.  No rows in, no rows out.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")
    if not unigram:
        loaded(model).check_merges()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = scratch(docs.sparkSession, "spelling")
    made = spelling(units_of(given, model), model, unigram)
    ids = F.transform("parts", lambda p: p.bitwiseAND(ID))
    # Written before it is sorted, since dealing by range looks at its input twice.
    # One sort serves both parts of the lattice's grouping; the hash aggregate would sort in each, past its first 128 units.
    with settings(docs.sparkSession, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        made = materialise(made.select(F.xxhash64("key").alias("hash"), "key", ids.alias("ids")), "units")
    made.repartitionByRange("hash").sortWithinPartitions("hash").write.parquet(folder)
    spelled = docs.sparkSession.read.parquet(folder)
    if spelled.count() > HELD or spelled.groupBy("hash").count().where("count > 1").take(1):  # too many to hold, or not told apart by hash
        return joined(given, spelled, model)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        speller = Speller(own, read_spelling(folder, np.uint16 if max(own.text) < 1 << 16 else np.int32))
        for batch in batches:
            yield listed(batch["doc_id"], *speller([t or "" for t in batch["text"].to_pylist()]))

    return given.mapInArrow(spell, ROWS)


def joined(docs: DataFrame, spelled: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode_pieces``, from a spelling of any size."""
    rows = numbered(docs, model)
    texts = rows.where("unit IS NULL").select("chunk", "doc_id", "codes", "hash")
    uses = rows.where("unit IS NOT NULL").select("chunk", "code", unit_key(F.col("unit")).alias("key"), F.when(F.col("odd"), F.col("unit")).alias("unit"))
    words = uses.join(spelled, "key", "left").select("chunk", "code", "unit", "ids").toDF("chunk", "code", "unit", "ids")  # names of its own for the cogroup

    def spell(texts: pa.Table, words: pa.Table) -> pa.Table:
        import xxhash

        own = loaded(model)
        words = words.sort_by("code").to_pylist()
        lists = [own.spelled(w["unit"], w["ids"] or []) if w["unit"] is not None else w["ids"] for w in words]
        shown = [own.decode(x) for x in lists]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, starts = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes
        batches = []
        for batch in texts.to_batches(max_chunksize=500):
            codes = [lengthened(np.frombuffer(c.as_py(), np.uint8)) for c in batch["codes"]]
            every = np.concatenate(codes) if codes else np.empty(0, np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes[every])])[np.cumsum([0, *map(len, codes)])]
            back = [xxhash.xxh3_64_intdigest(unescaped("".join(map(shown.__getitem__, c.tolist()))).encode()) - (1 << 63) for c in codes]
            same = [a == b for a, b in zip(back, batch["hash"].to_pylist(), strict=True)]
            batches.append(listed(batch["doc_id"], flat[ranges(starts[every], sizes[every])], bounds, same))
        return pa.Table.from_batches(batches, schema=KINDS)

    return texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(spell, ROWS)


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of ids (doc_id, ids); null ids count as none, and give an empty text."""
    model = model or tokenizer_path("piece_bpe_32k.model")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [array("i", i) if i is not None else () for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [unescaped(loaded(model).decode(i)) for i in ids]})

    small_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(texts, "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir))
