"""Packing of tokenised documents into sequences of a fixed capacity.

The histogram of piece lengths, at most ``capacity`` counts, is all that
packing needs: a configuration linear program over it (which multisets of
lengths share a sequence, and how often) is solved by multiplicative weights:
a length is worth its space, times a factor that falls exponentially with how
much of its demand is covered; each step prices configurations of some lengths
with a knapsack dynamic program and takes the best as often as covers a share of
one length's demand, until every length is covered.  The fractional solution is
rounded: of configurations that fill a sequence, whole parts first, then single
ones, largest fractions first, while their pieces last; what is left is placed
best fit, longest first, on counts rather than on pieces.  (Where best fit alone
takes fewer sequences, as when half of the pieces have one awkward length, its
plan is taken.)  Only then do pieces get their places, each from its rank among
the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, materialise, small_batches, tidy
from .words import crc32, encoder, tokenizer_path

CAPACITY = 4096
#: A step covers this share of some length's demand; how fast covered lengths lose worth; lengths priced together.
SHARE, RATE, PRICED = 0.5, 0.1, 24

#: How often a configuration is used, and how many pieces of which length it has.
Bins = tuple[int, list[tuple[int, int]]]


def best_configuration(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length, none over ``most``, that maximise the value in one sequence (bounded knapsack)."""
    best, steps = np.zeros(capacity + 1), []
    for i, (length, value) in enumerate(zip(lengths.tolist(), values.tolist(), strict=True)):
        left, n = min(int(most[i]), capacity // length), 1
        while left > 0:  # 1, 2, 4 .. and the rest: every count is a sum of some
            n = min(n, left)
            offer = best[: -n * length] + n * value
            took = offer > best[n * length :]
            best[n * length :][took] = offer[took]
            steps.append((i, n, n * length, took))
            left, n = left - n, 2 * n
    counts, c = np.zeros(len(lengths), np.int64), int(best.argmax())
    for i, n, space, took in reversed(steps):
        if c >= space and took[c - space]:
            counts[i] += n
            c -= space
    return counts


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, seed: int = 11) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """A covering of all of ``demand`` by configurations: (how often, lengths' positions, counts).

    Lengths are priced in groups of like demand, drawn anew in each round, with
    the ones that are least covered against theirs; a configuration of each
    group is taken SHARE / (its greatest part of a demand) times.
    """
    rng = np.random.default_rng(seed)
    covered, found = np.zeros(len(lengths)), []
    while len(open_ := np.flatnonzero(covered < 1 - 1e-9)):
        left = demand[open_] * (1 - covered[open_])
        order = open_[np.argsort(np.log(left) + rng.normal(0, 0.7, len(open_)))]
        hard = open_[np.argsort(-left * lengths[open_])[:4]]
        for at in range(0, len(order), PRICED - 4):
            group = np.union1d(order[at : at + PRICED - 4], hard)
            group = group[covered[group] < 1 - 1e-9]
            if not len(group):
                continue
            worth = lengths[group] / capacity * np.exp(-RATE * (covered[group] - covered[group].min()))
            need = demand[group] * (1 - covered[group])
            counts = best_configuration(lengths[group], worth, np.ceil(need), capacity)
            used = counts > 0
            often = float(max(min(SHARE * (demand[group][used] / counts[used]).min(), (need[used] / counts[used]).min()), (need[used] / counts[used]).min() * SHARE))
            covered[group[used]] += counts[used] * often / demand[group][used]
            found.append((often, group[used], counts[used]))
    return found


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[Bins]:
    """Best fit decreasing on counts: equal bins are one entry, so the work
    follows the number of distinct lengths and not that of pieces."""
    open_bins: dict[int, list[Bins]] = {}
    spaces = np.zeros(capacity + 1, bool)

    def put(space: int, bins: Bins) -> None:
        open_bins.setdefault(space, []).append(bins)
        spaces[space] = True

    for length, left in sorted(zip(lengths.tolist(), demand.tolist(), strict=True), reverse=True):
        while left:
            at = np.flatnonzero(spaces[length:])
            if len(at):
                space = int(at[0]) + length
                n, inside = open_bins[space].pop()
                if not open_bins[space]:
                    spaces[space] = False
            else:
                space, n, inside = capacity, left, []
            each = min(space // length, left)
            used = min(n, left // each)
            put(space - each * length, (used, [*inside, (length, each)]))
            if inside and n > used:
                put(space, (n - used, inside))
            left -= used * each
    return [b for group in open_bins.values() for b in group]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """All pieces of the histogram in configurations, as few sequences as we can."""
    full = histogram.get(capacity, 0)
    rest = {n: c for n, c in sorted(histogram.items()) if 0 < n < capacity and c}
    bins: list[Bins] = [(full, [(capacity, 1)])] if full else []
    if not rest:
        return bins
    lengths, left = np.array(list(rest), np.int64), np.array(list(rest.values()), np.int64)
    plans = configured(lengths, left, capacity), best_fit(lengths, left, capacity)
    return bins + min(plans, key=lambda plan: sum(n for n, _ in plan))  # the first of equals


def configured(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[Bins]:
    """The program solved and rounded, once more for what is left if that is the greater part; best fit for the rest."""
    left, bins = demand.copy(), []
    for _ in range(2):
        if 2 * left.sum() > demand.sum():
            have = np.flatnonzero(left)
            found, left[have] = rounded(fractional(lengths[have], left[have], capacity), lengths[have], left[have], capacity)
            bins += found
    have = left > 0
    return bins + best_fit(lengths[have], left[have], capacity)


def rounded(solution: list[tuple[float, np.ndarray, np.ndarray]], lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[Bins], np.ndarray]:
    """Full configurations by the whole parts of how often they are used, then once each, largest
    fractions first, as far as pieces last; and the demand that is left."""
    left, bins = demand.copy(), []
    full = [s for s in solution if int((s[2] * lengths[s[1]]).sum()) == capacity]
    for n, at, counts in [*((int(n + 1e-9), at, counts) for n, at, counts in full), *((1, at, counts) for _, at, counts in sorted(full, key=lambda s: -(s[0] % 1)))]:
        n = min(n, int((left[at] // counts).min()))
        if n:
            left[at] -= n * counts
            bins.append((n, list(zip(lengths[at].tolist(), counts.tolist(), strict=True))))
    return bins, left


def places(bins: list[Bins]) -> pd.DataFrame:
    """By length, ranges of ranks: first (rank), each (pieces a sequence), sequence, offset (of the range's first)."""
    rows, given, sequence = [], {}, 0
    for n, inside in bins:
        offset = 0
        for length, each in inside:
            first = given.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            given[length] = first + n * each
            offset += length * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], kind="stable")


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and rank there among its length's.

    Written once and read back, so that ranks hold whatever is computed again.
    """

    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for doc_id, null, text in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                ids = encode(text)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rank = seen.get(len(part), 0)
                    seen[len(part)] = rank + 1
                    out.append((doc_id, null, piece, start, len(part), crc32(part), task, rank))
            yield pd.DataFrame(out, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    dealt = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(dealt.mapInPandas(cut, "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, task int, rank long"), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; every document has at least its end token, so
    every row of ``docs`` has a piece, repeated rows and null doc_ids included.
    Pieces of one length get their places in no particular order.  No rows in,
    no rows out.
    """
    pieces = tokenised_pieces(docs, tokenizer or tokenizer_path(), capacity)
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(plan_bins(histogram, capacity))
    length, first, each, sequence, offset = (table[c].to_numpy(np.int64) for c in table)
    spread = length * (2**44) + first  # one sorted key; ranks stay far below 2**44

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            k = np.searchsorted(spread, n * (2**44) + rank, side="right") - 1
            copy, slot = np.divmod(rank - first[k], each[k])
            out = batch[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64").mask(batch["no_id"])
            yield out.assign(sequence_id=sequence[k] + copy, offset=offset[k] + slot * n)

    # A row for each task and length it had, so a few thousand a task.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"])
    return ranked.mapInPandas(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
