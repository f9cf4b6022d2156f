"""Secrets: fixed patterns, and formats inferred from labelled credentials.

Each format's labelled credentials make a prefix tree whose statistically
compatible states are merged (Hoeffding bounds on their continuations), which
gives a probabilistic automaton.  Every candidate, a long run of credential
characters, is scored by its likelihood under each automaton against that under
a model of ordinary words and numbers.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialise, small_batches

#: Kinds in the order that ties of a start are listed in; inferred formats follow by name.
KINDS = ("assign", "access", "hex")
#: Shortest candidate; described credentials of a format.
SHORTEST, EXAMPLES = 16, 200
#: States of the found values' prefix tree that share a depth, at most: one that fewer values reach than
#: 1 + values // FINEST isn't tested for a state of its own. Its values count all the same.
FINEST = 5_000
#: Different words that a task counts before it takes them apart.
WORDS = 100_000
#: Confidence of the merging test, probability of what an automaton hasn't seen, least log ratio per character.
ALPHA, UNSEEN, MARGIN = 0.05, 1e-4, 0.5

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
#: Only the six named words ignore case, and only between A-Z and a-z.
ASSIGN = re.compile(
    "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run either way
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)

#: Credentials in a run begin at its start or after one of these, and end before one or at its end.
SEPARATOR = re.compile(r"[+/_.=-]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans: (start, end, kind), code points, sorted."""
    found: list[Span] = []
    lowered = text.lower()
    if any(k in lowered for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# -- labelled credentials --------------------------------------------------------------------


def credentials(n: int = EXAMPLES, seed: int = 7) -> dict[str, list[str]]:
    """Labelled credentials by format, drawn from the formats' public descriptions."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    alnum, digits, upper = string.ascii_letters + string.digits, string.digits, string.ascii_uppercase + string.digits

    def jwt() -> str:
        part = lambda k: base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=")
        return f"eyJhbGciOi{part(18)}.eyJ{part(rng.randint(30, 60))}.{part(32)}"

    # Prefixes, alphabets and lengths of common credentials.
    makers = {
        "chat": lambda: f"xox{rng.choice('abp')}-{pick(digits, 12)}-{pick(digits, 12)}-{pick(alnum, 24)}",
        "cloud": lambda: "AIza" + pick(alnum + "_-", 35),
        "forge": lambda: f"gh{rng.choice('pousr')}_{pick(alnum, 36)}",
        "jwt": jwt,
        "lab": lambda: "glpat-" + pick(alnum + "_-", 20),
        "mail": lambda: f"SG.{pick(alnum + '_-', 22)}.{pick(alnum + '_-', 43)}",
        "package": lambda: "npm_" + pick(alnum, 36),
        "payment": lambda: f"{rng.choice(['sk', 'rk'])}_{rng.choice(['live', 'test'])}_{pick(alnum, 24)}",
        "temporary": lambda: "ASIA" + pick(upper, 16),
    }
    return {name: [make() for _ in range(n)] for name, make in makers.items()}


# -- automata --------------------------------------------------------------------------------


#: Characters at a credential's start that stand for themselves; later ones stand for their class.
LITERAL = 4
_CLASS = {c: k for k, group in (("a", string.ascii_lowercase), ("A", string.ascii_uppercase), ("0", string.digits)) for c in group}
_WITHIN = {"a": -math.log(26), "A": -math.log(26), "0": -math.log(10)}


def symbols(text: str, literal: int = LITERAL) -> list[str]:
    """What automata read: literal first characters, then classes (punctuation is its own)."""
    return [f"={c}" for c in text[:literal]] + [_CLASS.get(c, c) for c in text[literal:]]


#: The prefix tree's root; nodes are known by a hash of what leads to them.
ROOT = 0


def after(node: int, symbol: str) -> int:
    """The node that ``symbol`` leads to."""
    import xxhash

    return xxhash.xxh3_64_intdigest(symbol, node) >> 1


def steps(text: str) -> Iterator[tuple[int, str]]:
    """The nodes of a prefix tree that a text passes and the symbol read in each, "" at its end."""
    node = ROOT
    for c in symbols(text, 0):
        yield node, c
        node = after(node, c)
    yield node, ""


class Automaton:
    """A probabilistic automaton over ``symbols``, by state merging from a prefix tree."""

    def __init__(self, examples: list[str], alpha: float = ALPHA, literal: int = LITERAL):
        self._begin(alpha, literal)
        for text in examples:
            state = 0
            for c in symbols(text, literal):
                to = self.next[state].get(c)
                if to is None:
                    to = self._grow(state, c, 0)
                self.count[state][c] += 1
                state = to
            self.end[state] += 1
        self._merge()
        self._freeze()

    @classmethod
    def of_tree(cls, nodes: dict[int, dict[str, int]], alpha: float = ALPHA) -> Automaton:
        """The merged states of a prefix tree (see ``steps``; without literal characters) that may lack
        rare nodes, for ``walk``; ``recount`` makes it an automaton."""
        new = cls.__new__(cls)
        new._begin(alpha, 0)
        todo = [(ROOT, 0)]
        while todo:
            node, state = todo.pop()
            for c, n in sorted(nodes[node].items()):
                if not c:
                    new.end[state] = n
                elif (to := after(node, c)) in nodes:
                    todo.append((to, new._grow(state, c, n)))
                else:
                    new.count[state][c] = n
        new._merge()
        return new

    def _begin(self, alpha: float, literal: int) -> None:
        self.literal, self.radius = literal, math.sqrt(0.5 * math.log(2 / alpha))
        self.end, self.next, self.count = [0], [{}], [{}]

    def _grow(self, state: int, c: str, n: int) -> int:
        self.next[state][c], self.count[state][c] = len(self.end), n
        self.end.append(0)
        self.next.append({})
        self.count.append({})
        return len(self.end) - 1

    def walk(self, text: str) -> Iterator[tuple[int, str]]:
        """The states a text passes and the symbol read in each, "" at its end.  What the tree lacks goes on
        in the state that settled first: too few values got there to tell it from any other."""
        state = 0
        for c in symbols(text, self.literal):
            yield state, c
            state = self.next[state].get(c, self.home)
        yield state, ""

    def recount(self, counted: dict[tuple[int, str], int]) -> Automaton:
        """The automaton with the counts of all texts' walks."""
        size = len(self.end)
        self.end, self.count = [0] * size, [{} for _ in range(size)]
        for (state, c), n in counted.items():
            if c:
                self.count[state][c] = n
                self.next[state].setdefault(c, self.home)
            else:
                self.end[state] = n
        self.next = [{c: t for c, t in to.items() if c in seen} for to, seen in zip(self.next, self.count, strict=True)]
        self._freeze()
        return self

    def _total(self, s: int) -> int:
        return self.end[s] + sum(self.count[s].values())

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ends and continuations of two states, and of what follows, could be the same."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            na, nb = self._total(a), self._total(b)
            if not na or not nb:
                continue
            bound = self.radius * (na**-0.5 + nb**-0.5)
            if abs(self.end[a] / na - self.end[b] / nb) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """State b, the root of a tree, becomes part of a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                y = self.next[b].get(c)
                if y is not None and c in self.next[a]:
                    pairs.append((self.next[a][c], y))
                elif y is not None:
                    self.next[a][c] = y

    def _merge(self) -> None:
        """Settled states grow from the root; the commonest state next to them is
        merged with the first that it is compatible with, or settles itself."""
        settled = [0]
        while True:
            inside = set(settled)
            edges = [(self.count[s][c], s, c, t) for s in settled for c, t in self.next[s].items() if t not in inside]
            if not edges:
                self.home = settled[1] if len(settled) > 1 else 0
                return
            _, source, c, t = max(edges)
            # A literal start is never merged: it is what tells formats apart.
            same = next((s for s in settled if not c.startswith("=") and s != 0 and self._compatible(s, t)), None)
            if same is None:
                settled.append(t)
            else:
                self.next[source][c] = same
                self._fold(same, t)

    def _freeze(self) -> None:
        self.table: dict[int, dict[str, tuple[int, float]]] = {}
        self.ends: dict[int, float] = {}
        todo = [0]
        while todo:
            s = todo.pop()
            if s not in self.table:
                total = max(1, self._total(s))
                self.table[s] = {c: (t, math.log(self.count[s][c] / total) + _WITHIN.get(c, 0.0)) for c, t in self.next[s].items()}
                self.ends[s] = math.log(max(self.end[s] / total, UNSEEN))
                todo += self.next[s].values()
        del self.next, self.end, self.count

    def likelihood(self, text: str, least: float) -> float:
        """The logarithm of the text's probability; -inf once it falls below ``least``.

        A class that a state hasn't seen costs UNSEEN and changes nothing; a
        start that no labelled credential has is impossible.
        """
        state, total, table = 0, 0.0, self.table
        for i, c in enumerate(text):
            if i < self.literal:
                to = table[state].get("=" + c)
                if to is None:
                    return -math.inf
            else:
                to = table[state].get(_CLASS.get(c, c), (state, math.log(UNSEEN)))
            state, p = to
            total += p
            if total < least:
                return -math.inf
        return total + self.ends[state]


class Ordinary:
    """Ordinary words (letter pairs) and numbers (even digits and separators), whichever fits better."""

    def __init__(self, pairs: dict[str, int]):
        after: dict[str, int] = defaultdict(int)
        for pair, n in pairs.items():
            after[pair[0]] += n
        self.pairs = {p: math.log((n + 0.1) / (after[p[0]] + 8.0)) for p, n in pairs.items()}
        self.unseen = math.log(1 / 2000)

    def likelihood(self, text: str) -> float:
        words = sum(self.pairs.get(p, self.unseen) for p in map("".join, zip(" " + text, text, strict=False)))
        numbers = -math.log(12) * len(text) if not text.strip(string.digits + ".-+/=_") else -math.inf
        return max(words, numbers)


@dataclass
class Formats:
    automata: dict[str, Automaton]
    ordinary: Ordinary
    margin: float = MARGIN

    def format_of(self, text: str) -> str | None:
        """The format whose automaton explains the text better than ordinary text does, if one does."""
        usual = self.ordinary.likelihood(text)
        least = usual + self.margin * len(text)
        best, name = max((a.likelihood(text, least), n) for n, a in self.automata.items())
        return name if best >= least else None

    def inside(self, text: str, start: int, stop: int) -> list[Span]:
        """Credentials of a run: of those that overlap, the one with the greatest log ratio; failing any, the whole run."""
        run = text[start:stop]
        cuts = [0, *(m.end() for m in SEPARATOR.finditer(run))]
        offers = [(gain, a, b, name) for a in cuts if len(run) - a >= SHORTEST for name, automaton in self.automata.items() if automaton.literal for gain, b in self.ends_of(automaton, run[a:])]
        out: list[Span] = []
        for _, a, b, name in sorted(((gain, a, a + b, name) for gain, a, b, name in offers), key=lambda o: (-o[0], *o[1:])):
            if not any(s < start + b and start + a < e for s, e, _ in out):
                out.append((start + a, start + b, name))
        if not out and (name := self.format_of(run)):
            out.append((start, stop, name))
        return out

    def ends_of(self, automaton: Automaton, run: str) -> list[tuple[float, int]]:
        """Log ratio and end of each beginning of ``run``, up to a separator or its end, that the automaton explains better."""
        state, total, out = 0, 0.0, []
        least = None
        for i, c in enumerate(run):
            if i < automaton.literal:
                to = automaton.table[state].get("=" + c)
                if to is None:
                    return []
            else:
                to = automaton.table[state].get(_CLASS.get(c, c))
                if to is None:
                    if out and c not in _CLASS:
                        break  # what follows a separator that the format doesn't have is not the credential's
                    to = (state, math.log(UNSEEN))
            state, p = to
            total += p
            n = i + 1
            if n < SHORTEST:
                continue
            if least is None:
                least = self.ordinary.likelihood(run) + self.margin * SHORTEST
            if total < least:
                break
            if c != "." and (n == len(run) or SEPARATOR.match(run, n)):  # a stop at the end is a sentence's
                gain = total + automaton.ends[state] - self.ordinary.likelihood(run[:n])
                if gain >= self.margin * n:
                    out.append((gain, n))
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The fixed patterns' spans, and all spans."""
        base = base_spans(text)
        # Runs are scored whole, whatever the fixed patterns have of them; the automaton of
        # their own values says nothing new about a run that one of them touches.
        touched = lambda m: any(s < m.end() and m.start() < e for s, e, _ in base)
        found = [span for m in CANDIDATE.finditer(text) for span in self.inside(text, m.start(), m.end()) if span[2] != "found" or not touched(m)]
        rank = {k: i for i, k in enumerate((*KINDS, *sorted(self.automata)))}
        return base, sorted([*base, *found], key=lambda s: (s[0], rank[s[2]]))


def ordinary_and_found(docs: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """Of all ``docs``: how many different words of a document, outside the fixed patterns' spans, have
    which pair of characters; and the values that the patterns find (value), each once."""
    small_batches(docs.sparkSession)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, words = Counter(), Counter()

        def spell() -> None:
            for word, n in words.items():
                for pair in map("".join, zip(" " + word, word, strict=False)):
                    pairs[pair] += n
            words.clear()

        for batch in batches:
            values = set()
            for text in batch["text"]:
                rest, at = [], 0
                for s, e, k in base_spans(text):
                    values.add(ASSIGN.match(text, s, e)[2] if k == "assign" else text[s:e])
                    rest.append(text[at:s])
                    at = max(at, e)
                rest.append(text[at:])
                words.update(set(re.findall(r"[A-Za-z0-9+/_.=-]+", " ".join(rest))))
            if len(words) > WORDS:
                spell()
            if values:
                yield pd.DataFrame({"what": [*values], "n": 0})
        spell()
        if pairs:
            yield pd.DataFrame({"what": [*pairs], "n": [*pairs.values()]})

    rows = docs.where(F.col("text").isNotNull()).select("text").mapInPandas(gather, "what string, n long")
    # No value is spelled like a pair: values have eight characters or more.
    counted = materialise(rows.groupBy("what").agg(F.sum("n").alias("n")), "found-values")
    pairs = {r["what"]: r["n"] for r in counted.where("n > 0").collect()}  # pairs of 67 characters and a blank
    return pairs, counted.where("n = 0").select(F.col("what").alias("value"))


def tally(values: DataFrame, walk: Callable[[str], Iterator[tuple[int, str]]]) -> DataFrame:
    """at, symbol, n: how often the walks of all ``values`` are at a place and read a symbol."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(step for value in batch["value"] for step in walk(value))
            yield pd.DataFrame([(at, c, n) for (at, c), n in seen.items()], columns=["at", "symbol", "n"])

    return values.mapInPandas(count, "at long, symbol string, n long").groupBy("at", "symbol").agg(F.sum("n").alias("n"))


def learn_found(values: DataFrame) -> Automaton | None:
    """The automaton of all ``values``, None if there are none.

    Their prefix tree is counted where they are.  The driver merges the states of
    its nodes, those that 1 + values // FINEST reach; then all values walk through
    the merged states, and those counts make the automaton.
    """
    n = values.count()
    if not n:
        return None
    by_node = tally(values, steps).groupBy("at").agg(F.sum("n").alias("total"), F.collect_list(F.struct("symbol", "n")).alias("read"))  # ten symbols at most
    nodes = {r["at"]: dict(r["read"]) for r in by_node.where(F.col("total") >= 1 + n // FINEST).drop("total").collect()}
    states = Automaton.of_tree(nodes)
    return states.recount({(r["at"], r["symbol"]): r["n"] for r in tally(values, states.walk).collect()})


def learn(docs: DataFrame) -> Formats:
    """Formats from the described credentials and from all values that the fixed patterns find in
    ``docs``, ordinary text from all of the documents too."""
    pairs, values = ordinary_and_found(docs)
    automata = {name: Automaton(texts) for name, texts in credentials().items()}
    found = learn_found(values)
    if found:
        automata["found"] = found
    return Formats(automata, Ordinary(pairs))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    Spans are kind:start:end in code points, sorted by start, then kind.  Null
    and empty texts have none.  Repeated rows and null doc_ids get a row each.
    """

    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base, all_of_them = formats.spans(text or "")
                kinds = [k for _, _, k in base]
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(all_of_them)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"]).assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInPandas(rows, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, doc_id long").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_secrets(docs, learn(docs))
