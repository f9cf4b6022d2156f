"""Personal data by weak supervision, in built-in functions alone.

Fixed patterns give base spans; looser ones, and matches of the fixed ones that
failed their checks, give further candidates.  Labelers (regular expression,
checksum, gazetteer, context, boundary) vote for or against every candidate;
expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; the posteriors then train a span classifier, naive Bayes over a
span's shape and surroundings, which decides about the further candidates.

Work follows a text's length: positions are sums of blocks of sums, and pieces of
a text are taken from short cuts of it, never by counting from its start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, keyed, materialise, with_keys

#: Kinds in the order that ties of a start are listed in.
KINDS = ("email", "ip", "card", "phone")
MORE = ("handle", "iban", "name", "national", "tel")

# Matches as with plain quantifiers from the left: a run that fails at its start
# fails everywhere, so starts inside runs are skipped and runs never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@.])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20[A-Z][a-zà-ÿ]+(?:\x20[A-Z][a-zà-ÿ]+)?",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor")
#: Gazetteers: endings of domains, first digits of card numbers, lengths don't matter; country codes; first names.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
NAMES = ("Anna", "Carlos", "Claire", "David", "Emma", "Hans", "James", "Jean", "John", "Jose", "Juan", "Karl", "Maria", "Marie", "Mary", "Michael", "Peter", "Pierre", "Sarah", "Smith", "Thomas")
#: Words that announce personal data, in lower case.
CUES = r"(?:e-?mail|phone|tel|call|mobile|fax|contact|card|visa|account|iban|konto|ssn|social|address|name|ip|host|user|twitter|from|cuenta|carte)[^a-z]{0,12}$"

#: Words before numbers that are no personal data, in lower case.
ANTICUES = r"(?:order|invoice|version|release|page|figure|fig|table|chapter|section|isbn|part|serial|batch|ticket|item|model|build|line|no|nr|art|ref|id)[^a-z]{0,12}$"

LABELERS = ("regex", "check", "gazetteer", "context", "boundary")
ROUNDS = 50
#: The classifier's least probability for a span that no fixed pattern has.
SURE = 0.9


def _gate(kind: str, text: Column) -> Column:
    """What a text with a match of the kind has for sure; far cheaper than the pattern."""
    if kind in ("email", "handle"):
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "name":
        found = F.contains(text, F.lit(TITLES[0]))
        for title in TITLES[1:]:
            found = found | F.contains(text, F.lit(title))
        return found
    return F.regexp_like(text, F.lit(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20.)-]*[0-9]"))


#: Elements of an array that are summed together, characters of a text that are cut together.
BLOCK, CUT = 128, 256
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` has it."""
    return F.transform(F.array(value), body)[0]


def stage(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each evaluated once: a generator between two projections keeps
    them apart, where the optimizer would put a column's expression into the lambdas that use it."""
    return rows.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_stage")).select("*", *[F.col("_stage")[k].alias(k) for k in columns]).drop("_stage")


def running(values: Column, add, none: int = 0) -> Column:
    """Running totals of an array of integers, block by block: a block's totals are gathered, then the blocks' totals."""
    step = lambda acc, x: F.array_append(acc, add(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(none)), x))
    totals = lambda block: F.aggregate(block, F.array().cast("array<int>"), step)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: totals(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))
    ends = lambda parts: totals(F.transform(parts, lambda p: F.element_at(p, -1)))
    before = lambda parts: F.concat(F.array(F.lit(none)), F.slice(ends(parts), F.lit(1), F.size(parts) - 1))
    return let(blocks, lambda parts: F.flatten(F.zip_with(parts, before(parts), lambda p, at: F.transform(p, lambda x: add(at, x)))))


def cuts(text: Column) -> Column:
    """The text in cuts of CUT characters."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CUT).cast("int")), lambda k: F.substr(text, k * CUT + 1, F.lit(CUT)))


def piece(cut: Column, start: Column, stop: Column) -> Column:
    """The text from ``start`` to ``stop`` (not included), from its cuts; empty if stop isn't after start."""
    first = F.floor(start / CUT).cast("int")
    held = F.transform(F.sequence(first, F.floor((stop - 1) / CUT).cast("int")), lambda k: F.coalesce(F.get(cut, k), F.lit("")))
    return F.when(stop > start, F.substr(F.array_join(held, ""), start - first * CUT + 1, stop - start)).otherwise("")


def found(kind: str, pattern: str, text: Column) -> Column:
    """The pattern's leftmost non-overlapping matches: array of struct(start, rank, end, kind, value)."""
    rank = (*KINDS, *MORE).index(kind)
    none = F.array().cast(_SPAN)

    def placed(m: Column) -> Column:
        wide = F.zip_with(m["values"], F.slice(m["between"], F.lit(1), F.size(m["values"])), lambda v, b: F.length(v) + F.length(b))
        ends = let(wide, lambda w: running(w, lambda a, x: a + x))
        one = lambda v, e: F.struct((e - F.length(v)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), v.alias("value"))
        return F.when(F.size(m["values"]) > 0, F.zip_with(m["values"], ends, one)).otherwise(none)

    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("between"))
    return F.coalesce(F.when(_gate(kind, text), let(matches, placed)), none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    digits = F.reverse(digits_of(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(span: Column) -> Column:
    """The checks that base matches must pass; all others pass."""
    kind, value = span["kind"], span["value"]
    n = F.length(digits_of(value))
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "ip", F.regexp_like(value, F.lit(rf"^{part}(?:\.{part}){{3}}$")))
        .when(kind == "card", F.when(n.between(12, 19), luhn(value)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def fixed_matches(text: Column) -> Column:
    """All matches of the fixed patterns that a check lets pass or that have about the digits of what they look for."""
    n = lambda s: F.length(digits_of(s["value"]))
    close = {"card": lambda s: n(s).between(12, 19), "phone": lambda s: n(s).between(7, 17)}
    return F.array_sort(F.concat(*[F.filter(found(k, p, text), close[k]) if k in close else found(k, p, text) for k, p in PATTERNS.items()]))


def _any_of(value: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(value, F.lit(r"(?<![A-Za-z])(?:" + "|".join(words) + r")(?![A-Za-z])"))


def surrounded(cut: Column, span: Column) -> Column:
    """A span with what is before and after it, and whether it passes the base checks."""
    fields = [span[f].alias(f) for f in ("start", "rank", "end", "kind", "value")]
    before, after = F.lower(piece(cut, F.greatest(span["start"] - 30, F.lit(0)), span["start"])), piece(cut, span["end"], span["end"] + 1)
    return F.struct(*fields, before.alias("before"), after.alias("after"), (span["kind"].isin(*KINDS) & valid(span)).alias("passed"))


def voted(span: Column) -> Column:
    """The labelers' votes: 1 yes, -1 no, 0 none."""
    kind, value, passed, before = span["kind"], span["value"], span["passed"], span["before"]
    n = F.length(digits_of(value))
    regex = F.when(passed | kind.isin("national", "iban"), 1).when(kind.isin(*KINDS), -1).otherwise(0)
    check = F.when(kind == "card", F.when(passed, 1).otherwise(-1)).when(kind == "iban", F.when(_any_of(F.substr(value, F.lit(1), F.lit(2)), COUNTRIES), 1).otherwise(-1)).when(kind.isin("phone", "tel"), F.when(n.between(9, 15), 1).otherwise(-1)).when(kind == "national", F.when(F.regexp_like(value, F.lit("^(?:000|666|9)|-00-|-0000$")), -1).otherwise(1)).otherwise(0)
    gazetteer = F.when(kind == "email", F.when(_any_of(F.regexp_extract(value, r"\.([A-Za-z]+)$", 1), DOMAINS), 1).otherwise(-1)).when(kind == "card", F.when(F.regexp_like(value, F.lit("^[3-6]")), 1).otherwise(-1)).when(kind == "name", F.when(_any_of(value, NAMES), 1).otherwise(-1)).otherwise(0)
    context = F.when(F.regexp_like(before, F.lit(CUES)), 1).when(F.regexp_like(before, F.lit(ANTICUES)), -1).otherwise(0)
    near = F.regexp_like(before, F.lit("[a-z0-9_#=/]$")) | F.regexp_like(span["after"], F.lit("[A-Za-z0-9_=/]"))
    boundary = F.when(near, -1).otherwise(1)
    return F.struct(span.alias("span"), regex.alias("regex"), check.alias("check"), gazetteer.alias("gazetteer"), context.alias("context"), boundary.alias("boundary"))


def told(votes: Column) -> Column:
    """A candidate with its votes (in LABELERS' order) and its features."""
    span = votes["span"]
    n, left, right = F.length(digits_of(span["value"])), F.right(span["before"], F.lit(1)), span["after"]
    side = lambda c: F.when(c == "", "edge").when(F.regexp_like(c, F.lit(r"\s")), "blank").when(F.regexp_like(c, F.lit(r"[\p{L}\p{N}]")), "word").otherwise("mark")
    length = F.length(span["value"])
    shape = F.when(length <= 8, "short").when(length <= 16, "middle").otherwise("long")
    share = F.when(n == 0, "none").when(n * 2 < length, "some").otherwise("most")

    named = (("kind", F.concat(span["kind"], F.when(span["passed"] | ~span["kind"].isin(*KINDS), "").otherwise("?"))), ("left", side(left)), ("right", side(right)), ("length", shape), ("digits", share), ("cue", votes["context"].cast("string")), ("check", votes["check"].cast("string")))
    return F.struct(
        span["start"].alias("start"), span["rank"].alias("rank"), span["end"].alias("end"), span["kind"].alias("kind"), span["passed"].alias("passed"),
        F.concat_ws(",", *[votes[name].cast("string") for name in LABELERS]).alias("votes"),
        F.array(*[F.concat(F.lit(f"{name}="), v) for name, v in named]).alias("features"),
    )


def replaced(rows: DataFrame, text: Column, cut: Column, spans: Column, by, name: str) -> DataFrame:
    """``rows`` with ``name``: the text with each span, or run of spans that overlap, replaced by ``by`` of
    its first span and the run's end.  ``spans`` are sorted by start."""
    some = F.size(spans) > 0
    reach, at = F.col("_reach"), F.col("_at")
    rows = stage(rows, _reach=F.when(some, running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))))
    # A span begins a run where it starts at or after the end of all before it.
    begins = lambda i: F.coalesce(F.get(spans, i)["start"] >= F.get(reach, i - 1), F.lit(True))
    rows = stage(rows, _at=F.when(some, F.filter(F.sequence(F.lit(0), F.size(spans) - 1), begins)))
    end = lambda j: F.get(reach, F.coalesce(F.get(at, j + 1), F.size(spans)) - 1)
    run = lambda i, j: F.struct(F.get(spans, i).alias("span"), F.when(j == 0, 0).otherwise(end(j - 1)).alias("from"), end(j).alias("end"))
    rows = stage(rows, _runs=F.when(some, F.transform(at, run)))
    parts = F.transform("_runs", lambda r: F.concat(piece(cut, r["from"], r["span"]["start"]), by(r["span"], r["end"])))
    whole = F.concat(F.array_join(parts, ""), piece(cut, F.element_at(reach, -1), F.length(text)))
    return stage(rows, **{name: F.when(some, whole).otherwise(text)}).drop("_reach", "_at", "_runs")


def spotted(docs: DataFrame) -> DataFrame:
    """``docs`` with base and more: all judged candidates of each text (a null text has none)."""
    rows = stage(docs, _text=F.coalesce("text", F.lit("")))
    rows = stage(rows, _fixed=fixed_matches(F.col("_text")))
    rows = stage(rows, _cuts=cuts(F.col("_text")))
    # Looser patterns look at what is outside the fixed patterns' matches.
    rows = replaced(rows, F.col("_text"), F.col("_cuts"), F.col("_fixed"), lambda s, end: F.repeat(F.lit("\uffff"), end - s["start"]), "_rest")
    loose = F.concat("_fixed", *[found(k, p, F.col("_rest")) for k, p in LOOSE.items()])
    rows = stage(rows, _all=F.array_sort(loose))
    rows = stage(rows, _around=F.transform("_all", lambda s: surrounded(F.col("_cuts"), s)))
    rows = stage(rows, _votes=F.transform("_around", voted))
    rows = stage(rows, _told=F.transform("_votes", told))
    return rows.select(*docs.columns, F.filter("_told", lambda s: s["passed"]).alias("base"), F.filter("_told", lambda s: ~s["passed"]).alias("more"))


@dataclass
class Classifier:
    """Naive Bayes over features; also what expectation-maximisation said."""

    prior: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, float] = field(default_factory=dict)

    def sure(self, span: Column) -> Column:
        """Whether the span's probability is at least SURE."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        if self.weights:
            table = F.create_map(*[F.lit(x) for kv in sorted(self.weights.items()) for x in kv])
            total = total + F.aggregate(span["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return total >= math.log(SURE / (1 - SURE))


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[float], float]:
    """Posterior of each vote pattern, the labelers' accuracies, the share of true spans.

    Labelers err independently given the truth; an abstention says nothing.
    """
    accuracy, prior = [0.8] * len(LABELERS), 0.5
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for a, v in zip(accuracy, votes, strict=True):
                if v:
                    yes += math.log(a if v > 0 else 1 - a)
                    no += math.log(1 - a if v > 0 else a)
            posterior[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        total = sum(counts.values())
        prior = min(0.98, max(0.02, (1 + sum(n * posterior[v] for v, n in counts.items())) / (2 + total)))
        for k in range(len(LABELERS)):
            voted = sum(n for v, n in counts.items() if v[k])
            right = sum(n * (posterior[v] if v[k] > 0 else 1 - posterior[v]) for v, n in counts.items() if v[k])
            accuracy[k] = min(0.99, max(0.55, (right + 8) / (voted + 10)))  # better than a coin, by assumption
    return posterior, accuracy, prior


def train(spans: DataFrame) -> Classifier:
    """The classifier, from rows of base and more over the whole corpus."""
    each = spans.select(F.explode(F.concat("base", "more")).alias("s")).select("s.votes", "s.features")
    counted = {tuple(map(int, r["votes"].split(","))): r["count"] for r in each.groupBy("votes").count().collect()}  # 3**5 patterns at most
    if not counted:
        return Classifier()
    posterior, accuracy, prior = expectation_maximisation(counted)
    table = F.create_map(*[F.lit(x) for v, p in posterior.items() for x in (",".join(map(str, v)), p)])
    weighed = each.withColumn("p", F.element_at(table, F.col("votes"))).select(F.explode("features").alias("feature"), "p")
    rows = weighed.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # a row for each feature's value
    total_yes = sum(n * posterior[v] for v, n in counted.items())
    total_no = sum(counted.values()) - total_yes
    weights = {r["feature"]: math.log((r["yes"] + 1) / (total_yes + 4)) - math.log((r["no"] + 1) / (total_no + 4)) for r in rows}
    return Classifier(prior, weights, dict(zip(LABELERS, accuracy, strict=True)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(classifier: Classifier) -> Column:
    """Base spans and the candidates the classifier is sure of, sorted by start, then kind."""
    return F.array_sort(F.concat("base", F.filter("more", classifier.sure)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``.

    Spans are kind:start:end in code points, end exclusive.  Null and empty texts
    have none; repeated rows and null doc_ids get a row each.
    """
    spans = materialise(spotted(docs.select("doc_id", "text")).select("doc_id", "base", "more"), "spans")
    classifier = train(spans)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(all_spans(classifier)).alias("spans"))


def masked(rows: DataFrame, text: Column, spans: Column) -> DataFrame:
    """``rows`` with _clean: the text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    rows = stage(rows, _cuts=F.when(F.size(spans) > 0, cuts(text)))
    return replaced(rows, text, F.col("_cuts"), spans, lambda s, _: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")), "_clean").drop("_cuts")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, with personal data in ``text`` masked; null texts stay null.

    Rows with candidates are few: their spans are written with their keys, so
    that the patterns run once, and joined back to the rows they belong to.
    """
    rows = keyed(docs)
    judged_rows = spotted(rows.select("_key", F.col("_row")["text"].alias("text"))).select("_key", "base", "more")
    spans = materialise(judged_rows.where("size(base) > 0 OR size(more) > 0"), "spans")
    classifier = train(spans)
    chosen = spans.select("_key", all_spans(classifier).alias("spans")).where("size(spans) > 0")
    marked = with_keys(rows, materialise(chosen, "chosen"))
    clean = masked(marked, F.col("_row")["text"], F.col("spans"))
    return clean.select(*[(F.col("_clean") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
