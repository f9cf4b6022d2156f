import numpy as np

from corvane.llm import pieces as P
from corvane.llm.words import tokenizer_path


class Characters:
    """A spelling of every unit by its characters."""

    def __init__(self, pieces):
        self.of = {c: i for c, (i, _) in pieces.table.items() if len(c) == 1}

    def find(self, units):
        lists = [[self.of[c] for c in u if c in self.of] for u in units]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.ids = np.array([i for x in lists for i in x], np.int32)
        return np.cumsum(sizes) - sizes, sizes


def test_words_that_decode_to_themselves_are_not_put_together_again(monkeypatch):
    own = P.loaded(tokenizer_path("piece_bpe_32k.model"))
    seen, unescaped = [], P.unescaped
    monkeypatch.setattr(P, "unescaped", lambda text: seen.append(text) or unescaped(text))
    speller = P.Speller(own, Characters(own))
    texts = ["plain words here", "", "a▁b", "two  blanks", " first", "last ", "▁ y", "odd \U0001f600 one", "฀x and y"]
    ids, bounds, same = speller(texts)
    for t, a, b, s in zip(texts, bounds[:-1], bounds[1:], same, strict=True):
        back = unescaped(own.decode(ids[a:b].tolist())) if len(t) else ""
        assert bool(s) == (back == t) and (s or "▁" in t)
    assert len(seen) == 4  # the texts with blanks of their own only


def test_letters_are_one_unit_without_a_match():
    own = P.loaded(tokenizer_path("piece_bpe_32k.model"))
    words = ["plain", "Größe", "x²", "½", "ªº", "Ⅷ", "éa", "中文", "a1b", "st.\nOne", "a▁b", "_x", "", "٣", "ǅ", "ｆ", "\U0001d7d8", "\U0001f600"]
    assert sorted(own.units_of_words(words)) == sorted(u for w in words for u in own.units.findall(P.BLANK + w))


def test_words_that_dont_decode_to_themselves_are_found():
    """Pieces that make up two words together but neither of them, among words that are right."""
    own = P.loaded(tokenizer_path("piece_bpe_32k.model"))

    class Wrong(Characters):
        def find(self, units):
            starts, sizes = super().find(units)
            if "▁ab" in units:  # its last letter goes to the next word
                at = units.index("▁ab")
                sizes[at] -= 1
                starts[at + 1] -= 1
                sizes[at + 1] += 1
            return starts, sizes

    assert P.Speller(own, Wrong(own))(["one ab cd two", "one two", "cd"])[2] == [True, True, False]
    assert P.Speller(own, Characters(own))(["one ab cd two", "one two", "cd"])[2] == [True, True, True]


def test_units_are_grouped_by_hash_and_cut_once(spark):
    units = spark.createDataFrame([("▁one",), ("▁two",), ("▁one",), ("x" * 200,)], "unit string")
    made = P.spelling(units, tokenizer_path("piece_bpe_32k.model"), False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "functions=[first(" not in plan and "isnotnull(substr(" not in plan
    assert made.select("key").distinct().count() == made.count() == 3
