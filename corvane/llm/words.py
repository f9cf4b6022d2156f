"""Token ids of whole texts with a word-level memory in front of the tokenizers library."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from itertools import islice

import numpy as np

from .shared import kept_in_worker

#: The id that ends each document.
END_ID = 1

#: What word-end BPE files with these parts do to a run of letters is lower it and
#: hand its bytes to the merges; such runs skip the rest of the library's pipeline.
_LOWERING = ["NFC", "Replace", "Lowercase"]
_SPLITTING = ["Split", "ByteLevel"]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letters: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class _Memory(dict):
    """Chunk to number; asks ``learn`` for what it doesn't hold."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: bytes) -> int:
        return self.learn(chunk)


class ChunkMemory:
    """Ids of chunks of text, remembered.

    Of ``limit`` chunks the later third is forgotten: memory is bounded whatever
    the corpus, and the chunks met first, which the commonest are among, stay.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.known = _Memory(self._learn)
        self.flat, self.starts, self.sizes, self.held = array("I"), array("q"), array("q"), 0

    def _ids(self, chunk) -> bytes:
        """A chunk's ids as uint32 bytes."""
        raise NotImplementedError

    def _learn(self, chunk) -> int:
        ids, k = self._ids(chunk), len(self.known)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids) >> 2)
        self.held += len(chunk)
        self.flat.frombytes(ids)
        self.known[chunk] = k
        return k

    def _forget(self) -> None:
        keep = 2 * self.limit // 3 if len(self.known) > self.limit else 0  # long chunks: let all go
        first = list(islice(self.known.items(), keep))
        self.known.clear()
        self.known.update(first)
        self.held = sum(len(c) for c, _ in first)
        if len(self.starts) > keep:
            del self.flat[self.starts[keep] :], self.starts[keep:], self.sizes[keep:]

    def gather(self, chunks: list, end: int | None = None) -> np.ndarray:
        """The chunks' ids one after the other, uint32, and ``end`` if given."""
        parts = []
        for at in range(0, len(chunks), 50_000):  # long texts go in steps, so that memory holds a step's ids
            if len(self.known) > self.limit or self.held > 48 * self.limit:
                self._forget()
            step = chunks[at : at + 50_000]
            index = np.fromiter(map(self.known.__getitem__, step), np.int64, len(step))
            sizes = np.frombuffer(self.sizes, np.int64)[index]
            ends = np.cumsum(sizes)
            places = np.repeat(np.frombuffer(self.starts, np.int64)[index] - (ends - sizes), sizes) + np.arange(ends[-1])
            parts.append(np.frombuffer(self.flat, np.uint32)[places])
        if end is not None:
            parts.append(np.array([end], np.uint32))
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class WordEncoder(ChunkMemory):
    """Encodes texts as the tokenizer file does, remembering chunks between white space.

    Right for tokenizers whose pre-tokenizer drops white space and whose merges
    never cross it.  The words behind the chunks are remembered alike.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__(limit)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        kinds = lambda part, key: [x["type"] for x in (part or {}).get(key, [])]
        self.direct = parts["model"]["type"] == "BPE" and kinds(parts["normalizer"], "normalizers") == _LOWERING and kinds(parts["pre_tokenizer"], "pretokenizers") == _SPLITTING
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}

    def _merged(self, piece: bytes) -> bytes:
        """The ids of one pre-token, through the merges alone, as uint32 bytes."""
        found = self.words.get(piece)
        if found is None:
            if len(self.words) >= self.limit:
                self.words = dict(islice(self.words.items(), 2 * self.limit // 3))
            shown = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letters)
            found = self.words[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def _ids(self, chunk: bytes) -> bytes:
        if self.direct and len(chunk) < 64:
            core = chunk.rstrip(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
            if not core.isalpha():  # letters of Latin-1 are in NFC, and lower to one letter
                word = core.decode()
                core = word.lower().encode() if word.isalpha() and max(word) < "Ā" else b""
            if core:
                end = chunk[len(core) :]
                return self._merged(core) + self._merged(end) if end else self._merged(core)
        return array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text and END_ID, uint32.  A null text counts as empty."""
        data = (text or "").encode()
        return self.gather((data.lower() if self.direct else data).split(), END_ID)  # bytes split at the six ASCII blanks


_ENCODERS: dict[str, WordEncoder] = kept_in_worker()


def encoder(path: str) -> WordEncoder:
    """One per Python worker, until another operator's functions run there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
