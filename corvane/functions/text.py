"""Hashes and the hashed bag-of-words embedding of texts."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
_LOW = 0xFFFFFFFF
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.lru_cache(maxsize=1 << 18)
def fnv1a(text: str, seed: int = 0) -> int:
    """FNV-1a of the UTF-8 bytes, trailing blanks left out, as a signed 64-bit number."""
    h = FNV_OFFSET ^ (seed & (2**64 - 1))
    for b in text.rstrip(" ").encode():
        h = ((h ^ b) * FNV_PRIME) % 2**64
    return h - 2**64 if h >= 2**63 else h


def fnv1a_column(text: Column) -> Column:
    """The same for ASCII text in built-in functions.

    The state is two 32-bit halves, since products of 64-bit numbers overflow;
    the prime is 2**40 + 435, so a product is a shift and two short products.
    """
    chars = F.filter(F.split(F.rtrim(text), ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        low = s["low"].bitwiseXOR(F.ascii(c).cast("long"))
        product = low * 435
        high = s["high"] * 435 + F.shiftleft(low, 8) + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(_LOW).alias("high"), product.bitwiseAND(_LOW).alias("low"))

    first = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("high"), F.lit(FNV_OFFSET & _LOW).cast("long").alias("low"))
    return F.aggregate(chars, first, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))


def tokens(text: Column) -> Column:
    """Runs of a-z, 0-9 and _ once A-Z are lowered; other characters separate."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9_]+"), F.lit(0))


_TOKEN = re.compile("[a-z0-9_]+")
_LOWERING = str.maketrans(_UPPER, _LOWER)


def embed(text: str | None, dim: int, normalization: str = "l2") -> np.ndarray:
    """Counts of tokens by FNV-1a slot; divided by their norm for ``l2``.  Stored in single precision."""
    found = _TOKEN.findall((text or "").translate(_LOWERING))
    counts = np.bincount([fnv1a(t) % dim for t in found], minlength=dim).astype(np.float64) if found else np.zeros(dim)
    length = np.sqrt((counts * counts).sum())
    if normalization.lower() == "l2" and length > 0:
        counts /= length
    return counts.astype(np.float32)


def embed_column(text: Column, dim: int, normalization: str = "l2") -> Column:
    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series([embed(t, dim, normalization) for t in texts])

    return embedded(text)


def sha256_text(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def sha256_column(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
