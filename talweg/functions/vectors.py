"""Vector and score functions as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 1) -> Column:
    """Half-even on the binary value, unlike round(): the decimal text of the double decides."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits)).cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or unequally long vectors; a zero norm counts as 1."""
    na, nb = norm(a), norm(b)
    value = dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), value).otherwise(F.lit(0.0))


def _steps(sim: Column, tops: list[float], rest: Column) -> Column:
    at = [0.84, 0.78, 0.72, 0.66]
    out = F.when(sim <= 0, F.lit(0.0))
    for limit, score in zip(at, tops, strict=True):
        out = out.when(sim >= limit, F.lit(score))
    return out.otherwise(rest)


def band_score(sim: Column) -> Column:
    return _steps(sim, [95.0, 85.0, 75.0, 65.0], F.lit(55.0))


def experience_score(sim: Column) -> Column:
    """Like the band, but linear from 38 to 72 below similarity 0.66."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sim - 0.38) / (0.66 - 0.38)))
    return _steps(sim, [95.0, 88.0, 80.0, 72.0], rounded(38.0 + share * (72.0 - 38.0)))


def hash_bucket(token: Column, dim: int) -> Column:
    """md5 of the token as a number modulo ``dim``, folded by 32-bit words since the number has 128 bits."""
    digest = F.md5(token.cast("binary"))
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    out = F.lit(0).cast("bigint")
    for w in words:
        out = (out * (2**32 % dim) + w) % dim
    return out.cast("int")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


@lru_cache(maxsize=1 << 16)
def _bucket_of(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest(), 16) % dim


def hash_vectors(texts: Sequence[str], dim: int = 128) -> list[np.ndarray]:
    """Counts of hashed white-space tokens of each text, at length 1; zeros for empty text."""
    out = []
    for text in texts:
        counts = np.bincount([_bucket_of(w, dim) for w in text.split()] or [0], minlength=dim).astype(float) if text.strip() else np.zeros(dim)
        length = np.sqrt((counts * counts).sum())
        out.append(counts / length if length else counts)
    return out
