"""Cutting oversized items at natural boundaries by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks; each landmark snaps to the nearest natural boundary
(paragraph, line, sentence, then clause or blank). Candidate cuts thus depend on nearby text alone, so an edit moves only
the cuts next to it. From one cut the next is, of the candidates between the minimum and the maximum size, the one whose rolling hash is
least: a choice by content, on which two runs agree again as soon as they see the same stretch. Without a candidate it is the natural boundary
of least hash; without that, the place of least hash that does not part a combining mark from its letter.
Consecutive pieces overlap by exactly ``overlap`` characters, and a piece with its overlap is never over the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
LANDMARK_EVERY = 32
STRONG = re.compile(r"\n\s*|[。！？!?；;…](?=\s|[^\s\d])\s*|\.(?=\s)\s*")
WEAK = re.compile(r"[，、,:：]\s*|\s+")

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolled(text: str) -> np.ndarray:
    """The rolling hash over the ``WINDOW`` characters before each place from WINDOW to the text's end; one number for all places before that."""
    codes = _codes(text).astype(np.uint64)
    n = len(codes)
    mixed = (codes + np.uint64(0x2545F491)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    out = np.full(n + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    if n >= WINDOW:
        total = np.zeros(n - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            total += mixed[k : n - WINDOW + 1 + k] * _MULTIPLIERS[k]
        total ^= total >> np.uint64(32)
        out[WINDOW:] = total * np.uint64(0x9E3779B97F4A7C15)
        out[WINDOW:] ^= out[WINDOW:] >> np.uint64(29)
    return out


def landmarks(text: str) -> np.ndarray:
    """Places whose rolling hash is a landmark."""
    return WINDOW + np.nonzero(rolled(text)[WINDOW:] % np.uint64(LANDMARK_EVERY) == 0)[0]


def _nearest(sorted_at: np.ndarray, x: int) -> int | None:
    i = int(np.searchsorted(sorted_at, x))
    near = [int(v) for v in sorted_at[max(0, i - 1) : i + 1]]
    return min(near, key=lambda v: (abs(v - x), v)) if near else None


def cuts(text: str, max_size: int, overlap: int) -> list[int]:
    """Cut positions, first 0 and last len(text); gaps leave room for the overlap under ``max_size``."""
    n, reach = len(text), max_size - overlap
    if reach <= 0:
        raise ValueError("overlap_size must be under max_size")
    if n <= max_size:
        return [0, n]
    strong = np.array([m.end() for m in STRONG.finditer(text)], dtype=np.int64)
    weak = np.array([m.end() for m in WEAK.finditer(text)], dtype=np.int64)
    least, radius = max(1, reach // 3), max(1, reach // 4)
    snapped = set()
    for mark in landmarks(text).tolist():
        for points in (strong, weak):
            near = _nearest(points, mark)
            if near is not None and abs(near - mark) <= radius:
                snapped.add(near)
                break
    candidates = np.array(sorted(snapped), dtype=np.int64)
    strong_set = set(strong.tolist())
    best = np.array([c for c in candidates.tolist() if c in strong_set], dtype=np.int64)
    value = rolled(text)
    out = [0]
    while n - out[-1] > (max_size if len(out) == 1 else reach):
        at = out[-1]
        # The first piece has no overlap before it and may use the whole limit.
        most = at + (max_size if len(out) == 1 else reach)
        # nor may it end before there is a whole overlap for the second one
        lo = at + (max(least, overlap) if len(out) == 1 else least)
        cut_at = None
        for points in (best, strong, candidates, weak):
            near = points[np.searchsorted(points, lo) : np.searchsorted(points, most, "right")]
            if len(near):
                cut_at = int(near[np.argmin(value[near])])
                break
        if cut_at is None:
            cut_at = lo + int(np.argmin(value[lo : most + 1]))
            while cut_at > lo and unicodedata.combining(text[cut_at]):
                cut_at -= 1
        out.append(cut_at)
    out.append(n)
    return out


def split_text(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; ``end - start <= max_size`` and each starts ``overlap`` before the previous end."""
    at = cuts(text, max_size, overlap)
    return [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]


def split_items(items: DataFrame, keys: list[str], text: str = "item_text", max_size: str = "max_size", overlap: str = "overlap_size") -> DataFrame:
    """Pieces of every item: the key columns, piece_no (from 1), n_pieces, start_at, end_at (0-based, end exclusive), piece_text.

    Null texts give no piece; an empty text and one within its limit give one piece, made without Python; white space
    counts and is kept, so joining the pieces without their overlaps gives the text back. Repeated items give repeated
    pieces. A limit not above its overlap raises an error. An empty table gives no rows.
    """
    base = items.select(*keys, F.col(text).alias("_text"), F.col(max_size).alias("_max"), F.col(overlap).alias("_over")).where("_text is not null")
    fits = F.length("_text") <= F.col("_max")
    whole = base.where(fits).select(
        *keys, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_at"), F.length("_text").alias("end_at"), F.col("_text").alias("piece_text")
    )
    types = dict(base.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["piece_no int", "n_pieces int", "start_at int", "end_at int", "piece_text string"])

    def cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                item, limit, over = row[-3], int(row[-2]), int(row[-1])
                spans = split_text(item, limit, over)
                rows += [(*row[:-3], i + 1, len(spans), a, b, item[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "n_pieces", "start_at", "end_at", "piece_text"])

    return whole.unionByName(base.where(~fits).mapInPandas(cut_batches, schema))
