"""Sizes of texts in tokens of a public byte-level BPE vocabulary; its file's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family divide a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def sent(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary's file to the executors, once a session; the name under which ``SparkFiles`` has it there."""
    context = spark.sparkContext
    done = context.__dict__.setdefault("_talweg_files", set())
    if path not in done:
        context.addFile(path)
        done.add(path)
    return os.path.basename(path)


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _starts(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Per token id: characters that begin in it, and whether it begins within a character."""
    enc = encoding(path)
    size = enc.n_vocab
    chars, inner = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=bool)
    for token, rank in enc._mergeable_ranks.items():
        chars[rank] = sum(x & 0xC0 != 0x80 for x in token)
        inner[rank] = token[0] & 0xC0 == 0x80
    return chars, inner


def pieces(ids: list[int], capacity: int, path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(tokens, first character, end character) of the pieces of at most ``capacity`` tokens; no character is parted."""
    n = len(ids)
    chars, inner = _starts(path)
    array = np.asarray(ids, dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(chars[array])))
    out, at = [], 0
    while at < n:
        end = min(n, at + capacity)
        while end < n and end > at + 1 and inner[array[end]]:
            end -= 1
        if end < n and inner[array[end]]:
            end = min(n, at + capacity)
        out.append((end - at, int(before[at]), int(before[end])))
        at = end
    return out


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and n_tokens of each row; null texts count 0; whole texts, whatever their length."""
    types = dict(documents.dtypes)
    name = sent(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        for b in batches:
            out = b[keys].copy()
            out["n_tokens"] = [0 if not t else len(enc.encode_ordinary(t)) for t in b[text]]
            yield out

    return spread(documents.select(*keys, text)).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_tokens bigint")


def token_pieces(documents: DataFrame, capacities: list[int], vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, capacity, piece_no (from 1), n_pieces, n_tokens, char_from, char_to: one piece unless a text is over the capacity."""
    name = sent(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = SparkFiles.get(name)
        enc = encoding(path)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = enc.encode_ordinary(text) if text else []
                for c in capacities:
                    parts = [(len(ids), 0, len(text or ""))] if len(ids) <= c else pieces(ids, c, path)
                    rows += [(doc, c, i + 1, len(parts), *p) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "capacity", "piece_no", "n_pieces", "n_tokens", "char_from", "char_to"])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, capacity int, piece_no int, n_pieces int, n_tokens int, char_from int, char_to int"
    return spread(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())).mapInPandas(run, schema)
