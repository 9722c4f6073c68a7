"""Scores of many pairs: each side is packed once per record, two joins bring the sides to the pair, and the pair is scored in place.

Nothing of a pair depends on another pair. Its corpus are the candidate's own chunks, so document frequencies and lengths belong to the
candidate alone, and ranks are taken among the few rows of the pair. So neither tokens nor grid rows are shuffled: what travels is the pair
with the text and the sparse vectors of its job. Rows come sorted by candidate, who is unpacked once.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache, partial
from math import floor, log
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from talweg.config import Settings
from talweg.functions.text import TECH_TOKEN
from talweg.functions.vectors import experience_score, hash_vectors, rounded
from talweg.operators.chunks import SEMANTIC_CHARS
from talweg.operators.retrieval import DEGENERATE, DIGITS

DUTIES, DONE = ("resp", "jd_raw"), ("project", "work")
JOB_AXES, CANDIDATE_AXES = ("skill", "role"), ("skill", "cand_role")
ROWS_AT_ONCE = 500
BEST = "array<struct<j:int,d:int,cosine:double,bm25:double,rank_cos:int,rank_bm25:int,bm25_degenerate:boolean,rrf:double>>"
SCORED = f"best {BEST}, top array<double>, n_chunks bigint, skill_similarity double, role_similarity double"
_TOKEN = re.compile(f"{TECH_TOKEN}|[一-鿿]+")
_NUMBER = re.compile(r"_(\d+)$", re.ASCII)


def words(text: str) -> list[str]:
    """The same as the column ``functions.text.tokens`` without user words."""
    out: list[str] = []
    for t in _TOKEN.findall(text):
        if len(t) > 2 and "一" <= t[0] <= "鿿":
            out += map(add, t, t[1:])
        else:
            out.append(t.lower())
    return out


def number(kind: str) -> int:
    """Order of chunks: projects before work, then by number."""
    found = _NUMBER.search(kind)
    return (100_000 if kind.startswith("work_") else 0) + (int(found[1]) if found else 0)


def rounded_up(x: float) -> float:
    """As the SQL function round() to ``DIGITS`` digits, half away from zero."""
    return floor(x * 10**DIGITS + 0.5) / 10**DIGITS if x >= 0 else -floor(-x * 10**DIGITS + 0.5) / 10**DIGITS


def _sparse(vector: Sequence[float]) -> tuple[bytes, bytes]:
    v = np.asarray(vector, dtype=float)
    at = np.flatnonzero(v)
    return at.astype(np.uint16 if len(v) <= 1 << 16 else np.uint32).tobytes(), v[at].tobytes()


def packed_side(sides: DataFrame, blocks: Sequence[str], axes: Sequence[str], name: str, settings: Settings = Settings(), provider: Callable | None = None) -> DataFrame:
    """``sides`` (id, chunks, others) as id, others and ``name``: number, text and vector of the chunks of ``blocks``, and the vectors of ``axes``.

    Vectors are those of the whole chunk, asked of ``provider`` (or hashed) in batches, each distinct text of ``ROWS_AT_ONCE`` records
    once; a batch that fails gives zero vectors. An id has one row.
    """
    from talweg.operators.matching import embedded

    dim, size = settings.embedding_dim, settings.embedding_batch
    ask = provider or partial(hash_vectors, dim=dim)
    sides = sides.withColumn("chunks", F.filter("chunks", lambda c: c["block"].isin(*blocks) | c["profile_type"].isin(*axes)))
    others = [f for f in sides.schema.fields if f.name != "chunks"]

    def pack(rows: list[list[dict]]) -> list[bytes]:
        texts = list({c["chunk_text"]: None for chunks in rows for c in chunks})
        vector = dict(zip(texts, map(_sparse, embedded(texts, ask, dim, size)[0]), strict=True))
        out = []
        for chunks in rows:
            rated = sorted((number(c["profile_type"]), c["chunk_text"]) for c in chunks if c["block"] in blocks)
            ats = {c["profile_type"]: vector[c["chunk_text"]] for c in chunks if c["profile_type"] in axes}
            out.append(pickle.dumps(([k for k, _ in rated], [t[:SEMANTIC_CHARS] for _, t in rated], [vector[t] for _, t in rated], [ats.get(a) for a in axes]), 5))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(i, ROWS_AT_ONCE)
                columns = [b.column(f.name) for f in others] + [pa.array(pack(b.column("chunks").to_pylist()), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in others] + [name])

    return sides.mapInArrow(run, StructType([*others, StructField(name, BinaryType())])).dropDuplicates(["id"])


class _Vectors:
    """Sparse vectors as rows of one matrix, and their norms; a zero norm counts as 1."""

    def __init__(self, vectors: list[tuple[bytes, bytes]], dim: int):
        kind = np.uint16 if dim <= 1 << 16 else np.uint32
        self.rows = [(np.frombuffer(at, kind), np.frombuffer(v)) for at, v in vectors]
        self.norms = [float(np.sqrt(v @ v)) or 1.0 for _, v in self.rows]
        self.dim = dim

    def matrix(self) -> np.ndarray:
        m = np.zeros((len(self.rows), self.dim))
        for i, (at, v) in enumerate(self.rows):
            m[i, at] = v
        return m


class _Duties:
    def __init__(self, packed: bytes, dim: int):
        self.ids, self.texts, vectors, axes = pickle.loads(packed)
        self.vectors = _Vectors(vectors, dim)
        self.axes = [_Vectors([a], dim) if a else None for a in axes]

    @cached_property
    def words(self) -> list[list[str]]:
        return [words(t) for t in self.texts]


class _Done:
    def __init__(self, packed: bytes, settings: Settings):
        dim, k1, b = settings.embedding_dim, settings.bm25_k1, settings.bm25_b
        self.ids, texts, vectors, axes = pickle.loads(packed)
        self.vectors = _Vectors(vectors, dim)
        self.matrix = self.vectors.matrix()
        self.axes = [(v.matrix(), v.norms[0]) if (v := a and _Vectors([a], dim)) else None for a in axes]
        found = [words(t) for t in texts]
        mean = sum(map(len, found)) / len(found) if found else 0.0
        self.damp = [k1 * (1.0 - b + b * len(w) / (mean or 1.0)) for w in found]
        self.found: dict[str, list[tuple[int, int]]] = {}
        for i, w in enumerate(found):
            for term, tf in Counter(w).items():
                self.found.setdefault(term, []).append((i, tf))

    def bm25(self, asked: list[str], k1: float) -> list[float]:
        n, out = len(self.ids), [0.0] * len(self.ids)
        for term, qtf in Counter(filter(self.found.__contains__, asked)).items():
            hits = self.found[term]
            weight = qtf * log((n - len(hits) + 0.5) / (len(hits) + 0.5) + 1.0) * (k1 + 1.0)
            for i, tf in hits:
                out[i] += weight * tf / (tf + self.damp[i])
        return [rounded_up(x) for x in out]


def _ranks(scores: list[float]) -> list[int]:
    """1, 1, 3: equal scores share a rank and the next one skips; higher is better."""
    ordered = sorted(scores)
    return [1 + len(ordered) - bisect_right(ordered, s) for s in scores]


def scored(job: _Duties, person: _Done, settings: Settings) -> tuple[list[tuple], list[float]]:
    """The best experience of each duty, in the columns of ``BEST``, and the cosines of the best experiences over all."""
    k, ids, best, per_chunk = settings.rrf_k, person.ids, [], {}
    for j, asked, (at, v), norm in zip(job.ids, job.words, job.vectors.rows, job.vectors.norms, strict=True):
        dots = (person.matrix[:, at] @ v).tolist()
        cosine = [rounded_up(x / (norm * other)) for x, other in zip(dots, person.vectors.norms, strict=True)]
        lexical = person.bm25(asked, settings.bm25_k1)
        by_cosine, by_lexical, flat = _ranks(cosine), _ranks(lexical), max(lexical) - min(lexical) <= DEGENERATE
        rrf = [1.0 / (k + c) + (0.0 if flat else 1.0 / (k + x)) for c, x in zip(by_cosine, by_lexical, strict=True)]
        score = rrf if settings.hybrid else cosine
        i = min(range(len(ids)), key=lambda i: (-score[i], -cosine[i], ids[i]))
        best.append((j, ids[i], cosine[i], lexical[i], by_cosine[i], by_lexical[i], flat, rrf[i]))
        for i, d in enumerate(ids):
            mine = (-score[i], -cosine[i], j)
            if d not in per_chunk or mine < per_chunk[d]:
                per_chunk[d] = mine
    top = sorted((s, c, d) for d, (s, c, _) in per_chunk.items())[: settings.top_chunks]
    return best, [-c for _, c, _ in top]


def _axis(a: _Vectors | None, b: tuple[np.ndarray, float] | None) -> float | None:
    if a is None or b is None:
        return None
    (at, v), (row, norm) = a.rows[0], b
    return rounded_up(float(row[0, at] @ v) / (a.norms[0] * norm))


def score_pairs(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pairs`` (job_id, candidate_id, job, candidate, others), sides packed, with ``SCORED`` in place of the sides.

    ``best`` and ``top`` are empty where a side is missing or has no such chunks, a similarity is null where one side lacks the axis.
    """
    others = [f for f in pairs.schema.fields if f.name not in ("job", "candidate")]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()]
    fields = ["j", "d", "cosine", "bm25", "rank_cos", "rank_bm25", "bm25_degenerate", "rrf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duties = lru_cache(1024)(lambda packed: _Duties(packed, settings.embedding_dim))
        done = lru_cache(16)(lambda packed: _Done(packed, settings))
        for b in batches:
            rows, ends, tops, sizes, skills, roles = [], [0], [], [], [], []
            for job, candidate in zip(b.column("job"), b.column("candidate"), strict=True):
                best, top, n, skill, role = [], [], 0, None, None
                if (j := job.as_py()) is not None and (c := candidate.as_py()) is not None:
                    mine, theirs = duties(j), done(c)
                    if mine.ids and theirs.ids:
                        best, top = scored(mine, theirs, settings)
                        n = len(theirs.ids)
                    if mine.axes:
                        skill, role = (_axis(x, y) for x, y in zip(mine.axes, theirs.axes, strict=True))
                rows += best
                ends.append(len(rows))
                tops.append(top)
                sizes.append(n)
                skills.append(skill)
                roles.append(role)
            parts = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields))
            made = [best, pa.array(tops, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(skills, pa.float64()), pa.array(roles, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in others] + made, [f.name for f in others] + ["best", "top", "n_chunks", "skill_similarity", "role_similarity"])

    made = StructType.fromDDL(SCORED)
    return pairs.mapInArrow(run, StructType(others + made.fields))


def joined(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, how: str = "inner") -> DataFrame:
    """``pairs`` with their packed sides. The job's side travels to the candidates: jobs may have any number of pairs, so the shuffle that carries texts goes by candidate."""
    return pairs.join(jobs.withColumnRenamed("id", "job_id"), "job_id", how).join(candidates.withColumnRenamed("id", "candidate_id"), "candidate_id", how)


def delivered(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scored pairs with n_queries, mean_query_score, mean_chunk_score and delivery_score, null where no duty met an experience; as ``retrieval.delivery``."""
    def mean(cosines: Column) -> Column:
        return F.aggregate(F.transform(cosines, experience_score), F.lit(0.0), lambda s, x: s + x) / F.size(cosines)

    w = settings.job_coverage
    met = F.size("best") > 0
    out = pairs.withColumns({"n_queries": F.size("best").cast("bigint"), "mean_query_score": F.when(met, mean(F.col("best.cosine"))), "mean_chunk_score": F.when(met, mean(F.col("top")))})
    return out.withColumn("delivery_score", rounded(w * F.col("mean_query_score") + (1.0 - w) * F.col("mean_chunk_score")))
