"""Bulk scoring of job–candidate pairs: degree gate, skill overlap, semantic axes and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.config import Settings
from talweg.functions.lexicons import offered_terms, required_terms
from talweg.functions.nfkc import nfkc, nfkc_each
from talweg.functions.text import blank, degree_rank, shared_terms, snippet, strip, tokens
from talweg.functions.vectors import band_score, cosine, hash_vectors, rounded
from talweg.operators.chunks import SEMANTIC_CHARS, candidate_chunk_list, candidate_chunks, job_chunk_list, job_chunks
from talweg.operators.pair_scores import CANDIDATE_AXES, DONE, DUTIES, JOB_AXES, delivered, joined, packed_side, score_pairs
from talweg.operators.retrieval import best_per_query, bm25, fuse, weighted_sum
from talweg.session import cut, dealt

Provider = Callable[[list[str]], Sequence[Sequence[float]]]


def required_degree(own: Column, structured: Column) -> Column:
    """Text of the demanded degree: the record's own column, else the structured one."""
    return F.coalesce(F.when(~blank(own), strip(own)), F.when(~blank(structured), strip(structured)))


def demanded_text() -> Column:
    return required_degree(F.col("education_requirement"), F.col("structured.education_requirement"))


def demanded_rank(text: Column | None = None) -> Column:
    """Rank of the degree a job demands; null if it demands none or none that is known."""
    return degree_rank(F.lower(nfkc(demanded_text() if text is None else text)))


def resumes_read(resumes: DataFrame) -> DataFrame:
    """The readable résumés: candidate_id, id, updated_at, levels and the rank of the best degree."""
    degrees = F.coalesce(F.col("parsed.layer_1_extracted.education.degree"), F.array().cast("array<string>"))
    levels = F.transform(degrees, lambda d: strip(F.lower(d)))
    best = F.array_max(F.transform(nfkc_each(degrees), lambda d: degree_rank(F.lower(d))))
    return resumes.where("parsed is not null and status in ('parsed', 'candidate_bound')").select(
        "candidate_id", "id", "updated_at", F.filter(levels, lambda d: d.isNotNull() & (d != "")).alias("levels"), best.alias("best"))


def degree_gate(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """``pairs`` (job_id, candidate_id) with required_rank, best_rank, levels, gate and meets_requirement.

    The best degree over a candidate's readable résumés counts; levels are those of the newest résumé that passes (by updated_at, then
    id). Degrees are looked for in NFKC. No demand, or one that names no known degree, lets everyone pass (``gate`` says which).
    """
    wanted = jobs.select(F.col("id").alias("job_id"), demanded_text().alias("required")).distinct()
    wanted = wanted.withColumn("required_rank", demanded_rank(F.col("required")))
    met = pairs.join(wanted, "job_id", "left").join(resumes_read(resumes).distinct(), "candidate_id", "left")
    passes = F.coalesce(F.col("best") >= F.col("required_rank"), F.lit(False))
    found = met.groupBy("job_id", "candidate_id", "required", "required_rank").agg(
        F.max("best").alias("best_rank"), F.max_by(F.when(passes, F.col("levels")), F.when(passes, F.struct("updated_at", "id"))).alias("levels"), F.max(passes).alias("any"))
    gate = F.when(F.col("required").isNull(), "no_requirement").when(F.col("required_rank").isNull(), "unrecognised").otherwise("compared")
    return found.select(
        "job_id", "candidate_id", "required_rank", "best_rank", F.coalesce("levels", F.array().cast("array<string>")).alias("levels"), gate.alias("gate"),
        (F.col("required_rank").isNull() | F.col("any")).alias("meets_requirement"))


def gate_counts(gates: DataFrame) -> DataFrame:
    """How many candidates of each job met the gate and how many passed it."""
    return gates.groupBy("job_id").agg(F.count("*").alias("total_input"), F.count_if("meets_requirement").alias("passed_count"))


def asked_skills() -> Column:
    """The skills a job demands, each once."""
    s = F.col("structured")
    terms = F.array_distinct(F.concat(required_terms(s["required_skills"]), required_terms(s["preferred_skills"])))
    return F.coalesce(terms, F.array().cast("array<string>")).alias("asked")


def skill_score() -> Column:
    """Share of the ``asked`` skills that are ``offered``, 0 where either side has none."""
    usable = (F.size("asked") > 0) & (F.size("offered") > 0)
    matched = F.filter("asked", lambda t: F.array_contains("offered", t))
    return F.when(usable, rounded(100.0 * F.size(matched) / F.size("asked"))).otherwise(0.0).alias("skill_score")


def skill_scores(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of the demanded skills a candidate has: pair, skill_score, matched, missing (in the job's order) and status."""
    # The lexicon is applied once per record, not once per pair.
    asked = jobs.select(F.col("id").alias("job_id"), asked_skills()).dropDuplicates(["job_id"])
    offered = candidates.select(F.col("id").alias("candidate_id"), offered_terms(F.col("skills")).alias("offered")).dropDuplicates(["candidate_id"])
    met = pairs.join(asked, "job_id").join(offered, "candidate_id")
    matched = F.filter("asked", lambda t: F.array_contains("offered", t))
    missing = F.filter("asked", lambda t: ~F.array_contains("offered", t))
    status = F.when(F.size("asked") == 0, "no_job_skills").when(F.size("offered") == 0, "no_candidate_skills").otherwise("available")
    return met.select(
        "job_id", "candidate_id", skill_score(), matched.alias("matched"), missing.alias("missing"), status.alias("status"))


def embedded(texts: Sequence[str], provider: Provider, dim: int, size: int) -> tuple[list[Sequence[float]], list[str]]:
    """(vectors, statuses) of ``texts``, asked of the provider ``size`` at a time; a batch that fails, or is answered amiss, gives zeros."""
    vectors: list[Sequence[float]] = []
    statuses: list[str] = []
    for i in range(0, len(texts), size):
        part = list(texts[i : i + size])
        try:
            got = [np.asarray(v, dtype=float) for v in provider(part)]
            if len(got) != len(part) or any(v.shape != (dim,) for v in got):
                raise ValueError("vectors in another number or size than asked for")
            statuses += ["available"] * len(part)
        except Exception:  # whatever a provider raises, the other batches go on
            got = [np.zeros(dim)] * len(part)
            statuses += ["embedding_failed"] * len(part)
        vectors += got
    return vectors, statuses


def embed_chunks(chunks: DataFrame, settings: Settings = Settings(), provider: Provider | None = None) -> DataFrame:
    """Chunks with tokens, vector and embedding_status; each distinct text is embedded once, in batches, by ``provider`` or by hashing.

    ``provider`` takes a list of texts and gives as many vectors of ``settings.embedding_dim`` numbers; it runs in the tasks. A batch
    that fails gives zero vectors and the status ``embedding_failed``. The vector is that of the whole chunk; only
    the lexical side (tokens, snippets) reads its first ``SEMANTIC_CHARS`` characters.
    """
    dim, size = settings.embedding_dim, settings.embedding_batch
    ask = provider or partial(hash_vectors, dim=dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors, statuses = embedded(b["chunk_text"].tolist(), ask, dim, size)
            yield b.assign(vector=vectors, embedding_status=statuses)

    texts = dealt(chunks.select("content_hash", "chunk_text"), "content_hash").dropDuplicates(["content_hash"])
    ready = texts.mapInPandas(run, "content_hash string, chunk_text string, vector array<double>, embedding_status string")
    ready = ready.select("content_hash", F.substring("chunk_text", 1, SEMANTIC_CHARS).alias("semantic_text"), "vector", "embedding_status")
    return chunks.join(ready.withColumn("tokens", tokens(F.col("semantic_text"))), "content_hash")


def _order(kind: Column) -> Column:
    """Order of chunks: projects before work, then by number."""
    number = F.regexp_extract(kind, r"_(\d+)$", 1)
    return F.when(kind.startswith("work_"), 100_000).otherwise(0) + F.when(number == "", 0).otherwise(number.cast("int"))


def delivery_pairs(pairs: DataFrame, job_side: DataFrame, candidate_side: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fused rows (group_id, j, d) of every pair's duties and experiences; group_id is job and candidate."""
    group = F.concat_ws("|", "job_id", "candidate_id").alias("group_id")
    duties = job_side.where("block in ('resp', 'jd_raw')").select(F.col("entity_id").alias("job_id"), _order(F.col("profile_type")).alias("j"), F.col("tokens").alias("jt"), F.col("vector").alias("jv"))
    done = candidate_side.where("block in ('project', 'work')").select(F.col("entity_id").alias("candidate_id"), _order(F.col("profile_type")).alias("d"), F.col("tokens").alias("dt"), F.col("vector").alias("dv"))
    # Tokens go to the lexical side and vectors to the other one, each of a duty and an experience once per pair.
    grouped = pairs.select("job_id", "candidate_id", group)
    queries = grouped.join(duties.select("job_id", "j", F.col("jt").alias("tokens")), "job_id").select("group_id", "j", "tokens")
    corpus = grouped.join(done.select("candidate_id", "d", F.col("dt").alias("tokens")), "candidate_id").select("group_id", "d", "tokens")
    met = grouped.join(duties.drop("jt"), "job_id").join(done.drop("dt"), "candidate_id")
    angles = met.select("group_id", "j", "d", F.round(cosine(F.col("jv"), F.col("dv")), 10).alias("cosine"))
    return fuse(angles.join(bm25(queries, corpus, settings), ["group_id", "j", "d"]), settings)


def packed_jobs(jobs: DataFrame, *others: Column, axes: bool = True, settings: Settings = Settings()) -> DataFrame:
    """Jobs as id, others and ``job``, the packed duties (and axes); an id has one row."""
    rows = jobs.select("id", *others, job_chunk_list(settings.chunk_chars).alias("chunks"))
    return packed_side(rows, DUTIES, JOB_AXES if axes else (), "job", settings)


def packed_candidates(candidates: DataFrame, *others: Column, axes: bool = True, settings: Settings = Settings()) -> DataFrame:
    """Candidates as id, others and ``candidate``, the packed experiences (and axes); an id has one row."""
    rows = candidates.select("id", *others, candidate_chunk_list().alias("chunks"))
    return packed_side(rows, DONE, CANDIDATE_AXES if axes else (), "candidate", settings)


def delivered_pairs(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The pairs of which a duty met an experience, with group_id and the columns of ``score_pairs`` and ``delivered``."""
    sides = packed_jobs(jobs, axes=False, settings=settings), packed_candidates(candidates, axes=False, settings=settings)
    out = delivered(score_pairs(joined(pairs, *sides), settings), settings).where(F.size("best") > 0)
    return out.withColumn("group_id", F.concat_ws("|", "job_id", "candidate_id"))


def _with_meaning(scored: DataFrame, settings: Settings) -> DataFrame:
    """Scored pairs (with ``indexed``) with the bands of their axes, semantic_score and semantic_status; a missing axis counts 0, a candidate without chunks is not indexed."""
    zero, band = F.lit(0.0), lambda name: F.when(F.col(f"{name}_similarity").isNotNull(), band_score(F.col(f"{name}_similarity")))
    out = delivered(scored, settings).withColumns({"skill_band": F.coalesce(band("skill"), zero), "role_band": F.coalesce(band("role"), zero)})
    out = out.withColumns({"delivery_score": F.coalesce("delivery_score", zero), "semantic_status": F.when(F.col("indexed"), "available").otherwise("not_indexed")})
    return out.withColumn("semantic_score", weighted_sum({"skill_band": settings.weight_skill, "delivery_score": settings.weight_delivery, "role_band": settings.weight_role}))


def semantic_scores(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Semantic score of each pair from its skill, delivery and role axes; pairs that name no job or candidate of the tables are kept."""
    met = joined(pairs, packed_jobs(jobs, settings=settings), packed_candidates(candidates, settings=settings), "left")
    return _with_meaning(score_pairs(met.withColumn("indexed", F.col("candidate").isNotNull()), settings), settings)


def alignment_rows(pairs: DataFrame, job_side: DataFrame, candidate_side: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best experience of each duty of every pair, with the kinds of both, the beginnings of their texts and up to twelve terms these share."""
    best = best_per_query(delivery_pairs(pairs, job_side, candidate_side, settings), score="rrf" if settings.hybrid else "cosine")
    parts = F.split("group_id", r"\|")
    number = _order(F.col("profile_type"))
    duties = job_side.where("block in ('resp', 'jd_raw')").select(F.col("entity_id").alias("job_id"), number.alias("j"), F.col("profile_type").alias("job_profile_type"), snippet(F.col("semantic_text")).alias("job_text_snippet"))
    done = candidate_side.where("block in ('project', 'work')").select(F.col("entity_id").alias("candidate_id"), number.alias("d"), F.col("profile_type").alias("cand_profile_type"), snippet(F.col("semantic_text")).alias("cand_text_snippet"))
    out = best.withColumn("job_id", parts[0]).withColumn("candidate_id", parts[1]).join(duties, ["job_id", "j"]).join(done, ["candidate_id", "d"])
    return out.withColumn("shared_terms", shared_terms(F.col("job_text_snippet"), F.col("cand_text_snippet")))


def best_alignment(alignments: DataFrame) -> DataFrame:
    """The best row of each pair: by fused score, then cosine, both as they are shown, then the earlier duty."""
    order = Window.partitionBy("group_id").orderBy(F.desc(F.round("rrf", 8)), F.desc(F.round("cosine", 6)), F.asc("j"))
    return alignments.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def evidence(pairs: DataFrame, job_side: DataFrame, candidate_side: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Texts that speak for a pair: job_id, candidate_id, source_type (skill, role, delivery), text, similarity; empty texts are none."""
    columns = ["job_id", "candidate_id", "source_type", "text", "similarity"]

    def axis(name: str, mine: str, theirs: str) -> DataFrame:
        a = job_side.where(F.col("profile_type") == mine).select(F.col("entity_id").alias("job_id"), F.col("vector").alias("a"))
        b = candidate_side.where(F.col("profile_type") == theirs).select(F.col("entity_id").alias("candidate_id"), F.col("vector").alias("b"), F.col("semantic_text").alias("text"))
        return pairs.join(a, "job_id").join(b, "candidate_id").select("job_id", "candidate_id", F.lit(name).alias("source_type"), "text", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))

    delivered = best_alignment(alignment_rows(pairs, job_side, candidate_side, settings))
    delivered = delivered.select("job_id", "candidate_id", F.lit("delivery").alias("source_type"), F.col("cand_text_snippet").alias("text"), F.round("cosine", 6).alias("similarity"))
    return axis("skill", "skill", "skill").unionByName(axis("role", "role", "cand_role")).unionByName(delivered).where("text <> ''").select(*columns)


def quality_score(impact: Column, evidence: Column, risk: Column) -> Column:
    """Quality from a model's three marks of 0 to 100; a missing mark counts 0."""
    def clip(c: Column) -> Column:
        return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c.cast("double"), F.lit(0.0)))))

    return rounded(0.4 * clip(impact) + 0.4 * clip(evidence) + 0.2 * (100.0 - clip(risk)))


def ranked(scores: DataFrame, by: str = "overall_score") -> DataFrame:
    """Rows with a competition rank within their job, best first, null last."""
    order = Window.partitionBy("job_id").orderBy(F.desc_nulls_last(by), F.asc("candidate_id"))
    return scores.withColumn("place", F.row_number().over(order))


def newest(pairs: DataFrame, candidates: DataFrame, limit: int | None) -> DataFrame:
    """``pairs`` of the ``limit`` candidates of each job that were changed last (then by id); all of them without a limit."""
    if limit is None:
        return pairs
    order = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.asc("candidate_id"))
    dated = pairs.join(candidates.select(F.col("id").alias("candidate_id"), "updated_at").dropDuplicates(["candidate_id"]), "candidate_id")
    return dated.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select("job_id", "candidate_id")


def score_sides(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Embedded chunks of the jobs and of the candidates that ``pairs`` name."""
    asked = jobs.join(pairs.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
    people = candidates.join(pairs.select(F.col("candidate_id").alias("id")).distinct(), "id", "left_semi")
    return cut(embed_chunks(job_chunks(asked, settings.chunk_chars), settings)), cut(embed_chunks(candidate_chunks(people), settings))


def score_pool(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, resumes: DataFrame, quality: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Every job's pool through the gate, the axes and their fusion, with its place within the job.

    Of rows of ``jobs`` or ``candidates`` that share an id one counts; ``quality`` (candidate_id, quality_score) comes from a model and counts 0
    where there is none. Pairs that name no job or candidate of the tables, and those the gate rejects, have no row. Gate, skills and
    meanings need the same two records, so the pairs meet these once.
    """
    pool = newest(pairs, candidates, settings.pool_limit)
    asked = packed_jobs(jobs, demanded_rank().alias("required_rank"), asked_skills(), settings=settings)
    degrees = resumes_read(resumes).groupBy(F.col("candidate_id").alias("id")).agg(F.max("best").alias("best_rank"))
    people = packed_candidates(candidates, offered_terms(F.col("skills")).alias("offered"), settings=settings).join(degrees, "id", "left")
    met = joined(pool, asked, people).where("required_rank is null or best_rank >= required_rank")
    met = met.join(quality, "candidate_id", "left") if quality is not None else met.withColumn("quality_score", F.lit(None).cast("double"))
    met = met.select("job_id", "candidate_id", "job", "candidate", skill_score(), "quality_score", F.lit(True).alias("indexed"))
    scored = _with_meaning(score_pairs(met, settings), settings).select("job_id", "candidate_id", "skill_score", "semantic_score", "semantic_status", "quality_score")
    overall = weighted_sum({"skill_score": settings.overall_skill, "semantic_score": settings.overall_semantic, "quality_score": settings.overall_quality})
    return ranked(scored.withColumn("quality_score", F.coalesce("quality_score", F.lit(0.0))).withColumn("overall_score", overall))
