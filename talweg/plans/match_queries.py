"""Queries of chunks, retrieval and pair scoring, and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import text as x
from talweg.functions.lexicons import SKILL_ALIASES, alias_pairs, offered_terms
from talweg.functions.vectors import band_score, cosine, experience_score, hash_bucket
from talweg.operators.chunks import candidate_chunks, embedding_plan, job_chunks
from talweg.operators.matching import alignment_rows, degree_gate, delivered_pairs, evidence, gate_counts, score_pool, score_sides, semantic_scores, skill_scores
from talweg.operators.retrieval import bm25
from talweg.session import spread, table

DIGITS = 8


def _once(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).dropDuplicates(["id"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (job, candidate) pairs asked for again."""
    return table(spark, sf_dir, "match_retries").select("job_id", "candidate_id").distinct()


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (job, candidate) pairs of every job's pool."""
    return table(spark, sf_dir, "candidate_job_matches").where("job_id is not null and candidate_id is not null").select("job_id", "candidate_id").distinct()


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", x.content_hash(F.col("text")).alias("content_hash"))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", x.language(F.col("text")).alias("detected"))


def year_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _once(spark, sf_dir, "resumes").select("id", F.posexplode("parsed.layer_1_extracted.work_experience").alias("i", "w"))
    return work.select("id", "i", x.year_month(F.col("w.start")).alias("start_at"), x.year_month(F.col("w.end")).alias("end_at"))


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", x.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a job against its title."""
    corpus = spread(table(spark, sf_dir, "documents").where("job_id is not null")).select(F.col("job_id").alias("group_id"), F.col("doc_id").alias("d"), x.tokens(F.col("text")).alias("tokens"))
    queries = _once(spark, sf_dir, "jobs").select(F.col("id").alias("group_id"), F.lit(0).alias("j"), x.tokens(F.col("title")).alias("tokens"))
    scored = bm25(queries, corpus)
    return scored.select("group_id", "d", F.round("bm25", DIGITS).alias("bm25"))


def cosine_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the first one of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    sim = F.round(cosine(F.col("embedding"), F.col("head")), DIGITS)
    scored = e.join(F.broadcast(first), "label").select("vec_id", sim.alias("similarity"))
    return scored.select("vec_id", "similarity", band_score(F.col("similarity")).alias("band"), experience_score(F.col("similarity")).alias("experience"))


def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts of the hash embedding of each skill."""
    skills = _once(spark, sf_dir, "candidates").select(F.explode("skills").alias("skill")).where("skill is not null").distinct()
    words = skills.select(F.explode(F.split("skill", r"[ \t\n\r]+")).alias("w")).where("w <> ''").distinct()
    return words.select("w", hash_bucket(F.col("w"), 128).alias("bucket"), hash_bucket(F.col("w"), 384).alias("bucket_384"))


def job_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_chunks(_once(spark, sf_dir, "jobs")).select("entity_id", "profile_type", "content_hash")


def candidate_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_chunks(_once(spark, sf_dir, "candidates")).select("entity_id", "profile_type", "content_hash")


def content_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding plan of all jobs, their stored chunks being those before the titles of matched jobs changed."""
    jobs = _once(spark, sf_dir, "jobs")
    changed = jobs.join(table(spark, sf_dir, "match_retries").select(F.col("job_id").alias("id")).distinct(), "id", "left_semi").withColumn("title", F.concat(F.col("title"), F.lit(" II")))
    kept = jobs.join(changed.select("id"), "id", "left_anti")
    stored = job_chunks(jobs).withColumn("embedding_model", F.lit("hash-128")).withColumn("status", F.lit("available"))
    plan = embedding_plan(job_chunks(kept.unionByName(changed)), stored, "hash-128")
    return plan.groupBy("profile_type", "action").agg(F.count("*").alias("n"))


# Each scoring query has two forms: over the pairs asked for again, and over every job's pool.


def _gates(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    gate = degree_gate(pairs, table(spark, sf_dir, "jobs"), table(spark, sf_dir, "resumes"))
    return gate.select("job_id", "candidate_id", "required_rank", "best_rank", "gate", "meets_requirement")


def degree_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir, _pairs(spark, sf_dir))


def pool_degree_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir, _pool(spark, sf_dir))


def pool_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_counts(pool_degree_gates(spark, sf_dir))


def _overlap(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    scored = skill_scores(pairs, table(spark, sf_dir, "jobs"), table(spark, sf_dir, "candidates"))
    return scored.select("job_id", "candidate_id", "skill_score", "status", F.array_join("matched", "|").alias("matched"))


def skill_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, _pairs(spark, sf_dir))


def pool_skill_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, _pool(spark, sf_dir))


def skill_lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "candidates").select("id", F.array_join(offered_terms(F.col("skills")), "|").alias("terms"))


def _sides(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return pairs, *score_sides(pairs, _once(spark, sf_dir, "jobs"), _once(spark, sf_dir, "candidates"))


def _delivered(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    return delivered_pairs(pairs, table(spark, sf_dir, "jobs"), table(spark, sf_dir, "candidates"))


def _alignments(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """The best experience for each duty of every pair."""
    best = _delivered(spark, sf_dir, pairs).select("group_id", F.inline("best"))
    return best.select("group_id", "j", "d", F.round("cosine", 6).alias("cosine"), F.round("bm25", 6).alias("bm25"), "rank_cos", "rank_bm25", "bm25_degenerate", F.round("rrf", 8).alias("rrf"))


def rrf_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir, _pairs(spark, sf_dir))


def pool_rrf_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignments(spark, sf_dir, _pool(spark, sf_dir))


def delivery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir, _pairs(spark, sf_dir)).select("group_id", "n_queries", "n_chunks", "delivery_score")


def pool_delivery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir, _pool(spark, sf_dir)).select("group_id", "n_queries", "n_chunks", "delivery_score")


def _semantic(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    scored = semantic_scores(pairs, table(spark, sf_dir, "jobs"), table(spark, sf_dir, "candidates"))
    return scored.select("job_id", "candidate_id", "skill_band", "role_band", "delivery_score", "semantic_score", "semantic_status")


def semantic_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir, _pairs(spark, sf_dir))


def pool_semantic_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir, _pool(spark, sf_dir))


def alignment_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best experience for each duty of the pairs asked for again, with what both say and share."""
    rows = alignment_rows(*_sides(spark, sf_dir, _pairs(spark, sf_dir)))
    return rows.select("group_id", "j", "job_profile_type", "cand_profile_type", "job_text_snippet", "cand_text_snippet", F.array_join("shared_terms", "|").alias("shared_terms"))


def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that speak for each of these pairs."""
    return evidence(*_sides(spark, sf_dir, _pairs(spark, sf_dir)))


def pool_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's pool through gate, scores and rank."""
    scored = score_pool(_pool(spark, sf_dir), table(spark, sf_dir, "jobs"), table(spark, sf_dir, "candidates"), table(spark, sf_dir, "resumes"))
    return scored.select("job_id", "candidate_id", "skill_score", "semantic_score", "semantic_status", "quality_score", "overall_score", "place")


QUERIES = {
    "content_hashes": content_hashes, "language_detect": language_detect, "year_months": year_months, "tokenize_docs": tokenize_docs, "bm25_scores": bm25_scores, "cosine_bands": cosine_bands,
    "hash_buckets": hash_buckets, "job_chunk_rows": job_chunk_rows, "candidate_chunk_rows": candidate_chunk_rows, "content_hash_diff": content_hash_diff, "degree_gates": degree_gates,
    "skill_overlap": skill_overlap, "skill_lexicon_match": skill_lexicon_match, "rrf_alignments": rrf_alignments, "delivery_scores": delivery_scores, "semantic_scoring": semantic_scoring,
    "alignment_evidence": alignment_evidence, "evidence_snippets": evidence_snippets,
    "pool_degree_gates": pool_degree_gates, "pool_skill_overlap": pool_skill_overlap, "pool_rrf_alignments": pool_rrf_alignments, "pool_delivery_scores": pool_delivery_scores,
    "pool_semantic_scoring": pool_semantic_scoring, "pool_matches": pool_matches, "pool_gate_counts": pool_gate_counts,
}

# --- the same in SQL ---------------------------------------------------------------------------------------------------

_EDGES = r"'^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$'"
_HAN = r"\x{4e00}-\x{9fff}"


def _once_sql(name: str) -> str:
    return f"(SELECT DISTINCT ON (id) * FROM {name})"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_EDGES}, '', 'g')"


def _set(c: str) -> str:
    return f"nullif({_strip(f'coalesce({c}, {chr(39)*2})')}, '')"


def _first(items: str) -> str:
    return f"(SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest({items}) AS v, generate_subscripts({items}, 1) AS i) GROUP BY v))"


def _clean(c: str) -> str:
    items = f"list_filter(list_transform(list_filter(coalesce({c}, []), lambda v: v IS NOT NULL), lambda v: {_strip('v')}), lambda v: v <> '')"
    return f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"


def _join(label: str, items: str, sep: str = ", ") -> str:
    return f"CASE WHEN len({items}) > 0 THEN '{label}' || array_to_string({items}, '{sep}') END"


def _lines(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


_POS = f"coalesce({_set('w.title')}, {_strip('w.position')})"
_JOB_CHUNKS = f"""
jobs_clean AS (SELECT id, title, raw_jd_text, structured AS s, {_clean('structured.required_skills')} AS req, {_clean('structured.preferred_skills')} AS pref,
    {_clean('structured.responsibilities')} AS duties, {_clean('structured.keywords')} AS keys FROM {_once_sql('jobs')}),
jobs_text AS (SELECT id, duties, raw_jd_text, {_lines(_join('必备技能: ', 'req'), _join('加分技能: ', 'pref'))} AS skill,
    {_lines(_set('title'), f"'岗位: ' || {_set('s.job_title')}", f"'摘要: ' || {_set('s.job_summary')}", _join('关键词: ', 'keys'))} AS role FROM jobs_clean),
jobs_pack AS (SELECT id, list_reduce(list_transform(duties, lambda v: struct_pack(done := CAST([] AS VARCHAR[]), open := v)),
    lambda a, b: CASE WHEN length(a.open) + 3 + length(b.open) <= 4000 THEN struct_pack(done := a.done, open := a.open || ' | ' || b.open)
    ELSE struct_pack(done := list_append(a.done, a.open), open := b.open) END) AS p FROM jobs_text WHERE len(duties) > 0),
jobs_resp AS (SELECT id, list_append(p.done, p.open) AS parts FROM jobs_pack),
job_chunk AS (SELECT id AS entity_id, 'skill' AS profile_type, 'skill' AS block, skill AS chunk_text FROM jobs_text UNION ALL SELECT id, 'role', 'role', role FROM jobs_text
    UNION ALL SELECT id, 'jd_raw', 'jd_raw', {_strip('raw_jd_text')} FROM jobs_text WHERE len(duties) = 0 AND role = ''
    UNION ALL SELECT r.id, CASE WHEN length(array_to_string(t.duties, ' | ')) <= 4000 THEN 'resp' ELSE 'resp_' || (i - 1) END, 'resp', parts[i]
    FROM jobs_resp r JOIN jobs_text t ON t.id = r.id, unnest(generate_series(1, len(parts))) AS u(i)),
job_chunks AS (SELECT * FROM job_chunk WHERE chunk_text IS NOT NULL AND {_strip('chunk_text')} <> '')"""
_CAND_CHUNKS = f"""
people AS (SELECT id, {_clean('skills')} AS skills, {_clean('direction_tags')} AS tags, coalesce(projects, []) AS projects, coalesce(work_experience, []) AS work FROM {_once_sql('candidates')}),
people_text AS (SELECT *, list_transform(projects, lambda p: {_lines(f"'项目: ' || {_set('p.name')}", f"'角色: ' || {_set('p.role')}", _set('p.description'))}) AS pt,
    list_transform(work, lambda w: {_lines(f"'公司: ' || {_set('w.company')}", f"'职位: ' || nullif({_POS}, '')", _set('w.description'))}) AS wt,
    list_filter(list_transform(projects, lambda p: {_set('p.name')}), lambda v: v IS NOT NULL) AS pn,
    list_filter(list_transform(work, lambda w: concat_ws('·', {_set('w.company')}, nullif({_POS}, ''))), lambda v: v <> '') AS wn FROM people),
cand_chunk AS (SELECT id AS entity_id, 'skill' AS profile_type, 'skill' AS block, {_join('技能: ', 'skills')} AS chunk_text FROM people_text
    UNION ALL SELECT id, 'proj_' || (i - 1), 'project', pt[i] FROM people_text, unnest(generate_series(1, len(pt))) AS u(i)
    UNION ALL SELECT id, 'work_' || (i - 1), 'work', wt[i] FROM people_text, unnest(generate_series(1, len(wt))) AS u(i)
    UNION ALL SELECT id, 'cand_role', 'cand_role', {_lines(_join('方向标签: ', 'tags'), "'经历摘要: 项目 ' || len(list_filter(pt, lambda v: v <> '')) || ' 个, 工作/实习 ' || len(list_filter(wt, lambda v: v <> '')) || ' 个'", _join('项目名: ', 'pn[1:20]', '; '), _join('公司与职位: ', 'wn[1:20]', '; '))} FROM people_text),
cand_chunks AS (SELECT * FROM cand_chunk WHERE chunk_text IS NOT NULL AND {_strip('chunk_text')} <> '')"""


def _tokens(c: str) -> str:
    found = f"regexp_extract_all(coalesce({c}, ''), '[a-zA-Z][a-zA-Z0-9.+#_-]*|[0-9][a-zA-Z0-9.+#_-]*|[{_HAN}]+')"
    return f"flatten(list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '^[{_HAN}]') AND length(t) > 2 THEN list_transform(generate_series(1, length(t) - 1), lambda i: substring(t, i, 2)) ELSE [lower(t)] END))"


def _snippet(c: str) -> str:
    return f"CASE WHEN length({c}) > 320 THEN substring({c}, 1, 320) || '…' ELSE {c} END"


def _bucket(c: str, dim: int) -> str:
    out = "0"
    for i in range(4):
        out = f"(({out} * {2**32 % dim} + CAST(('0x' || substring(md5({c}), {8 * i + 1}, 8)) AS BIGINT)) % {dim})"
    return f"CAST({out} AS INTEGER)"


def _bm25(queries: str, corpus: str) -> str:
    """CTEs giving ``lexical`` (group_id, j, d, bm25) of queries and corpus (group_id, j or d, tokens)."""
    return f"""
c_len AS (SELECT group_id, d, len(tokens) AS dl, count(*) OVER (PARTITION BY group_id) AS n, avg(len(tokens)) OVER (PARTITION BY group_id) AS avgdl FROM {corpus}),
c_tf AS (SELECT group_id, d, t, count(*) AS tf FROM (SELECT group_id, d, unnest(tokens) AS t FROM {corpus}) GROUP BY ALL),
c_df AS (SELECT group_id, t, count(*) AS df FROM c_tf GROUP BY ALL),
c_q AS (SELECT group_id, j, t, count(*) AS qtf FROM (SELECT group_id, j, unnest(tokens) AS t FROM {queries}) GROUP BY ALL),
c_s AS (SELECT q.group_id, q.j, f.d, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))) AS s
    FROM c_q q JOIN c_tf f USING (group_id, t) JOIN c_df USING (group_id, t) JOIN c_len l ON l.group_id = q.group_id AND l.d = f.d GROUP BY ALL),
lexical AS (SELECT q.group_id, q.j, c.d, coalesce(round(s, 10), 0) AS bm25 FROM {queries} q JOIN {corpus} c USING (group_id) LEFT JOIN c_s x ON x.group_id = q.group_id AND x.j = q.j AND x.d = c.d)"""


_WEIGHTS = f"""
texts AS (SELECT DISTINCT sha256(chunk_text) AS h, chunk_text AS st FROM (SELECT chunk_text FROM job_chunks UNION ALL SELECT chunk_text FROM cand_chunks)),
vec AS (SELECT h, b, count(*) AS c FROM (SELECT h, {_bucket('w', 128)} AS b FROM (SELECT h, unnest(regexp_split_to_array(st, '[\\s\\x{{3000}}\\x{{00a0}}\\x{{2003}}\\x{{2009}}\\x{{202f}}]+')) AS w FROM texts) WHERE w <> '') GROUP BY ALL),
len AS (SELECT h, sqrt(sum(c * c)) AS n FROM vec GROUP BY h),
asked AS (SELECT DISTINCT job_id, candidate_id FROM match_retries),
jc AS (SELECT entity_id AS job_id, profile_type, block, sha256(chunk_text) AS h, substring(chunk_text, 1, 2000) AS st, CASE WHEN regexp_matches(profile_type, '_\\d+$') THEN CAST(regexp_extract(profile_type, '_(\\d+)$', 1) AS INTEGER) ELSE 0 END AS k FROM job_chunks),
cc AS (SELECT entity_id AS candidate_id, profile_type, block, sha256(chunk_text) AS h, substring(chunk_text, 1, 2000) AS st, CASE WHEN block = 'work' THEN 100000 ELSE 0 END + CASE WHEN regexp_matches(profile_type, '_\\d+$') THEN CAST(regexp_extract(profile_type, '_(\\d+)$', 1) AS INTEGER) ELSE 0 END AS k FROM cand_chunks),
met AS (SELECT a.job_id || '|' || a.candidate_id AS group_id, a.job_id, a.candidate_id, jc.profile_type AS jp, cc.profile_type AS cp, jc.block AS jb, cc.block AS cb, jc.k AS j, cc.k AS d, jc.h AS jh, cc.h AS ch, jc.st AS jt, cc.st AS ct
    FROM asked a JOIN jc USING (job_id) JOIN cc USING (candidate_id)),
angle AS (SELECT jh, ch, round(coalesce(sum(x.c * y.c), 0) / (any_value(p.n) * any_value(q.n)), 10) AS cosine FROM (SELECT DISTINCT jh, ch FROM met) m JOIN len p ON p.h = jh JOIN len q ON q.h = ch
    LEFT JOIN vec x ON x.h = jh LEFT JOIN vec y ON y.h = ch AND y.b = x.b GROUP BY jh, ch),
grid AS (SELECT m.*, cosine FROM met m JOIN angle USING (jh, ch) WHERE jb IN ('resp', 'jd_raw') AND cb IN ('project', 'work')),
g_q AS (SELECT group_id, j, {_tokens('any_value(jt)')} AS tokens FROM grid GROUP BY group_id, j),
g_c AS (SELECT group_id, d, {_tokens('any_value(ct)')} AS tokens FROM grid GROUP BY group_id, d),
{_bm25('g_q', 'g_c')},
ranks AS (SELECT group_id, j, d, cosine, bm25, rank() OVER (PARTITION BY group_id, j ORDER BY cosine DESC) AS rank_cos, rank() OVER (PARTITION BY group_id, j ORDER BY bm25 DESC) AS rank_bm25,
    max(bm25) OVER (PARTITION BY group_id, j) - min(bm25) OVER (PARTITION BY group_id, j) <= 1e-9 AS bm25_degenerate FROM grid JOIN lexical USING (group_id, j, d)),
fused AS (SELECT *, 1.0 / (60 + rank_cos) + CASE WHEN bm25_degenerate THEN 0 ELSE 1.0 / (60 + rank_bm25) END AS rrf FROM ranks),
per_j AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY group_id, j ORDER BY rrf DESC, cosine DESC, d) = 1),
per_d AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY group_id, d ORDER BY rrf DESC, cosine DESC, j) = 1),
top_d AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n_chunks FROM per_d QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rrf DESC, cosine DESC, d) <= 3)"""


def _experience(s: str) -> str:
    linear = f"CAST(printf('%.1f', 38 + greatest(0.0, least(1.0, ({s} - CAST(0.38 AS DOUBLE)) / (CAST(0.66 AS DOUBLE) - CAST(0.38 AS DOUBLE)))) * 34) AS DOUBLE)"
    return f"CAST(CASE WHEN {s} <= 0 THEN 0 WHEN {s} >= 0.84 THEN 95 WHEN {s} >= 0.78 THEN 88 WHEN {s} >= 0.72 THEN 80 WHEN {s} >= 0.66 THEN 72 ELSE {linear} END AS DOUBLE)"


def _band(s: str) -> str:
    return f"CAST(CASE WHEN {s} <= 0 THEN 0 WHEN {s} >= 0.84 THEN 95 WHEN {s} >= 0.78 THEN 85 WHEN {s} >= 0.72 THEN 75 WHEN {s} >= 0.66 THEN 65 ELSE 55 END AS DOUBLE)"


_DELIVERED = f"""{_WEIGHTS},
dq AS (SELECT group_id, count(*) AS n_queries, avg({_experience('cosine')}) AS mq FROM per_j GROUP BY 1), dc AS (SELECT group_id, max(n_chunks) AS n_chunks, avg({_experience('cosine')}) AS mc FROM top_d GROUP BY 1),
delivered AS (SELECT group_id, n_queries, n_chunks, CAST(printf('%.1f', CAST(0.62 AS DOUBLE) * mq + CAST(0.38 AS DOUBLE) * mc) AS DOUBLE) AS delivery_score FROM dq JOIN dc USING (group_id))"""
_DEG = "CASE WHEN {0} LIKE '%博士%' THEN 3 WHEN {0} LIKE '%硕士%' THEN 2 WHEN {0} LIKE '%本科%' THEN 1 WHEN {0} LIKE '%大专%' THEN 0 END"
_YM = r"""CASE WHEN regexp_matches(lower(coalesce({0}, '')), '至今|现在|present|current|ongoing|在读') THEN 'present'
    WHEN regexp_matches({0}, '(?:19|20)\d{{2}}\s*[./\-年]\s*(?:1[0-2]|0?[1-9])') THEN regexp_extract({0}, '((?:19|20)\d{{2}})\s*[./\-年]\s*(1[0-2]|0?[1-9])', 1) || '-' || lpad(regexp_extract({0}, '((?:19|20)\d{{2}})\s*[./\-年]\s*(1[0-2]|0?[1-9])', 2), 2, '0')
    ELSE regexp_extract(coalesce({0}, ''), '(?:19|20)\d{{2}}') END"""
_PAIRS = alias_pairs(SKILL_ALIASES)
_EXACT = "CASE " + " ".join(f"WHEN low = '{a}' THEN '{c}'" for a, c in _PAIRS) + " " + " ".join(f"WHEN low LIKE '%{a}%' THEN '{c}'" for a, c in _PAIRS if len(a) >= 2) + " END"
# DuckDB has no NFKC: it is the composition of the characters' own compatibility forms, which come from Python's tables by rule.
_FORMS = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x30000) if not 0xAC00 <= c <= 0xDFFF)
_NFKC = ", ".join(f"({ord(c)}, '{form.replace(chr(39), chr(39) * 2)}')" for c, form in _FORMS if form != c)
_SPACES = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _bare(c: str) -> str:
    return _strip(f"regexp_replace({c}, '^{_SPACES}|{_SPACES}$', '', 'g')")


_TERMS = f"""
forms(c, form) AS (VALUES {_NFKC}),
raw_terms AS (SELECT 'o' AS side, id, i, {_bare('v')} AS v FROM (SELECT id, unnest(skills) AS v, generate_subscripts(skills, 1) AS i FROM {_once_sql('candidates')})
    UNION ALL SELECT 'r', id, i, {_bare('v')} FROM (SELECT id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM (SELECT id, list_concat(coalesce(structured.required_skills, []), coalesce(structured.preferred_skills, [])) AS a FROM {_once_sql('jobs')}))),
odd_terms AS (SELECT v, nfc_normalize(string_agg(coalesce(form, chr(u)), '' ORDER BY p)) AS nv FROM
    (SELECT v, unicode(substring(v, p, 1)) AS u, p FROM (SELECT DISTINCT v FROM raw_terms WHERE regexp_matches(v, '[^\\x00-\\x7f{_HAN}]')), unnest(generate_series(1, length(v))) AS t(p)) LEFT JOIN forms ON c = u GROUP BY v),
nfkc_terms AS (SELECT side, id, i, v, coalesce(nv, v) AS nv FROM raw_terms LEFT JOIN odd_terms USING (v) WHERE v <> ''),
cut_terms AS (SELECT side, id, i, CASE WHEN side = 'r' THEN lower(v) WHEN regexp_matches(nv, '[{_HAN}]') THEN substring(nv, 1, 24) ELSE lower(nv) END AS own, CASE WHEN side = 'r' THEN nv WHEN regexp_matches(nv, '[{_HAN}]') THEN substring(nv, 1, 24) ELSE nv END AS sought FROM nfkc_terms),
named AS (SELECT side, id, min(i) AS i, coalesce(canon, own) AS term FROM (SELECT *, {_EXACT} AS canon FROM (SELECT *, lower({_strip('sought')}) AS low FROM cut_terms)) GROUP BY side, id, coalesce(canon, own))"""

ORACLES = {
    "content_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "language_detect": f"""SELECT doc_id, CASE WHEN text IS NULL OR {_strip('text')} = '' THEN 'zh' WHEN length(regexp_replace(text, '[^{_HAN}]', '', 'g')) > greatest(8.0, length(text) * 0.04) THEN 'zh' ELSE 'en' END AS detected FROM documents""",
    "year_months": f"SELECT id, CAST(i - 1 AS INTEGER) AS i, {_YM.format('w.start')} AS start_at, {_YM.format('w.end')} AS end_at FROM (SELECT id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT id, parsed.layer_1_extracted.work_experience AS a FROM {_once_sql('resumes')}))",
    "tokenize_docs": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "bm25_scores": f"""WITH qq AS (SELECT id AS group_id, 0 AS j, {_tokens('title')} AS tokens FROM {_once_sql('jobs')}), dd AS (SELECT job_id AS group_id, doc_id AS d, {_tokens('text')} AS tokens FROM documents WHERE job_id IS NOT NULL),
        {_bm25('qq', 'dd')} SELECT group_id, d, round(bm25, {DIGITS}) AS bm25 FROM lexical""",
    "cosine_bands": f"""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS head FROM embeddings GROUP BY 1),
        s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, head), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) * sqrt(list_sum(list_transform(head, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))), {DIGITS}) AS similarity
        FROM embeddings JOIN f USING (label)) SELECT vec_id, similarity, {_band('similarity')} AS band, {_experience('similarity')} AS experience FROM s""",
    "hash_buckets": f"SELECT w, {_bucket('w', 128)} AS bucket, {_bucket('w', 384)} AS bucket_384 FROM (SELECT DISTINCT unnest(regexp_split_to_array(s, '[ \\t\\n\\r]+')) AS w FROM (SELECT unnest(skills) AS s FROM candidates)) WHERE w <> ''",
    "job_chunk_rows": f"WITH {_JOB_CHUNKS} SELECT entity_id, profile_type, sha256(chunk_text) AS content_hash FROM job_chunks",
    "candidate_chunk_rows": f"WITH {_CAND_CHUNKS} SELECT entity_id, profile_type, sha256(chunk_text) AS content_hash FROM cand_chunks",
    "content_hash_diff": f"""WITH {_JOB_CHUNKS}, hit AS (SELECT DISTINCT job_id FROM match_retries),
        plan AS (SELECT profile_type, CASE WHEN profile_type = 'role' AND title IS NOT NULL AND entity_id IN (SELECT job_id FROM hit) THEN 'embed' ELSE 'keep' END AS action FROM job_chunks c JOIN (SELECT DISTINCT ON (id) id, title FROM jobs) j ON j.id = c.entity_id)
        SELECT profile_type, action, count(*) AS n FROM plan GROUP BY ALL""",
    "degree_gates": f"""WITH a AS (SELECT DISTINCT job_id, candidate_id FROM match_retries), w AS (SELECT DISTINCT id AS job_id, coalesce({_set('education_requirement')}, {_set('structured.education_requirement')}) AS required FROM {_once_sql('jobs')}),
        e AS (SELECT candidate_id, unnest(parsed.layer_1_extracted.education) AS e FROM {_once_sql('resumes')} WHERE parsed IS NOT NULL AND status IN ('parsed', 'candidate_bound')),
        b AS (SELECT candidate_id, max({_DEG.format('e.degree')}) AS best_rank FROM e GROUP BY 1),
        g AS (SELECT a.job_id, a.candidate_id, required, {_DEG.format('required')} AS required_rank, best_rank FROM a LEFT JOIN w USING (job_id) LEFT JOIN b USING (candidate_id))
        SELECT job_id, candidate_id, required_rank, best_rank, CASE WHEN required IS NULL THEN 'no_requirement' WHEN required_rank IS NULL THEN 'unrecognised' ELSE 'compared' END AS gate, required_rank IS NULL OR coalesce(best_rank >= required_rank, false) AS meets_requirement FROM g""",
    "skill_lexicon_match": f"WITH {_TERMS} SELECT c.id, coalesce(t, '') AS terms FROM {_once_sql('candidates')} c LEFT JOIN (SELECT id, string_agg(term, '|' ORDER BY i) AS t FROM named WHERE side = 'o' GROUP BY id) n ON n.id = c.id",
    "skill_overlap": f"""WITH {_TERMS}, a AS (SELECT DISTINCT r.job_id, r.candidate_id FROM match_retries r JOIN jobs j ON j.id = r.job_id JOIN candidates c ON c.id = r.candidate_id),
        s AS (SELECT a.job_id, a.candidate_id, (SELECT count(*) FROM named n WHERE n.side = 'r' AND n.id = a.job_id) AS nr, (SELECT count(*) FROM named n WHERE n.side = 'o' AND n.id = a.candidate_id) AS no,
            (SELECT string_agg(n.term, '|' ORDER BY n.i) FROM named n JOIN named o ON o.term = n.term AND o.side = 'o' AND o.id = a.candidate_id WHERE n.side = 'r' AND n.id = a.job_id) AS matched,
            (SELECT count(*) FROM named n JOIN named o ON o.term = n.term AND o.side = 'o' AND o.id = a.candidate_id WHERE n.side = 'r' AND n.id = a.job_id) AS nm FROM a)
        SELECT job_id, candidate_id, CASE WHEN nr > 0 AND no > 0 THEN CAST(printf('%.1f', 100.0 * nm / nr) AS DOUBLE) ELSE 0.0 END AS skill_score, CASE WHEN nr = 0 THEN 'no_job_skills' WHEN no = 0 THEN 'no_candidate_skills' ELSE 'available' END AS status, coalesce(matched, '') AS matched FROM s""",
    "rrf_alignments": f"WITH {_JOB_CHUNKS}, {_CAND_CHUNKS}, {_WEIGHTS} SELECT group_id, j, d, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25, CAST(rank_cos AS INTEGER) AS rank_cos, CAST(rank_bm25 AS INTEGER) AS rank_bm25, bm25_degenerate, round(rrf, 8) AS rrf FROM per_j",
    "alignment_evidence": f"""WITH {_JOB_CHUNKS}, {_CAND_CHUNKS}, {_WEIGHTS},
        shown AS (SELECT p.group_id, p.j, jp AS job_profile_type, cp AS cand_profile_type, {_snippet('jt')} AS job_text_snippet, {_snippet('ct')} AS cand_text_snippet FROM per_j p JOIN grid USING (group_id, j, d))
        SELECT *, array_to_string(list_sort(list_distinct(list_intersect({_tokens('job_text_snippet')}, {_tokens('cand_text_snippet')})))[1:12], '|') AS shared_terms FROM shown""",
    "evidence_snippets": f"""WITH {_JOB_CHUNKS}, {_CAND_CHUNKS}, {_WEIGHTS},
        top_j AS (SELECT * FROM per_j QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(rrf, 8) DESC, round(cosine, 6) DESC, j) = 1),
        told AS (SELECT job_id, candidate_id, CASE WHEN jp = 'skill' THEN 'skill' ELSE 'role' END AS source_type, ct AS text, round(cosine, 6) AS similarity FROM met JOIN angle USING (jh, ch)
            WHERE (jp = 'skill' AND cp = 'skill') OR (jp = 'role' AND cp = 'cand_role')
            UNION ALL SELECT job_id, candidate_id, 'delivery', {_snippet('ct')}, round(t.cosine, 6) FROM top_j t JOIN grid USING (group_id, j, d))
        SELECT * FROM told WHERE text <> ''""",
    "delivery_scores": f"WITH {_JOB_CHUNKS}, {_CAND_CHUNKS}, {_DELIVERED} SELECT * FROM delivered",
    "semantic_scoring": f"""WITH {_JOB_CHUNKS}, {_CAND_CHUNKS}, {_DELIVERED},
        sk AS (SELECT job_id, candidate_id, {_band('cosine')} AS skill_band FROM met JOIN angle USING (jh, ch) WHERE jp = 'skill' AND cp = 'skill'), ro AS (SELECT job_id, candidate_id, {_band('cosine')} AS role_band FROM met JOIN angle USING (jh, ch) WHERE jp = 'role' AND cp = 'cand_role')
        SELECT a.job_id, a.candidate_id, coalesce(skill_band, 0) AS skill_band, coalesce(role_band, 0) AS role_band, coalesce(delivery_score, 0) AS delivery_score,
        CAST(printf('%.1f', CAST(0.2 AS DOUBLE) * coalesce(skill_band, 0) + CAST(0.8 AS DOUBLE) * coalesce(delivery_score, 0)) AS DOUBLE) AS semantic_score, CASE WHEN a.candidate_id IN (SELECT candidate_id FROM cc) THEN 'available' ELSE 'not_indexed' END AS semantic_status
        FROM asked a LEFT JOIN sk USING (job_id, candidate_id) LEFT JOIN ro USING (job_id, candidate_id) LEFT JOIN delivered v ON v.group_id = a.job_id || '|' || a.candidate_id""",
}


def _over_pool(sql: str) -> str:
    """The same over every job's pool."""
    pool = "(SELECT job_id, candidate_id FROM candidate_job_matches WHERE job_id IS NOT NULL AND candidate_id IS NOT NULL)"
    return sql.replace("FROM match_retries", f"FROM {pool}")


ORACLES |= {f"pool_{name}": _over_pool(ORACLES[name]) for name in ("degree_gates", "rrf_alignments", "delivery_scores", "semantic_scoring")}
ORACLES["pool_skill_overlap"] = ORACLES["skill_overlap"].replace("FROM match_retries r", "FROM (SELECT job_id, candidate_id FROM candidate_job_matches) r")
ORACLES["pool_gate_counts"] = f"SELECT job_id, count(*) AS total_input, count(*) FILTER (WHERE meets_requirement) AS passed_count FROM ({ORACLES['pool_degree_gates']}) GROUP BY job_id"
