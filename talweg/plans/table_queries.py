"""Queries that read, filter, enrich and change tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.text import file_kind, normal_email
from talweg.operators import tables as t
from talweg.session import table


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").dropDuplicates(["id"])


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "resumes").dropDuplicates(["id"])


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidate_job_matches").dropDuplicates(["id"])


def scan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "match_retries").select(F.col("candidate_id").alias("id"))
    return t.by_ids(_candidates(spark, sf_dir), ids).select("id", "name", "email")


def scan_pair_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "match_retries").select("job_id", "candidate_id").distinct()
    return _matches(spark, sf_dir).join(asked, ["job_id", "candidate_id"]).select("id", "job_id", "candidate_id", "created_at", "overall_score")


def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "match_retries").select("request_id", F.col("candidate_id").alias("id"))
    return asked.join(_candidates(spark, sf_dir).select("id", "name"), "id").select("request_id", "id", "name")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumes(spark, sf_dir).groupBy(file_kind(F.col("file_name")).alias("kind")).agg(F.count("*").alias("n"))


def candidate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _resumes(spark, sf_dir).groupBy("candidate_id").agg(F.count("*").alias("n_resumes"), F.max("updated_at").alias("newest"))
    joined = _candidates(spark, sf_dir).join(counts, F.col("id") == F.col("candidate_id"), "left")
    return joined.select("id", F.coalesce("n_resumes", F.lit(0)).alias("n_resumes"), "newest")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where(t.contains_any("an", "name", "email", "summary")).select("id", "name")


def json_text_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where(t.json_contains("skills", "kafka")).select("id")


def candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = t.all_of(F.col("years_of_experience") >= 3, t.json_contains("skills", "python"), None)
    return t.page(_candidates(spark, sf_dir).where(tests), [F.desc_nulls_first("years_of_experience"), F.asc("id")], 50, 10).select("id", "years_of_experience")


def matches_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.col("created_at").between(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2025-06-30").cast("timestamp_ntz"))
    return _matches(spark, sf_dir).where(span).groupBy("status").agg(F.count("*").alias("n"))


def jobs_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").dropDuplicates(["id"])
    owner = jobs.agg(F.min("created_by_id").alias("owner"))
    return jobs.join(F.broadcast(owner), F.col("created_by_id") == F.col("owner")).select("id", "title", "created_at")


def email_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _candidates(spark, sf_dir).withColumn("address", normal_email(F.col("email"))).where("address is not null")
    return t.newest(keyed.select("address", "id", "updated_at"), "address", "updated_at", "id")


def newest_resume_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _resumes(spark, sf_dir).where("status = 'candidate_bound' and file_name is not null").select("file_name", "id", "updated_at")
    return t.newest(bound, "file_name", "updated_at", "id")


def match_list_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _candidates(spark, sf_dir).select(F.col("id").alias("candidate_id"), "name", "email")
    rows = _matches(spark, sf_dir).join(people, "candidate_id", "left")
    return t.page(rows, [F.desc_nulls_last("overall_score"), F.desc("created_at"), F.asc("id")], 200).select("id", "name", "email", "overall_score")


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    patch = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("URGENT"))).alias("c_mktsegment"), F.max(F.lit("never")).alias("c_name"))
    return t.update(base, patch, "c_custkey", allowed=["c_mktsegment"])


def update_with_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patch = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(
        "c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("has_c_mktsegment"), F.lit(0.0).alias("c_acctbal"), (F.col("c_acctbal") < 0).alias("has_c_acctbal"))
    return t.update_present(base, patch, "c_custkey")


def merge_fill_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _candidates(spark, sf_dir).select("id", "email", "phone", "summary")
    patch = _resumes(spark, sf_dir).where("parsed is not null").groupBy(F.col("candidate_id").alias("id")).agg(
        F.max("parsed.layer_1_extracted.basic.email").alias("email"), F.max("parsed.layer_1_extracted.basic.phone").alias("phone"), F.max("parsed.layer_1_extracted.basic.target_role").alias("summary"))
    return t.fill_empty(base, patch, "id", replace=["summary"])


def delete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "match_retries").select("job_id", "candidate_id")
    return t.delete(_matches(spark, sf_dir).select("id", "job_id", "candidate_id"), keys)


def replace_for_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    retries = table(spark, sf_dir, "match_retries")
    kept = t.delete(_matches(spark, sf_dir).select("id", "job_id", "candidate_id"), retries.select("job_id", "candidate_id"))
    new = t.newest(retries.withColumn("pair", F.concat_ws("|", "job_id", "candidate_id")), "pair", "requested_at", "request_id")
    return kept.unionByName(new.select(F.col("request_id").alias("id"), "job_id", "candidate_id"))


def insert_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("id", "email")
    return t.insert(rows.where(F.col("id") < "8"), rows.where(F.col("id") >= "8"))


QUERIES = {
    "scan_ids": scan_ids, "scan_pair_newest": scan_pair_newest, "ids_in_order": ids_in_order, "file_kinds": file_kinds, "candidate_relations": candidate_relations,
    "keyword_search": keyword_search, "json_text_contains": json_text_contains, "candidates_filtered": candidates_filtered, "matches_between": matches_between,
    "jobs_of_owner": jobs_of_owner, "email_lookup": email_lookup, "newest_resume_by_file": newest_resume_by_file, "match_list_enriched": match_list_enriched,
    "partial_update": partial_update, "update_with_presence": update_with_presence, "merge_fill_if_empty": merge_fill_if_empty, "delete_pairs": delete_pairs,
    "replace_for_retries": replace_for_retries, "insert_normalised": insert_normalised,
}

_C = "(SELECT DISTINCT ON (id) * FROM candidates)"
_R = "(SELECT DISTINCT ON (id) * FROM resumes)"
_M = "(SELECT DISTINCT ON (id) * FROM candidate_job_matches)"
_BLANK = r"'^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$', '', 'g'"


def _email(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, {_BLANK})), '')"


def _filled(c: str) -> str:
    return f"(regexp_replace(coalesce({c}, ''), {_BLANK}) <> '')"


ORACLES = {
    "scan_ids": f"SELECT id, name, email FROM {_C} WHERE id IN (SELECT candidate_id FROM match_retries)",
    "scan_pair_newest": f"SELECT m.id, m.job_id, m.candidate_id, m.created_at, m.overall_score FROM {_M} m WHERE EXISTS (SELECT 1 FROM match_retries r WHERE r.job_id = m.job_id AND r.candidate_id = m.candidate_id)",
    "ids_in_order": f"SELECT r.request_id, c.id, c.name FROM match_retries r JOIN {_C} c ON c.id = r.candidate_id",
    "file_kinds": f"""SELECT CASE WHEN s IN ('txt','md') THEN 'text' WHEN s IN ('doc','docx') THEN 'office' WHEN s IN ('png','jpg','jpeg','webp','bmp','tif','tiff') THEN 'image' ELSE 'pdf' END AS kind, count(*) AS n
        FROM (SELECT lower(regexp_extract(coalesce(file_name, ''), '\\.([A-Za-z0-9]+)$', 1)) AS s FROM {_R}) GROUP BY 1""",
    "candidate_relations": f"SELECT c.id, coalesce(n, 0) AS n_resumes, newest FROM {_C} c LEFT JOIN (SELECT candidate_id, count(*) AS n, max(updated_at) AS newest FROM {_R} GROUP BY 1) r ON r.candidate_id = c.id",
    "keyword_search": f"SELECT id, name FROM {_C} WHERE name ILIKE '%an%' OR email ILIKE '%an%' OR summary ILIKE '%an%'",
    "json_text_contains": f"SELECT id FROM {_C} WHERE lower(CAST(to_json(skills) AS VARCHAR)) LIKE '%kafka%'",
    "candidates_filtered": f"SELECT id, years_of_experience FROM {_C} WHERE years_of_experience >= 3 AND lower(CAST(to_json(skills) AS VARCHAR)) LIKE '%python%' ORDER BY years_of_experience DESC NULLS FIRST, id LIMIT 50 OFFSET 10",
    "matches_between": f"SELECT status, count(*) AS n FROM {_M} WHERE created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2025-06-30' GROUP BY 1",
    "jobs_of_owner": "SELECT id, title, created_at FROM (SELECT DISTINCT ON (id) * FROM jobs) WHERE created_by_id = (SELECT min(created_by_id) FROM jobs)",
    "email_lookup": f"SELECT address, id, updated_at FROM (SELECT {_email('email')} AS address, id, updated_at, row_number() OVER (PARTITION BY {_email('email')} ORDER BY updated_at DESC, id DESC) AS r FROM {_C}) WHERE r = 1 AND address IS NOT NULL",
    "newest_resume_by_file": f"SELECT file_name, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY updated_at DESC, id DESC) AS r FROM {_R} WHERE status = 'candidate_bound' AND file_name IS NOT NULL) WHERE r = 1",
    "match_list_enriched": f"SELECT m.id, c.name, c.email, m.overall_score FROM {_M} m LEFT JOIN {_C} c ON c.id = m.candidate_id ORDER BY m.overall_score DESC NULLS LAST, m.created_at DESC, m.id LIMIT 200",
    "partial_update": """SELECT c_custkey, c_name, coalesce(p.s, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN
        (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' END) AS s FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey""",
    "update_with_presence": "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey < 5 AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "merge_fill_if_empty": f"""SELECT c.id, CASE WHEN {_filled('c.email')} THEN c.email ELSE coalesce(p.email, c.email) END AS email, CASE WHEN {_filled('c.phone')} THEN c.phone ELSE coalesce(p.phone, c.phone) END AS phone,
        CASE WHEN {_filled('p.summary')} THEN p.summary ELSE c.summary END AS summary FROM {_C} c LEFT JOIN (SELECT candidate_id, max(parsed.layer_1_extracted.basic.email) AS email,
        max(parsed.layer_1_extracted.basic.phone) AS phone, max(parsed.layer_1_extracted.basic.target_role) AS summary FROM {_R} WHERE parsed IS NOT NULL GROUP BY 1) p ON p.candidate_id = c.id""",
    "delete_pairs": f"SELECT m.id, m.job_id, m.candidate_id FROM {_M} m WHERE NOT EXISTS (SELECT 1 FROM match_retries r WHERE r.job_id = m.job_id AND r.candidate_id = m.candidate_id)",
    "replace_for_retries": f"""SELECT m.id, m.job_id, m.candidate_id FROM {_M} m WHERE NOT EXISTS (SELECT 1 FROM match_retries r WHERE r.job_id = m.job_id AND r.candidate_id = m.candidate_id)
        UNION ALL SELECT request_id, job_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY requested_at DESC, request_id DESC) AS r FROM match_retries) WHERE r = 1""",
    "insert_normalised": f"SELECT id, CASE WHEN id >= '8' THEN {_email('email')} ELSE email END AS email FROM {_C}",
}
