"""Queries of splitting, mapping and top N (splitting, mapping to a canonical list, top N per group) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.canonical import map_rows, map_values
from talweg.llm.splitting import split_items
from talweg.llm.topn import top_n_per_group
from talweg.session import table


def _items(column: Column) -> Column:
    return F.posexplode(column)


def oversized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every splittable item with its limits: rec_id, field_name, block_no, item_no, item_text, max_size, overlap_size."""
    jobs = table(spark, sf_dir, "jobs")
    limits = table(spark, sf_dir, "size_limits").where("unit_name = 'chars'").select("field_path", "max_size", "overlap_size")
    whole = jobs.select(F.col("id").alias("rec_id"), F.lit("raw_jd_text").alias("field_name"), F.lit(0).alias("block_no"), F.lit(0).alias("item_no"), F.col("raw_jd_text").alias("item_text"), F.lit("jobs.raw_jd_text").alias("field_path"))
    duties = jobs.select("id", F.posexplode("structured.responsibilities").alias("i", "item_text")).select(
        F.col("id").alias("rec_id"), F.lit("responsibilities").alias("field_name"), F.lit(0).alias("block_no"), (F.col("i") + 1).alias("item_no"), "item_text", F.lit("jobs.structured.responsibilities").alias("field_path"))
    work = table(spark, sf_dir, "resumes").select("id", F.posexplode(F.col("parsed.layer_1_extracted.work_experience.descriptions")).alias("b", "items"))
    described = work.select("id", "b", F.posexplode("items").alias("i", "item_text")).select(
        F.col("id").alias("rec_id"), F.lit("descriptions").alias("field_name"), (F.col("b") + 1).alias("block_no"), (F.col("i") + 1).alias("item_no"), "item_text",
        F.lit("resumes.parsed.layer_1_extracted.work_experience.descriptions").alias("field_path"))
    return whole.unionByName(duties).unionByName(described).join(F.broadcast(limits), "field_path").drop("field_path")


KEYS2 = ["rec_id", "field_name", "block_no", "item_no"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over their limit: those of which the splitting operator makes a second piece."""
    return split_items(oversized_sources(spark, sf_dir), KEYS2).where("piece_no = 2").select(*KEYS2).distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the items over their limit."""
    pieces = split_items(oversized_sources(spark, sf_dir), KEYS2).where("n_pieces > 1")
    return pieces.dropDuplicates([*KEYS2, "piece_no"])


def entered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-entered values: rec_id, field_name, item_no, kind, value."""
    skills = table(spark, sf_dir, "candidates").select("id", F.posexplode("skills").alias("i", "value")).select(
        F.col("id").alias("rec_id"), F.lit("skills").alias("field_name"), (F.col("i") + 1).alias("item_no"), F.lit("skill").alias("kind"), "value")
    education = table(spark, sf_dir, "resumes").select("id", F.posexplode(F.col("parsed.layer_1_extracted.education")).alias("i", "e"))
    studied = education.select("id", "i", F.explode(F.array(
        F.struct(F.lit("school").alias("kind"), F.col("e.school").alias("value")), F.struct(F.lit("degree").alias("kind"), F.col("e.degree").alias("value")))).alias("v"))
    return skills.unionByName(studied.select(F.col("id").alias("rec_id"), F.col("v.kind").alias("field_name"), (F.col("i") + 1).alias("item_no"), "v.kind", "v.value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are no label as written, with the entry meant, or 0."""
    mapped = map_rows(entered_values(spark, sf_dir), table(spark, sf_dir, "ref_entries"), ["rec_id", "field_name", "item_no"])
    return mapped.select("rec_id", "field_name", "item_no", "ref_id").distinct()


def p4_unmatched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the values the list does not have, with the number of records holding them."""
    values = entered_values(spark, sf_dir)
    lost = map_values(values, table(spark, sf_dir, "ref_entries")).where("ref_id = 0").select("kind", "value")
    counted = values.groupBy("kind", "value").agg(F.countDistinct("rec_id").alias("n_records"))
    return counted.join(lost, ["kind", "value"]).select("kind", "value", "n_records")


def _scored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidate_job_matches").select("id", "job_id", F.col("explanation.score_breakdown.overall_score").alias("score"), "created_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches of every job."""
    best = top_n_per_group(_scored_matches(spark, sf_dir), "job_id", "score", "id", n=10, ties=[("created_at", True)])
    return best.select("job_id", F.col("id").alias("match_id"))


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best matches of every job with rank and score."""
    best = top_n_per_group(_scored_matches(spark, sf_dir), "job_id", "score", "id", n=3, ties=[("created_at", True)])
    return best.select("job_id", F.col("id").alias("match_id"), "score", "rank_no")


QUERIES = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p4_found": p4_found, "p4_unmatched_values": p4_unmatched_values, "p6_found": p6_found, "p6_ranked": p6_ranked,
}

_OVER = """
WITH lim AS (SELECT field_path, max_size FROM size_limits WHERE unit_name = 'chars'),
a AS (SELECT DISTINCT id AS rec_id, 'raw_jd_text' AS field_name, 0 AS block_no, 0 AS item_no FROM jobs
      WHERE length(raw_jd_text) > (SELECT max_size FROM lim WHERE field_path = 'jobs.raw_jd_text')),
r AS (SELECT id, unnest(structured.responsibilities) AS t, generate_subscripts(structured.responsibilities, 1) AS i FROM jobs),
b AS (SELECT DISTINCT id AS rec_id, 'responsibilities' AS field_name, 0 AS block_no, CAST(i AS INTEGER) AS item_no FROM r
      WHERE length(t) > (SELECT max_size FROM lim WHERE field_path = 'jobs.structured.responsibilities')),
w AS (SELECT id, unnest(parsed.layer_1_extracted.work_experience) AS e, generate_subscripts(parsed.layer_1_extracted.work_experience, 1) AS k FROM resumes),
d AS (SELECT id, k, unnest(e.descriptions) AS t, generate_subscripts(e.descriptions, 1) AS i FROM w),
c AS (SELECT DISTINCT id AS rec_id, 'descriptions' AS field_name, CAST(k AS INTEGER) AS block_no, CAST(i AS INTEGER) AS item_no FROM d
      WHERE length(t) > (SELECT max_size FROM lim WHERE field_path = 'resumes.parsed.layer_1_extracted.work_experience.descriptions'))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c
"""

_RANKED = """
WITH m AS (SELECT DISTINCT id, job_id, created_at, explanation.score_breakdown.overall_score AS score FROM candidate_job_matches
           WHERE job_id IS NOT NULL AND explanation.score_breakdown.overall_score IS NOT NULL AND NOT isnan(explanation.score_breakdown.overall_score)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, created_at, id) AS rank_no FROM m)
"""

ORACLES = {
    "p2_found": _OVER,
    "p6_found": _RANKED + "SELECT job_id, id AS match_id FROM r WHERE rank_no <= 10",
    "p6_ranked": _RANKED + "SELECT job_id, id AS match_id, score, CAST(rank_no AS INTEGER) AS rank_no FROM r WHERE rank_no <= 3",
}
