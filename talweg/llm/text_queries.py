"""Queries over free text: consistent characters, scanning noise, personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.normalise import changed_values
from talweg.llm.pii import find_personal_data, redact
from talweg.llm.scan_noise import find_noise, noise_kinds, repair
from talweg.session import table


def spelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills, schools and names: rec_id, field_name, item_no, value."""
    skills = table(spark, sf_dir, "candidates").select("id", F.posexplode("skills").alias("i", "value")).select(
        F.col("id").alias("rec_id"), F.lit("skills").alias("field_name"), (F.col("i") + 1).alias("item_no"), "value")
    resumes = table(spark, sf_dir, "resumes")
    schools = resumes.select("id", F.posexplode(F.col("parsed.layer_1_extracted.education.school")).alias("i", "value")).select(
        F.col("id").alias("rec_id"), F.lit("school").alias("field_name"), (F.col("i") + 1).alias("item_no"), "value")
    names = resumes.select(F.col("id").alias("rec_id"), F.lit("name").alias("field_name"), F.lit(0).alias("item_no"), F.col("parsed.layer_1_extracted.basic.name").alias("value"))
    return skills.unionByName(schools).unionByName(names)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of which a character must be replaced, composed or dropped to reach the consistent form."""
    return changed_values(spelled_values(spark, sf_dir)).select("rec_id", "field_name", "item_no").distinct()


def p3_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different writings of each consistent form occur."""
    values = spelled_values(spark, sf_dir)
    changed = changed_values(values.select("field_name", "value").distinct())
    return changed.groupBy("field_name", "plain_text").agg(F.countDistinct("value").alias("n_writings"))


def resume_texts(spark: SparkSession, sf_dir: str, basic: bool = True) -> DataFrame:
    """Previews, raw blocks of work entries and, if wanted, of the basic part (with candidate_id): resume_id, field_name, item_no, raw_text, own_name."""
    resumes = table(spark, sf_dir, "resumes").where("parsed is not null")
    parts = [("raw_text_preview", F.col("parsed.document_meta.raw_text_preview"))]
    if basic:
        parts.append(("basic_raw_block", F.col("parsed.layer_1_extracted.basic.raw_block")))
    single = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(0).alias("item_no"), c.alias("raw_text")) for n, c in parts])
    work = F.transform(
        F.coalesce(F.col("parsed.layer_1_extracted.work_experience.raw_block"), F.array().cast("array<string>")),
        lambda t, i: F.struct(F.lit("work_raw_block").alias("field_name"), (i + 1).cast("int").alias("item_no"), t.alias("raw_text")),
    )
    whom = ["candidate_id"] if basic else []
    rows = resumes.select(*whom, F.col("id").alias("resume_id"), F.col("parsed.layer_1_extracted.basic.name").alias("own_name"), F.explode(F.concat(single, work)).alias("t"))
    return rows.select("resume_id", *whom, "t.field_name", "t.item_no", "t.raw_text", "own_name").where("raw_text is not null and raw_text <> ''")


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in structured fields: of candidates and of resumes."""
    resumes = table(spark, sf_dir, "resumes").select(F.col("parsed.layer_1_extracted.basic.name").alias("name"))
    return table(spark, sf_dir, "candidates").select("name").unionByName(resumes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of resumes with each type of personal data in them."""
    spans = find_personal_data(resume_texts(spark, sf_dir), known_names(spark, sf_dir), entity="candidate_id")
    return spans.select("resume_id", "field_name", "item_no", "pii_type").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with placeholders in place of the personal data."""
    clean = redact(resume_texts(spark, sf_dir).distinct(), known_names(spark, sf_dir), entity="candidate_id")
    return clean.select("resume_id", "field_name", "item_no", "clean_text")


def p5_generalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and terms that disclose the candidate by ten bits or more (one in a thousand) generalised to [TERM] besides."""
    clean = redact(resume_texts(spark, sf_dir).distinct(), known_names(spark, sf_dir), entity="candidate_id", least_bits=10.0)
    return clean.select("resume_id", "field_name", "item_no", "clean_text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of resumes with each kind of scanning damage in them."""
    keys = ["resume_id", "field_name", "item_no"]
    return noise_kinds(find_noise(resume_texts(spark, sf_dir, basic=False)), keys).select(*keys, "noise_kind")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that scanning damaged, as continuous paragraphs."""
    clean = repair(resume_texts(spark, sf_dir, basic=False).distinct())
    return clean.where("clean_text <> raw_text").select("resume_id", "field_name", "item_no", "clean_text")


QUERIES = {
    "p1_found": p1_found, "p1_repaired": p1_repaired,
    "p3_found": p3_found, "p3_spellings": p3_spellings, "p5_found": p5_found, "p5_redacted": p5_redacted, "p5_generalised": p5_generalised,
}
ORACLES: dict[str, str] = {}
