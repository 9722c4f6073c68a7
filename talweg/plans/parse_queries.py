"""Queries of parsing, model answers, page layout and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators.model_answers import keep_grounded, layer1_of_answer, routed
from talweg.operators.resume_parse import DIRECTIONS, candidate_record, normal_blocks, parse_documents
from talweg.functions.lexicons import labels_by_keyword
from talweg.session import shared_folder, table
from talweg.sources.files import page_text
from talweg.streaming.queue import usage_windows


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed as résumés: how many entries each section gave."""
    p = parse_documents(_documents(spark, sf_dir), "doc_id", "text")
    return p.select(
        "doc_id", "parse_status", F.col("layer1.basic.email").alias("email"), F.size("layer1.education").alias("n_education"), F.size("layer1.work_experience").alias("n_work"),
        F.size("layer1.projects").alias("n_projects"), F.size("layer1.skills").alias("n_skills"))


def resume_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed, normalised and bound: the candidate record of each."""
    p = parse_documents(_documents(spark, sf_dir), "doc_id", "text").withColumn("layer1", normal_blocks(F.col("layer1")))
    record = candidate_record(F.col("layer1"))
    return p.select("doc_id", record.alias("c")).select("doc_id", "c.name", "c.email", F.array_join("c.skills", "|").alias("skills"), F.array_join("c.direction_tags", "|").alias("direction_tags"))


def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First e-mail address in each document."""
    return _documents(spark, sf_dir).select("doc_id", F.regexp_extract(F.coalesce("text", F.lit("")), r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0).alias("email"))


def direction_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.array_join(labels_by_keyword(F.col("text"), DIRECTIONS), "|").alias("tags"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records as a model would answer them: coerced, grounded in the preview, and routed to the stored record if nothing was left."""
    r = table(spark, sf_dir, "resumes").dropDuplicates(["id"]).where("parsed is not null").select("id", F.col("parsed.document_meta.raw_text_preview").alias("source"), F.to_json("parsed.layer_1_extracted").alias("answer"))
    read = r.withColumn("record", layer1_of_answer(F.col("answer")))
    out = routed(read, [("model", F.when(F.col("record").isNotNull(), keep_grounded(F.col("record"), F.coalesce("source", F.lit("")))))])
    return out.select("id", "route", F.size("layer1.work_experience").alias("n_work"), F.size("record.work_experience").alias("n_answered"), F.size("layer1.skills").alias("n_skills"))


def page_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work entries laid out as page blocks and read back in order."""
    blocks = F.transform("parsed.layer_1_extracted.work_experience", lambda w, i: F.struct(
        F.lit("text").alias("block_label"), w["company"].alias("block_content"), (F.lit(1000) - i).alias("block_order"), F.array(F.lit(0), F.lit(0)).alias("block_bbox")))
    pages = F.array(F.struct(F.lit(0).alias("page_index"), F.concat(F.array(F.struct(F.lit("seal").alias("block_label"), F.lit("x").alias("block_content"), F.lit(0).alias("block_order"), F.array(F.lit(0), F.lit(0)).alias("block_bbox"))), blocks).alias("parsing_res_list")))
    r = table(spark, sf_dir, "resumes").dropDuplicates(["id"]).where("parsed.layer_1_extracted.work_experience is not null")
    return r.select("id", page_text(pages).alias("page_text"))


def stream_usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly usage of the events as a stream, run to its end."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # the file source wants a folder; the pattern picks the one table
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"

    def keep(result: DataFrame, _: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/result")

    keep(usage_windows(spark.read.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).limit(0)), -1)  # an empty stream has no batch
    run = usage_windows(events).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    run.start().awaitTermination()
    return spark.read.parquet(f"{folder}/result").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "row_count", F.round("sum_value", 4).alias("sum_value"))


QUERIES = {
    "resume_sections": resume_sections, "resume_candidates": resume_candidates, "contact_extract": contact_extract, "direction_tags": direction_tags, "model_answers": model_answers,
    "page_flatten": page_flatten, "stream_usage_windows": stream_usage_windows,
}

_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}' END" for label, words in DIRECTIONS.items())
ORACLES = {
    "contact_extract": r"SELECT doc_id, regexp_extract(coalesce(text, ''), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0) AS email FROM documents",
    "direction_tags": f"SELECT doc_id, concat_ws('|', {_TAGS}) AS tags FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)",
    "page_flatten": "SELECT id, coalesce(array_to_string(list_reverse(list_filter(list_transform(parsed.layer_1_extracted.work_experience, lambda w: trim(coalesce(w.company, ''))), lambda v: v <> '')), chr(10) || chr(10)), '') AS page_text FROM (SELECT DISTINCT ON (id) * FROM resumes) WHERE parsed.layer_1_extracted.work_experience IS NOT NULL",
    "stream_usage_windows": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS row_count, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2",
}
