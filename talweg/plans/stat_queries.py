"""Log statistics over the events table: type is the module, value the amount, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators import stats
from talweg.session import table



def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a state by user, metrics from the value, and a model that is missing for some users."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("user_id") % 5 == 0, "pending").when(F.col("user_id") % 7 == 0, "failed").otherwise("completed")
    return e.select(
        "event_id", "ts", "event_type", state.alias("status"), F.col("value").alias("faithfulness"), (100 - F.col("value")).alias("relevancy"), F.col("user_id").alias("duration_ms"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string"))).alias("model_name"), F.round(F.col("value")).cast("bigint").alias("tokens"))


def eval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.evaluation_statistics(_log(spark, sf_dir), ["faithfulness", "relevancy"])


def eval_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trends(_log(spark, sf_dir).where("status = 'completed'"), "ts", ["faithfulness", "relevancy"], "day")


def eval_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.alerts(_log(spark, sf_dir), {"faithfulness": 20.0, "relevancy": 20.0}, "ts", "event_id", limit=None)
    return found.select("event_id", F.concat_ws(",", "violated").alias("violated"))


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_summary(_log(spark, sf_dir), "ts", ["tokens"], ["tokens", "duration_ms"])


def usage_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_by_time(_log(spark, sf_dir), "ts", ["tokens"], "hour")


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_by_time(_log(spark, sf_dir), "ts", ["tokens"], "day")


def usage_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_log(spark, sf_dir), "event_type", "tokens")


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_log(spark, sf_dir), "model_name", "tokens", unknown="unknown")


def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_values(_log(spark, sf_dir), "model_name")


QUERIES = {
    "eval_statistics": eval_statistics, "eval_trends": eval_trends, "eval_alerts": eval_alerts, "usage_summary": usage_summary, "usage_by_hour": usage_by_hour,
    "usage_by_day": usage_by_day, "usage_by_module": usage_by_module, "usage_by_model": usage_by_model, "distinct_models": distinct_models,
}

_L = """(SELECT event_id, ts, event_type, CASE WHEN user_id % 5 = 0 THEN 'pending' WHEN user_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, value AS faithfulness, 100 - value AS relevancy,
    user_id AS duration_ms, CASE WHEN user_id % 3 > 0 THEN 'model-' || (user_id % 3) END AS model_name, CAST(round(value) AS BIGINT) AS tokens FROM events)"""
_DONE = "FILTER (status = 'completed')"
ORACLES = {
    "eval_statistics": f"""SELECT count(*) {_DONE} AS completed_count, count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'failed') AS failed_count,
        nullif(avg(faithfulness) {_DONE}, 0) AS avg_faithfulness, nullif(min(faithfulness) {_DONE}, 0) AS min_faithfulness, nullif(max(faithfulness) {_DONE}, 0) AS max_faithfulness,
        nullif(avg(relevancy) {_DONE}, 0) AS avg_relevancy, nullif(min(relevancy) {_DONE}, 0) AS min_relevancy, nullif(max(relevancy) {_DONE}, 0) AS max_relevancy,
        nullif(avg(duration_ms) {_DONE}, 0) AS avg_duration_ms FROM {_L}""",
    "eval_trends": f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS row_count, avg(faithfulness) AS avg_faithfulness, avg(relevancy) AS avg_relevancy FROM {_L} WHERE status = 'completed' GROUP BY 1",
    "eval_alerts": f"SELECT event_id, concat_ws(',', CASE WHEN faithfulness < 20 THEN 'faithfulness' END, CASE WHEN relevancy < 20 THEN 'relevancy' END) AS violated FROM {_L} WHERE status = 'completed' AND (faithfulness < 20 OR relevancy < 20)",
    "usage_summary": f"SELECT count(*) AS row_count, CAST(sum(tokens) AS BIGINT) AS sum_tokens, avg(tokens) AS avg_tokens, avg(duration_ms) AS avg_duration_ms, min(ts) AS period_start, max(ts) AS period_end FROM {_L}",
    "usage_by_hour": f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, count(*) AS row_count, CAST(sum(tokens) AS BIGINT) AS sum_tokens FROM {_L} GROUP BY 1",
    "usage_by_day": f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS row_count, CAST(sum(tokens) AS BIGINT) AS sum_tokens FROM {_L} GROUP BY 1",
    "usage_by_module": f"SELECT event_type, count(*) AS row_count, CAST(sum(tokens) AS BIGINT) AS sum_tokens, avg(tokens) AS avg_tokens FROM {_L} GROUP BY 1",
    "usage_by_model": f"SELECT coalesce(model_name, 'unknown') AS model_name, count(*) AS row_count, CAST(sum(tokens) AS BIGINT) AS sum_tokens, avg(tokens) AS avg_tokens FROM {_L} GROUP BY model_name",
    "distinct_models": f"SELECT DISTINCT model_name FROM {_L} WHERE model_name IS NOT NULL",
}
