"""Embedding and scoring of pairs, by cases written out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from talweg.operators.matching import embed_chunks, gate_counts, newest
from talweg.plans.registry import QUERIES
from talweg.session import table

CHUNK = "entity_id string, profile_type string, block string, chunk_text string, content_hash string"


def bucket(word, dim=128):
    return int(hashlib.md5(word.encode()).hexdigest(), 16) % dim


def test_vector_reads_the_whole_chunk(spark):
    text = "java " * 400 + "python " * 300  # the second word begins at character 2,001
    row = embed_chunks(spark.createDataFrame([("1", "resp", "resp", text, "h")], CHUNK)).first()
    length = math.hypot(400, 300)
    assert math.isclose(row["vector"][bucket("java")], 400 / length) and math.isclose(row["vector"][bucket("python")], 300 / length)
    assert row["semantic_text"] == text[:2000] and row["tokens"] == ["java"] * 400


def test_provider_answers_in_batches_and_may_fail(spark):
    from talweg.config import Settings
    from talweg.operators.matching import embedded

    def provider(texts):
        assert len(texts) <= 2
        if "bad" in texts:
            raise OSError("no answer")
        return [[float(len(t)), 1.0] for t in texts] if "short" not in texts else [[1.0]]

    vectors, statuses = embedded(["a", "bcd", "bad", "x", "short"], provider, 2, 2)
    assert statuses == ["available"] * 2 + ["embedding_failed"] * 3 and [list(v) for v in vectors] == [[1, 1], [3, 1], [0, 0], [0, 0], [0, 0]]
    chunks = spark.createDataFrame([("1", "resp", "resp", "abc", "h"), ("2", "resp", "resp", "abc", "h")], CHUNK)
    rows = embed_chunks(chunks, Settings(embedding_dim=2), lambda texts: [[0.0, 2.0]] * len(texts)).collect()
    assert [(r["vector"], r["embedding_status"]) for r in rows] == [([0.0, 2.0], "available")] * 2


KEY = ("job_id", "candidate_id")


@pytest.fixture(scope="module")
def over_pool(spark, sf):
    return {name: {tuple(r[k] for k in KEY): r for r in QUERIES[f"pool_{name}"](spark, sf).collect()} for name in ("degree_gates", "skill_overlap", "semantic_scoring", "matches")}


def test_whole_pool_is_scored(spark, sf, over_pool):
    pairs = table(spark, sf, "candidate_job_matches").where("job_id is not null and candidate_id is not null").select(*KEY).distinct()
    every = {tuple(r) for r in pairs.collect()}
    assert len(every) > 20 * table(spark, sf, "match_retries").select(*KEY).distinct().count()
    assert set(over_pool["degree_gates"]) == set(over_pool["semantic_scoring"]) == every
    assert {k: r for k, r in over_pool["skill_overlap"].items() if k in every} == over_pool["skill_overlap"]
    again = {tuple(r[k] for k in KEY): r for r in QUERIES["skill_overlap"](spark, sf).collect()}
    assert again == {k: over_pool["skill_overlap"][k] for k in again}


def test_pool_is_gated_scored_and_ranked(over_pool):
    passed = {k for k, r in over_pool["degree_gates"].items() if r["meets_requirement"]}
    matches, skills, meanings = over_pool["matches"], over_pool["skill_overlap"], over_pool["semantic_scoring"]
    assert passed < set(over_pool["degree_gates"]) and set(matches) == passed & set(skills)
    pools = {}
    for k, r in matches.items():
        assert (r["skill_score"], r["semantic_score"], r["quality_score"]) == (skills[k]["skill_score"], meanings[k]["semantic_score"], 0.0)
        assert r["overall_score"] == round(0.3 * r["skill_score"] + 0.4 * r["semantic_score"] + 0.3 * r["quality_score"], 1)
        pools.setdefault(k[0], []).append(r)
    for rows in pools.values():
        best_first = sorted(rows, key=lambda r: (-r["overall_score"], r["candidate_id"]))
        assert [r["place"] for r in best_first] == list(range(1, len(rows) + 1))


def test_pool_limit(spark):
    pairs = spark.createDataFrame([("j", c) for c in "abc"], "job_id string, candidate_id string")
    people = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "id string, day int").select("id", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("updated_at"))
    assert {r["candidate_id"] for r in newest(pairs, people, 2).collect()} == {"b", "c"} and newest(pairs, people, None).count() == 3


def test_gate_counts(spark):
    gates = spark.createDataFrame([("j", "a", True), ("j", "b", False), ("k", "a", False)], "job_id string, candidate_id string, meets_requirement boolean")
    assert {tuple(r) for r in gate_counts(gates).collect()} == {("j", 2, 1), ("k", 1, 0)}
