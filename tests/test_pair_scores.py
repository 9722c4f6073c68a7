"""Pairs scored in place give what the operators over grid rows give, and shuffle no grid rows."""

import random

import pytest
from pyspark.sql import functions as F

from talweg import session
from talweg.config import Settings
from talweg.functions.text import tokens
from talweg.operators.matching import delivered_pairs, delivery_pairs, score_sides
from talweg.operators.pair_scores import number, rounded_up, words
from talweg.operators.retrieval import best_per_query, delivery
from talweg.plans.registry import QUERIES

JOB = "id string, title string, raw_jd_text string, structured struct<job_title:string,required_skills:array<string>,preferred_skills:array<string>,responsibilities:array<string>,keywords:array<string>,job_summary:string>"
MAN = "id string, skills array<string>, direction_tags array<string>, projects array<struct<name:string,role:string,description:string>>, work_experience array<struct<period:string,company:string,title:string,position:string,description:string>>"
IN_PLACE = ["pool_delivery_scores", "delivery_scores", "pool_semantic_scoring", "semantic_scoring", "pool_rrf_alignments", "rrf_alignments"]


def test_words_are_the_tokens(spark):
    texts = ["", "用Python3.11 和 C++", "数据", "数", "数据仓库a仓", "node.js_x-9 é Ünï ９９ 㐀一鿿龥", "A\n　b 库存中台𠀀项目", "-x .net 3D #tag K İ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == {t: words(t) for t in texts}


def test_numbers_and_rounding(spark):
    assert [number(k) for k in ("resp", "resp_3", "jd_raw", "proj_10", "work_0", "cand_role")] == [0, 3, 0, 10, 100_000, 0]
    values = [0.0, 1 / 3, 1 / 2048, -1 / 2048, 0.00048828125, 0.1234567890499, 0.99999999999, 12.3456789012345]
    assert [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 10)).collect()] == [rounded_up(v) for v in values]


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(5)
    vocabulary = ["java", "Go", "数据", "仓库存", "SQL", "模型训练", "接口", "x"]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=rnd.randint(1, n)))
    some = lambda make, most: [make() for _ in range(rnd.randint(0, most))]
    jobs = [(f"j{i}", text(3), text(20), (None, [text(2)], None, some(lambda: text(900), 4), [text(2)], None)) for i in range(9)] + [("raw", None, text(30), None), ("none", None, " ", None)]
    people = [(f"c{i}", [text(2)], None, some(lambda: (text(2), " ", text(9)), 12), some(lambda: (None, text(1), None, text(1), text(9)), 4)) for i in range(12)] + [("none", None, None, None, None)]
    jobs, people = spark.createDataFrame(jobs * 2, JOB), spark.createDataFrame(people * 2, MAN)
    pairs = jobs.select(F.col("id").alias("job_id")).distinct().crossJoin(people.select(F.col("id").alias("candidate_id")).distinct())
    return pairs.unionByName(spark.createDataFrame([("j1", "gone"), ("gone", "c1"), (None, "c1")], "job_id string, candidate_id string")).localCheckpoint(), jobs, people


@pytest.mark.parametrize("settings", [Settings(), Settings(hybrid=False, top_chunks=2, job_coverage=0.3, embedding_dim=7, rrf_k=1)])
def test_same_as_over_grid_rows(records, settings):
    pairs, jobs, people = records
    grid = delivery_pairs(pairs, *score_sides(pairs, jobs.dropDuplicates(["id"]), people.dropDuplicates(["id"]), settings), settings).localCheckpoint()
    got = delivered_pairs(pairs, jobs, people, settings).localCheckpoint()
    columns = ["group_id", "n_queries", "n_chunks", "delivery_score"]
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in delivery(grid, settings).select(*columns).collect()}
    columns = ["group_id", "j", "d", "cosine", F.round("bm25", 8), "rank_cos", "rank_bm25", "bm25_degenerate", F.round("rrf", 10)]
    best = {tuple(r) for r in best_per_query(grid, score="rrf" if settings.hybrid else "cosine").select(*columns).collect()}
    assert {tuple(r) for r in got.select("group_id", F.inline("best")).select(*columns).collect()} == best and len({j for _, j, *_ in best}) > 1


@pytest.mark.parametrize("name", IN_PLACE)
def test_pairs_are_shuffled_without_their_grid(spark, sf, name):
    before = list(session._cuts)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert session._cuts == before and "Window" not in plan and plan.count("Exchange hashpartitioning") <= 5


def test_pool_meets_its_records_once(spark, sf):
    before = list(session._cuts)
    plan = QUERIES["pool_matches"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert session._cuts == before and plan.count("Exchange hashpartitioning") <= 7
