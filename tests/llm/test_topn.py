from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.llm.topn import top_n_per_group

SCHEMA = "id string, job string, score double, at timestamp, rank_no int"


def brute(rows, n):
    groups = {}
    for i, g, s, at, _ in set(rows):
        if g is not None and i is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s, at, i))
    return {(g, i) for g, v in groups.items() for _, _, i in sorted(v)[:n]}


def run(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA)
    return [(r["job"], r["id"]) for r in top_n_per_group(df, "job", "score", "id", n, [("at", True)]).collect()]


T = datetime(2024, 1, 1)


def test_nulls_nan_ties_repeats_and_clashing_column(spark):
    rows = [("a", "x", 1.0, T, 5), ("a", "x", 1.0, T, 5), ("b", "x", 1.0, T, 9), ("c", "x", None, T, 1), ("d", "x", float("nan"), T, 1), ("e", None, 9.0, T, 1), (None, "x", 9.0, T, 1), ("f", "y", float("inf"), T, 1), ("g", "y", -3.5, T, 1)]
    got = run(spark, rows, 1)
    assert sorted(got) == sorted(brute(rows, 1)) == [("x", "a"), ("y", "f")]


def test_empty(spark):
    assert run(spark, [], 3) == []


def test_repeats_do_not_take_places_in_a_hot_group(spark):
    rows = [(f"r{i % 40:03d}", "hot", float(i % 40), T, 0) for i in range(4000)] + [(f"s{i}", f"g{i}", 1.0, T, 0) for i in range(50)]
    got = run(spark, rows, 10)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefghijkl"), st.sampled_from(["p", "q", None]), st.sampled_from([None, 0.0, 0.5, 0.5000001, 99.0, -1.0, 1e300]), st.just(T), st.just(1)), max_size=40, unique_by=lambda r: r[0]))
def test_like_brute_force(spark, rows):
    assert set(run(spark, rows, 2)) == brute(rows, 2)


def test_whole_table_like_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from talweg.llm.data_queries import ORACLES, p6_found

    con = duckdb.connect()
    con.execute(f"create view candidate_job_matches as select * from read_parquet('{sf}/candidate_job_matches.parquet')")
    want = set(con.execute(ORACLES["p6_found"]).fetchall())
    assert {(r["job_id"], r["match_id"]) for r in p6_found(spark, sf).collect()} == want


def test_threshold_keeps_rows_before_ranking(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit("g").alias("job"), (F.col("id") % 1000).cast("double").alias("score"), F.lit(T).alias("at"), F.lit(0).alias("rank_no"))
    best = top_n_per_group(df, "job", "score", "id", 10, [("at", True)])
    assert {r["id"] for r in best.collect()} == set(sorted(str(999 + 1000 * k) for k in range(20))[:10])  # of the twenty rows at 999, by id
