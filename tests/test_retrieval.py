import pytest

from talweg.config import Settings
from talweg.operators.chunks import candidate_chunks, embedding_plan, job_chunks, packed
from talweg.operators.retrieval import best_per_query, bm25, delivery, fuse

A, B, C = "a", "b", "c"


def scores(spark, query):
    q = spark.createDataFrame([("g", 0, query)], "group_id string, j int, tokens array<string>")
    docs = spark.createDataFrame([("g", 0, [A, B, B]), ("g", 1, [B, C])], "group_id string, d int, tokens array<string>")
    return [r["bm25"] for r in bm25(q, docs).orderBy("d").collect()]


def test_bm25(spark):
    assert scores(spark, [A, B]) == [0.8806417664, 0.2003533591]
    assert scores(spark, [B, B]) == [0.4894538437, 0.4007067182]
    assert scores(spark, []) == [0.0, 0.0]


def fused(spark, rows):
    return fuse(spark.createDataFrame(rows, "group_id string, j int, d int, cosine double, bm25 double"))


def test_ranks_and_fusion(spark):
    rows = {r["d"]: r for r in fused(spark, [("g", 0, 0, 0.9, 2.0), ("g", 0, 1, 0.9, 1.0), ("g", 0, 2, 0.5, 1.0)]).collect()}
    assert [rows[d]["rank_cos"] for d in range(3)] == [1, 1, 3]
    assert round(rows[0]["rrf"], 10) == 0.0327868852
    one = fused(spark, [("g", 0, 0, 0.4, 7.0)]).first()
    assert one["bm25_degenerate"] and round(one["rrf"], 10) == 0.0163934426
    pair = {r["d"]: r for r in fused(spark, [("g", 0, 0, 0.7, 2.0), ("g", 0, 1, 0.5, 1.0)]).collect()}
    assert round(pair[1]["rrf"], 10) == 0.0322580645


def test_delivery(spark):
    f = fused(spark, [("g", 0, 0, 0.7, 2.0), ("g", 0, 1, 0.5, 1.0), ("h", 0, 0, 0.9, 0.0)])
    got = {r["group_id"]: r["delivery_score"] for r in delivery(f).collect()}
    assert got == {"g": 68.3, "h": 95.0}
    assert best_per_query(f).where("group_id = 'g'").first()["d"] == 0
    assert {r["group_id"]: r["delivery_score"] for r in delivery(f, Settings(hybrid=False)).collect()} == got


def test_settings(monkeypatch):
    monkeypatch.setenv("SEMANTIC_RRF_K", "0")
    monkeypatch.setenv("SEMANTIC_WEIGHT_SKILL", "1")
    monkeypatch.setenv("SEMANTIC_WEIGHT_DELIVERY", "1")
    monkeypatch.setenv("SEMANTIC_DELIVERY_JOB_COVERAGE", "7")
    s = Settings.from_environment()
    assert (s.rrf_k, s.weight_skill, s.weight_role, s.job_coverage) == (1, 0.5, 0.0, 1.0)
    monkeypatch.setenv("SEMANTIC_WEIGHT_SKILL", "-1")
    assert Settings.from_environment().weight_delivery == 0.8


def test_packing(spark):
    df = spark.createDataFrame([(["aaaa", "bbbb", "cc", "d" * 30],), ([],)], "items array<string>")
    assert [r[0] for r in df.select(packed(df["items"], 11)).collect()] == [["aaaa | bbbb", "cc", "d" * 30], []]


JOB = "id string, title string, raw_jd_text string, structured struct<job_title:string,required_skills:array<string>,preferred_skills:array<string>,responsibilities:array<string>,keywords:array<string>,job_summary:string>"
MAN = "id string, skills array<string>, direction_tags array<string>, projects array<struct<name:string,role:string,description:string>>, work_experience array<struct<period:string,company:string,title:string,position:string,description:string>>"


def test_chunks(spark):
    jobs = spark.createDataFrame([
        ("1", "Dev", "raw", (None, [" Go ", "Go", None], ["C"], ["x" * 3000, "y" * 3000], ["k"], " ")),
        ("2", " ", " raw text ", None), ("3", None, None, (None, None, None, ["one", "two"], None, None)),
    ], JOB)
    got = {(r["entity_id"], r["profile_type"]): r["chunk_text"] for r in job_chunks(jobs).collect()}
    assert got["1", "skill"] == "必备技能: Go\n加分技能: C" and got["1", "role"] == "Dev\n关键词: k" and {"resp_0", "resp_1"} <= {t for e, t in got if e == "1"}
    assert got["2", "jd_raw"] == "raw text" and ("2", "role") not in got and got["3", "resp"] == "one | two"
    men = spark.createDataFrame([("1", ["Go"], None, [("", "", " "), ("P", None, "d")], [(None, "X", None, "Boss", None)]), ("2", None, None, None, None)], MAN)
    got = {(r["entity_id"], r["profile_type"]): r["chunk_text"] for r in candidate_chunks(men).collect()}
    assert got["1", "proj_1"] == "项目: P\nd" and ("1", "proj_0") not in got and got["1", "work_0"] == "公司: X\n职位: Boss"
    assert got["1", "cand_role"] == "经历摘要: 项目 1 个, 工作/实习 1 个\n项目名: P\n公司与职位: X·Boss"
    assert {k for k in got if k[0] == "2"} == {("2", "cand_role")}


def test_embedding_plan(spark):
    key = "entity_type string, entity_id string, profile_type string, content_hash string"
    desired = spark.createDataFrame([("job", "1", "skill", "h1"), ("job", "1", "role", "h2"), ("job", "2", "role", "h9")], key)
    stored = spark.createDataFrame([("job", "1", "skill", "h1", "m", "available"), ("job", "1", "role", "old", "m", "available"), ("job", "1", "resp", "h", "m", "available"), ("job", "3", "resp", "h", "m", "available"), ("job", "2", "role", "h9", "m", "embedding_failed")], key + ", embedding_model string, status string")
    got = {(r["entity_id"], r["profile_type"]): r["action"] for r in embedding_plan(desired, stored, "m").collect()}
    assert got == {("1", "skill"): "keep", ("1", "role"): "embed", ("1", "resp"): "delete", ("2", "role"): "embed"}
    assert pytest.approx(1) == sum(a == "keep" for a in got.values())
