"""NFKC before look-ups; the forms are written out by hand, since DuckDB has no NFKC."""

from pyspark.sql import functions as F

from talweg.functions.lexicons import canonical_skill, labels_by_keyword, offered_terms, required_terms
from talweg.functions.nfkc import nfkc, nfkc_each
from talweg.operators.matching import degree_gate, skill_scores

SKILLS = "array<string>"
JOB = "id string, education_requirement string, structured struct<education_requirement:string,required_skills:array<string>,preferred_skills:array<string>>"
RESUME = "id string, candidate_id string, status string, updated_at timestamp, parsed struct<layer_1_extracted:struct<education:array<struct<degree:string>>>>"


def test_forms(spark):
    df = spark.createDataFrame([("ｓｑｌ", ["ａ", None, "b", "⼤专"]), ("plain 文", ["b"]), (None, None), ("e\u0301", [])], f"t string, a {SKILLS}")
    got = df.select(nfkc(F.col("t")), nfkc_each(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("sql", ["a", None, "b", "大专"]), ("plain 文", ["b"]), (None, None), ("é", [])]


def test_lexicon(spark):
    df = spark.createDataFrame([([" ｊａｖａ ", "ＳＱＬ", "ＡＩ产品", "ｆｏｏ", "Java", "\u2003figma\u2003"],)], f"s {SKILLS}")
    row = df.select(offered_terms(F.col("s")).alias("o"), required_terms(F.col("s")).alias("r"), canonical_skill(F.col("s")[1]).alias("c"), labels_by_keyword(F.col("s")[0], {"be": ("ＪＡＶＡ",), "qa": ("pytest",)}).alias("l")).first()
    assert row["o"] == ["java", "sql", "AI产品", "foo", "figma"] and row["c"] == "sql" and row["l"] == ["be"]
    # A demand that is not in the lexicon stays as it is written, in lower case.
    assert row["r"] == ["java", "sql", "ａｉ产品", "ｆｏｏ", "figma"]


def test_pairs(spark):
    jobs = spark.createDataFrame([("j", "⼤专以上", (None, ["SQL"], None))], JOB)
    people = spark.createDataFrame([("c", ["ｓｑｌ"])], f"id string, skills {SKILLS}")
    pairs = spark.createDataFrame([("j", "c")], "job_id string, candidate_id string")
    assert skill_scores(pairs, jobs, people).first()["skill_score"] == 100.0
    resumes = spark.createDataFrame([("r", "c", "parsed", None, (([("本科",)],),)), ("s", "c", "parsed", None, (([("⼤专",)],),))], RESUME)
    gate = degree_gate(pairs, jobs, resumes.where("id = 's'")).first()
    assert (gate["required_rank"], gate["best_rank"], gate["gate"], gate["meets_requirement"]) == (0, 0, "compared", True)
    assert degree_gate(pairs, jobs, resumes).first()["best_rank"] == 1
