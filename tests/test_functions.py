"""Values worked out by hand from the formulas."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from talweg.functions import text as x
from talweg.functions import vectors as v
from talweg.functions.lexicons import canonical_skill, labels_by_keyword, offered_terms, required_terms, tier
from talweg.operators.matching import quality_score, required_degree


def value(spark, column, **named):
    df = spark.range(1)
    for k, c in named.items():
        df = df.withColumn(k, c)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("sim", "band", "experience"), [(0.0, 0, 0), (0.1, 55, 38), (0.38, 55, 38), (0.45, 55, 46.5), (0.5, 55, 52.6), (0.52, 55, 55), (0.6, 55, 64.7), (0.66, 65, 72), (0.72, 75, 80), (0.78, 85, 88), (0.84, 95, 95)])
def test_bands(spark, sim, band, experience):
    assert value(spark, v.band_score(F.lit(sim))) == band
    assert value(spark, v.experience_score(F.lit(sim))) == experience


def test_cosine_and_hash_embedding(spark):
    a = lambda *xs: F.array(*[F.lit(float(i)) for i in xs])
    assert value(spark, v.cosine(a(1, 0), a(1, 0))) == 1.0
    assert value(spark, v.cosine(a(1, 0), a(1, 0, 0))) == 0.0
    assert value(spark, v.cosine(a(0, 0), a(1, 0))) == 0.0
    assert value(spark, v.cosine(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0.0
    for word, bucket in (("python", 93), ("java", 70), ("后端", 32)):
        assert value(spark, v.hash_bucket(F.lit(word), 128)) == bucket == int(hashlib.md5(word.encode()).hexdigest(), 16) % 128
    e = v.hash_vectors(["python java python"], 128)[0]
    assert math.isclose(e[93], 2 / math.sqrt(5)) and math.isclose(e[70], 1 / math.sqrt(5)) and sum(i != 0 for i in e) == 2
    assert set(v.hash_vectors([""], 16)[0]) == {0.0}


def test_tokens(spark):
    assert value(spark, x.tokens(F.lit("Étion C++ node.js 3.5 v2_x école"))) == ["tion", "c++", "node.js", "3.5", "v2_x", "cole"]
    assert value(spark, x.tokens(F.lit("机器学习 Java 的"))) == ["机器", "器学", "学习", "java", "的"]
    assert value(spark, x.tokens(F.lit("熟悉机器学习平台"), ["机器学习"])) == ["熟悉", "机器学习", "平台"]
    assert value(spark, x.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, x.shared_terms(F.lit("java go rust"), F.lit("rust JAVA c"))) == ["java", "rust"]


@pytest.mark.parametrize(("raw", "want"), [("2020/12", "2020-12"), ("2024年9月", "2024-09"), ("2021", "2021"), ("至今", "present"), ("abc", ""), ("2022.3", "2022-03")])
def test_year_month(spark, raw, want):
    assert value(spark, x.year_month(F.lit(raw))) == want


def test_degrees_language_snippet_kind_json(spark):
    for text, rank in (("本科及以上，硕士优先", 2), ("大专", 0), ("研究生", None)):
        assert value(spark, x.degree_rank(F.lit(text))) == rank
    assert value(spark, required_degree(F.lit(" "), F.lit(" 本科 "))) == "本科"
    assert [value(spark, x.language(F.lit(t))) for t in ("", "plain english words", "本" * 9, "本" * 9 + "x" * 400)] == ["zh", "en", "zh", "en"]
    assert value(spark, x.snippet(F.lit("a" * 321))) == "a" * 320 + "…"
    assert [value(spark, x.file_kind(F.lit(n))) for n in ("a.TXT", "b.docx", "c.png", "d.xyz", "")] == ["text", "office", "image", "pdf", "pdf"]
    assert value(spark, x.json_object(F.lit('sure: {"a": {"b": 1}} done'))) == '{"a": {"b": 1}}'
    assert value(spark, x.json_object(F.lit("no braces"))) is None
    assert value(spark, x.grounded(F.lit("LabView!"), F.lit("uses labview"))) is False
    assert value(spark, x.grounded(F.lit("LabView!"), F.lit("uses labview"), relaxed=True)) is True


def test_lexicon(spark):
    wanted = {"HTML": "机器学习", "NoSQL": "sql", "mongodb集群": "go", "digital marketing": "git", "MySQL": "mysql", "K8s": "docker", "Spring Boot": "java", "沟通能力": None}
    for phrase, canonical in wanted.items():
        assert value(spark, canonical_skill(F.lit(phrase))) == canonical
    terms = F.array(F.lit(" Java "), F.lit(None), F.lit(""), F.lit("spring"), F.lit("AI产品"))
    assert value(spark, required_terms(terms)) == ["java", "ai产品"]
    assert value(spark, offered_terms(terms)) == ["java", "AI产品"]
    assert value(spark, labels_by_keyword(F.lit("Vue 与 MySQL"), {"fe": ("vue",), "be": ("mysql",), "qa": ("pytest",)})) == ["fe", "be"]
    assert value(spark, tier(F.lit("甲大学乙学院"), {"985": ("甲大学",), "211": ("乙学院",)})) == "985"
    assert value(spark, tier(F.lit(None).cast("string"), {"985": ("甲大学",)})) == "other"


def test_quality_and_rounding(spark):
    assert value(spark, quality_score(F.lit(80), F.lit(60), F.lit(25))) == 71.0
    assert value(spark, quality_score(F.lit(None), F.lit(500), F.lit(-3))) == 60.0
    assert value(spark, v.rounded(F.lit(0.25))) == 0.2 and value(spark, v.rounded(F.lit(2.675), 2)) == 2.67
