"""Lexicon look-ups as column expressions; the lexicons are parameters with defaults."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.nfkc import nfkc, nfkc_each
from talweg.functions.text import HAN, strip
from talweg.functions.vectors import bound

# Canonical skills and the spellings that stand for them, in the order they are tried.
SKILL_ALIASES: dict[str, tuple[str, ...]] = {
    "python": ("python", "django", "flask", "fastapi", "pandas", "numpy", "sklearn"),
    "java": ("java", "spring", "springboot", "spring boot", "mybatis", "maven", "gradle"),
    "go": ("golang", "gin框架", "gin", "go语言"),
    "c++": ("c++", "cpp", "cmake"),
    "c": ("c语言", "embedded c"),
    "rust": ("rust", "tokio", "cargo"),
    "javascript": ("javascript", "typescript", "nodejs", "node.js", "vue", "react", "angular"),
    "sql": ("sql", "mysql", "postgresql", "postgres", "oracle", "sqlite", "数据库"),
    "mysql": ("mysql", "mariadb"),
    "redis": ("redis",),
    "mongodb": ("mongodb", "mongo"),
    "kafka": ("kafka",),
    "rabbitmq": ("rabbitmq", "amqp"),
    "docker": ("docker", "kubernetes", "k8s", "容器"),
    "linux": ("linux", "ubuntu", "centos", "shell", "bash"),
    "git": ("git", "github", "gitlab", "ci/cd", "jenkins"),
    "pytorch": ("pytorch", "torch"),
    "tensorflow": ("tensorflow", "keras"),
    "机器学习": ("机器学习", "machine learning", "ml", "xgboost", "lightgbm"),
    "深度学习": ("深度学习", "deep learning", "神经网络", "cnn", "rnn", "transformer"),
    "nlp": ("nlp", "自然语言", "bert", "llm", "大模型"),
    "cv": ("计算机视觉", "opencv", "图像识别", "目标检测"),
    "spark": ("spark", "hadoop", "hive", "flink"),
    "数据分析": ("数据分析", "tableau", "power bi", "excel"),
    "android": ("android", "kotlin"),
    "ios": ("ios", "swift", "objective-c", "objc"),
}


def alias_pairs(lexicon: Mapping[str, Sequence[str]] = SKILL_ALIASES) -> list[tuple[str, str]]:
    """(spelling, canonical): each spelling at the place it first has, with the canonical it last has; canonicals stand for themselves."""
    pairs: dict[str, str] = {}
    for canonical, spellings in lexicon.items():
        for spelling in (*spellings, canonical):
            pairs[spelling] = canonical
    return list(pairs.items())


def canonical_skill(phrase: Column, lexicon: Mapping[str, Sequence[str]] = SKILL_ALIASES) -> Column:
    """Exact spelling, else the first spelling of two or more characters that is part of the phrase in NFKC; null if none is."""
    return _canonical(nfkc(_bare(phrase)), lexicon)


def _canonical(phrase: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The same of a phrase that is in NFKC."""
    pairs = alias_pairs(lexicon)
    exact = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in pairs if len(a) >= 2])

    def found(low: Column) -> Column:
        within = F.filter(table, lambda p: low.contains(p["a"]))
        return F.when(low != "", F.coalesce(F.try_element_at(exact, low), F.try_element_at(within, F.lit(1))["c"]))

    return bound(F.lower(strip(phrase)), found)


def _bare(t: Column) -> Column:
    """Without any Unicode white space at both ends; NFKC would turn it into blanks that stay."""
    return strip(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))


def _kept(terms: Column) -> Column:
    return F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), _bare), lambda t: t.isNotNull() & (t != ""))


def required_terms(terms: Column, lexicon: Mapping[str, Sequence[str]] = SKILL_ALIASES) -> Column:
    """Terms of a demand: canonical, else as they stand in lower case; each once, in order."""
    kept = _kept(terms)
    return F.array_distinct(F.zip_with(kept, nfkc_each(kept), lambda t, n: F.coalesce(_canonical(n, lexicon), F.lower(t))))


def offered_terms(terms: Column, lexicon: Mapping[str, Sequence[str]] = SKILL_ALIASES) -> Column:
    """Terms of an offer, in NFKC: Han terms are cut to 24 characters and keep their case, others are in lower case; canonical where known."""
    def token(t: Column) -> Column:
        return F.when(t.rlike(f"[{HAN}]"), F.substring(t, 1, 24)).otherwise(F.lower(t))

    return F.array_distinct(F.transform(nfkc_each(_kept(terms)), lambda t: bound(token(t), lambda own: F.coalesce(_canonical(own, lexicon), own))))


def labels_by_keyword(text: Column, labels: Mapping[str, Sequence[str]]) -> Column:
    """Labels with any keyword in the text, both in NFKC and lower case, in the order of the mapping."""
    low = F.lower(nfkc(F.coalesce(text, F.lit(""))))
    tests = [F.when(F.lit(False) if not words else _any([low.contains(unicodedata.normalize("NFKC", w).lower()) for w in words]), F.lit(label)) for label, words in labels.items()]
    return F.array_compact(F.array(*tests))


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def tier(name: Column, tiers: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """The first tier of which a name equals or is part of the value."""
    value = strip(F.coalesce(name, F.lit("")))
    out = F.lit(other)
    for label, names in reversed(list(tiers.items())):
        if names:
            out = F.when(_any([value.contains(n) for n in names]), F.lit(label)).otherwise(out)
    return out
