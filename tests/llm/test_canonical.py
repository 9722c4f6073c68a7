import math
import random
from collections import Counter

import pytest

from talweg.llm.canonical import SCHOOLS, SKILLS, Vocabulary, _key_tokens, compare_key, map_rows, map_values, similarity_join, tokens

ENTRIES = [
    (1, "skill", "Python", None), (2, "skill", "C", None), (3, "skill", "C++", None), (4, "skill", "C#", None), (5, "skill", "Deep Learning", None), (6, "skill", "数据分析", None),
    (10, "school", "Dincit Medical College", None), (11, "school", "Susaid Institute of Technology", ["Susaid Tech"]), (12, "school", "云原财经大学", ["云原财经"]), (13, "school", "墨原大学", None),
    (20, "degree", "Bachelor", ["本科", "学士"]), (21, "degree", "MBA", None),
]
VALUES = [
    ("skill", "Pyhon", 1), ("skill", "精通 Python", 1), ("skill", "PYTHON", 1), ("skill", "Руthоn", 1), ("skill", "c#", 4), ("skill", "C, advanced", 2), ("skill", "deep_learning", 5), ("skill", "数据 分析", 6),
    ("skill", "数据分析(三年)", 6), ("skill", "beekeeping", 0), ("school", "Dincti Medical College", 10), ("school", "College of Medicine, Dincit", 10), ("school", "SUSAID INST. OF TECH.", 11),
    ("school", "Susaid I.T.", 11), ("school", "毕业于云原财经大学", 12), ("school", "云 原 财 经 大 学", 12), ("school", "云原财金大学", 12), ("school", "墨原大", 13), ("school", "云原財經大學", 12),
    ("school", "Stargrorth Academy", 0), ("degree", "BSc", 20), ("degree", "全日制本科", 20), ("degree", "M.B.A.", 21), ("degree", "进修", 0),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "ref_id int, ref_kind string, label_text string, alt_labels array<string>")


def test_values(spark, entries):
    rows = spark.createDataFrame([(v[0], v[1]) for v in VALUES] + [("skill", None), ("skill", " 　"), ("skill", "Pyhon")], "kind string, value string")
    got = {(r["kind"], r["value"]): r["ref_id"] for r in map_values(rows, entries).collect()}
    assert got == {(k, v): i for k, v, i in VALUES}


def test_rows_leave_out_labels_and_keep_repeats(spark, entries):
    rows = spark.createDataFrame([("a", "skill", "Python", 7), ("b", "skill", "python", 8), ("c", "skill", "python", 9), ("d", "skill", None, 1), ("e", "skill", "x" * 5000, 1)], "rec string, kind string, value string, ref_id int").drop("ref_id")
    got = {(r["rec"], r["ref_id"]) for r in map_rows(rows, entries, ["rec"]).collect()}
    assert got == {("b", 1), ("c", 1), ("e", 0)}
    assert map_rows(rows.limit(0), entries, ["rec"]).count() == 0
    assert {r["ref_id"] for r in map_values(rows, entries.limit(0)).collect()} == {0}


def test_join_like_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    left, right = sorted(set(words[:40])), sorted(set(words[20:]))
    frame = lambda ws: spark.createDataFrame([(w, "k", tokens(w)) for w in ws], "id string, kind string, tokens array<string>")
    for least in (0.4, 0.7, 1.0):
        want = set()
        sets = [set(tokens(w)) for w in [*left, *right]]
        df = Counter(t for x in sets for t in x)
        weight = lambda ts: sum(math.log(1 + len(sets) / df[t]) for t in ts)
        for x in left:
            for y in right:
                a, b = set(tokens(x)), set(tokens(y))
                if round(weight(a & b) / weight(a | b), 9) >= least:
                    want.add((x, y))
        assert {(r["left_id"], r["right_id"]) for r in similarity_join(frame(left), frame(right), least).collect()} == want


def test_built_in_tokens_equal_python(spark):
    keys = ["aab", "a", "数据分析", "ccccc", "=ba"]
    df = spark.createDataFrame([(k, "k", k) for k in keys], "id string, kind string, compare_key string")
    assert {r["id"]: r["tokens"] for r in _key_tokens(df).collect()} == {k: tokens(k) for k in keys}


def test_keys():
    assert compare_key("React Native 3 yrs", SKILLS) == "reactnative"
    assert compare_key("The Thuhoas Univ.", SCHOOLS) == "thuhoasuniversity"
    assert compare_key("", Vocabulary()) == ""
