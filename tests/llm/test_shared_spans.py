import random

import numpy as np
import pytest

from talweg.llm import shared_spans as s


def brute(texts, least=200):
    grams = {}
    for i, t in texts:
        for k in range(len(t or "") - least + 1):
            grams.setdefault(t[k : k + least], set()).add(i)
    return {(a, b) for v in grams.values() for a in v for b in v if a < b}


def words(rng, n):
    return "".join(rng.choice(["alpha ", "beta", "，", "数据", "\n", "x", "aa", " ", "Gam", "的", "9"]) for _ in range(n))


def pairs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    return {(r["doc_id_a"], r["doc_id_b"]) for r in s.shared_spans(df).select("doc_id_a", "doc_id_b").distinct().collect()}


def test_guarantee_of_the_rounds():
    """Any 200 characters have the same anchors inside, whatever stands around them."""
    rng = random.Random(1)
    for kind in range(60):
        if kind % 3 == 0:
            core = "".join(rng.choice("ab") for _ in range(200))
        elif kind % 3 == 1:
            core = (("ab" * rng.randint(1, 3)) * 100)[: rng.randint(0, 200)].ljust(200, rng.choice("a-"))
        else:
            core = words(rng, 300)[:200]
        keys = []
        for _ in range(2):
            text = words(rng, rng.randint(0, 80)) + rng.choice(["a", "ab", "-"]) * rng.randint(0, 40) + core + rng.choice(["a", "b", "-"]) * rng.randint(0, 40) + words(rng, rng.randint(0, 80))
            keys.append(set(s._of_texts([text])[1].tolist()))
        assert keys[0] & keys[1], core


def test_like_brute_force(spark):
    rng = random.Random(5)
    shared = [words(rng, 200) for _ in range(6)] + ["-" * 260, "ab" * 150, "word " * 60]
    texts = []
    for i in range(80):
        parts = [words(rng, rng.randint(5, 120))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [p[a : a + rng.randint(150, 400)], words(rng, rng.randint(0, 60))]
        texts.append((i, "".join(parts)))
    texts += [(100, None), (101, ""), (102, "x" * 199), (103, "y" * 200), (104, "y" * 200), (105, "y" * 1000)]
    assert pairs(spark, texts) == brute(texts)


def test_exact_limits(spark):
    rng = random.Random(9)
    core = words(rng, 300)
    texts = [(1, "A" + core[:199] + "B"), (2, "C" + core[:199] + "D"), (3, "E" + core[:200] + "F"), (4, "G" + core[:200] + "H")]
    assert pairs(spark, texts) == {(3, 4)}


def test_large_groups_and_copies(spark, monkeypatch):
    monkeypatch.setattr(s, "SMALL_GROUP", 4)
    rng = random.Random(2)
    line, core = words(rng, 100)[:190], words(rng, 400)[:230]
    texts = [(i, f"{i:03d}" * 9 + line + f"{i * 7:03d}" * 9) for i in range(30)] + [(100 + i, f"{i:03d}" * 20 + core + f"{i * 3:03d}" * 9) for i in range(12)] + [(200 + i, core) for i in range(6)]
    assert pairs(spark, texts) == brute(texts)


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 4096)
    rng = random.Random(3)
    core = words(rng, 200)[:260]
    long = words(rng, 9000)
    texts = [(1, long[:4000] + core + long[4000:]), (2, "z" + core), (3, long[7000:7200] + "!"), (4, long[20000:20210])]
    assert pairs(spark, texts) == brute(texts)


def test_parts(spark):
    rng = random.Random(4)
    core = words(rng, 400)[:300]
    df = spark.createDataFrame([(1, core + "11", 7), (2, "22" + core, 7), (3, "nothing", 7), (4, None, 7)], "doc_id bigint, text string, n_chars int")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in s.shared_parts(df, s.shared_spans(df)).collect()}
    assert got == {1: (302, 300), 2: (302, 300), 3: (7, 0), 4: (None, 0)}
    assert s.shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.shared_spans(df, 100)


def test_symbols_part_documents():
    codes = np.array([ord(c) for c in "aaaa\x00aaaa\x00"], dtype=np.uint32)
    _, start, _, _ = s.symbols(codes, np.array([4, 9]))
    assert {4, 5, 9} <= set(start.tolist())
