import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talweg.llm import mixing, packing
from talweg.llm.tokens import VOCABULARY, encoding, pieces, token_counts, token_pieces

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        h = {rng.randint(1, 12): rng.randint(1, 9) for _ in range(6)}
        got = packing.bucket_boundaries(h, 12, 3)
        best = min(padding(h, sorted({a, b, 12})) for a in range(1, 13) for b in range(1, 13))
        assert got[-1] == 12 and len(got) <= 3 and padding(h, got) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_fill(sizes):
    where, kinds, leftover = packing.fill(sizes, 50, [10, 25, 50])
    load = {}
    for size, c in zip(sizes, where, strict=True):
        load[c] = load.get(c, 0) + size
    assert all(v <= 50 for v in load.values()) and (not sizes or max(load) < len(kinds))
    # a batch has as many items of its bucket as its boundary allows, and no other item that is not a leftover
    for c in load:
        mine = [size for size, x, rest in zip(sizes, where, leftover, strict=True) if x == c and not rest]
        assert not mine or len(mine) == 50 // [10, 25, 50][kinds[c]] and {int(size > 10) + int(size > 25) for size in mine} == {kinds[c]}


def test_boundaries_decide_the_assignment():
    rng = random.Random(5)
    sizes = sorted((min(100, int(rng.lognormvariate(3, 0.8)) + 1) for _ in range(5000)), reverse=True)
    histogram = {s: sizes.count(s) for s in set(sizes)}
    best = packing.bucket_boundaries(histogram, 100)
    least = -(-sum(sizes) // 100)
    batched = {}
    for name, bounds in (("best", best), ("one", [100]), ("other", [7, 30, 60, 100])):
        where, kinds, leftover = packing.fill(sizes, 100, bounds)
        assert len(kinds) <= 1.01 * least
        groups = {}
        for i, c in enumerate(where):
            groups.setdefault(c, []).append(i)
        batched[name] = ({tuple(g) for g in groups.values()}, sum(s for s, rest in zip(sizes, leftover, strict=True) if not rest))
    assert batched["best"][0] != batched["one"][0] and batched["best"][0] != batched["other"][0]
    # most tokens are placed by the batches of optimal buckets, more than by those of any others
    assert batched["best"][1] > 0.6 * sum(sizes) and batched["best"][1] > max(batched["one"][1], batched["other"][1])


def test_pieces_join_and_keep_characters(spark):
    enc = encoding()
    text = "数据分析 naïve 😀 words " * 40
    ids = enc.encode_ordinary(text)
    for capacity in (1, 3, 7, 50, 10_000):
        got = pieces(ids, capacity)
        assert sum(n for n, _, _ in got) == len(ids) and all(n <= capacity for n, _, _ in got)
        assert got[0][1] == 0 and got[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(got, got[1:]))
    df = spark.createDataFrame([(1, text, 9), (2, "", 9), (3, None, 9)], "doc_id bigint, text string, n_tokens int").drop("n_tokens")
    rows = token_pieces(df, [16, 4096]).collect()
    assert {(r["doc_id"], r["capacity"]) for r in rows if r["n_pieces"] > 1} == {(1, 16)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, ["doc_id"]).collect()} == {1: len(ids), 2: 0, 3: 0}


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 5_000)
    rng = random.Random(2)
    rows = [(i, 100, rng.choice([0, 1, 40, 60, 99, 100]), "x") for i in range(600)] + [(i, 100, 50, "y") for i in range(600)] + [(999, None, 5, "z"), (998, 100, None, "z"), (7, 100, 60, "x"), (7, 100, 60, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, capacity int, n_tokens int, bucket_no string")
    got = packing.pack(df).collect()
    assert len(got) == len(rows) and sum(r["container_id"] is None for r in got) == 2
    load = {}
    for r in got:
        if r["container_id"]:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 100 and len({c.split("-")[1] for c in load}) > 3
    assert sum(load.values()) / (100 * len(load)) > 0.9
    assert packing.pack(df.limit(0)).count() == 0
    report = packing.fill_report(packing.pack(df)).first()
    assert report["n_items"] == len(rows) - 2 and 0 < report["leftover_tokens"] < report["used_tokens"] and report["batch_unused_share"] > report["unused_share"]
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 10, 11)], "doc_id bigint, capacity int, n_tokens int"))


def test_sainte_lague():
    assert mixing.sainte_lague(10, [6, 3, 1]) == [6, 3, 1]
    assert mixing.sainte_lague(7, [53, 24, 23]) == [3, 2, 2]
    assert mixing.sainte_lague(10, [6, 3, 1], [2, 99, 99]) == [2, 6, 2]
    assert mixing.sainte_lague(12, [2, 2, 6], [2, 3, 8]) == [2, 3, 7]
    assert mixing.sainte_lague(10, [1, 1], [3, 3]) == [3, 3] and mixing.sainte_lague(5, []) == [] and mixing.sainte_lague(4, [0, 1]) == [0, 4]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12)), max_size=9), st.integers(0, 60))
def test_seats_go_to_the_highest_quotients(parties, seats):
    """Against giving one seat after the other."""
    weights, caps = [w for w, _ in parties], [c for _, c in parties]
    want = [0] * len(parties)
    for _ in range(seats):
        able = [i for i in range(len(parties)) if weights[i] > 0 and want[i] < caps[i]]
        if able:
            want[max(able, key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
    assert mixing.sainte_lague(seats, weights, caps) == want


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 300)
    docs = [(i, "big", "some words of text here") for i in range(400)] + [(1000 + i, "small", "other words, fewer of them") for i in range(20)] + [(5000, None, "x"), (5001, "small", None), (5002, "small", ""), (5003, "rest", "not asked"), (0, "big", "some words of text here")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "small", 0.3, 3), (1, "gone", 0.2, 9), (2, "gone", 1.0, 2)], "mix_id int, source_name string, target_share double, max_repeats int")
    uses, shares = mixing.mix(df, targets)
    u, s = uses.collect(), {(r["mix_id"], r["source_name"]): r for r in shares.collect()}
    assert all(1 <= r["n_uses"] <= (3 if r["source_name"] == "small" else 1) for r in u) and len({r["doc_id"] for r in u}) == len(u)
    assert {r["mix_id"] for r in u} == {1} and not {r["doc_id"] for r in u} & {5000, 5001, 5002, 5003}
    assert abs(s[1, "big"]["actual_share"] - 0.625) < 0.03 and abs(s[1, "small"]["actual_share"] - 0.375) < 0.03 and s[1, "gone"]["used_tokens"] == 0 and s[2, "gone"]["actual_share"] == 0
    assert [tuple(r) for r in sorted(u)] == [tuple(r) for r in sorted(mixing.mix(df, targets)[0].collect())]
    capped = {r["source_name"]: r for r in mixing.mix(df, targets, total_tokens=10**6)[1].where("mix_id = 1").collect()}
    assert capped["small"]["used_tokens"] == 3 * capped["small"]["available_tokens"] and capped["big"]["used_tokens"] == capped["big"]["available_tokens"]
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[1].count() == 0
