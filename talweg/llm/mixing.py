"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The size of a mix is divided into blocks. Blocks go one by one to the source with the highest quotient share / (2 k + 1), k being what it has, as
long as its cap (its tokens times its allowed repeats) has room; a source's blocks go to its shards the same way by
the shards' tokens. Inside a shard documents stand in a seeded order; the quota is spent on whole passes over the shard and on the
first documents of one more pass, so no document is used more than a pass oftener than another of its shard, nor over its cap.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm.tokens import VOCABULARY, token_counts
from talweg.session import bounded, cut

BLOCKS = 20_000
SHARD_TOKENS = 8_000_000


def sainte_lague(seats: int, weights: Sequence[float], caps: Sequence[int] | None = None) -> list[int]:
    """Seats of each party by highest quotients, none over its cap; ties go to the earlier party. Fewer seats are given only if all caps are full."""
    caps = [seats] * len(weights) if caps is None else list(caps)
    got = _certain_seats(seats, weights, caps)
    seats -= sum(got)
    heap = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(weights) if w > 0 and got[i] < caps[i]]
    heapq.heapify(heap)
    while seats > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _certain_seats(seats: int, weights: Sequence[float], caps: Sequence[int]) -> list[int]:
    """Seats whose quotients are over a common divisor that gives out fewer than there are; so few are left for the heap, however many there are in all."""
    w, most = np.maximum(np.asarray(weights, dtype=float), 0.0), np.asarray(caps, dtype=float)

    def over(divisor: float) -> np.ndarray:
        return np.minimum(np.ceil((w / divisor - 1) / 2).clip(0), most)  # quotients w / (2 k + 1) over the divisor

    if not w.sum() > 0 or not np.minimum(most, np.where(w > 0, seats, 0)).sum() > seats:
        return [0] * len(w) if not w.sum() > 0 or seats <= 0 else [int(min(c, seats)) if x > 0 else 0 for x, c in zip(w, most, strict=True)]
    low, high = 0.0, float(w.max()) * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle).sum() <= seats else (middle, high)
    # a little over the divisor, so that ties at it are left to the heap
    return [int(x) for x in over(high * (1 + 1e-9))]


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): how often each document is used in each mix, and each source's target and actual share.

    ``documents``: doc_id, source, text. ``targets``: mix_id, source_name, target_share, max_repeats. Without ``total_tokens`` a mix is as large as it
    can be with every source that has tokens at its target (a source without any gets 0 and the others keep their proportions); with it,
    sources at their cap leave their part to the others. uses: mix_id, source_name, doc_id, n_tokens, n_uses (at least 1, at most max_repeats). shares:
    mix_id, source_name, target_share, max_repeats, available_tokens, used_tokens, actual_share. Documents of null source or
    without tokens are in no mix; doc_id is unique, a repeated row is one document; no documents or no targets give empty uses. Ties in the order go by doc_id.
    """
    wanted = targets.where("mix_id is not null and source_name is not null").select("mix_id", "source_name", "target_share", "max_repeats").distinct()
    rows = sorted(wanted.collect(), key=lambda r: (r["mix_id"], r["source_name"]))  # the small table of the mixes themselves
    spark = documents.sparkSession
    names = sorted({r["source_name"] for r in rows})
    chosen = documents.select("doc_id", "source", "text").where(F.col("source").isin(names or [""]))
    sized = cut(token_counts(chosen, ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0").dropDuplicates(["doc_id"]))
    totals = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    shards = {s: max(1, -(-t // SHARD_TOKENS)) for s, t in totals.items()}
    shard_rows = [(s, n) for s, n in shards.items()]
    placed = sized.join(F.broadcast(spark.createDataFrame(shard_rows, "source string, n_shards bigint")), "source")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("n_shards"))).drop("n_shards")
    per_shard: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect():  # one small row for SHARD_TOKENS tokens
        per_shard.setdefault(r["source"], []).append((r["shard"], r["t"]))

    quotas = []
    for mix_id in sorted({r["mix_id"] for r in rows}):
        sources = [r for r in rows if r["mix_id"] == mix_id]
        limits = [totals.get(r["source_name"], 0) * max(0, r["max_repeats"] or 0) for r in sources]
        weights = [r["target_share"] or 0.0 if limit > 0 else 0.0 for r, limit in zip(sources, limits, strict=True)]
        whole = sum(weights)
        if whole <= 0:
            continue
        size = min(total_tokens, sum(limits)) if total_tokens else int(min(limit / (w / whole) for limit, w in zip(limits, weights, strict=True) if w > 0))
        # at least four blocks for every shard, however many there are
        block = max(1.0, size / max(BLOCKS, 4 * sum(len(per_shard.get(r["source_name"], [])) for r in sources)))
        # a cap is a whole number of blocks; the tolerance keeps a source at its exact limit from losing its last block to rounding
        seats = sainte_lague(round(size / block), weights, [int(limit / block + 1e-6) for limit in limits])
        for r, blocks in zip(sources, seats, strict=True):
            parts = sorted(per_shard.get(r["source_name"], []))
            most = r["max_repeats"] or 0
            given = sainte_lague(blocks, [t for _, t in parts], [int(t * most / block + 1 - 1e-9) for _, t in parts])
            quotas += [(mix_id, r["source_name"], most, shard, float(g * block), t) for (shard, t), g in zip(parts, given, strict=True) if g]
    quota = spark.createDataFrame(quotas, "mix_id int, source string, most int, shard bigint, quota double, shard_tokens bigint")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    queue = placed.withColumn("upto", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    used = queue.join(bounded(quota), ["source", "shard"])
    passes = F.floor(F.col("quota") / F.col("shard_tokens"))
    rest = F.col("quota") - passes * F.col("shard_tokens")
    # A document that the quota's end falls into is used if more than half of it is inside.
    used = used.withColumn("n_uses", F.least(F.col("most").cast("bigint"), passes + F.when(F.col("upto") - F.col("n_tokens") / 2 < rest, 1).otherwise(0)).cast("int"))
    uses = used.where("n_uses > 0").select("mix_id", F.col("source").alias("source_name"), "doc_id", "n_tokens", "n_uses")
    spent = uses.groupBy("mix_id", "source_name").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"))
    available = spark.createDataFrame([(s, t) for s, t in totals.items()], "source_name string, available_tokens bigint")
    shares = wanted.join(F.broadcast(available), "source_name", "left").join(spent, ["mix_id", "source_name"], "left").fillna(0, ["available_tokens", "used_tokens"])
    all_used = F.sum("used_tokens").over(Window.partitionBy("mix_id"))
    shares = shares.withColumn("actual_share", F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(F.lit(0.0)))
    return uses, shares.select("mix_id", "source_name", "target_share", "max_repeats", "available_tokens", "used_tokens", "actual_share")
