"""Filling containers of fixed capacity: token-budget batches inside optimal length buckets, then leftovers across buckets.

The histogram of item sizes has no more entries than the capacity; a dynamic program over it chooses the bucket boundaries that minimise
padding (each size raised to its bucket's boundary). Inside a bucket of boundary B a batch is ``capacity // B`` items, which the token budget
always holds; so a bucket's batches leave room by how much its sizes vary, and the dynamic program makes that least.

Batches are kept from the longest bucket down for as long as ``RESERVE`` of the tokens not yet placed would fill all the room
they leave. The items of the other buckets, and a bucket's last batch if it is not whole, are the leftovers: in a second step, counted as
such, they go by largest fit into the room of the kept batches (the fullest first) and then into containers of their own.
This runs per shard; shards hold a bounded number of tokens and items, and there are as many as the corpus needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 16
RESERVE = 0.8
GRID = 512
SHARD_TOKENS = 4_000_000
SHARD_ITEMS = 200_000


def bucket_boundaries(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Ascending boundaries, the last one the capacity, that minimise the padding; candidates lie on a grid of capacity / GRID."""
    step = max(1, capacity // GRID)
    points = list(range(step, capacity, step)) + [capacity]
    count, total = np.zeros(len(points) + 1), np.zeros(len(points) + 1)
    for size, n in histogram.items():
        i = min(len(points), max(1, -(-size // step)))
        count[i] += n
        total[i] += n * size
    count, total, at = np.cumsum(count), np.cumsum(total), np.array([0, *points])
    n = len(points)
    # padding[i, j]: sizes over at[i] and up to at[j], raised to at[j]
    padding = at[None, :] * (count[None, :] - count[:, None]) - (total[None, :] - total[:, None])
    padding[np.tril_indices(n + 1, 0)] = np.inf
    best, back = padding[0].copy(), [np.zeros(n + 1, dtype=int)]
    for _ in range(min(buckets, n) - 1):
        options = best[:, None] + padding
        options[0] = padding[0]
        back.append(np.argmin(options, axis=0))
        best = np.minimum(options.min(axis=0), best)
        best[0] = 0
    out, j = [], n
    for chosen in reversed(back):
        if j == 0:
            break
        out.append(int(at[j]))
        j = int(chosen[j])
    return sorted(out)


class _BySize:
    """Items by size; ``take(room)`` gives the first of the largest size that fits."""

    def __init__(self, sizes: list[int], items: list[int], capacity: int) -> None:
        self.items: dict[int, list[int]] = {}
        for i in reversed(items):
            self.items.setdefault(sizes[i], []).append(i)
        # lower[s]: the largest size <= s that still has items, found with path compression
        self.lower = [s if s in self.items else s - 1 for s in range(capacity + 1)]

    def largest(self, room: int) -> int:
        lower, root = self.lower, room
        while root > 0 and lower[root] != root:
            root = lower[root]
        while room > root:
            lower[room], room = root, lower[room]
        return root

    def take(self, room: int) -> tuple[int, int] | None:
        """(item, size) of a size above 0."""
        size = self.largest(room)
        if size <= 0:
            return None
        item = self.items[size].pop()
        if not self.items[size]:
            self.lower[size] = size - 1
        return item, size


def fill(sizes: list[int], capacity: int, boundaries: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """Container number of each item, each container's bucket number, and whether each item was placed as a leftover; sizes are at most the capacity."""
    members: list[list[int]] = [[] for _ in boundaries]
    for i, b in enumerate(np.searchsorted(boundaries, sizes).tolist()):
        members[b].append(i)
    where, kinds, leftover = [0] * len(sizes), [], [False] * len(sizes)
    open_tokens, room, rest, rooms = sum(sizes), 0, [], []
    for b in reversed(range(len(boundaries))):
        each = max(1, capacity // boundaries[b])
        batches = [members[b][i : i + each] for i in range(0, len(members[b]), each)]
        for batch in batches:
            used = sum(sizes[i] for i in batch)
            if len(batch) < each or not used or room + capacity - used > RESERVE * (open_tokens - used):
                rest += batch
                continue
            for i in batch:
                where[i] = len(kinds)
            rooms.append((capacity - used, len(kinds)))
            kinds.append(b)
            room += capacity - used
            open_tokens -= used
    left = _BySize(sizes, rest, capacity)
    for i in rest:
        leftover[i] = True
    for free, number in sorted(rooms):
        while free > 0 and (got := left.take(free)):
            where[got[0]] = number
            free -= got[1]
    while (got := left.take(capacity)) is not None:
        free = capacity
        kinds.append(int(np.searchsorted(boundaries, got[1])))
        while got:
            where[got[0]] = len(kinds) - 1
            free -= got[1]
            got = left.take(free)
    if left.items.get(0) and not kinds:
        kinds.append(0)
    return where, kinds, leftover


def pack(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``items`` with container_id, bucket_no (of the container) and placed_by ("bucket" or "leftover"). Items: capacity int, n_tokens int (at most the capacity), and any other columns.

    Rows of null size or capacity raise no error and are given no container (null). Items of size 0 need no room and share a container. Equal
    sizes are placed in the order of all columns' hash, the same on every run; repeated rows are items of their own; an empty
    table gives an empty table. Other columns are kept; container_id, bucket_no and placed_by are replaced if present.
    """
    items = items.drop("container_id", "bucket_no", "placed_by")
    sized = items.where("n_tokens is not null and capacity is not null")
    counts = sized.groupBy("capacity", "n_tokens").agg(F.count("*").alias("n")).collect()  # at most the sum of the capacities
    histograms: dict[int, dict[int, int]] = {}
    for r in counts:
        histograms.setdefault(r["capacity"], {})[r["n_tokens"]] = r["n"]
    if any(max(h) > c for c, h in histograms.items()):
        raise ValueError("items over the capacity must be split first")
    bounds = {c: bucket_boundaries(h, c, buckets) for c, h in histograms.items()}
    shards = {c: max(1, -(-sum(s * n for s, n in h.items()) // SHARD_TOKENS), -(-sum(h.values()) // SHARD_ITEMS)) for c, h in histograms.items()}
    shard_of = F.coalesce(*[F.when(F.col("capacity") == c, F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in items.columns]), F.lit(s))) for c, s in shards.items()]) if shards else F.lit(0)
    names = items.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", container_id string, bucket_no int, placed_by string"

    def per_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(key[0]), int(key[1])
        group = group.sort_values(["n_tokens", "_order"], ascending=[False, True], kind="stable")
        where, kinds, leftover = fill([int(x) for x in group["n_tokens"]], capacity, bounds[capacity])
        out = group[names].copy()
        out["container_id"] = [f"{capacity}-{shard}-{i}" for i in where]
        out["bucket_no"] = [kinds[i] for i in where]
        out["placed_by"] = ["leftover" if x else "bucket" for x in leftover]
        return out

    ready = sized.withColumn("_shard", shard_of.cast("bigint")).withColumn("_order", F.xxhash64(*[F.col(f"`{x}`") for x in items.columns]))
    packed = ready.groupBy("capacity", "_shard").applyInPandas(per_shard, schema)
    unsized = items.where("n_tokens is null or capacity is null").withColumn("container_id", F.lit(None).cast("string")).withColumn("bucket_no", F.lit(None).cast("int")).withColumn("placed_by", F.lit(None).cast("string"))
    return packed.unionByName(unsized)


def fill_report(packed: DataFrame) -> DataFrame:
    """How full the containers are, of each capacity.

    capacity, n_items, n_containers, used_tokens, unused_share, least_containers (no packing can need fewer), leftover_tokens (placed across
    buckets), n_batches (containers that a bucket's batch opened) and batch_unused_share (the room that the batches left to the leftovers).
    """
    whole = packed.where("container_id is not null")
    by_bucket = F.col("placed_by") == "bucket"
    boxes = whole.groupBy("capacity", "container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"), F.sum(F.when(by_bucket, F.col("n_tokens"))).alias("batched"))
    out = boxes.groupBy("capacity").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_containers"), F.sum("used").alias("used_tokens"), F.coalesce(F.sum("batched"), F.lit(0)).alias("batch_tokens"), F.count("batched").alias("n_batches"))
    size = F.col("capacity")
    return out.select(
        "capacity", "n_items", "n_containers", "used_tokens", (1 - F.col("used_tokens") / (F.col("n_containers") * size)).alias("unused_share"),
        F.ceil(F.col("used_tokens") / size).alias("least_containers"), (F.col("used_tokens") - F.col("batch_tokens")).alias("leftover_tokens"), "n_batches",
        F.when(F.col("n_batches") > 0, 1 - F.col("batch_tokens") / (F.col("n_batches") * size)).alias("batch_unused_share"))
