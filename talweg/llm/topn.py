"""Top N rows of every group, by a safe score threshold from per-group histograms.

Pass 1 builds, per group, a histogram of the score. A bin does not count rows but a lower bound of the *distinct* rows
in it, taken from the smallest and largest row hash of two hash classes; repeated rows therefore never lower the
survivors under N. Adding the bins from the top gives the highest bin at which at least N distinct rows are certain;
pass 2 drops every row under that bin before anything is ranked, and ranks the survivors exactly with the tie keys.

No row is shuffled before it has passed its threshold: thresholds travel to the rows. Groups holding more than 1/1000 of the rows are
hot; there are fewer than 1000 of them by definition, so they are broadcast one by one. All other groups share ``SLOTS`` slots by
their hash, and a slot has the least threshold of its groups, which is safe for each of them; so what is broadcast is bounded, and
with more groups than slots the filter lets more rows through but loses none. The ranking limits each group within every task before
rows meet, so that a hot group whose scores are all tied is no hot spot either. The histogram is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.session import cut

HOT_SHARE = 1000
BINS_PER_E = 64
CLASSES = 2
SLOTS = 1 << 20


def score_bin(score: Column) -> Column:
    """A monotone bin of any double; fine near the usual score range, never overflowing at the ends."""
    return F.floor(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.asinh(score))) * BINS_PER_E).cast("int")


def top_n_per_group(df: DataFrame, group: str, score: str, key: str, n: int = 10, ties: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    """The ``n`` best distinct rows of each group: columns group, key, score, the tie columns and ``rank_no``.

    Rows with a null group, null key, or a null or NaN score do not compete. Equal scores go by ``ties`` (column, ascending)
    and then by ascending ``key``. A row that occurs repeatedly counts once. An empty table gives no rows; a group of
    fewer than ``n`` rows returns all of them. Other columns of ``df`` are ignored, whatever their names.
    """
    names = [c for c, _ in ties]
    rows = df.select(
        F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(score).cast("double").alias("_s"),
        *[F.col(c).alias(f"_t{i}") for i, c in enumerate(names)],
    ).where("_g is not null and _k is not null and _s is not null and not isnan(_s)")
    rows = rows.withColumn("_bin", score_bin(F.col("_s")))

    h = F.xxhash64("_k")
    parts = [F.when(F.pmod(h, F.lit(CLASSES)) == c, h) for c in range(CLASSES)]
    aggs = [F.count("*").alias("_n")]
    for c, p in enumerate(parts):
        aggs += [F.min(p).alias(f"_lo{c}"), F.max(p).alias(f"_hi{c}")]
    sure = sum((F.when(F.col(f"_lo{c}").isNull(), 0).when(F.col(f"_lo{c}") == F.col(f"_hi{c}"), 1).otherwise(2) for c in range(CLASSES)), F.lit(0))
    histogram = rows.select("_g", "_bin", "_k").groupBy("_g", "_bin").agg(*aggs).select("_g", "_bin", "_n", sure.alias("_sure"))
    above = Window.partitionBy("_g").orderBy(F.desc("_bin"))
    cumulated = histogram.withColumn("_cum", F.sum("_sure").over(above))
    thresholds = cut(
        cumulated.groupBy("_g").agg(
            F.coalesce(F.max(F.when(F.col("_cum") >= n, F.col("_bin"))), F.min("_bin")).alias("_least"), F.sum("_n").alias("_rows")
        )
    )
    total = thresholds.agg(F.sum("_rows")).first()[0] or 0
    hot = thresholds.where(F.col("_rows") > F.lit(total / HOT_SHARE)).select(F.col("_g").alias("_hg"), F.col("_least").alias("_hot_least"))
    slot = F.pmod(F.xxhash64("_g"), F.lit(SLOTS)).cast("int")
    cold = thresholds.where(F.col("_rows") <= F.lit(total / HOT_SHARE)).groupBy(slot.alias("_slot")).agg(F.min("_least").alias("_least"))

    order = [F.desc("_s"), *[F.asc(f"_t{i}") if up else F.desc(f"_t{i}") for i, (_, up) in enumerate(ties)], F.asc("_k")]
    ranked = Window.partitionBy("_g").orderBy(*order)
    # at most 1000 and SLOTS rows
    limits = rows.join(F.broadcast(hot), F.col("_g") == F.col("_hg"), "left").withColumn("_slot", slot).join(F.broadcast(cold), "_slot", "left")
    over = limits.where(F.col("_bin") >= F.coalesce("_hot_least", "_least")).drop("_hg", "_hot_least", "_least", "_slot", "_bin")
    # Equal rows share a dense rank, so that repeats neither take places nor need a shuffle of their own.
    out = over.withColumn("rank_no", F.dense_rank().over(ranked)).where(F.col("rank_no") <= n).dropDuplicates(["_g", "rank_no"])
    return out.select(
        F.col("_g").alias(group), F.col("_k").alias(key), F.col("_s").alias("score"),
        *[F.col(f"_t{i}").alias(c) for i, c in enumerate(names)], "rank_no",
    )
