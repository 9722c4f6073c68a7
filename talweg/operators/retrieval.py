"""Hybrid retrieval: BM25 and cosine fused by reciprocal rank, and the scores made of it.

Rows are (group, j, d): ``group`` is the pair or collection within which ranks are taken (a document or chunk corpus), ``j`` the query
chunk, ``d`` the candidate chunk. Everything is joins, aggregates and windows over such rows; a group's rows stay bounded by its
own chunks, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.config import Settings
from talweg.functions.vectors import experience_score, rounded
from talweg.session import cut

DEGENERATE = 1e-9
DIGITS = 10


def bm25(queries: DataFrame, corpus: DataFrame, settings: Settings = Settings(), group: str = "group_id") -> DataFrame:
    """Okapi scores of every (group, j, d): columns group, j, d, bm25.

    ``queries``: group, j, tokens; ``corpus``: group, d, tokens. The corpus of a group is its own chunks. A query term counts as
    often as it occurs in the query; a query without terms scores 0 everywhere; scores are rounded to 10 digits, so that
    ties do not hang on the order of summation. A row of the corpus meets the asked terms of its group, keeps its hits in one array
    and is scored in place: of the hits only counts per term are shuffled, so a group of any size is spread over the tasks that read it.
    """
    k1, b = settings.bm25_k1, settings.bm25_b
    asked = queries.groupBy(group).agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("asked"))
    common = F.array_intersect("tokens", "asked")
    counted = F.transform(common, lambda q: F.struct(q.alias("term"), F.size(F.filter("tokens", lambda t: t == q)).alias("tf")))
    met = cut(corpus.join(asked, group).select(group, "d", F.size("tokens").alias("dl"), counted.alias("hits")))
    sizes = met.groupBy(group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = met.select(group, F.explode("hits.term").alias("term")).groupBy(group, "term").agg(F.count("*").alias("df"))
    qtf = queries.select(group, "j", F.explode("tokens").alias("term")).groupBy(group, "j", "term").agg(F.count("*").alias("qtf"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    terms = qtf.join(df, [group, "term"]).join(sizes.select(group, "n"), group).groupBy(group, "j").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("qtf") * idf))).alias("weights"))
    sides = queries.select(group, "j").join(terms, [group, "j"], "left").groupBy(group).agg(F.collect_list(F.struct("j", "weights")).alias("sides")).join(sizes.drop("n"), group)
    length = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    rows = met.join(sides, group).select(group, "d", "hits", (k1 * (1.0 - b + b * F.col("dl") / length)).alias("damp"), F.explode("sides").alias("side"))
    weight = lambda h: F.coalesce(F.try_element_at("side.weights", h["term"]), F.lit(0.0)) * h["tf"] * (k1 + 1.0) / (h["tf"] + F.col("damp"))
    total = F.aggregate("hits", F.lit(0.0), lambda s, h: s + weight(h))
    return rows.select(group, F.col("side.j").alias("j"), "d", F.round(F.when(F.col("side.weights").isNull(), 0.0).otherwise(total), DIGITS).alias("bm25"))


def competition_rank(score: Column, *partition: str) -> Column:
    """1, 1, 3: equal scores share a rank and the next one skips; higher is better."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(F.desc(score)))


def fuse(pairs: DataFrame, settings: Settings = Settings(), group: str = "group_id") -> DataFrame:
    """``pairs`` (group, j, d, cosine, bm25) with rank_cos, rank_bm25, bm25_degenerate and rrf.

    A query whose lexical scores do not differ says nothing: its fusion is the cosine rank alone. One chunk is always such a case.
    """
    row = Window.partitionBy(group, "j")
    spread = F.max("bm25").over(row) - F.min("bm25").over(row)
    ranked = pairs.withColumn("rank_cos", competition_rank(F.col("cosine"), group, "j")).withColumn("rank_bm25", competition_rank(F.col("bm25"), group, "j"))
    ranked = ranked.withColumn("bm25_degenerate", spread <= DEGENERATE)
    k = settings.rrf_k
    lexical = F.when(F.col("bm25_degenerate"), 0.0).otherwise(1.0 / (k + F.col("rank_bm25")))
    return ranked.withColumn("rrf", 1.0 / (k + F.col("rank_cos")) + lexical)


def best_per_query(fused: DataFrame, group: str = "group_id", score: str = "rrf") -> DataFrame:
    """The best candidate chunk of each query chunk: by fusion, then cosine, then the earlier chunk."""
    order = Window.partitionBy(group, "j").orderBy(F.desc(score), F.desc("cosine"), F.asc("d"))
    return fused.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def best_per_chunk(fused: DataFrame, group: str = "group_id", score: str = "rrf") -> DataFrame:
    """The best query chunk of each candidate chunk."""
    order = Window.partitionBy(group, "d").orderBy(F.desc(score), F.desc("cosine"), F.asc("j"))
    return fused.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def delivery(fused: DataFrame, settings: Settings = Settings(), group: str = "group_id") -> DataFrame:
    """Delivery axis of each group: mean experience score of the queries' best chunks, blended with that of the best chunks overall.

    Columns: group, n_queries, n_chunks, mean_query_score, mean_chunk_score, delivery_score. With ``settings.hybrid`` off cosine alone ranks.
    """
    score = "rrf" if settings.hybrid else "cosine"
    queries = best_per_query(fused, group, score).groupBy(group).agg(F.avg(experience_score(F.col("cosine"))).alias("mean_query_score"), F.count("*").alias("n_queries"))
    chunks = best_per_chunk(fused, group, score)
    order = Window.partitionBy(group).orderBy(F.desc(score), F.desc("cosine"), F.asc("d"))
    placed = chunks.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    top = placed.where(F.col("_r") <= settings.top_chunks).groupBy(group).agg(F.avg(experience_score(F.col("cosine"))).alias("mean_chunk_score"), F.max("_n").alias("n_chunks"))
    w = settings.job_coverage
    out = queries.join(top, group).withColumn("delivery_score", rounded(w * F.col("mean_query_score") + (1.0 - w) * F.col("mean_chunk_score")))
    return out.select(group, "n_queries", "n_chunks", "mean_query_score", "mean_chunk_score", "delivery_score")


def weighted_sum(parts: dict[str, float]) -> Column:
    """Sum of columns times weights, a null part counting 0, rounded to one digit."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return rounded(total)
