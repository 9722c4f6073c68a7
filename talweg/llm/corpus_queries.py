"""Queries over the document corpus: shared spans, packing, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talweg.llm.mixing import mix
from talweg.llm.packing import fill_report, pack
from talweg.llm.shared_spans import shared_parts, shared_spans
from talweg.llm.tokens import token_pieces
from talweg.session import cut, table


def _token_capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    limits = table(spark, sf_dir, "size_limits").where("unit_name = 'tokens' and field_path = 'documents.text'").select("max_size").distinct()
    return sorted(r[0] for r in limits.collect())


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, or of each piece of a text over the capacity, for every token limit."""
    items = cut(token_pieces(table(spark, sf_dir, "documents"), _token_capacities(spark, sf_dir)))
    return pack(items).select("capacity", "container_id", "bucket_no", "placed_by", "doc_id", "piece_no", "n_pieces", "n_tokens", "char_from", "char_to")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_containers(spark, sf_dir))


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common run of at least 200 characters."""
    return shared_spans(table(spark, sf_dir, "documents")).select("doc_id_a", "doc_id_b").distinct()


def p9_shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, how many of its characters also occur in others in runs of at least 200."""
    documents = table(spark, sf_dir, "documents")
    return shared_parts(documents, cut(shared_spans(documents)))


QUERIES = {
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_uses": p8_uses, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shared_parts": p9_shared_parts,
}
ORACLES: dict[str, str] = {}
