"""Clean states of the stored tables: one row per document, assignment, edge and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(at)).where("_place = 1").drop("_place")


def current_docs(docs: DataFrame) -> DataFrame:
    """The newest state of each document; null titles, contents and sources become empty, a null type becomes ``web``.

    Rows without an id are left out; of states ingested at one time the first
    title stays.
    """
    columns = docs.select("id", "title", "source", "source_type", "rel_path", "content", "content_hash", "created_at", "ingested_at").where("id is not null")
    newest = latest(columns, ["id"], F.desc_nulls_last("ingested_at"), F.asc_nulls_last("title"))
    return newest.select(
        "id", F.coalesce(F.trim("title"), F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("source_type", F.lit("web")).alias("source_type"),
        "rel_path", F.coalesce("content", F.lit("")).alias("content"), "content_hash", "created_at", "ingested_at",
    )


def assignments(doc_concepts: DataFrame) -> DataFrame:
    """Distinct ``doc_id, concept_id``, trimmed, concepts in lower case; null and blank ones are left out.  Every assignment has weight 1."""
    rows = doc_concepts.select(F.trim("doc_id").alias("doc_id"), F.lower(F.trim("concept_id")).alias("concept_id"))
    return rows.where("doc_id <> '' and concept_id <> ''").distinct()


def current_edges(edges: DataFrame, newest: bool = True) -> DataFrame:
    """The newest state (or the oldest) of each edge, types in lower case, null weights as 0, without self edges."""
    rows = edges.select("src_id", "dst_id", F.lower(F.trim("edge_type")).alias("edge_type"), "weight", F.try_to_timestamp("updated_at").alias("updated_at"))
    rows = rows.where("src_id is not null and dst_id is not null and edge_type is not null and src_id <> dst_id")
    order = (F.desc_nulls_last("updated_at"), F.desc_nulls_last("weight")) if newest else (F.asc_nulls_first("updated_at"), F.asc_nulls_first("weight"))
    state = latest(rows, ["src_id", "dst_id", "edge_type"], *order)
    return state.select("src_id", "dst_id", "edge_type", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def current_stats(doc_stats: DataFrame) -> DataFrame:
    """The newest row of each document's statistics."""
    rows = doc_stats.where("doc_id is not null").withColumn("at", F.try_to_timestamp("updated_at"))
    newest = latest(rows, ["doc_id"], F.desc_nulls_last("at"), F.desc_nulls_last("importance"))
    return newest.select("doc_id", "source_type", F.coalesce("has_source", F.lit(0)).alias("has_source"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


def current_sources(sources: DataFrame) -> DataFrame:
    """The ledger with one row per key: the newest state, with the first document and creation of the oldest."""
    rows = sources.where("source_key is not null").withColumn("at", F.try_to_timestamp("updated_at"))
    first = latest(rows, ["source_key"], F.asc_nulls_last("at"), "last_doc_id").select("source_key", "first_doc_id", "created_at")
    newest = latest(rows, ["source_key"], F.desc_nulls_last("at"), "last_doc_id").select("source_key", "canonical_url", "last_doc_id", "content_hash", "updated_at")
    return newest.join(first, "source_key")
