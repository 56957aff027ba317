"""Listings and views that are served from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 20
SORTS = ("date", "importance", "type")


def listing(docs: DataFrame, stats: DataFrame, sort: str = "date", page: int = 1, per_page: int = PAGE) -> DataFrame:
    """One page of documents, newest first, or by importance or type; an unknown order is by date."""
    rows = docs.join(stats.select(F.col("doc_id").alias("id"), "importance"), "id", "left")
    rows = rows.select("id", "title", "source_type", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    orders = {"date": [F.desc("id")], "importance": [F.desc("importance"), F.desc("id")], "type": [F.asc("source_type"), F.desc("id")]}
    return rows.orderBy(*orders.get(sort, orders["date"])).offset((max(page, 1) - 1) * per_page).limit(per_page)


def pages(docs: DataFrame, per_page: int = PAGE) -> DataFrame:
    """Total documents and pages, one page at least."""
    return docs.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long").alias("pages"))


def graph_view(docs: DataFrame, frequency: DataFrame, assigned: DataFrame, concepts: int = 50, documents: int = 100) -> DataFrame:
    """Links ``source, target`` between the most frequent concepts and the first documents by title that have one of them."""
    top = frequency.where("is_stop = 0 and df > 0").orderBy(F.desc("df"), "concept_id").limit(concepts).select("concept_id")
    links = assigned.join(F.broadcast(top), "concept_id", "left_semi")
    shown = docs.join(links.select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "title").orderBy("title", "id").limit(documents)
    kept = links.join(F.broadcast(shown.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return kept.select(F.concat(F.lit("d:"), "doc_id").alias("source"), F.concat(F.lit("c:"), "concept_id").alias("target"))


def category(docs: DataFrame, stats: DataFrame, source_type: str) -> DataFrame:
    """Documents whose statistics name the type, most important first."""
    rows = docs.select("id", "title").join(stats.where(F.col("source_type") == source_type).select(F.col("doc_id").alias("id"), "importance"), "id")
    return rows.orderBy(F.desc("importance"), "title", "id")


def concept_documents(docs: DataFrame, assigned: DataFrame, concept: str) -> DataFrame:
    """Documents of a concept by title."""
    has = assigned.where(F.col("concept_id") == concept.strip().lower()).select(F.col("doc_id").alias("id"))
    return docs.join(has, "id", "left_semi").select("id", "title", "source_type").orderBy("title", "id")


def select_documents(docs: DataFrame, text: str | None = None, source_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents of a type whose metadata mention ``text``, in order of path."""
    rows = docs
    if source_type:
        rows = rows.where(F.col("source_type") == source_type)
    if text:
        meta = F.lower(F.to_json(F.struct("id", "title", "source", "source_type")))
        rows = rows.where(F.contains(meta, F.lit(text.lower())))
    rows = rows.orderBy("rel_path", "id")
    return rows.limit(limit) if limit is not None else rows


def concept_list(frequency: DataFrame, limit: int = 200) -> DataFrame:
    """The most frequent concepts that aren't stops and have a document; ties by label, then by id."""
    rows = frequency.where("is_stop = 0 and df >= 1").select("concept_id", "label", "df")
    return rows.orderBy(F.desc("df"), "label", "concept_id").limit(limit)
