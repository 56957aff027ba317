"""Quality metrics over the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.keys import bare_hash
from quillmesh.functions.text import FRONT_MATTER


def source_type_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_type").agg(F.count("*").alias("n"))


def importance_buckets(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents by importance: high from 0.7, medium from 0.4, low above 0, else (or without statistics) unscored."""
    joined = docs.select("id").join(stats.select(F.col("doc_id").alias("id"), "importance"), "id", "left")
    bucket = F.when(F.col("importance") >= 0.7, "high").when(F.col("importance") >= 0.4, "medium").when(F.col("importance") > 0, "low").otherwise("unscored")
    return joined.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def orphans(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Documents without concepts."""
    return docs.select("id").join(assigned.select(F.col("doc_id").alias("id")), "id", "left_anti")


def isolated(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents at neither end of a related edge."""
    related = edges.where("edge_type = 'related'")
    ends = related.select(F.col("src_id").alias("id")).unionByName(related.select(F.col("dst_id").alias("id")))
    return docs.select("id").join(ends, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree`` over all edges at either end; counted on each side first, so that a hub target is one row per task."""
    ends = edges.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("n")))
    return ends.groupBy("id").agg(F.sum("n").alias("degree"))


def duplicate_contents(docs: DataFrame) -> DataFrame:
    """Stored hashes that several documents have, with their number."""
    hashed = docs.where("content_hash is not null").groupBy(bare_hash(F.col("content_hash")).alias("content_hash")).agg(F.count("*").alias("n"))
    return hashed.where("n > 1")


def duplicate_source_keys(sources: DataFrame) -> DataFrame:
    """Keys that the ledger holds more than once."""
    return sources.where("source_key is not null").groupBy("source_key").agg(F.count("*").alias("n")).where("n > 1")


def doctor(docs: DataFrame, sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """``id, problem`` of documents without a title, content or path, of ledger keys held twice, and of documents (``indexed``: id) the index lacks or has in excess."""
    checks = [("title", "no title"), ("content", "no content"), ("rel_path", "no path")]
    problems = [docs.where(F.coalesce(F.trim(c), F.lit("")) == "").select("id", F.lit(text).alias("problem")) for c, text in checks]
    problems.append(duplicate_source_keys(sources).select(F.col("source_key").alias("id"), F.lit("source key twice").alias("problem")))
    problems.append(docs.select("id").join(indexed, "id", "left_anti").select("id", F.lit("not indexed").alias("problem")))
    problems.append(indexed.select("id").join(docs, "id", "left_anti").select("id", F.lit("no document").alias("problem")))
    out = problems[0]
    for more in problems[1:]:
        out = out.unionByName(more)
    return out.distinct()


def file_problems(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """``path, problem`` of Markdown files without a front matter that ends, without one of the fields it must have, or without an analysis."""
    # Fields that every document has.
    required = ("id", "title", "source_type", "source_key", "content_hash")
    front = F.regexp_extract(content, FRONT_MATTER, 1)
    checks = [F.when(~F.rlike(content, F.lit(FRONT_MATTER)), "no front matter")]
    checks += [F.when(F.rlike(content, F.lit(FRONT_MATTER)) & ~F.rlike(front, F.lit(rf"(?m)^{name}:")), f"no {name}") for name in required]
    checks.append(F.when(~F.rlike(front, F.lit(r"(?m)^\s*confidence:")), "no analysis"))
    found = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    return found.unionByName(files.where(F.col(content).isNull()).select(F.col(path).alias("path"), F.lit("no front matter").alias("problem")))


def missing_notes(frequency: DataFrame, noted: DataFrame, min_df: int = 2) -> DataFrame:
    return frequency.where(F.col("df") >= min_df).join(noted, "concept_id", "left_anti").select("concept_id", "df")


def hubs(frequency: DataFrame, hub: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent concepts above the hub threshold."""
    return frequency.crossJoin(F.broadcast(hub)).where("df > hub").select("concept_id", "df").orderBy(F.desc("df"), "concept_id").limit(limit)


def overview(docs: DataFrame, assigned: DataFrame, edges: DataFrame, concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of totals, averages and rates; averages are over the documents that have the thing counted."""
    related = edges.where("edge_type = 'related'")
    total = docs.agg(F.count("*").alias("documents"))
    parts = [
        concepts.where("coalesce(is_stop, 0) = 0").agg(F.count("*").alias("concepts")),
        related.agg(F.count("*").alias("related_edges")),
        edges.where("edge_type = 'cooccurrence'").agg(F.count("*").alias("cooccurrence_edges")),
        orphans(docs, assigned).agg(F.count("*").alias("orphans")),
        isolated(docs, edges).agg(F.count("*").alias("isolated")),
        assigned.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("concepts_per_document")),
        related.groupBy("src_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("related_per_document")),
        degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree")),
        duplicate_contents(docs).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies")),
        duplicate_source_keys(sources).agg(F.count("*").alias("duplicate_keys")),
    ]
    for part in parts:
        total = total.crossJoin(F.broadcast(part))
    some = F.greatest(F.col("documents"), F.lit(1))
    return total.withColumn("connectivity", F.round(1 - F.col("isolated") / some, 6)).withColumn("duplicate_rate", F.round(F.col("copies") / some, 6)).drop("copies")
