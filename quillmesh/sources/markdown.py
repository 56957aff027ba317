"""Markdown files with a front matter as a source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import front_matter


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path, name, content`` of every file below ``path``, each file whole."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with an id in their front matter: ``id, title, source, source_type, rel_path, content, meta``."""
    meta, body = front_matter(F.col("content"))
    rows = read_files(spark, path).select("path", meta.alias("meta"), body.alias("body")).where("meta['id'] is not null and meta['id'] <> ''")
    return rows.select(
        F.col("meta")["id"].alias("id"), F.coalesce(F.col("meta")["title"], F.lit("")).alias("title"), F.coalesce(F.col("meta")["source"], F.lit("")).alias("source"),
        F.coalesce(F.col("meta")["source_type"], F.lit("web")).alias("source_type"), F.col("path").alias("rel_path"), F.col("body").alias("content"), "meta",
    )


def concepts_of(meta: object) -> tuple[list[str], list[tuple[str, str]]]:
    """Concepts and entities of a parsed front matter, in any of its four forms: a comma list, a list of names, a list of records, or a record of lists."""
    given = meta.get("concepts") if isinstance(meta, dict) else None
    entities: list[tuple[str, str]] = []

    def names(items: object) -> list[str]:
        if isinstance(items, str):
            return [x.strip() for x in items.split(",") if x.strip()]
        out = []
        for item in items if isinstance(items, list) else []:
            name = str(item.get("id") or "").removeprefix("concept:") if isinstance(item, dict) else str(item)
            if name.strip():
                out.append(name.strip())
        return out

    if isinstance(given, dict):
        for item in given.get("entities") or []:
            key = str(item.get("id") or "").strip() if isinstance(item, dict) else str(item).strip()
            if key:
                entities.append((key, str(item.get("label") or key) if isinstance(item, dict) else key))
        return names(given.get("primary")) + names(given.get("candidates")), entities
    return names(given), entities


def read_concepts(files: DataFrame) -> DataFrame:
    """``doc_id, kind, name, label`` of the concepts and entities that files (``content``) name; broken YAML names none."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for text in batch["content"]:
                found = re.match(r"\A---\n(.*?)\n---", text or "", re.S)
                try:
                    meta = yaml.safe_load(found[1]) if found else None
                except yaml.YAMLError:
                    meta = None
                if isinstance(meta, dict) and meta.get("id"):
                    concepts, entities = concepts_of(meta)
                    rows += [(str(meta["id"]), "concept", c, c) for c in concepts] + [(str(meta["id"]), "entity", k, label) for k, label in entities]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "name", "label"])

    return files.select("content").mapInPandas(run, "doc_id string, kind string, name string, label string")
