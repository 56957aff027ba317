"""Parsed sources: papers, PDFs, repositories and videos, from captured bytes and records.

Fetching is left to whoever captures them; text extractors are passed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.keys import arxiv_id, doi, repo_name, video_id

#: Characters of a PDF's text that its document keeps, as its reader defines it.
PDF_CHARS = 5000
REPOSITORY = "full_name string, description string, language string, stargazers_count long, html_url string, license struct<spdx_id:string>, topics array<string>"
VIDEO = "title string, author_name string, thumbnail_url string"


def classify_paper(text: Column) -> Column:
    """``kind, identifier`` of what was typed for a paper: an arXiv id, a DOI, or neither (raw)."""
    bare = F.trim(text)
    is_arxiv = F.rlike(bare, F.lit(r"(?i)^(?:https?://)?(?:www\.)?(?:arxiv\.org/(?:abs|pdf|html)/|arxiv:)?(?:\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)(?:\.pdf)?$"))
    is_doi = F.rlike(bare, F.lit(r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)?10\.\d{4,9}/\S+$"))
    kind = F.when(is_arxiv, "arxiv").when(is_doi, "doi").otherwise("raw")
    return F.struct(kind.alias("kind"), F.when(is_arxiv, arxiv_id(bare)).when(is_doi, doi(bare)).otherwise(bare).alias("identifier"))


def doi_records(captured: DataFrame, record: str = "record") -> DataFrame:
    """Title, authors, year, summary and DOI of captured citation records (CSL JSON); a broken record leaves empty fields."""
    # Fields of a citation record.
    schema = "title string, DOI string, abstract string, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>"
    parsed = captured.withColumn("_d", F.from_json(record, schema))
    names = F.transform("_d.author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    return parsed.select(
        *captured.columns, F.coalesce("_d.title", F.lit("")).alias("title"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("authors"),
        F.col("_d.issued.date-parts")[0][0].cast("string").alias("year"), F.trim(F.regexp_replace(F.coalesce("_d.abstract", F.lit("")), "<[^>]*>", " ")).alias("summary"), F.lower("_d.DOI").alias("doi"),
    )


def paper_records(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """Title, summary, authors and year of captured Atom entries."""

    def at(path: str) -> Column:
        return F.trim(F.regexp_replace(F.xpath_string(feed, F.lit(path)), r"\s+", " "))

    entry = "//*[local-name()='entry'][1]/*[local-name()='{}']"
    authors = F.xpath(feed, F.lit("//*[local-name()='entry'][1]/*[local-name()='author']/*[local-name()='name']/text()"))
    return feeds.select("*", at(entry.format("title")).alias("title"), at(entry.format("summary")).alias("summary"), F.array_join(authors, ", ").alias("authors"), F.left(at(entry.format("published")), F.lit(4)).alias("year"))


def repository_records(captured: DataFrame, record: str = "record", readme: str = "readme") -> DataFrame:
    """Captured repository records (JSON) with their README (base64) as title, url, body."""
    parsed = captured.withColumn("_r", F.from_json(record, REPOSITORY)).withColumn("_readme", F.coalesce(F.decode(F.unbase64(F.regexp_replace(readme, r"\s", "")), "UTF-8"), F.lit("")))
    facts = F.concat_ws("\n", *(F.concat(F.lit(f"- {name}: "), F.col(column).cast("string")) for name, column in (("Language", "_r.language"), ("Stars", "_r.stargazers_count"), ("License", "_r.license.spdx_id"))))
    body = F.concat_ws("\n\n", F.nullif(F.coalesce("_r.description", F.lit("")), F.lit("")), F.nullif(facts, F.lit("")), F.nullif(F.col("_readme"), F.lit("")))
    return parsed.withColumn("title", F.coalesce("_r.full_name", repo_name(F.col("_r.html_url")))).withColumn("url", F.col("_r.html_url")).withColumn("body", body).drop("_r", "_readme")


def video_records(captured: DataFrame, url: str = "url", record: str = "record") -> DataFrame:
    """Captured video records (JSON) with the id from the URL; a broken record leaves empty fields."""
    parsed = captured.withColumn("_v", F.from_json(record, VIDEO))
    return parsed.select(*captured.columns, video_id(F.col(url)).alias("video_id"), F.coalesce("_v.title", F.lit("")).alias("title"), F.coalesce("_v.author_name", F.lit("")).alias("author"))


def pdf_documents(blobs: DataFrame, extract: Callable[[bytes], list[str | None]]) -> DataFrame:
    """``path, body`` of PDF bytes; ``extract`` gives the text of each page, None for a page it can't read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for content in batch["content"]:
                text = "\n\n".join(p for p in extract(bytes(content)) if p)
                bodies.append(text if len(text) <= PDF_CHARS else text[:PDF_CHARS] + "\n\n... [truncated]")
            yield pd.DataFrame({"path": batch["path"], "body": bodies})

    return blobs.select("path", "content").mapInPandas(run, "path string, body string")
