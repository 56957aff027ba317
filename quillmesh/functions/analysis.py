"""Prompts for, and answers of, a language model that describes documents.

The model itself is passed in as a function; nothing here calls a service.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a body that a prompt takes.
BODY_CHARS = 8000
REF = "array<struct<id:string,label:string>>"
SCHEMA = (
    "title string, summary string, why_important string, key_points array<string>, "
    f"primary_concepts {REF}, candidate_concepts {REF}, display_tags array<string>, entities {REF}, confidence double, importance double"
)


def analysis_prompt(base: str, specific: Column, title: Column, url: Column, body: Column) -> Column:
    """General and type-specific instructions, then the document's title, source and body."""
    source = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("Source: "), url, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(base), F.lit("\n\n---\n\n"), specific, F.lit("\n\n---\n\n## Input\n\nTitle: "), title, F.lit("\n"), source, F.lit("\n"), F.left(body, F.lit(BODY_CHARS)))


def with_header(source_type: Column, body: Column, **known: Column) -> Column:
    """``body`` after what is known of a paper (authors, doi, arxiv_id) or a repository (description, language); other types have no header."""
    # The names that the lines of a header begin with.
    papers = {"authors": "Authors", "doi": "DOI", "arxiv_id": "arXiv"}
    repositories = {"description": "Description", "language": "Language"}

    def header(names: dict[str, str]) -> Column:
        lines = [F.when(F.coalesce(known[k], F.lit("")) != "", F.concat(F.lit(f"{name}: "), known[k])) for k, name in names.items() if k in known]
        joined = F.concat_ws("\n", *lines) if lines else F.lit("")
        return F.when(joined != "", F.concat(joined, F.lit("\n\n"), body)).otherwise(body)

    return F.when(source_type == "paper", header(papers)).when(source_type.isin("repo", "git_repo"), header(repositories)).otherwise(body)


def first_json(answer: str | None) -> str | None:
    """The first complete JSON object or array in an answer, inside or outside of a code fence."""
    if not answer:
        return None
    decoder = json.JSONDecoder()
    for at, c in enumerate(answer):
        if c in "{[":
            try:
                _, end = decoder.raw_decode(answer, at)
            except ValueError:
                continue
            return answer[at:end]
    return None


def _refs(items: object) -> list[dict]:
    out = []
    for item in items if isinstance(items, list) else []:
        if isinstance(item, str) and item.strip():
            out.append({"id": item.strip().lower().replace(" ", "-"), "label": item.strip()})
        elif isinstance(item, dict) and item.get("id"):
            out.append({"id": str(item["id"]), "label": str(item.get("label") or item["id"])})
    return out


def read_analysis(answer: str | None) -> dict:
    """An answer as a record of ``SCHEMA``; what is missing or of another type gets its default."""
    text = first_json(answer)
    data = json.loads(text) if text else {}
    data = data if isinstance(data, dict) else {}

    def words(key: str) -> list[str]:
        return [str(x) for x in data[key]] if isinstance(data.get(key), list) else []

    def number(key: str) -> float:
        return float(data[key]) if isinstance(data.get(key), (int, float)) and not isinstance(data.get(key), bool) else 0.0

    return {
        **{k: str(data.get(k) or "") for k in ("title", "summary", "why_important")},
        "key_points": words("key_points"),
        "primary_concepts": _refs(data.get("primary_concepts")),
        "candidate_concepts": _refs(data.get("candidate_concepts")),
        "display_tags": words("display_tags"),
        "entities": _refs(data.get("entities")),
        "confidence": number("confidence"),
        "importance": number("importance"),
    }


def read_analyses(answers: DataFrame, answer: str = "answer", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and the fields of ``SCHEMA`` for every answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "json": [json.dumps(read_analysis(a), ensure_ascii=False) for a in batch["answer"]]})

    rows = answers.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(answer).alias("answer")).mapInPandas(run, "doc_id string, json string")
    return rows.select("doc_id", F.from_json("json", SCHEMA).alias("a")).select("doc_id", "a.*")


def analyse(documents: DataFrame, model: Callable[[str], str], prompt: str = "prompt", doc_id: str = "doc_id", tries: int = 3) -> DataFrame:
    """``doc_id, answer, error`` of a model function run inside the tasks, retried when it raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, p in zip(batch["doc_id"], batch["prompt"]):
                answer, error = None, None
                for _ in range(tries):
                    try:
                        answer, error = model(p), None
                        break
                    except Exception as e:
                        error = str(e)[:500]
                out.append((i, answer, error))
            yield pd.DataFrame(out, columns=["doc_id", "answer", "error"])

    return documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(prompt).alias("prompt")).mapInPandas(run, "doc_id string, answer string, error string")


def concept_rows(analysis: DataFrame) -> DataFrame:
    """Assignments of an analysis, ``doc_id, concept_id, role, weight``: primary ones weigh 1, candidates 0.5."""
    parts = [analysis.select("doc_id", F.explode(c).alias("c"), F.lit(role).alias("role"), F.lit(w).alias("weight")) for c, role, w in (("primary_concepts", "primary", 1.0), ("candidate_concepts", "candidate", 0.5))]
    return parts[0].unionByName(parts[1]).select("doc_id", F.col("c.id").alias("concept_id"), "role", "weight")


def without_analysis(documents: DataFrame, analysis: DataFrame) -> DataFrame:
    """Documents whose analysis has no confidence; 0 counts as analysed."""
    return documents.join(analysis.where("confidence is not null").select("doc_id"), "doc_id", "left_anti")


def _scalar(text: str) -> str:
    """``functions.text.yaml_scalar`` of one value."""
    if text == "" or ": " in text or "\n" in text or text[-1] in ": " or re.match(r"""[-?{"'\[\]{}#&*!|>%@`,]""", text):
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return text


# Keys of a front matter that an analysis owns, and its version.
OWNED, VERSION = ("summary", "analysis", "concepts", "tags_display"), "analyzer_v1"


def analysed_text(text: str, found: dict) -> str:
    """``text`` with an analysis in its front matter, in place of an earlier one; a text without a front matter stays as it is."""
    parts = re.match(r"(?s)\A---\n(.*?)\n---(?=\n|\Z)", text or "")
    if not parts:
        return text
    # A top-level key begins a block; the blocks of an earlier analysis go.
    blocks = re.split(r"(?m)^(?=[^\s#-][^\n]*:)", parts[1])
    kept = [b.rstrip("\n") for b in blocks if b.strip() and b.split(":", 1)[0].strip() not in OWNED]
    lines = [*kept, f"summary: {_scalar(found.get('summary') or '')}", "analysis:", f"  analyzer_version: {VERSION}"]
    lines += [f"  {name}: {float(found.get(name) or 0.0)}" for name in ("confidence", "importance")]
    lines.append("concepts:")
    for group, weight, items in (("primary", 1.0, found.get("primary_concepts")), ("candidates", 0.5, found.get("candidate_concepts")), ("entities", None, found.get("entities"))):
        if items is not None and len(items):
            lines.append(f"  {group}:")
            for item in items:
                lines += [f"    - id: {'' if weight is None else 'concept:'}{item['id']}", f"      label: {_scalar(item['label'] or '')}"]
                lines += [] if weight is None else [f"      weight: {weight}"]
    tags = found.get("display_tags")
    if tags is not None and len(tags):
        lines += ["tags_display:", *(f"  - {_scalar(tag)}" for tag in tags)]
    return "---\n" + "\n".join(lines) + "\n---" + text[parts.end() :]


def write_analyses(documents: DataFrame, analyses: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """``doc_id, content`` of every document, with its analysis (fields of ``SCHEMA``, as many as there are) written into the front matter; without one it stays."""
    names = [c for c in analyses.columns if c != "doc_id"]
    found = analyses.select("doc_id", F.struct(*names).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": [t if f is None else analysed_text(t, f) for t, f in zip(batch["content"], batch["found"])]})

    rows = documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content")).join(found, "doc_id", "left")
    return rows.mapInPandas(run, "doc_id string, content string")


def edited_text(text: str, memo: str | None = None, rating: str | float | None = None) -> str:
    """``text`` with a memo and a rating set in its front matter, or taken out where they are blank; a rating that is no number is left alone."""
    import yaml

    parts = re.match(r"(?s)\A---\n(.*?)\n---\n*(.*)", text or "")
    meta = (yaml.safe_load(parts[1]) if parts else None) or {}
    body = parts[2] if parts else text
    for name, value in (("memo", (memo or "").strip()), ("rating", str(rating if rating is not None else "").strip())):
        if not value:
            meta.pop(name, None)
            continue
        try:
            meta[name] = float(value) if name == "rating" else value
        except ValueError:
            pass
    front = yaml.safe_dump(meta, allow_unicode=True, default_flow_style=False, sort_keys=False)
    return f"---\n{front}---\n\n{body}" + ("" if body.endswith("\n") else "\n")
