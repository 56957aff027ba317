"""Records of instruction pairs for fine-tuning, as column expressions and one cleaning step."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.analysis import first_json


def _clean(column: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^\s+|\s+$", ""))


def distinct_pairs(pairs: DataFrame, order: str = "pair_id") -> DataFrame:
    """Pairs with an instruction and a response, the first of each instruction (compared in lower case by the start of its SHA-1)."""
    rows = pairs.withColumn("instruction", _clean("instruction")).withColumn("context", _clean("context")).withColumn("response", _clean("response"))
    rows = rows.where("instruction <> '' and response <> ''").withColumn("key", F.left(F.sha1(F.lower("instruction")), F.lit(12)))
    first = Window.partitionBy("key").orderBy(order)
    return rows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place", "key")


def user_text() -> Column:
    return F.when(F.col("context") != "", F.concat("instruction", F.lit("\n\n"), "context")).otherwise(F.col("instruction"))


def chat_record(system: str) -> Column:
    """``messages``: system, user and assistant."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", user_text()), message("assistant", F.col("response")))


def instruction_record() -> list[Column]:
    """``instruction``, ``input`` and ``output``."""
    return [F.col("instruction"), F.col("context").alias("input"), F.col("response").alias("output")]


def read_generated(answers: DataFrame, order: str, doc_id: str = "doc_id", answer: str = "answer") -> DataFrame:
    """Pairs of model answers, ``at, doc_id, place, instruction, context, response, difficulty, tags``, the first of each instruction.

    An answer holds a JSON array of pairs somewhere; one without gives none.
    Items that aren't records, and pairs with a blank instruction or response,
    are left out; missing fields become empty.  ``at`` is ``order``, which with
    the place in the answer decides who comes first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, doc, text in zip(batch["at"], batch["doc_id"], batch["answer"]):
                found = next((x for x in arrays_of(text) if any(isinstance(p, dict) for p in x)), [])
                for place, pair in enumerate(found):
                    if isinstance(pair, dict):
                        tags = pair.get("tags") if isinstance(pair.get("tags"), list) else []
                        rows.append((at, doc, place, *(str(pair.get(c) or "") for c in ("instruction", "context", "response", "difficulty")), [str(x) for x in tags]))
            yield pd.DataFrame(rows, columns=["at", "doc_id", "place", "instruction", "context", "response", "difficulty", "tags"])

    rows = answers.select(F.col(order).cast("long").alias("at"), F.col(doc_id).cast("string").alias("doc_id"), F.col(answer).cast("string").alias("answer"))
    pairs = rows.mapInPandas(run, "at long, doc_id string, place int, instruction string, context string, response string, difficulty string, tags array<string>")
    return distinct_pairs(pairs.withColumn("_turn", F.struct("at", "place")), order="_turn").drop("_turn")


def arrays_of(answer: str | None) -> Iterator[list]:
    """The JSON arrays of an answer, outermost ones in order."""
    rest = answer or ""
    while (text := first_json(rest)) is not None:
        value = json.loads(text)
        if isinstance(value, list):
            yield value
        rest = rest[rest.index(text) + len(text) :]


def generation_counts(answers: DataFrame, kept: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row ``answers, documents, pairs`` of what was read and what was kept."""
    return answers.agg(F.count("*").alias("answers"), F.count_distinct(doc_id).alias("documents")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("pairs"))))


def training_prompt(template: str, title: Column, source_type: Column, summary: Column, concepts: Column, body: Column, pairs: int = 5, characters: int = 4000) -> Column:
    """``template`` with its places ``{title}``, ``{source_type}``, ``{summary}``, ``{concepts}``, ``{n_pairs}`` and ``{body}`` filled; of a longer body the first ``characters``, as the prompt is defined."""
    out = F.lit(template)
    filled = {"title": title, "source_type": F.coalesce(source_type, F.lit("web")), "summary": summary, "concepts": concepts, "n_pairs": F.lit(str(pairs)), "body": F.left(body, F.lit(characters))}
    for name, value in filled.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
