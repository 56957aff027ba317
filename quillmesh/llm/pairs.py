"""Broken instruction-response pairs.

Refusals are found by their openings: the first sentences of responses are
clustered by MinHash, every link is verified, and an opening whose cluster
recurs across unrelated instructions, mostly with hardly anything after it, is
a template that declines.  What is too rare to recur is told by the collection
as well: an opening that says nothing of its prompt, in words that no fuller
answer and no prompt uses.  No phrases are listed.  Emptiness, copying,
language and termination are checks of a single pair; the last asks the
collection whether an unpunctuated end is a whole word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import pair_checks as C
from quillmesh.operators.components import connected_components
from quillmesh.llm.neardup import letters_and_digits, run_hashes
from quillmesh.session import cut

#: Share of a response's runs that must come from instruction and context in a copy.
COPIED = 0.7
#: Instructions an opening must recur across, the least share of its responses with at most one more sentence, and its fewest letters: short answers recur too.
RECURS, BARE, LETTERS = 2, 0.5, 9
#: Sentences that may follow a template.
AFTER = 2
#: Share of a lone opening's terms that nothing else uses, its fewest terms, and the most that any opening may share with its prompt.
FOREIGN, TERMS, SHARED = 0.4, 4, 0.2
#: MinHash bands and rows, and the similarity of openings of one cluster (runs of five characters).
BANDS, ROWS, SIMILAR = 10, 4, 0.8
#: Responses that use a word before their last one, from which on it counts as a whole word.
KNOWN_WORD = 2

_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for pair_id, instruction, context, response in zip(batch["pair_id"], batch["instruction"], batch["context"], batch["response"]):
            prompt = xxhash.xxh64_intdigest(letters_and_digits(instruction)) - (1 << 63)
            defect = "empty" if C.is_empty(response) else "copy" if C.copied_share(instruction, context, response) >= COPIED else None
            if defect:
                rows.append((pair_id, prompt, defect, None, 0, 0.0, None, False, False, None))
                continue
            parts = C.sentences(response)
            first = parts[0] if parts else ""
            terms, asked = C.terms_of(first), C.terms_of(f"{instruction or ''}\n{context or ''}")
            own = terms & asked
            spoken, written = C.language(instruction or ""), C.language(response)
            other = bool(spoken and written and spoken != written)
            foreign = other and written not in C.languages_asked(instruction, context)
            how, word = C.ending(response)
            wanted = C.WANTS_REFUSAL.search(f"{instruction or ''}\n{context or ''}") is not None
            verdict = "wrong_language" if foreign else "truncated" if how == "cut" else None
            # Only an opening with hardly anything after it is looked up term by term.  Words are strange, too, where they are of another language.
            looked_up = not other and len(parts) <= 2 and len(terms) >= TERMS and len(own) <= SHARED * len(terms)
            lone = [{"term": t, "own": int(t in own or len(parts) > 1)} for t in sorted(terms)] if looked_up else None
            rows.append((pair_id, prompt, verdict, C.opening(response), len(parts) - 1, len(own) / max(1, len(terms)), lone, wanted, how == "open" and bool(word), word or None))
        yield pd.DataFrame(rows, columns=["pair_id", "prompt", "verdict", "opening", "more", "shared", "lone", "wanted", "asks", "word"])


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["opening"]:
            runs = run_hashes(text, 5)
            if len(runs):
                lowest = (runs[:, None] * _SEEDS[0] + _SEEDS[1]).min(axis=0).reshape(BANDS, ROWS)
                rows += [(text, band, values.tobytes()) for band, values in enumerate(lowest)]
        yield pd.DataFrame(rows, columns=["opening", "band", "bucket"])


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each opening to those before it in its bucket that stand for it; one that resembles none of them stands for itself.  Rows come sorted by band and bucket."""
    at, heads = None, []
    for batch in batches:
        rows = []
        for opening, band, bucket in zip(batch["opening"], batch["band"], batch["bucket"]):
            if (band, bucket) != at:
                # Most buckets have one opening, whose runs nobody asks for.
                at, heads = (band, bucket), [[opening, None]]
                continue
            x = run_hashes(opening, 5)
            linked = False
            for held in heads:
                if held[1] is None:
                    held[1] = run_hashes(held[0], 5)
                y = held[1]
                if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= SIMILAR * (len(x) + len(y) - common):
                    rows.append((opening, held[0]))
                    linked = True
            if not linked:
                heads.append([opening, x])
        yield pd.DataFrame(rows, columns=["a", "b"])


def opening_templates(looked: DataFrame) -> DataFrame:
    """``opening, prompts, bare, shared`` of every opening: the distinct instructions of its cluster, the share of its responses with at most one more sentence, and the mean share of terms taken from the prompt.

    Clusters are the connected components of verified links between all
    distinct openings, those that occur once included.
    """
    # Distinct prompts are counted first, so that a pair repeated under other ids is one, and a frequent opening one row.
    once = looked.where("opening <> ''").groupBy("opening", "prompt").agg(F.min("more").alias("more"), F.max("shared").alias("shared"))
    signed = once.select("opening").distinct().mapInPandas(_sign, "opening string, band int, bucket binary")
    links = cut(signed.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "opening").mapInPandas(_link, "a string, b string").distinct())
    parts = connected_components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    own = once.withColumn("node", F.xxhash64("opening")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = own.groupBy("component").agg(F.count_distinct("prompt").alias("prompts"), F.avg((F.col("more") <= 1).cast("double")).alias("bare"), F.avg("shared").alias("shared"))
    return own.select("opening", "component").distinct().join(whole, "component").select("opening", "prompts", "bare", "shared")


def _terms(text: Column) -> Column:
    """``pair_checks.terms_of`` as an expression, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substr(w, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(F.rlike(w, F.lit(r"[぀-ヿ㐀-鿿]")), pairs(w)).otherwise(F.array(w))))


def defective_pairs(pairs: DataFrame, pair_id: str = "pair_id", instruction: str = "instruction", context: str = "context", response: str = "response") -> DataFrame:
    """Every pair with a defect, ``pair_id, defect``: empty, copy, refusal, wrong_language or truncated, the first that holds.

    Null contexts count as blank; with a null instruction only emptiness,
    refusal and termination can be told.  A refusal that the instruction or
    context asks for, and a language that it names, are none.  Texts are read
    whole; rows repeated under one id give one row; no rows give none.
    """
    rows = pairs.select(F.col(pair_id).alias("pair_id"), *(F.col(c).cast("string").alias(n) for c, n in ((instruction, "instruction"), (context, "context"), (response, "response")))).where("pair_id is not null")
    fields = "pair_id long, prompt long, verdict string, opening string, more int, shared double, lone array<struct<term:string,own:int>>, wanted boolean, asks boolean, word string"
    # Written once: the templates and the verdicts read it several times.
    looked = cut(rows.withColumn("pair_id", F.col("pair_id").cast("long")).mapInPandas(_look, fields))
    templates = opening_templates(looked)
    # What the collection says of words: how often a response uses one before its last word, and how many prompts and fuller answers have it.
    last, lone = looked.where("asks").select("word").distinct(), looked.where("lone is not null").select("pair_id", F.explode("lone").alias("l")).select("pair_id", F.col("l.term").alias("word"), "l.own")
    asked = last.unionByName(lone.select("word")).distinct()
    inner = F.regexp_extract_all(F.lower("response"), F.lit(r"[\p{L}]+(?:['’][\p{L}]+)?(?=[^\p{L}]+[\p{L}])"), F.lit(0))
    fuller = F.size(F.regexp_extract_all("response", F.lit(r"\p{L}[^.!?。！？\n]*"), F.lit(0))) > 1
    texts = F.concat_ws("\n", "instruction", "context", F.when(fuller, F.col("response")))
    uses = F.concat(*(F.transform(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), lambda w: F.struct(w.alias("word"), F.lit(a).alias("inner"), F.lit(b).alias("common"))) for words, a, b in ((inner, 1, 0), (_terms(texts), 0, 1))))
    used = rows.select(F.explode(uses).alias("u")).select("u.*").join(asked, "word", "left_semi").groupBy("word").agg(F.sum("inner").alias("inner"), F.sum("common").alias("common"))
    used = cut(used)
    known = used.where(F.col("inner") >= KNOWN_WORD).select("word", F.lit(True).alias("known"))
    strange = lone.join(used, "word", "left").groupBy("pair_id").agg(F.avg((F.coalesce("common", F.lit(0)) <= F.col("own")).cast("double")).alias("strange"))
    full = looked.drop("lone", "shared").join(templates, "opening", "left").join(known, "word", "left").join(strange, "pair_id", "left")
    template = (F.col("prompts") >= RECURS) & (F.col("bare") >= BARE) & (F.col("more") <= AFTER) & (F.col("shared") <= SHARED) & (F.length("opening") >= LETTERS)
    declines = F.coalesce(template, F.lit(False)) | (F.coalesce("strange", F.lit(0.0)) >= FOREIGN)
    broken_word = F.col("asks") & F.col("known").isNull()
    defect = (
        F.when(F.col("verdict").isin("empty", "copy"), F.col("verdict"))
        .when(declines & ~F.col("wanted"), "refusal")
        .when(declines & F.col("wanted") & (F.col("verdict").isNull() | (F.col("verdict") == "truncated")), F.lit(None))
        .when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(broken_word, "truncated")
    )
    return full.select("pair_id", defect.alias("defect")).where("defect is not null").distinct()
