"""Mapping freely typed values to the entries of a canonical list.

Values and entries become bags of tokens.  Each distinct token that the list
doesn't know is repaired by joining it to the list's vocabulary: by edit
distance (through shared deletion variants, so that no token meets the whole
vocabulary), as an abbreviation with a full stop, or as a plural acronym.  The
repaired tokens then meet the entries under each entry's rarest token, and soft
TF-IDF ranks the entries that are completely covered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

# Words around a value that say nothing about which entry is meant.
FILLERS = frozenset(
    "a about an and basics concept draft etc for general intro introduction keyword label misc note notes of on overview re see stuff tag the topic various wip など について メモ その他".split()
)
#: Words shorter than this are never repaired; words of LONG or more letters may have two edits, others one.
SHORT, LONG = 4, 8
MIN_SCORE = 0.7
#: Words of more letters are compared by their fifths, since they have very many deletion variants.
FIFTHS = 38

_KANA = re.compile(r"[぀-ヿ㐀-鿿]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]{2})")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_DOTTED = re.compile(r"^\W*((?:[^\W\d_]\.){2,}[^\W\d_]?)\.?\W*$")
_ACRONYM = re.compile(r"\(\s*([^\W\d_]{2,8})\s*\)\s*$")


def fold(text: str) -> str:
    """Compatibility forms unified, accents dropped (kana keep their marks), upper case kept."""
    text = unicodedata.normalize("NFKC", text)
    if _KANA.search(text):
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def tokens_of(text: str) -> list[tuple[str, bool]]:
    """Lower-case tokens of a value, each with whether a full stop marks it as cut short.

    ``CamelCase`` is split; ``A.B.C.`` is one token; a value with kana or kanji
    is one token without blanks, middle dots and long-vowel marks.
    """
    text = fold(text)
    if _KANA.search(text):
        squeezed = "".join(_WORD.findall(text)).replace("ー", "").replace("・", "").lower()
        return [(squeezed, False)] if squeezed else []
    if dotted := _DOTTED.match(text):
        return [(dotted[1].replace(".", "").lower(), False)]
    out = []
    for word in _WORD.finditer(_CAMEL.sub(" ", text)):
        end = word.end()
        out.append((word[0].lower(), _CAMEL.sub(" ", text)[end : end + 1] == "."))
    return out


def deletions(word: str, most: int) -> list[str]:
    """``word`` and everything up to ``most`` deletions make of it."""
    out = {word}
    for n in range(1, most + 1):
        out |= {"".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(len(word)), n)}
    return list(out)


def fifths(word: str) -> list[str]:
    """The five pieces of a word, with its length and their place.  Two edits, swaps across a border included, leave one piece whole."""
    n = len(word)
    return [f"{n} {i} {word[i * n // 5 : (i + 1) * n // 5]}" for i in range(5)]


def fifths_met(word: str) -> list[str]:
    """The fifths of any word within two edits that ``word`` may hold."""
    out = set()
    for n in range(len(word) - 2, len(word) + 3):
        for i in range(5):
            s, e = i * n // 5, (i + 1) * n // 5
            out |= {f"{n} {i} {word[s + by : e + by]}" for by in range(-2, 3) if s + by >= 0}
    return list(out)


def edits_allowed(word: str) -> int:
    return 0 if len(word) < SHORT else 1 if len(word) < LONG else 2


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours."""
    above, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, above, row = above, row, [i]
        for j, y in enumerate(b, 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
    return row[-1]


def _tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(raw, i, t, short) for raw in batch["raw"] for i, (t, short) in enumerate(tokens_of(raw))]
        yield pd.DataFrame(rows, columns=["raw", "at", "token", "short"])


def _entry_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for entry, label in zip(batch["entry"], batch["label"]):
            forms: dict[tuple[str, ...], str] = {}
            acronyms = set()
            for text in (entry, label):
                if text is None:
                    continue
                if own := _ACRONYM.search(fold(text)):
                    acronyms.add(own[1].lower())
                    text = fold(text)[: own.start()]
                words = [t for t, _ in tokens_of(text)]
                if words:
                    forms[tuple(sorted(set(words)))] = "words"
                if len(words) > 1:
                    forms.setdefault(("".join(words),), "joined")
                if len(words) > 2:
                    acronyms.add("".join(w[0] for w in words))
            for acronym in acronyms:
                forms.setdefault((acronym,), "acronym")
            rows += [(entry, list(words), kind) for words, kind in forms.items()]
        yield pd.DataFrame(rows, columns=["entry", "words", "kind"])


def _variants(listed: bool):
    """Keys under which a typed word meets listed ones: shared deletion variants, or fifths of long words."""

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 2000):
                rows = []
                for word in batch["word"][s : s + 2000]:
                    # Words of neighbouring lengths have both, so that any two within two edits share a kind of key.
                    if len(word) <= FIFTHS + 2:
                        rows += [(word, v) for v in deletions(word, edits_allowed(word))]
                    if len(word) > FIFTHS:
                        rows += [(word, v) for v in (fifths(word) if listed else fifths_met(word))]
                yield pd.DataFrame(rows, columns=["word", "variant"])

    return variants


def _closeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        d = [edit_distance(a, b) for a, b in zip(batch["token"], batch["word"])]
        near = [x <= min(edits_allowed(a), edits_allowed(b)) for x, a, b in zip(d, batch["token"], batch["word"])]
        similarity = [1.0 - x / max(len(a), len(b)) for x, a, b in zip(d, batch["token"], batch["word"])]
        yield pd.DataFrame({"token": batch["token"], "word": batch["word"], "similarity": similarity})[near]


def canonical_values(values: DataFrame, value: str, entries: DataFrame, entry: str, label: str, min_score: float = MIN_SCORE) -> DataFrame:
    """Each distinct non-blank value with the entry it means: ``raw, entry, score, how``.

    ``how`` is ``exact`` (the value is an entry or label as typed), ``repaired``
    or ``unmatched``, where entry and score are null.  An entry is meant when
    all its words are there, in any order, spelling and style, and no word is
    left over but fillers; sharing some words is not enough.  An acronym counts
    when only one entry has it.  Equal scores go to the smallest entry.  Null
    and blank values and null entries are left out, null labels ignored; with
    no entries everything is unmatched.
    """
    raw = values.select(F.col(value).cast("string").alias("raw")).where(r"raw is not null and raw rlike '(?U)\\S'").distinct()
    listed = entries.select(F.col(entry).cast("string").alias("entry"), F.col(label).cast("string").alias("label")).where("entry is not null")
    as_typed = listed.select("entry", F.explode(F.array("entry", "label")).alias("raw")).where("raw is not null").groupBy("raw").agg(F.min("entry").alias("exact"))
    looked = raw.join(as_typed, "raw", "left")

    # What later joins read several times is written once, which also keeps their plans small.
    forms = cut(listed.mapInPandas(_entry_forms, "entry string, words array<string>, kind string").distinct())
    owners = forms.groupBy("words").agg(F.countDistinct("entry").alias("owners"), F.max((F.col("kind") == "words").cast("int")).alias("spelled"))
    forms = forms.join(owners, "words").where((F.col("kind") == "words") | ((F.col("owners") == 1) & (F.col("spelled") == 0))).select("entry", "words").distinct()
    forms = cut(forms)
    words = forms.select("entry", "words", F.explode("words").alias("word"))
    frequency = words.groupBy("word").agg(F.countDistinct("entry").alias("df"))
    idf = frequency.crossJoin(F.broadcast(listed.agg(F.countDistinct("entry").alias("n")))).select("word", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    weighted = words.join(idf, "word").groupBy("entry", "words").agg(F.collect_list(F.struct("word", "idf")).alias("terms"))
    weighted = weighted.withColumn("key", F.sort_array(F.transform("terms", lambda t: F.struct((-t.idf).alias("rare"), t.word.alias("word"))))[0].word)

    weighted, vocabulary = cut(weighted), cut(frequency.select("word"))

    looked = cut(looked)
    parts = cut(looked.where("exact is null").select("raw").mapInPandas(_tokenize, "raw string, at int, token string, short boolean"))
    tokens = cut(parts.select("token", "short").distinct())
    same = tokens.select("token").distinct().join(vocabulary, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("similarity"))
    unknown = tokens.join(same.select("token"), "token", "left_anti")
    asked = unknown.where("not short").select(F.col("token").alias("word")).distinct().where(F.length("word") >= SHORT)
    deleted = asked.mapInPandas(_variants(False), "word string, variant string").withColumnRenamed("word", "token")
    known = vocabulary.where(F.length("word") >= SHORT).mapInPandas(_variants(True), "word string, variant string")
    # Two edits make four at most where swaps count twice; only what stays below is looked at for swaps.
    near = deleted.join(known, "variant").select("token", "word").distinct().where(F.levenshtein("token", "word", 4) >= 0).mapInPandas(_closeness, "token string, word string, similarity double")
    starts = vocabulary.where(F.length("word") > 3).withColumn("start", F.explode(F.expr("transform(sequence(3, length(word) - 1), n -> left(word, n))")))
    cut_short = unknown.where("short").join(starts, F.col("token") == F.col("start")).select("token", "word", F.lit(0.95).alias("similarity")).distinct()
    plural = unknown.where(F.col("token").rlike("^.{2,8}s$")).join(vocabulary, F.expr("left(token, length(token) - 1)") == F.col("word")).select("token", "word", F.lit(0.98).alias("similarity")).distinct()
    repairs = cut(same.unionByName(near).unionByName(cut_short).unionByName(plural).groupBy("token", "word").agg(F.max("similarity").alias("similarity")))

    read = cut(parts.join(repairs, "token"))
    filler = F.col("token").isin(*sorted(FILLERS))
    needed = parts.groupBy("raw").agg(F.collect_list(F.when(~filler, F.col("at"))).alias("needed"))
    mended = read.groupBy("raw").agg(F.collect_list(F.struct("at", "word", "similarity")).alias("read"))
    candidates = read.select("raw", F.col("word").alias("key")).distinct().join(weighted, "key").select("raw", "entry", "words", "terms").distinct()
    judged = candidates.join(mended, "raw").join(needed, "raw")
    best = F.transform("terms", lambda t: F.struct(t.idf.alias("idf"), F.array_max(F.transform(F.filter("read", lambda r: r.word == t.word), lambda r: r.similarity)).alias("s")))
    used = F.transform(F.filter("read", lambda r: F.array_contains("words", r.word)), lambda r: r["at"])
    judged = judged.withColumn("best", best).where(F.forall("best", lambda b: b.s.isNotNull()) & (F.size(F.array_except("needed", used)) == 0))
    weight = F.aggregate("best", F.lit(0.0), lambda a, b: a + b.idf * b.idf)
    shared = F.aggregate("best", F.lit(0.0), lambda a, b: a + b.idf * b.idf * b.s)
    judged = judged.withColumn("score", F.round(shared / weight, 9)).where(F.col("score") >= min_score)
    first = Window.partitionBy("raw").orderBy(F.desc("score"), F.desc(F.size("words")), "entry")
    chosen = judged.withColumn("place", F.row_number().over(first)).where("place = 1").select("raw", F.col("entry").alias("meant"), "score")
    out = looked.join(chosen, "raw", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("meant").isNotNull(), "repaired").otherwise("unmatched")
    return out.select("raw", F.coalesce("exact", "meant").alias("entry"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"), how.alias("how"))


def map_mentions(mentions: DataFrame, mention_id: str, value: str, entries: DataFrame, entry: str, label: str, min_score: float = MIN_SCORE) -> DataFrame:
    """``canonical_values`` for every row: ``mention_id, raw, entry, score, how``; null and blank values have ``how = 'blank'``."""
    rows = mentions.select(F.col(mention_id).alias("mention_id"), F.col(value).cast("string").alias("raw"))
    mapped = canonical_values(mentions, value, entries, entry, label, min_score)
    return rows.join(mapped, "raw", "left").select("mention_id", "raw", "entry", "score", F.coalesce("how", F.lit("blank")).alias("how"))
