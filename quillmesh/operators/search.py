"""Full-text search: postings, a small query language, BM25 and snippets.

The language has words (all must be there), ``OR``, ``NOT``, ``"a phrase"``,
``prefix*``, ``column:word``, ``^first`` and ``NEAR(a b, n)``; other
parentheses raise an error.  A query is read on the driver into a plan of
DataFrame set operations; nothing is evaluated there.  ``write_index`` stores
postings once, clustered by term, and a search reads those of its terms only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import ACCENTED, PLAIN, search_tokens
from quillmesh.session import cut

COLUMNS = ("title", "source", "content")
K1, B = 1.2, 0.75
#: Folders of a stored index, and its tables.
BUCKETS = 16
DOCUMENTS, COLLECTION = "id string, title string, source string, content string", "n long, average double"
POSTINGS = "id string, length int, at int, col string, pos int, term string, bucket int"
_FOLD = str.maketrans(ACCENTED, PLAIN)


def postings(docs: DataFrame) -> DataFrame:
    """``id, col, pos, term`` of every token of the searched columns; nulls hold none."""
    columns = F.array(*[F.struct(F.lit(c).alias("col"), search_tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in COLUMNS])
    rows = docs.select("id", F.explode(columns).alias("c"))
    return rows.select("id", F.col("c.col").alias("col"), F.posexplode("c.tokens").alias("pos", "term"))


def term_counts(docs: DataFrame) -> DataFrame:
    """``id, term, tf`` over all searched columns."""
    return postings(docs).groupBy("id", "term").agg(F.count("*").alias("tf"))


@dataclass
class Match:
    """One condition: words in a row (or near each other), the last perhaps a prefix, in one column or any."""

    words: list[str]
    column: str | None = None
    prefix: bool = False
    first: bool = False
    near: int | None = None


@dataclass
class Query:
    """Alternatives, each of conditions that must hold and ones that must not."""

    alternatives: list[tuple[list[Match], list[Match]]] = field(default_factory=list)

    def wanted(self) -> list[Match]:
        return [m for need, _ in self.alternatives for m in need]


_PART = re.compile(r'\s*(?:NEAR\(([^)]*)\)|(?:(\w+)\s*:\s*)?(\^)?\s*(?:"([^"]*)"|([^\s"()]+))|([()]))')


def read_query(text: str) -> Query:
    """The query that ``text`` asks; raises ``ValueError`` where it asks nothing."""
    query = Query()
    need: list[Match] = []
    without: list[Match] = []
    negative = False
    for part in _PART.finditer(text):
        near, column, first, phrase, word, _ = part.groups()
        if part[6]:
            raise ValueError("parentheses are only understood after NEAR")
        if word == "AND":
            continue
        if word == "OR":
            query.alternatives.append((need, without))
            need, without = [], []
            continue
        if word == "NOT":
            negative = True
            continue
        if near is not None:
            body, _, distance = near.partition(",")
            match = Match(re.findall(r"\w+", body.lower().translate(_FOLD)), near=int(distance or 10))
        else:
            raw = phrase if phrase is not None else word
            prefix = raw.endswith("*")
            words = re.findall(r"[^\W_]+", raw.lower().translate(_FOLD))
            if not words:
                continue
            match = Match(words, column, prefix, bool(first))
        (without if negative else need).append(match)
        negative = False
    query.alternatives.append((need, without))
    query.alternatives = [x for x in query.alternatives if x[0]]
    if not query.alternatives:
        raise ValueError("the query asks for nothing")
    return query


def _holds(rows: DataFrame, match: Match) -> DataFrame:
    """Ids for which the condition holds."""
    if match.column:
        rows = rows.where(F.col("col") == match.column)
    last = len(match.words) - 1

    def word(i: int) -> DataFrame:
        if i == last and match.prefix:
            return rows.where(F.col("term").startswith(match.words[i]))
        return rows.where(F.col("term") == match.words[i])

    at = word(0).select("id", "col", F.col("pos").alias("p0"))
    if match.first:
        at = at.where("p0 = 0")
    for i in range(1, len(match.words)):
        following = word(i).select("id", "col", F.col("pos").alias(f"p{i}"))
        at = at.join(following, ["id", "col"])
        if match.near is None:
            at = at.where(F.col(f"p{i}") == F.col(f"p{i - 1}") + 1)
        else:
            at = at.where((F.abs(F.col(f"p{i}") - F.col("p0")) - 1) <= match.near)
    return at.select("id").distinct()


def matching(rows: DataFrame, query: Query) -> DataFrame:
    """Ids that the query asks for, from ``postings``."""
    out = None
    for need, without in query.alternatives:
        ids = _holds(rows, need[0])
        for match in need[1:]:
            ids = ids.join(_holds(rows, match), "id", "left_semi")
        for match in without:
            ids = ids.join(_holds(rows, match), "id", "left_anti")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct() if len(query.alternatives) > 1 else out


def _placed(column: str) -> Column:
    """The tokens of an array column as structs with the column's name and their place."""
    return F.transform(column, lambda x, i: F.struct(F.lit(column).alias("col"), i.alias("pos"), x.alias("term")))


def wanted_postings(docs: DataFrame, words: list[str], prefixes: list[str]) -> DataFrame:
    """``id, length, col, pos, term`` of the tokens a query can need; the others are dropped before rows are made of them."""
    tokens = {c: search_tokens(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS}
    split = docs.select("id", *(t.alias(c) for c, t in tokens.items()))

    entries = F.concat(*map(_placed, COLUMNS))

    def needed(e):
        condition = e.term.isin(*words) if words else F.lit(False)
        for p in prefixes:
            condition = condition | e.term.startswith(p)
        return condition

    length = F.size("title") + F.size("source") + F.size("content")
    return split.select("id", length.alias("length"), F.explode(F.filter(entries, needed)).alias("e")).select("id", "length", "e.col", "e.pos", "e.term")


def collection_size(docs: DataFrame) -> DataFrame:
    """One row ``n, average``: documents, and tokens of a document with any."""
    length = reduce(lambda a, b: a + b, (F.size(search_tokens(F.coalesce(F.col(c), F.lit("")))) for c in COLUMNS))
    return docs.select(length.alias("length")).where("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def _bucket(start: Column) -> Column:
    return F.pmod(F.xxhash64(start), F.lit(BUCKETS)).cast("int")


@dataclass
class SearchIndex:
    """A stored index: ``postings`` by bucket of a term's first two letters and in order of terms, ``documents`` as shown, and the size of the ``collection``."""

    spark: SparkSession
    path: str

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/documents")

    @property
    def collection(self) -> DataFrame:
        return self.spark.read.schema(COLLECTION).parquet(f"{self.path}/collection")

    @property
    def postings(self) -> DataFrame:
        # Named here, since an empty table has no folders to tell it from.
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def rows(self, words: list[str], prefixes: list[str]) -> DataFrame:
        """Postings of words and beginnings; the buckets of others aren't read."""
        starts = [w[:2] for w in words] + [p[:2] for p in prefixes]
        condition = F.col("term").isin(*words) if words else F.lit(False)
        for p in prefixes:
            condition = condition | F.col("term").startswith(p)
        rows = self.postings.where(condition)
        if all(len(p) > 1 for p in prefixes):
            buckets = self.spark.createDataFrame([(x,) for x in sorted(set(starts))], "start string").select(_bucket(F.col("start")).alias("b")).distinct().collect()
            rows = rows.where(F.col("bucket").isin(*[r["b"] for r in buckets]))
        return rows.drop("bucket")


def write_index(docs: DataFrame, path: str) -> SearchIndex:
    """Store the index of ``docs`` (id, title, source, content) below ``path``, which is overwritten."""
    spark = docs.sparkSession
    docs.select("id", *COLUMNS).write.mode("overwrite").parquet(f"{path}/documents")
    length = F.size("title") + F.size("source") + F.size("content")
    split = SearchIndex(spark, path).documents.select("id", *(search_tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS)).withColumn("length", length)
    rows = split.select("id", "length", F.posexplode(F.concat(*map(_placed, COLUMNS))).alias("at", "e")).select("id", "length", "at", "e.*").withColumn("bucket", _bucket(F.left("term", F.lit(2))))
    # Rebalancing splits what a frequent beginning would make too large, and joins what is small.
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # Every document with tokens has one that stands first.
    index = SearchIndex(spark, path)
    index.postings.where("at = 0").agg(F.count("*").alias("n"), F.avg("length").alias("average")).write.mode("overwrite").parquet(f"{path}/collection")
    return index


def bm25(rows: DataFrame, collection: DataFrame, ids: DataFrame, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
    """``id, score`` of the documents ``ids`` for words and prefixes; better ones have lower scores.

    A prefix counts as one term with the tokens that begin with it.  The words
    of a phrase count one by one.
    """
    asked = rows.where(F.col("term").isin(*terms)).select("id", "length", "term") if terms else None
    for p in prefixes:
        more = rows.where(F.col("term").startswith(p)).select("id", "length", F.lit(p + "*").alias("term"))
        asked = more if asked is None else asked.unionByName(more)
    hits = asked.groupBy("id", "length", "term").agg(F.count("*").alias("f"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    # As many rows as the query has terms.
    scored = hits.join(ids, "id", "left_semi").join(F.broadcast(frequency), "term").crossJoin(F.broadcast(collection))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return scored.groupBy("id").agg((-F.sum(part)).alias("score"))


def search(docs: DataFrame | SearchIndex, text: str, limit: int | None = 20) -> DataFrame:
    """The best matches ``id, title, source, score`` in documents or a stored index; equal scores in order of id.  ``limit=None`` gives all."""
    query = read_query(text)
    terms = sorted({w for m in query.wanted() for w in (m.words[:-1] if m.prefix else m.words)})
    prefixes = sorted({m.words[-1] for m in query.wanted() if m.prefix})
    unwanted = [m for _, without in query.alternatives for m in without]
    every = sorted({w for m in [*query.wanted(), *unwanted] for w in (m.words[:-1] if m.prefix else m.words)})
    starts = sorted({m.words[-1] for m in [*query.wanted(), *unwanted] if m.prefix})
    if isinstance(docs, SearchIndex):
        rows, collection, shown = docs.rows(every, starts), docs.collection, docs.documents
    else:
        # The texts are read once for the tokens that matter, which all conditions then share.
        rows, collection, shown = cut(wanted_postings(docs, every, starts)), collection_size(docs), docs
    scored = bm25(rows, collection, matching(rows, query), terms, prefixes)
    found = scored.join(shown.select("id", "title", "source"), "id").select("id", "title", "source", F.round("score", 6).alias("score"))
    ordered = found.orderBy("score", "id")
    return ordered.limit(limit) if limit is not None else ordered


def search_page(docs: DataFrame | SearchIndex, text: str, page: int = 1, per_page: int = 20, most: int = 1000) -> DataFrame:
    """A page of the matches, each with the ``total`` that can be paged through (``most`` at most)."""
    found = cut(search(docs, text, most))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("score", "id").offset((max(page, 1) - 1) * per_page).limit(per_page).crossJoin(F.broadcast(total))


def snippet(content: str, words: list[str], tokens: int = 40, left: str = ">>>", right: str = "<<<") -> str:
    """Up to ``tokens`` words of ``content`` around the first hit, hits between marks, ``...`` where it is cut."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", content)]
    folded = [content[s:e].lower().translate(_FOLD) for s, e in spans]
    hit = next((i for i, w in enumerate(folded) if w in words), 0)
    low = max(0, min(hit - tokens // 4, len(spans) - tokens))
    high = min(len(spans), low + tokens)
    if not spans:
        return content
    out, at = "", spans[low][0] if low else 0
    for i in range(low, high):
        s, e = spans[i]
        out += content[at:s] + (left + content[s:e] + right if folded[i] in words else content[s:e])
        at = e
    return ("..." if low else "") + out + ("..." if high < len(spans) else content[at:])


def search_with_snippets(docs: DataFrame | SearchIndex, text: str, limit: int = 20) -> DataFrame:
    """``search`` with a snippet of the content, made for the rows of the result only."""
    words = sorted({w for m in read_query(text).wanted() for w in m.words})

    @F.pandas_udf("string")
    def cut_out(content):
        return content.map(lambda c: snippet(c or "", words))

    found = search(docs, text, limit)
    shown = docs.documents if isinstance(docs, SearchIndex) else docs
    # The result has ``limit`` rows at most.
    return shown.select("id", "content").join(F.broadcast(found), "id").select("id", "title", "source", "score", cut_out("content").alias("snippet")).orderBy("score", "id")
