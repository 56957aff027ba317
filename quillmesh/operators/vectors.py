"""Text vectors: hashed TF-IDF and hash embeddings in sparse form, and exact cosine search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import vector_tokens
from quillmesh.session import cut

DIMENSIONS = 4096
EMBEDDING = 256


def bucket_counts(docs: DataFrame, doc_id: str = "id") -> DataFrame:
    """``id, dim, tf`` of title and content: tokens hashed to 4096 dimensions by the last three digits of their MD5."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    tokens = docs.select(F.col(doc_id).alias("id"), F.explode(vector_tokens(text)).alias("token"))
    dim = F.conv(F.right(F.md5("token"), F.lit(3)), 16, 10).cast("int")
    return tokens.groupBy("id", dim.alias("dim")).agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``dim, idf`` with idf = ln(1 + N / (df + 1)), N all documents."""
    frequency = counts.groupBy("dim").agg(F.count("*").alias("df"))
    return frequency.crossJoin(F.broadcast(n_docs)).select("dim", F.log1p(F.col("n_docs") / (F.col("df") + 1)).alias("idf"))


def _unit(weights: DataFrame) -> DataFrame:
    """``id, dim, w`` scaled to length one; rows of a document stand together already, so nothing is shuffled."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weights.withColumn("norm", norm).where("norm > 0").select("id", "dim", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(docs: DataFrame) -> DataFrame:
    """Unit vectors ``id, dim, w`` in sparse form; a document without tokens has no rows."""
    return _tfidf(cut(bucket_counts(docs)), docs)[0]


def _tfidf(counts: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors, and the weights of dimensions they are made with: at most 4096 rows, whatever the collection."""
    weights = cut(idf(counts, docs.agg(F.count("*").alias("n_docs"))))
    return _unit(counts.join(F.broadcast(weights), "dim").select("id", "dim", (F.col("tf") * F.col("idf")).alias("w"))), weights


def tfidf_search(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The documents most similar to ``query``, ``id, score`` (four digits), only positive scores; ties by id."""
    spark = docs.sparkSession
    vectors, weights = _tfidf(cut(bucket_counts(docs)), docs)
    asked = spark.createDataFrame([(query,)], "text string").select(F.explode(vector_tokens(F.col("text"))).alias("token"))
    asked = asked.groupBy(F.conv(F.right(F.md5("token"), F.lit(3)), 16, 10).cast("int").alias("dim")).agg(F.count("*").alias("tf"))
    asked = asked.join(weights, "dim").select("dim", (F.col("tf") * F.col("idf")).alias("q"))
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    scored = vectors.join(F.broadcast(asked), "dim").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("dot")).crossJoin(F.broadcast(length))
    found = scored.select("id", F.round(F.col("dot") / F.col("length"), 4).alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(limit)


def hash_embedding(docs: DataFrame, dim: int = EMBEDDING, text: str = "content", doc_id: str = "id") -> DataFrame:
    """Unit vectors ``id, dim, w``: each word with its neighbours, hashed by SHA-256; ``dim`` divides 256."""
    if EMBEDDING % dim:
        raise ValueError("dim must divide 256")
    words = docs.select(F.col(doc_id).alias("id"), F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "").alias("words")).where("size(words) > 0")
    grams = F.transform("words", lambda w, i: F.concat_ws(" ", F.slice("words", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))))
    hashed = words.select("id", F.explode(grams).alias("gram")).select("id", (F.conv(F.right(F.sha2("gram", 256), F.lit(2)), 16, 10).cast("int") % dim).alias("dim"))
    return _unit(hashed.groupBy("id", "dim").agg(F.count("*").cast("double").alias("w")))


def cosine(left: str, right: str) -> Column:
    """Cosine of two array columns of one length, null where one has none."""

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    return F.try_divide(dot(left, right), F.sqrt(dot(left, left) * dot(right, right)))


def embedding_search(vectors: DataFrame, query: list[float], limit: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The vectors most similar to ``query`` among those of its length, ``vec_id, score`` (four digits), only positive; ties by id."""
    if not any(query):
        raise ValueError("the query vector is zero")
    rows = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) == len(query))).withColumn("_q", F.array(*[F.lit(float(x)) for x in query]))
    scored = rows.select(F.col(vec_id).alias("vec_id"), F.round(cosine(embedding, "_q"), 4).alias("score")).where("score > 0 and not isnan(score)")
    return scored.orderBy(F.desc("score"), "vec_id").limit(limit)


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", model: str = "model", embedding: str = "embedding", dim: int = 64) -> DataFrame:
    """Rows with exactly ``dim`` finite values that aren't all zero, as ``vec_id, model, embedding``.

    Rows with a null id, model or embedding, or with a null value inside it, are left out.
    """
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(model).cast("string").alias("model"), F.col(embedding).cast("array<float>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("model").isNotNull() & (F.size("embedding") == dim))
        .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    )


Engine = Callable[[list[str]], list[list[float]]]
_ENGINES: dict[str, Callable[[], Engine]] = {}


def register_engine(name: str, make: Callable[[], Engine]) -> None:
    """Make an embedding engine known; ``make`` runs once in every Python worker that needs it."""
    _ENGINES[name] = make


def _local_hash() -> Engine:
    import hashlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = (text or "").lower().split()
            counts = Counter(int(hashlib.sha256(" ".join(words[max(0, i - 1) : i + 2]).encode()).hexdigest()[-2:], 16) for i in range(len(words)))
            norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
            out.append([counts.get(d, 0) / norm for d in range(EMBEDDING)])
        return out

    return embed


register_engine("hash", _local_hash)


def embed_with(docs: DataFrame, engine: str, text: str = "content", doc_id: str = "id", batch: int = 100, limit: int | None = None) -> DataFrame:
    """``id, model, embedding`` by a registered engine, in batches, one engine per worker; unknown engines raise ``ValueError``."""
    if engine not in _ENGINES:
        raise ValueError(f"unknown engine: {engine}")
    make = _ENGINES[engine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for rows in batches:
            embed = embed or make()
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                texts = [(t or "")[:limit] for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "model": engine, "embedding": embed(texts)})

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, model string, embedding array<double>")


def preferred_search(embeddings: DataFrame | None, docs: DataFrame, query: str, engine: Engine, limit: int = 10) -> DataFrame:
    """``id, title, score`` by embeddings (id, embedding) where there are any, and by TF-IDF otherwise; titles are those of ``docs``, or the id."""
    if embeddings is not None and not embeddings.isEmpty():
        found = embedding_search(embeddings, engine([query])[0], limit, vec_id="id").withColumnRenamed("vec_id", "id")
    else:
        found = tfidf_search(docs, query, limit)
    titled = found.join(docs.select("id", F.nullif("title", F.lit("")).alias("title")), "id", "left")
    return titled.select("id", F.coalesce("title", "id").alias("title"), "score").orderBy(F.desc("score"), "id")
