"""The concept graph: document frequency, hubs, term scores, importance, edges and collections.

Inputs are the clean states of ``views``: documents, distinct assignments and
concepts.  Quirks that define the numbers are kept: entities never gain a
document frequency, every assignment weighs 1, hubs are judged by the number of
indexed documents, and related edges run one way, from a document's active
terms to whatever shares them.  Stale rows of earlier builds can't arise, since
every build is a function of its inputs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

# How much a type of source says about importance.
TYPE_WEIGHTS = {"paper": 1.0, "pdf": 0.8, "git_repo": 0.7, "repo": 0.7, "web": 0.4, "video": 0.3, "memo": 0.0}


def normalize_concepts(assigned: DataFrame, aliases: dict[str, str], stops: set[str]) -> DataFrame:
    """Assignments under their canonical names, without stop concepts.

    Aliases are looked up by the lower-case name and applied before the stops,
    which are compared as written.  Both come from small configuration files.
    """
    spark = assigned.sparkSession
    named = assigned
    if aliases:
        table = spark.createDataFrame([(k, str(v)) for k, v in aliases.items()], "concept_id string, canonical string")
        named = assigned.join(F.broadcast(table), "concept_id", "left").select("doc_id", F.coalesce("canonical", "concept_id").alias("concept_id"))
    if stops:
        table = spark.createDataFrame([(s,) for s in stops], "concept_id string")
        named = named.join(F.broadcast(table), "concept_id", "left_anti")
    return named.distinct()


def concept_frequency(concepts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Concepts with ``df``, the number of documents that have them (0 if none), and ``is_stop``."""
    counts = assigned.groupBy("concept_id").agg(F.count("*").alias("df"))
    listed = concepts.select(F.lower(F.trim("concept_id")).alias("concept_id"), F.coalesce("label", "concept_id").alias("label"), "kind", F.coalesce("is_stop", F.lit(0)).alias("is_stop"))
    return listed.join(counts, "concept_id", "left").select("concept_id", "label", "kind", "is_stop", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def hub_threshold(docs: DataFrame) -> DataFrame:
    """One row ``n_docs, hub``: two in a thousand documents, between 50 and 5000."""
    hub = F.least(F.lit(5000), F.greatest(F.lit(50), F.floor(F.lit(0.002) * F.col("n_docs")))).cast("long")
    return docs.agg(F.count("*").alias("n_docs")).select("n_docs", hub.alias("hub"))


def score_term(concept_id: Column, label: Column, df: Column, weight: Column, n_docs: Column, hub: Column, interest: Column | None = None) -> Column:
    """How well a concept stands for a document: its weight, rarity, technical look and interest, less what is generic or a hub."""
    n = n_docs.cast("double")
    rarity = F.when(n > 0, F.log(1 + n / (df + 1)) / F.log(1 + n)).otherwise(0.0)
    technical = F.when(F.contains(concept_id, F.lit("-")), 0.5).otherwise(0.0) + F.when(F.rlike(label, F.lit(r"\p{Lu}")), 0.5).otherwise(0.0)
    segments = F.least(F.lit(1.0), F.size(F.split(concept_id, "-")) / 3.0)
    generic = F.when(n > 0, df / n).otherwise(0.0)
    crowding = F.pow(df / hub.cast("double"), 2.0)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))
    # The parts of a score.
    total = 0.40 * clamped + 0.25 * rarity + 0.15 * technical + 0.10 * segments - generic - crowding
    if interest is not None:
        total = total + 0.10 * interest.cast("double")
    return F.greatest(F.lit(0.0), total)


def active_terms(docs: DataFrame, concepts: DataFrame, assigned: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` best concepts of each document, ``doc_id, concept_id, df, score, place``: not stops, in two documents or more, no hubs.

    Scores are compared to nine digits; equal ones rank by concept.
    """
    frequency = concept_frequency(concepts, assigned)
    usable = frequency.crossJoin(F.broadcast(hub_threshold(docs))).where("is_stop = 0 and df >= 2 and df <= hub")
    scored = usable.withColumn("score", F.round(score_term(F.col("concept_id"), F.col("label"), F.col("df"), F.lit(1.0), F.col("n_docs"), F.col("hub")), 9))
    ranked = assigned.join(scored.select("concept_id", "df", "score"), "concept_id")
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "concept_id")
    return ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("doc_id", "concept_id", "df", "score", "place")


def type_weight(source_type: Column) -> Column:
    return reduce(lambda e, kv: e.when(source_type == kv[0], kv[1]), list(TYPE_WEIGHTS.items())[1:], F.when(source_type == "paper", TYPE_WEIGHTS["paper"])).otherwise(0.0)


def importance(assigned: DataFrame, concepts: DataFrame, stats: DataFrame) -> DataFrame:
    """``doc_id, importance`` (not rounded) from the number and rarity of non-stop concepts, the type and a source; 0 without concepts."""
    frequency = concept_frequency(concepts, assigned).where("is_stop = 0")
    rare = F.when(F.col("df") > 0, 1.0 / F.col("df")).otherwise(1.0)
    per_doc = assigned.join(frequency.select("concept_id", "df"), "concept_id").groupBy("doc_id").agg(F.countDistinct("concept_id").alias("n"), F.avg(rare).alias("rarity"))
    value = 0.40 * F.least(F.lit(1.0), F.col("n") / 3.0) + 0.30 * F.least(F.lit(1.0), 2.0 * F.col("rarity")) + 0.15 * type_weight(F.col("source_type")) + 0.15 * (F.col("has_source") > 0).cast("double")
    joined = stats.select("doc_id", "source_type", "has_source").join(per_doc, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("n").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).alias("importance"))


def related_edges(docs: DataFrame, concepts: DataFrame, assigned: DataFrame, top_k: int = 10) -> DataFrame:
    """Up to ``top_k`` documents ``dst_id`` for each ``src_id`` that share its active terms, by the sum of 1/df; ties by id.

    Active terms are never hubs, so one term brings a document at most as many
    others as a hub may have.
    """
    terms = active_terms(docs, concepts, assigned).select(F.col("doc_id").alias("src_id"), "concept_id", "df")
    others = assigned.select(F.col("doc_id").alias("dst_id"), "concept_id")
    shared = terms.join(others, "concept_id").where("src_id <> dst_id")
    weights = shared.groupBy("src_id", "dst_id").agg(F.sum(1.0 / F.greatest(F.col("df"), F.lit(1))).alias("weight"))
    best = Window.partitionBy("src_id").orderBy(F.desc(F.round("weight", 9)), "dst_id")
    return weights.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_k).select("src_id", "dst_id", "weight")


def concept_pairs(docs: DataFrame, concepts: DataFrame, assigned: DataFrame, least: int = 2) -> DataFrame:
    """Pairs ``c1 < c2`` of usable concepts (in two documents or more, no stop, no hub) with the documents they share, ``least`` or more."""
    usable = concept_frequency(concepts, assigned).crossJoin(F.broadcast(hub_threshold(docs))).where("is_stop = 0 and df >= 2 and df <= hub").select("concept_id")
    rows = assigned.join(usable, "concept_id", "left_semi")
    left, right = rows.select("doc_id", F.col("concept_id").alias("c1")), rows.select("doc_id", F.col("concept_id").alias("c2"))
    return left.join(right, "doc_id").where("c1 < c2").groupBy("c1", "c2").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def limit_pairs(pairs: DataFrame, top_k: int = 20) -> DataFrame:
    """The pairs that are accepted when they come in falling order and each concept takes at most ``top_k``.

    Equal to taking them one by one: in each round the pairs that stand within
    both their concepts' free places are accepted, then places are counted
    again, until none is left.  Rounds are few; each is written to the
    checkpoint folder.
    """
    left = cut(pairs.select("c1", "c2", "n"))
    taken = None
    used = None
    while not left.isEmpty():
        ends = left.select("c1", "c2", "n", F.explode(F.array("c1", "c2")).alias("c"))
        rank = Window.partitionBy("c").orderBy(F.desc("n"), "c1", "c2")
        ends = ends.withColumn("place", F.row_number().over(rank))
        if used is not None:
            ends = ends.join(used, "c", "left")
        free = F.lit(top_k) - (F.coalesce("used", F.lit(0)) if used is not None else F.lit(0))
        judged = ends.groupBy("c1", "c2", "n").agg(F.min((F.col("place") <= free).cast("int")).alias("inside"), F.min(free).alias("free"))
        judged = cut(judged)
        now = judged.where("inside = 1 and free > 0").select("c1", "c2", "n")
        taken = cut(now if taken is None else taken.unionByName(now))
        used = cut(taken.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").agg(F.count("*").alias("used")))
        full = used.where(F.col("used") >= top_k).select("c")
        rest = judged.where("inside = 0").select("c1", "c2", "n")
        rest = rest.join(full.withColumnRenamed("c", "c1"), "c1", "left_anti").join(full.withColumnRenamed("c", "c2"), "c2", "left_anti")
        left = cut(rest.select("c1", "c2", "n"))
    return taken if taken is not None else pairs.select("c1", "c2", "n").limit(0)


def cooccurrence_edges(docs: DataFrame, concepts: DataFrame, assigned: DataFrame, least: int = 2, top_k: int = 20) -> DataFrame:
    """Co-occurrence edges in both directions, ``src_id, dst_id, weight``, at most ``top_k`` from a concept."""
    pairs = limit_pairs(concept_pairs(docs, concepts, assigned, least), top_k)
    return pairs.select("c1", "c2", F.col("n").cast("double").alias("weight")).select(F.explode(F.array(F.struct(F.col("c1").alias("src_id"), F.col("c2").alias("dst_id"), "weight"), F.struct(F.col("c2").alias("src_id"), F.col("c1").alias("dst_id"), "weight"))).alias("e")).select("e.*")


def top_edges(edges: DataFrame, edge_type: str, limit: int = 10) -> DataFrame:
    """The heaviest edges of a type from each node, with their place; ties by target."""
    best = Window.partitionBy("src_id").orderBy(F.desc(F.round("weight", 9)), "dst_id")
    rows = edges.where(F.col("edge_type") == edge_type).select("src_id", "dst_id", "weight")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def find_related(edges: DataFrame, docs: DataFrame, limit: int = 10) -> DataFrame:
    """Related documents of each document, with titles where the index has them."""
    found = top_edges(edges, "related", limit)
    return found.join(docs.select(F.col("id").alias("dst_id"), "title"), "dst_id", "left").select("src_id", "dst_id", "weight", "place", "title")


def cooccurring_concepts(edges: DataFrame, concepts: DataFrame, limit: int = 10) -> DataFrame:
    """Concepts that stand beside each concept, with their labels; unknown ones are left out."""
    known = concepts.select(F.lower(F.trim("concept_id")).alias("dst_id"), "label")
    return top_edges(edges.join(known.select("dst_id"), "dst_id", "left_semi"), "cooccurrence", limit).join(known, "dst_id").select("src_id", "dst_id", "weight", "place", "label")


def resolve_collection(docs: DataFrame, assigned: DataFrame, stats: DataFrame, concepts: list[str], types: list[str]) -> DataFrame:
    """Documents with any of the concepts or of any of the types, most important first, then by title and id."""
    names = [c.removeprefix("concept:").strip().lower() for c in concepts]
    by_concept = assigned.where(F.col("concept_id").isin(*names)).select(F.col("doc_id").alias("id"))
    by_type = stats.where(F.col("source_type").isin(*types)).select(F.col("doc_id").alias("id"))
    ids = by_concept.unionByName(by_type).distinct()
    found = docs.join(ids, "id", "left_semi").join(stats.select(F.col("doc_id").alias("id"), "importance"), "id", "left")
    return found.select("id", "title", "source_type", F.coalesce("importance", F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "title", "id")


def note_candidates(concepts: DataFrame, assigned: DataFrame, docs: DataFrame, noted: DataFrame, min_df: int = 2, titles: int = 5) -> DataFrame:
    """Concepts worth a note that have none: ``concept_id, label, df, titles`` (the first ones by title)."""
    wanted = concept_frequency(concepts, assigned).where((F.col("is_stop") == 0) & (F.col("df") >= min_df)).join(noted, "concept_id", "left_anti")
    named = assigned.join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    # Only the first titles of a concept are gathered, however many documents it has.
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("concept_id").orderBy("title", "doc_id"))).where(F.col("place") <= titles)
    lists = first.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x.title).alias("titles"))
    return wanted.join(lists, "concept_id", "left").select("concept_id", "label", "df", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def concept_note(label: Column, df: Column, titles: Column) -> Column:
    """The text of a concept's note."""
    listed = F.when(F.size(titles) > 0, F.concat(F.lit("\n\n## Documents\n"), F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n"))).otherwise("")
    return F.concat(F.lit("# "), label, F.lit("\n\nAppears in "), df.cast("string"), F.lit(" document(s)."), listed, F.lit("\n"))


def document_edges(assigned_entities: DataFrame, docs_with_keys: DataFrame) -> DataFrame:
    """Entity edges (document to entity) and source edges (document to source key), all of weight 1."""
    entity = assigned_entities.select(F.col("doc_id").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("entity").alias("edge_type"), F.lit(1.0).alias("weight"))
    source = docs_with_keys.where("source_key <> ''").select(F.col("id").alias("src_id"), F.col("source_key").alias("dst_id"), F.lit("source").alias("edge_type"), F.lit(1.0).alias("weight"))
    return entity.unionByName(source).distinct()


def replace_documents(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Incremental rebuild: rows of changed and deleted documents leave, those of ``new`` come in."""
    changed = new.select(key).distinct().unionByName(gone.select(key).distinct()).distinct()
    return old.join(changed, key, "left_anti").unionByName(new)


def full_build(docs: DataFrame, concepts: DataFrame, assigned: DataFrame, stats: DataFrame, least: int = 2, top_k: int = 20) -> dict[str, DataFrame]:
    """All tables of the graph: ``concepts`` with frequencies, ``doc_concepts``, ``doc_stats`` with importance, and ``edges`` of every type.

    ``docs`` has a ``source_key``.  Everything is a function of the inputs, so
    nothing of an earlier build can be left over.
    """
    named = concepts.where("kind = 'entity'").select(F.lower(F.trim("concept_id")).alias("concept_id"))
    scored = stats.drop("importance").join(importance(assigned, concepts, stats), "doc_id")
    related = related_edges(docs, concepts, assigned).withColumn("edge_type", F.lit("related"))
    beside = cooccurrence_edges(docs, concepts, assigned, least, top_k).withColumn("edge_type", F.lit("cooccurrence"))
    own = document_edges(assigned.join(named, "concept_id", "left_semi"), docs)
    return {"concepts": concept_frequency(concepts, assigned), "doc_concepts": assigned, "doc_stats": scored, "edges": own.unionByName(related).unionByName(beside)}


def incremental_build(before: dict[str, DataFrame], docs: DataFrame, concepts: DataFrame, fresh: DataFrame, gone: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    """``full_build`` over the assignments of an earlier build with those of changed documents (``fresh``) in place of theirs, and without deleted ones (``gone``: doc_id).

    What depends on the whole collection, frequencies, importance and edges by
    rank, is made anew.
    """
    return full_build(docs, concepts, replace_documents(before["doc_concepts"], fresh, gone), stats)


def drop_documents(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that begin or end at a document of ``gone`` (doc_id)."""
    return edges.join(gone.select(F.col("doc_id").alias("src_id")), "src_id", "left_anti").join(gone.select(F.col("doc_id").alias("dst_id")), "dst_id", "left_anti").select(*edges.columns)


def hub_of(n_docs: int) -> int:
    """The hub threshold of a known number of documents."""
    return min(5000, max(50, math.floor(0.002 * n_docs)))
