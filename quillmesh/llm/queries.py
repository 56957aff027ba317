"""Queries of the training-data problems."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.canonical import canonical_values, map_mentions
from quillmesh.llm.cooccurrence import significant_pairs
from quillmesh.llm.mixing import mix_sources
from quillmesh.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from quillmesh.llm.packing import pack_containers
from quillmesh.llm.pairs import defective_pairs
from quillmesh.llm.pii import find_pii, replace_pii
from quillmesh.llm.vptree import nearest, similar_pairs, usable_vectors
from quillmesh.session import cut, table

#: Kinds of containers that ``p6_containers`` fills at most.
SPECIFICATIONS = 100
#: Where the session names the key of surrogates; without one, each run draws its own.
KEY = "spark.quillmesh.surrogateKey"


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Defective pairs with the kind of their defect."""
    return defective_pairs(table(spark, root, "training_pairs"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of concepts at least five times together and four times as often as chance."""
    return significant_pairs(table(spark, root, "doc_concepts"), "doc_id", "concept_id").select("concept_a", "concept_b")


def p2_scored_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The same pairs with their counts, ratio and log-likelihood ratio."""
    pairs = significant_pairs(table(spark, root, "doc_concepts"), "doc_id", "concept_id")
    return pairs.select("concept_a", "concept_b", "n_ab", "n_a", "n_b", F.round("ratio", 6).alias("ratio"), F.round("llr", 6).alias("llr"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Mentions that aren't an entry as typed, with the entry they mean or ''."""
    mapped = map_mentions(table(spark, root, "concept_mentions"), "mention_id", "raw_label", table(spark, root, "concepts"), "concept_id", "label")
    return mapped.where(F.col("how").isin("repaired", "unmatched")).select("mention_id", F.coalesce("entry", F.lit("")).alias("concept_id")).distinct()


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct value with its entry, score and how it was found, unmatched ones included."""
    return canonical_values(table(spark, root, "concept_mentions"), "raw_label", table(spark, root, "concepts"), "concept_id", "label")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors of one model with a cosine of 0.9 or more, one among the other's ten nearest."""
    return similar_pairs(usable_vectors(table(spark, root, "doc_vectors")), k=10, min_cosine=0.9)


def p4_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar vectors, however far, of every vector whose id is divisible by 50, against all."""
    vectors = usable_vectors(table(spark, root, "doc_vectors"))
    near = nearest(vectors, k=10, queries=vectors.where("vec_id % 50 = 0"))
    return near.select("vec_id", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents whose contents are equal or nearly so."""
    return near_duplicate_pairs(table(spark, root, "docs"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per document with its class, its group and its number of links."""
    return near_duplicate_groups(table(spark, root, "docs"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every text in containers of each specification."""
    specs = table(spark, root, "container_specs").select("capacity_tokens").where("capacity_tokens > 0").distinct().limit(SPECIFICATIONS + 1).collect()
    if len(specs) > SPECIFICATIONS:
        raise ValueError(f"more than {SPECIFICATIONS} specifications")
    return pack_containers(table(spark, root, "documents"), [int(s["capacity_tokens"]) for s in specs])


def p6_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of ``p6_containers``, for each capacity: the texts packed, containers too full, texts split that would fit, and texts of which tokens are missing or stand twice."""
    packed = cut(p6_containers(spark, root))
    full = packed.groupBy("capacity", "container").agg(F.sum("tokens").alias("held")).groupBy("capacity").agg(F.count_if(F.col("held") > F.col("capacity")).alias("too_full"))
    pieces = packed.groupBy("capacity", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("reach"))
    split, gaps = F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))), F.count_if(F.col("tokens") != F.col("reach"))
    return pieces.groupBy("capacity").agg(F.count("*").alias("texts"), split.alias("split"), gaps.alias("gaps")).join(full, "capacity")


def p7_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of ``p7_shares``, for each source: whether its share is near the aim, and whether no text is used too often."""
    report, targets = p7_shares(spark, root), table(spark, root, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    reachable = report.where("texts > 0").agg(F.sum("target_share").alias("reachable"))
    aim = F.when(F.col("texts") > 0, F.col("target_share") / F.col("reachable")).otherwise(0.0)
    rows = report.join(targets, "source").crossJoin(F.broadcast(reachable))
    return rows.select("source", (F.abs(F.col("actual_share") - aim) <= 0.01).alias("near_aim"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"))


def p7_selection(spark: SparkSession, root: str) -> DataFrame:
    """The texts selected for each source, with the number of the use."""
    return mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Every item of personal data, once per document."""
    return find_pii(table(spark, root, "documents"), table(spark, root, "name_lexicon")).select("doc_id", "pii_type", "pii_text").distinct()


def p8_texts(spark: SparkSession, root: str) -> DataFrame:
    """Every text with typed placeholders, and with surrogates, in place of the items."""
    key = spark.conf.get(KEY, None) or secrets.token_hex(32)
    return replace_pii(table(spark, root, "documents"), table(spark, root, "name_lexicon"), key)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_scored_pairs, p3_found, p3_values, p4_found, p4_nearest, p5_found, p5_groups, p6_containers, p6_checks, p7_selection, p7_shares, p7_checks, p8_found, p8_texts)}

_PAIRS = """
with m as (select distinct doc_id, lower(trim(concept_id)) as c from doc_concepts
           where trim(coalesce(doc_id, '')) <> '' and trim(coalesce(concept_id, '')) <> ''),
     t as (select count(distinct doc_id) as n from m),
     k as (select c, count(*) as n from m group by c),
     p as (select a.c as concept_a, b.c as concept_b, count(*) as n_ab from m a join m b on a.doc_id = b.doc_id and a.c < b.c group by 1, 2),
     s as (select concept_a, concept_b, n_ab, ka.n as n_a, kb.n as n_b, t.n as n
           from p join k ka on ka.c = concept_a join k kb on kb.c = concept_b cross join t
           where n_ab >= 5 and n_ab * t.n >= 4 * ka.n * kb.n)
"""


def _x(term: str) -> str:
    return f"(case when {term} > 0 then ({term}) * ln({term}) else 0 end)"


_G2 = f"2.0 * ({_x('n_ab')} + {_x('n_a - n_ab')} + {_x('n_b - n_ab')} + {_x('n - n_a - n_b + n_ab')} - {_x('n_a')} - {_x('n - n_a')} - {_x('n_b')} - {_x('n - n_b')} + {_x('n')})"

_VECTORS = """
with v as (select vec_id, model, embedding::double[] as e from doc_vectors
           where model is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

#: Of the others none can be stated in SQL over the tables; tests hold them against brute force and invariants.
ORACLES = {
    "p2_found": _PAIRS + "select concept_a, concept_b from s",
    "p2_scored_pairs": _PAIRS + f"select concept_a, concept_b, n_ab, n_a, n_b, round(n_ab::double * n / (n_a::double * n_b), 6) as ratio, round({_G2}, 6) as llr from s",
    "p4_found": _VECTORS
    + """, d as (select a.vec_id as q, b.vec_id as o, list_cosine_similarity(a.e, b.e) as cosine from v a join v b on a.model = b.model and a.vec_id <> b.vec_id),
       r as (select q, o, cosine, row_number() over (partition by q order by round(cosine, 9) desc, o) as k from d)
       select distinct least(q, o) as vec_a, greatest(q, o) as vec_b from r where k <= 10 and cosine >= 0.9""",
    "p4_nearest": _VECTORS
    + """, d as (select a.vec_id, b.vec_id as other, list_cosine_similarity(a.e, b.e) as cosine from v a join v b on a.model = b.model and a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
       r as (select vec_id, other, cosine, row_number() over (partition by vec_id order by round(cosine, 9) desc, other)::int as rank from d)
       select vec_id, other, round(cosine, 6) as cosine, rank from r where rank <= 10""",
    "p5_found": r"""
       with n as (select distinct id, lower(regexp_replace(content, '[^\p{L}\p{N}]+', '', 'g')) as t from docs where id is not null and content is not null),
            g as (select distinct id, substr(t, i::int, 5) as g from n, unnest(range(1, length(t) - 3)) as u(i) where length(t) >= 5),
            k as (select id, count(*) as n from g group by id),
            c as (select a.id as id_a, b.id as id_b, count(*) as c from g a join g b on a.g = b.g and a.id < b.id group by 1, 2)
       select id_a, id_b from c join k ka on ka.id = id_a join k kb on kb.id = id_b where c >= 0.6 * (ka.n + kb.n - c)""",
    "p5_groups": r"""
       with recursive n as (select distinct id, lower(regexp_replace(content, '[^\p{L}\p{N}]+', '', 'g')) as t from docs where id is not null and content is not null),
            m as (select id, t, min(id) over (partition by t) as class_id, count(*) over (partition by t) as copies from n where length(t) >= 5),
            k as (select distinct class_id, t from m),
            g as (select distinct class_id, substr(t, i::int, 5) as g from k, unnest(range(1, length(t) - 3)) as u(i)),
            z as (select class_id, count(*) as n from g group by 1),
            c as (select a.class_id as a, b.class_id as b, count(*) as c from g a join g b on a.g = b.g and a.class_id <> b.class_id group by 1, 2),
            l as (select a, b from c join z za on za.class_id = a join z zb on zb.class_id = b where c >= 0.6 * (za.n + zb.n - c)),
            r as (select class_id as x, class_id as y from k union select r.x, l.b from r join l on l.a = r.y),
            o as (select x, min(y) as group_id from r group by 1),
            d as (select a, count(*) as links from l group by 1)
       select id, m.class_id, group_id, copies, coalesce(links, 0) as links from m join o on o.x = m.class_id left join d on d.a = m.class_id""",
    "p6_checks": r"select distinct capacity_tokens as capacity, (select count(*) from documents where doc_id is not null and regexp_matches(text, '[^\s\p{Z}]')) as texts, 0::bigint as split, 0::bigint as gaps, 0::bigint as too_full from container_specs where capacity_tokens > 0",
    "p7_checks": "select lower(trim(source)) as source, true as near_aim, true as within_repeats from mix_targets where source is not null and target_share > 0",
}
