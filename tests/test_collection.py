import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import health as H
from quillmesh.operators import views
from quillmesh.operators.serving import listing, pages


def assigned(spark, sets):
    return spark.createDataFrame([(d, c) for d, cs in sets.items() for c in cs], "doc_id string, concept_id string")


def concepts(spark, names, stops=()):
    return spark.createDataFrame([(n, n, "concept", int(n in stops)) for n in names], "concept_id string, label string, kind string, is_stop int")


def docs(spark, ids):
    return spark.createDataFrame([(i, f"T {i}", "", "web", f"{i}.md", "text") for i in ids], "id string, title string, source string, source_type string, rel_path string, content string")


SETS = {"d1": {"rag", "graph-rag", "knowledge-graph"}, "d2": {"rag", "graph-rag"}, "d3": {"rag", "knowledge-graph"}, "d4": {"embedding"}, "d5": {"machine-learning"}}
NAMES = sorted(set().union(*SETS.values()))


def test_frequency_alias_and_stop(spark):
    rows = assigned(spark, {"doc1": {"rag"}, "doc2": {"retrieval-augmented-generation"}, "doc3": {"ai"}})
    named = G.normalize_concepts(rows, {"retrieval-augmented-generation": "rag"}, {"ai"})
    got = {r["concept_id"]: r["df"] for r in G.concept_frequency(concepts(spark, ["rag", "ai"]), named).collect()}
    assert got == {"rag": 2, "ai": 0}


@pytest.mark.parametrize("n, hub", [(0, 50), (100, 50), (50_000, 100), (100_000, 200)])
def test_hub_threshold(spark, n, hub):
    assert G.hub_threshold(spark.range(n).toDF("id")).first()["hub"] == hub == G.hub_of(n)


@pytest.mark.parametrize("n, rarity, kind, source, value", [(3, 0.5, "web", 0, 0.76), (3, 1.0, "paper", 1, 1.0), (1, 0.1, "memo", 0, 0.19)])
def test_importance(spark, n, rarity, kind, source, value):
    # Concepts whose mean of 1/df is the wanted rarity: all of them stand in 1/rarity documents.
    many = round(1 / rarity)
    rows = {f"d{i}": {f"c{j}" for j in range(n)} for i in range(many)}
    stats = spark.createDataFrame([(d, kind, source) for d in rows] + [("none", kind, source)], "doc_id string, source_type string, has_source int")
    got = {r["doc_id"]: r["importance"] for r in G.importance(assigned(spark, rows), concepts(spark, [f"c{j}" for j in range(n)]), stats).collect()}
    assert abs(got["d0"] - value) < 0.006 and got["none"] == 0.0


def test_related_edges_have_no_self_and_both_ways(spark):
    sets = {"d1": {"rag"}, "d2": {"rag", "graph-rag"}, "d3": {"cooking"}}
    got = {(r["src_id"], r["dst_id"]) for r in G.related_edges(docs(spark, sets), concepts(spark, ["rag", "graph-rag", "cooking"]), assigned(spark, sets)).collect()}
    assert got == {("d1", "d2"), ("d2", "d1")}


def test_cooccurrence_edges(spark):
    args = docs(spark, SETS), concepts(spark, NAMES), assigned(spark, SETS)
    got = {(r["src_id"], r["dst_id"]): r["weight"] for r in G.cooccurrence_edges(*args).collect()}
    assert got == {("graph-rag", "rag"): 2.0, ("rag", "graph-rag"): 2.0, ("knowledge-graph", "rag"): 2.0, ("rag", "knowledge-graph"): 2.0}
    assert G.cooccurrence_edges(*args, least=3).count() == 0
    assert G.cooccurrence_edges(*args, top_k=1).where("src_id = 'rag'").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_limited_pairs_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i:02}" for i in range(12)]
    pairs = [(a, b, rng.randint(2, 5)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.6]
    used, taken = defaultdict(int), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used[a] < 3 and used[b] < 3:
            taken.add((a, b))
            used[a] += 1
            used[b] += 1
    got = G.limit_pairs(spark.createDataFrame(pairs, "c1 string, c2 string, n long"), 3).collect()
    assert {(r["c1"], r["c2"]) for r in got} == taken


def test_incremental_equals_full(spark):
    changed = {"d1": {"rag"}, "d6": {"new"}}
    got = G.replace_documents(assigned(spark, SETS), assigned(spark, changed), spark.createDataFrame([("d5",)], "doc_id string"))
    full = {**SETS, **changed}
    full.pop("d5")
    assert {tuple(r) for r in got.collect()} == {(d, c) for d, cs in full.items() for c in cs}


def test_states(spark):
    rows = [("a", "b", "Related", 0.5, "2024-01-01T00:00:00+00:00"), ("a", "b", "related", None, "2024-01-02T00:00:00Z"), ("a", "a", "related", 1.0, None), (None, "b", "related", 1.0, None)]
    got = views.current_edges(spark.createDataFrame(rows, "src_id string, dst_id string, edge_type string, weight double, updated_at string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "related", 0.0)]
    ids = views.assignments(spark.createDataFrame([(" d ", "C"), ("d", " c"), (None, "c"), ("d", " ")], "doc_id string, concept_id string")).collect()
    assert [tuple(r) for r in ids] == [("d", "c")]


def test_health_on_small_and_empty(spark):
    d, a, c = docs(spark, SETS), assigned(spark, SETS), concepts(spark, NAMES)
    edges = spark.createDataFrame([("d1", "d2", "related", 1.0), ("d1", "x", "source", 1.0)], "src_id string, dst_id string, edge_type string, weight double")
    sources = spark.createDataFrame([("k",), ("k",), (None,)], "source_key string")
    hashed = d.withColumn("content_hash", H.F.lit("sha256:1"))
    row = H.overview(hashed, a, edges, c, sources).first()
    assert (row["documents"], row["orphans"], row["isolated"], row["max_degree"], row["duplicate_keys"]) == (5, 0, 3, 2, 1)
    assert abs(row["duplicate_rate"] - 0.8) < 1e-9
    none = H.overview(hashed.limit(0), a.limit(0), edges.limit(0), c.limit(0), sources.limit(0)).first()
    assert none["documents"] == 0 and none["max_degree"] == 0 and none["duplicate_rate"] == 0


def test_listings(spark):
    stats = spark.createDataFrame([("d1", "web", 0, 0.9)], "doc_id string, source_type string, has_source int, importance double")
    d = docs(spark, SETS)
    assert [r["id"] for r in listing(d, stats, "importance", per_page=2).collect()] == ["d1", "d5"]
    assert [r["id"] for r in listing(d, stats, "nonsense", page=2, per_page=2).collect()] == ["d3", "d2"]
    assert tuple(pages(d.limit(0)).first()) == (0, 1)


def test_notes(spark):
    noted = spark.createDataFrame([("graph-rag",)], "concept_id string")
    got = G.note_candidates(concepts(spark, NAMES), assigned(spark, SETS), docs(spark, SETS), noted)
    notes = {r["concept_id"]: r["note"] for r in got.select("concept_id", G.concept_note(G.F.col("label"), G.F.col("df"), G.F.col("titles")).alias("note")).collect()}
    assert set(notes) == {"rag", "knowledge-graph"}
    assert notes["knowledge-graph"] == "# knowledge-graph\n\nAppears in 2 document(s).\n\n## Documents\n- T d1\n- T d3\n"


def test_an_incremental_build_equals_a_full_one(spark):
    sets = {"d1": {"rag", "graph-rag", "acme"}, "d2": {"rag", "graph-rag"}, "d3": {"rag", "cooking"}, "d4": {"cooking"}}
    older = {"d1": {"cooking"}, "d2": {"rag", "graph-rag"}, "d4": {"cooking"}, "gone": {"rag"}}
    names = concepts(spark, ["rag", "graph-rag", "cooking"]).unionByName(spark.createDataFrame([("acme", "Acme", "entity", 0)], "concept_id string, label string, kind string, is_stop int"))
    keyed = docs(spark, sets).withColumn("source_key", F.concat(F.lit("memo:"), "id"))
    stats = spark.createDataFrame([(d, "web", 0, 0.0) for d in sets], "doc_id string, source_type string, has_source int, importance double")
    full = G.full_build(keyed, names, assigned(spark, sets), stats)
    fresh = assigned(spark, {d: sets[d] for d in ("d1", "d3")})
    again = G.incremental_build({"doc_concepts": assigned(spark, older)}, keyed, names, fresh, spark.createDataFrame([("gone",)], "doc_id string"), stats)
    for name in full:
        assert sorted(map(str, full[name].collect())) == sorted(map(str, again[name].collect())), name
    assert {r["edge_type"] for r in full["edges"].collect()} == {"related", "cooccurrence", "entity", "source"}


def test_edges_of_deleted_documents_leave(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src_id string, dst_id string")
    assert [tuple(r) for r in G.drop_documents(edges, spark.createDataFrame([("b",)], "doc_id string")).collect()] == [("c", "d")]
