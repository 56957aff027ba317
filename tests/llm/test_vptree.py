import numpy as np
import pytest

from quillmesh.llm import vptree
from quillmesh.llm.vptree import ShardTree, nearest, similar_pairs, usable_vectors


def made(seed=1, n=400, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.15
    return x


def frame(spark, x, models=("m",)):
    rows = [(i, models[i % len(models)], [float(v) for v in r], i, "clash") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, model string, embedding array<float>, rep long, unit string")


def brute(df, k):
    rows = df.select("vec_id", "model", "embedding").collect()
    out = {}
    for model in {r["model"] for r in rows}:
        own = sorted((r["vec_id"], r["embedding"]) for r in rows if r["model"] == model)
        ids, x = [i for i, _ in own], np.array([e for _, e in own], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = x @ x.T
        for i, q in enumerate(ids):
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(c[i, j], 9), ids[j]))[:k]
            out[q] = [ids[j] for j in order]
    return out


def test_shard_tree_is_exact_at_factor_one():
    x = made()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    old, vptree.LEAF_ROWS = vptree.LEAF_ROWS, 32
    try:
        ids, d = ShardTree(np.arange(len(x)), x).search(x, 5, np.full(len(x), 2.0), 1.0)
    finally:
        vptree.LEAF_ROWS = old
    assert (np.sort(d, axis=1) == d).all()
    true = np.sort(np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)), axis=1)[:, :5]
    assert np.abs(d - true).max() < 1e-6


def test_nearest_equals_brute_force_over_shards(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 40)
    df = usable_vectors(frame(spark, made(), ("a", "b")))
    true = brute(df, 10)
    got = {}
    for r in nearest(df, 10, prune=1.0).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r["other"])
    hits = sum(len(set(got[q]) & set(true[q])) for q in true)
    assert hits == sum(map(len, true.values()))


def test_recall_of_the_default_factor(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 40)
    df = usable_vectors(frame(spark, made(3)))
    true = brute(df, 10)
    got = nearest(df, 10).collect()
    assert sum(r["other"] in true[r["vec_id"]] for r in got) >= 0.9 * sum(map(len, true.values()))


def test_copies_tie_by_id_and_a_hot_vector_stays_whole(spark):
    x = np.vstack([np.ones((30, 64)), made(5, 10)])
    got = nearest(usable_vectors(frame(spark, x)), 10).where("vec_id < 30").collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["rank"]] = r["other"]
    assert len(by) == 30 and all([v[i] for i in range(1, 11)] == [j for j in range(11) if j != q][:10] for q, v in by.items())


def test_unusable_vectors_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0] * 64
    rows = [(1, "m", good), (2, "m", None), (3, "m", [1.0] * 63), (4, "m", [0.0] * 64), (5, "m", good[:-1] + [nan]), (6, "m", good[:-1] + [inf]), (7, None, good), (None, "m", good), (8, "m", [2.0] * 64), (9, "m", good[:-1] + [None])]
    df = usable_vectors(spark.createDataFrame(rows, "vec_id long, model string, embedding array<float>"))
    assert sorted(r["vec_id"] for r in df.collect()) == [1, 8]
    assert [tuple(r) for r in similar_pairs(df).collect()] == [(1, 8)]
    assert similar_pairs(df.limit(0)).count() == 0


def test_some_queries_against_all(spark):
    df = usable_vectors(frame(spark, made(2, 120)))
    true = brute(df, 3)
    got = nearest(df, 3, queries=df.where("vec_id % 50 = 0")).collect()
    assert {r["vec_id"] for r in got} == {0, 50, 100}
    assert all(r["other"] in true[r["vec_id"]] for r in got)


@pytest.mark.parametrize("k", [1, 10])
def test_fewer_than_k(spark, k):
    got = nearest(usable_vectors(frame(spark, made(4, 3))), k).groupBy("vec_id").count().collect()
    assert all(r["count"] == min(k, 2) for r in got)
