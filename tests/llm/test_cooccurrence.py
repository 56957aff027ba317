import math
from collections import Counter
from itertools import combinations

import pytest

from quillmesh.llm.cooccurrence import cooccurrence, significant_pairs

FIELDS = "doc_id string, concept_id string, item string, n int"


def rows_of(baskets):
    return [(d, c, "clash", 1) for d, cs in baskets.items() for c in cs]


def brute(baskets):
    sets = [sorted({c.strip().lower() for c in cs}) for cs in baskets.values()]
    return Counter(p for s in sets for p in combinations(s, 2)), Counter(c for s in sets for c in s), len(sets)


@pytest.fixture(scope="module")
def baskets():
    out = {f"d{i}": ["hub", f"c{i % 7}", f"e{i % 5}", f"c{i % 7} "] for i in range(60)}
    out["big"] = [f"c{i}" for i in range(40)] + ["hub"]
    return out


@pytest.mark.parametrize("block", [256, 6])
def test_counts_equal_brute_force_also_in_blocks(spark, baskets, block):
    pairs, single, n = brute(baskets)
    got = cooccurrence(spark.createDataFrame(rows_of(baskets), FIELDS), "doc_id", "concept_id", block=block).collect()
    assert {(r["concept_a"], r["concept_b"]): r["n_ab"] for r in got} == dict(pairs)
    assert all((r["n_a"], r["n_b"], r["n_records"]) == (single[r["concept_a"]], single[r["concept_b"]], n) for r in got)


def test_likelihood_ratio(spark, baskets):
    def h(*ks):
        return sum(k * math.log(k) for k in ks if k)

    for r in cooccurrence(spark.createDataFrame(rows_of(baskets), FIELDS), "doc_id", "concept_id").collect():
        k, a, b, n = r["n_ab"], r["n_a"], r["n_b"], r["n_records"]
        expected = 2 * (h(k, a - k, b - k, n - a - b + k) - h(a, n - a) - h(b, n - b) + h(n))
        assert abs(r["llr"] - max(0, expected)) < 1e-6


def test_only_significant_pairs(spark):
    baskets = {f"d{i}": ["x", "y"] if i < 5 else ["x"] if i < 6 else ["z"] for i in range(40)}
    got = significant_pairs(spark.createDataFrame(rows_of(baskets), FIELDS), "doc_id", "concept_id").collect()
    assert [(r["concept_a"], r["concept_b"], r["n_ab"]) for r in got] == [("x", "y", 5)]


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [("d", "A", "", 1), ("d", " a ", "", 1), ("d", None, "", 1), ("d", "  ", "", 1), (None, "b", "", 1), (" ", "b", "", 1), ("d", "b", "", 1)]
    got = cooccurrence(spark.createDataFrame(rows, FIELDS), "doc_id", "concept_id").collect()
    assert [(r["concept_a"], r["concept_b"], r["n_ab"], r["n_records"]) for r in got] == [("a", "b", 1, 1)]
    assert cooccurrence(spark.createDataFrame([], FIELDS), "doc_id", "concept_id").count() == 0
