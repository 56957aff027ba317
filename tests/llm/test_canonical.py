import random

import pytest

from quillmesh.llm.canonical import canonical_values, edit_distance, map_mentions, tokens_of

ENTRIES = [
    ("hybrid-planning", "Hybrid Planning"), ("sparse-vocabulary-navigation", "Sparse Vocabulary Navigation (SVN)"), ("robust-caching", "ロバストキャッシング"), ("wexobel", None),
    ("undorrost-labs", "Undorrost Labs"), ("semantic-encryption", "semantic-encryption"), ("context-encryption", "Context Encryption"),
]
VALUES = {
    "hybrid-planning": "hybrid-planning", "Hybrid Planning": "hybrid-planning", "htbrid-planning": "hybrid-planning", "HYBRID PLANNING": "hybrid-planning", "planning, hybrid": "hybrid-planning", "HybridPlanning": "hybrid-planning",
    "  #hybrid_planning\t": "hybrid-planning", "hybrid planning (notes)": "hybrid-planning", "hybrid plann.": "hybrid-planning", "ｈｙｂｒｉｄ　ｐｌａｎｎｉｎｇ": "hybrid-planning", "hýbrid planning – misc": "hybrid-planning",
    "SVN": "sparse-vocabulary-navigation", "S.V.N.": "sparse-vocabulary-navigation", "#svns": "sparse-vocabulary-navigation", "ロバスト キャッシング ": "robust-caching", "ﾛﾊﾞｽﾄｷｬｯｼﾝｸﾞ": "robust-caching", "wexoble": "wexobel",
    "labs, undorrost": "undorrost-labs", "semantic context encryption": None, "hybrid knitting": None, "hybrid": None, "???": None, "Knitting shop": None, "semantic": None,
}


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES + [(None, "nobody")], "concept_id string, label string")


def test_values(spark, entries):
    df = spark.createDataFrame([(v, 1, "x") for v in VALUES] + [(None, 2, "y"), (" ", 3, "z")], "raw_label string, entry int, word string")
    got = {r["raw"]: (r["entry"], r["how"]) for r in canonical_values(df, "raw_label", entries, "concept_id", "label").collect()}
    assert {k: v[0] for k, v in got.items()} == VALUES
    assert got["hybrid-planning"][1] == got["Hybrid Planning"][1] == "exact" and got["SVN"][1] == "repaired" and got["semantic"][1] == "unmatched"


def test_every_mention_comes_out(spark, entries):
    df = spark.createDataFrame([(1, "SVN"), (2, "SVN"), (3, None), (4, ""), (5, "x" * 20000)], "mention_id long, raw_label string")
    got = {r["mention_id"]: (r["entry"], r["how"]) for r in map_mentions(df, "mention_id", "raw_label", entries, "concept_id", "label").collect()}
    assert got == {1: ("sparse-vocabulary-navigation", "repaired"), 2: ("sparse-vocabulary-navigation", "repaired"), 3: (None, "blank"), 4: (None, "blank"), 5: (None, "unmatched")}


def test_empty_tables(spark, entries):
    none = spark.createDataFrame([], "raw_label string")
    assert canonical_values(none, "raw_label", entries, "concept_id", "label").count() == 0
    got = canonical_values(spark.createDataFrame([("a b",)], "raw_label string"), "raw_label", entries.limit(0), "concept_id", "label").collect()
    assert [(r["entry"], r["how"]) for r in got] == [(None, "unmatched")]


def test_long_words_keep_both_edits(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in range(36, 72, 2)]
    typed = {}
    for word in words:
        for _ in range(6):
            w = list(word)
            for _ in range(2):
                i = rng.randrange(1, len(w) - 1)
                match rng.randrange(4):
                    case 0: w[i] = "z"
                    case 1: del w[i]
                    case 2: w.insert(i, "z")
                    case 3: w[i], w[i + 1] = w[i + 1], w[i]
            if edit_distance("".join(w), word) in (1, 2):
                typed["".join(w)] = word
    entries = spark.createDataFrame([(w, None) for w in words], "concept_id string, label string")
    got = {r["raw"]: r["entry"] for r in canonical_values(spark.createDataFrame([(t,) for t in typed], "raw_label string"), "raw_label", entries, "concept_id", "label").collect()}
    assert got == typed and len(typed) > 60


def test_small_helpers():
    assert edit_distance("spetcral", "spectral") == 1 and edit_distance("abc", "") == 3 and edit_distance("kitten", "sitting") == 3
    assert tokens_of("provena. columnar") == [("provena", True), ("columnar", False)] and tokens_of("") == []
