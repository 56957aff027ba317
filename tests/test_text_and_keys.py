import hashlib
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import analysis as A
from quillmesh.functions import keys as K
from quillmesh.functions import text as T
from quillmesh.functions import training_records as R
from quillmesh.operators import search as S
from quillmesh.operators import vectors as V


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def key(spark, source_type, url=None, title=None, doc_id=None):
    row = spark.createDataFrame([(source_type, url, title, doc_id)], "s string, u string, t string, d string")
    return row.select(K.source_key(F.col("s"), F.col("u"), F.col("t"), F.col("d"))).first()[0]


def test_source_keys(spark):
    digest = hashlib.sha256(b"a title").hexdigest()[:16]
    cases = [
        (("web", "https://Example.com:8080/a/?utm_source=x&b=1&ref=q#top"), "url:https://example.com/a?b=1"),
        (("web", "https://u:p@example.com/"), "url:https://example.com"), (("web", None, "A Title "), f"paper:{digest}"), (("web", None, None, "X1"), "memo:X1"), (("memo", "https://a.b", "t", "X2"), "memo:X2"),
        (("git_repo", "https://github.com/owner/name.git"), "repo:github.com/owner/name"), (("repo", "owner/name"), "repo:github.com/owner/name"), (("repo", "https://gitlab.com/a/b/"), "repo:gitlab.com/a/b"),
        (("paper", "https://doi.org/10.1000/xyz"), "doi:10.1000/xyz"), (("paper", "doi:10.1000/xyz"), "doi:10.1000/xyz"), (("paper", "https://arxiv.org/abs/2401.12345v2"), "arxiv:2401.12345v2"), (("paper", "arxiv:hep-th/9901001"), "arxiv:hep-th/9901001"),
        (("paper", "https://x.org/p.pdf", "A title"), f"paper:{digest}"), (("paper",), "paper:unknown"), ((None, None, None, None), "memo:unknown"),
    ]
    for args, expected in cases:
        assert key(spark, *args) == expected, args


def test_canonical_url_keeps_order_and_drops_blank(spark):
    urls = ["https://a.b/?z=1&y=&x=2&gclid=3&UTM_A=4", "a.b/c/", "", None]
    assert column(spark, urls, K.canonical_url) == ["https://a.b?z=1&x=2", "a.b/c", "", None]


def test_canonical_url_encodes_parameters_anew(spark):
    urls = ["https://a.b/p?a=b=", "https://a.b/p?q=a%20b&r=c+d", "https://a.b/p?x", "https://a.b/p?k=%E3%81%82*~", "https://a.b/p?t=100%&u=1"]
    assert column(spark, urls, K.canonical_url) == ["https://a.b/p?a=b%3D", "https://a.b/p?q=a+b&r=c+d", "https://a.b/p", "https://a.b/p?k=%E3%81%82%2A~", "https://a.b/p?t=100%25&u=1"]


def test_identifiers(spark):
    assert column(spark, ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?t=1&v=abcdefghijk", "https://www.youtube.com/shorts/abcdefghijk", "https://a.b"], K.video_id) == ["abcdefghijk"] * 3 + [None]
    assert column(spark, ["https://github.com/a/b.git", "git@github.com:a/b.git", "a/b", "x"], K.repo_name) == ["a/b", "a/b", "a/b", None]
    assert column(spark, ["abc"], K.shard_path) == ["ba/78/abc.md"]


def test_ulids_sort_by_time_and_repeat(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' as t, 'a' as s union all select timestamp'2024-01-01 00:00:01', 'a' union all select timestamp'2024-01-01 00:00:00', 'b'")
    made = [r[0] for r in rows.select(K.ulid(F.col("t"), F.col("s"))).collect()]
    assert made[0][:10] == made[2][:10] == "01HK153X00" and made[0] < made[1] and made[0] != made[2] and all(len(m) == 26 for m in made)
    assert made == [r[0] for r in rows.select(K.ulid(F.col("t"), F.col("s"))).collect()]
    assert column(spark, ["My Tag! x", "日本", ""], K.slug) == ["my-tag-x", "all", "all"]


def test_yaml_scalars(spark):
    values = ["plain", "a: b", "end:", "- x", "", "https://x.y", 'say "hi": now', "trailing ", None]
    assert column(spark, values, T.yaml_scalar) == ["plain", '"a: b"', '"end:"', '"- x"', '""', "https://x.y", '"say \\"hi\\": now"', '"trailing "', "null"]


def test_front_matter(spark):
    rows = spark.createDataFrame([("---\nid: 1\ntitle: \"x\"\nid: 2\n---\n\nbody\n---\n",), ("no matter",), ("---\nid: 1\nnever ends",), ("",)], "v string")
    meta, body = T.front_matter(F.col("v"))
    got = [(r["m"], r["b"]) for r in rows.select(meta.alias("m"), body.alias("b")).collect()]
    assert got == [({"id": "2", "title": '"x"'}, "body\n---\n"), ({}, "no matter"), ({}, "---\nid: 1\nnever ends"), ({}, "")]


@pytest.mark.parametrize(
    "name, content, expected",
    [
        ("a.md", "# Title\ntext", ("Title", None, "memo")), ("b.url", "https://x.y/z", ("b", "https://x.y/z", "web")), ("c.txt", "https://x.y\nmore", ("c", "https://x.y", "web")),
        ("d.md", "https://x.y\nHeadline\nbody", ("Headline", "https://x.y", "web")), ("e.md", "   ", ("e", None, "memo")),
    ],
)
def test_inbox_files(spark, name, content, expected):
    row = spark.createDataFrame([(name, content)], "n string, c string").select(T.classify_file(F.col("n"), F.col("c")).alias("x")).first()["x"]
    assert tuple(row) == expected


def test_broken_front_matter(spark):
    assert column(spark, ["---\nid: 1\n", "---\nid: 1\n---\nx", "x"], T.broken_front_matter) == [True, False, False]


DOCS = [("a", "Shard guide", "https://x.y/shard", "The shard index is small. A café helps."), ("b", "", "", "An index of shards and an index of cafes"), ("c", "Cooking", "", "rice"), ("d", "日本語検索", "", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, title string, source string, content string")


@pytest.mark.parametrize("text", ["shard", "index cafe", "shard OR rice", "index NOT shard", "shar*", '"shard index"', "title:shard", "NEAR(shard small, 2)", "^cooking", "nothing"])
def test_search_finds_what_sqlite_finds(spark, docs, text):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, title, source, content)")
    db.executemany("insert into t values (?, ?, ?, ?)", [tuple(x or "" for x in d) for d in DOCS])
    want = dict(db.execute("select id, rank from t where t match ?", (text.replace("NEAR(shard small, 2)", "NEAR(shard small, 2)"),)).fetchall())
    got = {r["id"]: r["score"] for r in S.search(docs, text, None).collect()}
    assert set(got) == set(want)
    if " " not in text and not text.startswith('"') and "*" not in text and ":" not in text:
        assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_empty_queries_and_tables(spark, docs):
    for text in ("", "  ", "NOT x", "???"):
        with pytest.raises(ValueError):
            S.search(docs, text)
    assert S.search(docs.limit(0), "shard").count() == 0


def test_a_stored_index_answers_as_documents_do(spark, docs, tmp_path):
    index = S.write_index(docs, str(tmp_path / "index"))
    for text in ("parser", "pars*", "s*", "index OR parser", "index NOT parser", "title:parser"):
        assert sorted(map(tuple, S.search(index, text, limit=None).collect())) == sorted(map(tuple, S.search(docs, text, limit=None).collect())), text
    empty = S.write_index(docs.limit(0), str(tmp_path / "none"))
    assert S.search(empty, "parser").count() == 0 and S.search_page(empty, "parser").count() == 0


def test_pages_of_a_search(spark):
    rows = spark.createDataFrame([(f"d{i:02}", "parser", "", "word " * i) for i in range(45)], "id string, title string, source string, content string")
    pages = [S.search_page(rows, "parser", page=i).collect() for i in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0] and {r["total"] for p in pages for r in p} == {45}
    assert [r["id"] for p in pages for r in p] == [r["id"] for r in S.search(rows, "parser", limit=None).collect()]


def test_parentheses_are_refused():
    with pytest.raises(ValueError):
        S.read_query("(a OR b) c")
    assert S.read_query("NEAR(a b, 3)").wanted()[0].near == 3


def test_engine_preference(spark):
    rows = spark.createDataFrame([("a", "One", "schema trace"), ("b", "", "buffer")], "id string, title string, content string")
    by_words = V.preferred_search(None, rows, "schema trace", lambda texts: [[1.0, 0.0]] * len(texts)).collect()
    assert [(r["id"], r["title"]) for r in by_words] == [("a", "One")]
    stored = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "id string, embedding array<double>")
    assert [(r["id"], r["title"], r["score"]) for r in V.preferred_search(stored, rows, "x", lambda texts: [[1.0, 0.0]] * len(texts)).collect()] == [("b", "b", 1.0)]


def test_snippet():
    assert S.snippet("one two three four", ["three"], tokens=2) == "...>>>three<<< four"
    assert S.snippet("", ["x"]) == "" and S.snippet("a b", ["z"]) == "a b"


def test_vectors_are_unit_and_rank(spark):
    df = spark.createDataFrame([("a", "t", "retrieval of documents by vectors"), ("b", "t", "retrieval with documents"), ("c", "", "cooking rice"), ("d", None, None)], "id string, title string, content string")
    norms = V.tfidf(df).groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert len(norms) == 3 and all(abs(r["s"] - 1) < 1e-9 for r in norms)
    assert [r["id"] for r in V.tfidf_search(df, "retrieval documents").collect()] == ["b", "a"]
    assert V.tfidf(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [256, 128, 64])
def test_hash_embedding_equals_its_engine(spark, dim):
    df = spark.createDataFrame([("a", "One two three two"), ("b", ""), ("c", None)], "id string, content string")
    long = V.hash_embedding(df, dim).collect()
    assert {r["id"] for r in long} == {"a"} and abs(sum(r["w"] ** 2 for r in long) - 1) < 1e-9
    if dim == 256:
        dense = {r["id"]: r["embedding"] for r in V.embed_with(df, "hash").collect()}
        assert np.allclose([dense["a"][r["dim"]] for r in long], [r["w"] for r in long]) and not any(dense["b"])
    with pytest.raises(ValueError):
        V.embed_with(df, "unknown")


def test_embedding_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id int, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in V.embedding_search(df, [2.0, 0.0]).collect()] == [(1, 1.0), (2, 0.7071)]


def test_analysis(spark):
    answers = ['```json\n{"title": "T", "primary_concepts": ["Graph RAG", {"id": "x", "label": "X"}], "confidence": 0.5}\n```', "no json {", None, 'text {"a": "}"} more']
    rows = spark.createDataFrame([(str(i), a) for i, a in enumerate(answers)], "doc_id string, answer string")
    got = {r["doc_id"]: r for r in A.read_analyses(rows).collect()}
    assert got["0"]["title"] == "T" and [(c["id"], c["label"]) for c in got["0"]["primary_concepts"]] == [("graph-rag", "Graph RAG"), ("x", "X")]
    assert got["1"]["title"] == "" and got["2"]["confidence"] == 0.0 and got["3"]["key_points"] == []
    assert A.first_json('a [1, "]"] b') == '[1, "]"]'

    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return "ok"

    done = {r["doc_id"]: (r["answer"], r["error"]) for r in A.analyse(spark.createDataFrame([("1", "good"), ("2", "bad")], "doc_id string, prompt string"), model).collect()}
    assert done == {"1": ("ok", None), "2": (None, "no")}


def test_generated_pairs(spark):
    first = 'Here [you] go: ```json [{"instruction": " What? ", "response": "This.", "difficulty": "easy", "tags": ["a"]}, 7, {"instruction": "", "response": "x"}] ```'
    second = '[{"instruction": "what?", "response": "again"}, {"instruction": "How?", "context": "c", "response": "So."}]'
    answers = spark.createDataFrame([(2, "d2", second), (1, "d1", first), (3, "d3", "no pairs"), (4, "d4", None)], "n long, doc_id string, answer string")
    got = {r["instruction"]: (r["doc_id"], r["context"], r["response"], r["difficulty"], r["tags"]) for r in R.read_generated(answers, "n").collect()}
    assert got == {"What?": ("d1", "", "This.", "easy", ["a"]), "How?": ("d2", "c", "So.", "", [])}
    assert tuple(R.generation_counts(answers, R.read_generated(answers, "n")).first()) == (4, 4, 2)


def test_prompts(spark):
    row = spark.createDataFrame([("T", "paper", None, "b" * 5000)], "t string, s string, m string, b string")
    text = row.select(R.training_prompt("{title}|{source_type}|{summary}|{n_pairs}|{body}", F.col("t"), F.col("s"), F.col("m"), F.lit("x"), F.col("b"))).first()[0]
    assert text == "T|paper||5|" + "b" * 4000
    known = {"authors": F.lit("A, B"), "doi": F.lit(""), "description": F.lit("tool"), "language": F.lit("C")}
    headed = [row.select(A.with_header(F.lit(kind), F.lit("body"), **known)).first()[0] for kind in ("paper", "repo", "web")]
    assert headed == ["Authors: A, B\n\nbody", "Description: tool\nLanguage: C\n\nbody", "body"]


def test_an_analysis_is_written_and_replaced():
    import yaml

    text = "---\nid: a\ntitle: 'x: y'\nsummary: old\nconcepts:\n  - b\n\n  - c\n# note\nrating: 2\n---\n\nbody\n---\nrest"
    found = {"summary": "s: t", "confidence": 0.5, "primary_concepts": [{"id": "k", "label": "K: k"}], "candidate_concepts": [], "entities": [{"id": "e", "label": "E"}], "display_tags": ["t"]}
    for _ in range(2):
        text = A.analysed_text(text, found)
    meta = yaml.safe_load(text.split("---")[1])
    assert meta["concepts"] == {"primary": [{"id": "concept:k", "label": "K: k", "weight": 1.0}], "entities": [{"id": "e", "label": "E"}]}
    assert (meta["id"], meta["title"], meta["summary"], meta["rating"], meta["tags_display"]) == ("a", "x: y", "s: t", 2, ["t"]) and meta["analysis"]["confidence"] == 0.5
    assert text.endswith("\n---\n\nbody\n---\nrest") and A.analysed_text("no front matter", found) == "no front matter"


def test_a_document_is_edited():
    text = A.edited_text("---\nid: a\n---\n\nbody", memo=" m ", rating="4")
    assert text == "---\nid: a\nmemo: m\nrating: 4.0\n---\n\nbody\n"
    assert A.edited_text(text, memo="", rating="many") == "---\nid: a\nrating: 4.0\n---\n\nbody\n"


def test_analysis_rows(spark):
    ref = "array<struct<id:string,label:string>>"
    found = spark.createDataFrame([("d", [("a", "A")], [("b", "B")], 0.0), ("e", [], [], None)], f"doc_id string, primary_concepts {ref}, candidate_concepts {ref}, confidence double")
    assert {tuple(r) for r in A.concept_rows(found).collect()} == {("d", "a", "primary", 1.0), ("d", "b", "candidate", 0.5)}
    rows = spark.createDataFrame([("d",), ("e",), ("f",)], "doc_id string")
    assert {r["doc_id"] for r in A.without_analysis(rows, found).collect()} == {"e", "f"}
