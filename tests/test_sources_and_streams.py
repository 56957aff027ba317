import json

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import ingest as I
from quillmesh.operators.health import file_problems
from quillmesh.session import shared_folder
from quillmesh.sources import config, markdown, parsers, sinks
from quillmesh.streaming.inbox import inbox_stream, ingest_stream, windowed_counts

LEDGER = "source_key string, canonical_url string, first_doc_id string, last_doc_id string, content_hash string, created_at string, updated_at string"


def files(tmp_path, contents):
    for name, text in contents.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_markdown_source(spark, tmp_path):
    path = files(tmp_path, {"ab/one.md": "---\nid: d1\ntitle: One\nconcepts:\n  primary: [{id: 'concept:rag'}]\n  entities: [{id: acme, label: Acme}]\n---\n\nBody", "two.md": "no id", "x.txt": "---\nid: no\n---\n", "bad.md": "---\nid: d2\ntitle: [\n---\n"})
    got = {r["id"]: (r["title"], r["content"], r["source_type"]) for r in markdown.read_documents(spark, path).collect()}
    assert got == {"d1": ("One", "Body", "web"), "d2": ("[", "", "web")}
    named = {tuple(r) for r in markdown.read_concepts(markdown.read_files(spark, path)).collect()}
    assert named == {("d1", "concept", "rag", "rag"), ("d1", "entity", "acme", "Acme")}


def test_concept_forms():
    assert markdown.concepts_of({"concepts": "a, b"}) == (["a", "b"], [])
    assert markdown.concepts_of({"concepts": ["a", {"id": "concept:b"}, {"id": ""}]}) == (["a", "b"], [])
    assert markdown.concepts_of(None) == ([], [])


def test_config(tmp_path):
    files(tmp_path, {"aliases.yml": "rag: retrieval\n", "stop.yml": "- ai\n", "tax.yml": "collections:\n  x: {include_types: [paper]}\n", "me.yml": "interests: [RAG]\n"})
    assert config.load_aliases(f"{tmp_path}/aliases.yml") == {"rag": "retrieval"} and config.load_aliases(f"{tmp_path}/none.yml") == {}
    assert config.load_stop_concepts(f"{tmp_path}/stop.yml") == {"ai"} and config.load_taxonomy(f"{tmp_path}/tax.yml") == {"x": {"include_types": ["paper"]}} and config.load_interests(f"{tmp_path}/me.yml") == {"rag"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    assert sinks.export_parquet({"t": df, "none": df.limit(0)}, f"{tmp_path}/out") == {"t": 2, "none": 0}
    assert spark.read.parquet(f"{tmp_path}/out/none").columns == ["a", "b"]
    sinks.export_jsonl(df, f"{tmp_path}/json")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert sorted(lines, key=lambda x: x["a"]) == [{"a": 1, "b": "é"}, {"a": 2}]
    sinks.write_vectors(spark.createDataFrame([("x", 3, 0.5)], "id string, dim int, w double"), f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 1
    blobs = sinks.read_blobs(spark, files(tmp_path / "raw", {"a.pdf": "x"}), "*.pdf")
    assert parsers.pdf_documents(blobs, lambda b: ["one", None, "y" * 6000]).first()["body"].endswith("\n\n... [truncated]")


def test_parsers(spark):
    typed = spark.createDataFrame([("2401.12345",), ("https://arxiv.org/pdf/2401.12345v2",), ("https://doi.org/10.1000/x",), ("some title",)], "t string")
    got = [tuple(r["p"]) for r in typed.select(parsers.classify_paper(F.col("t")).alias("p")).collect()]
    assert got == [("arxiv", "2401.12345"), ("arxiv", "2401.12345v2"), ("doi", "10.1000/x"), ("raw", "some title")]
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A\n b</title><summary>S</summary><published>2024-01-02</published><author><name>X</name></author><author><name>Y</name></author></entry></feed>"
    row = parsers.paper_records(spark.createDataFrame([(feed,)], "feed string")).first()
    assert (row["title"], row["authors"], row["year"]) == ("A b", "X, Y", "2024")
    record = json.dumps({"full_name": "o/n", "description": "D", "language": "Go", "stargazers_count": 3, "html_url": "https://github.com/o/n"})
    row = parsers.repository_records(spark.createDataFrame([(record, "UmVhZA==")], "record string, readme string")).first()
    assert row["title"] == "o/n" and row["body"] == "D\n\n- Language: Go\n- Stars: 3\n\nRead"
    row = parsers.video_records(spark.createDataFrame([("https://youtu.be/abcdefghijk", "broken")], "url string, record string")).first()
    assert (row["video_id"], row["title"]) == ("abcdefghijk", "")


def test_decisions_follow_the_order(spark):
    rows = [("1.md", "k", "h1", "n1"), ("2.md", "k", "h1", "n2"), ("3.md", "k", "h2", "n3"), ("1.md", "new", "h", "n4"), ("2.md", "new", "h", "n5")]
    incoming = spark.createDataFrame([(*r, "u") for r in rows], "name string, source_key string, content_hash string, doc_id string, url string")
    ledger = spark.createDataFrame([("k", "u", "old", "old", "h0", "t0", "t0"), ("other", "u", "o", "o", "h", "t0", "t0")], LEDGER)
    decided = I.ingest_decisions(incoming, ledger)
    assert {(r["source_key"], r["name"]): (r["action"], r["doc_id"]) for r in decided.collect()} == {
        ("k", "1.md"): ("update", "old"), ("k", "2.md"): ("skip", "old"), ("k", "3.md"): ("update", "old"), ("new", "1.md"): ("new", "n4"), ("new", "2.md"): ("skip", "n4"),
    }
    after = {r["source_key"]: (r["first_doc_id"], r["last_doc_id"], r["content_hash"], r["created_at"]) for r in I.update_ledger(ledger, decided, "t1").collect()}
    assert after == {"k": ("old", "old", "h2", "t0"), "new": ("n4", "n4", "h", "t1"), "other": ("o", "o", "h", "t0")}
    assert I.ingest_decisions(incoming.limit(0), ledger).count() == 0


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "rel_path string, content_hash string")
    new = spark.createDataFrame([("a", "2"), ("c", None), ("d", "1")], "rel_path string, content_hash string")
    assert {tuple(r) for r in I.snapshot_changes(old, new).collect()} == {("a", "M"), ("b", "D"), ("d", "A")}
    index, disk = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int"), spark.createDataFrame([("b", 9), ("c", 3)], "id string, x int")
    assert {tuple(r) for r in I.repair_index(index, disk).collect()} == {("b", 2), ("c", 3)}
    assert {tuple(r) for r in I.verify_index(index, disk).collect()} == {("a", "ghost"), ("c", "missing")}


def test_inbox_stream_equals_a_batch(spark, tmp_path):
    inbox = files(tmp_path / "inbox", {"a.md": "# A\ntext", "b.txt": "https://x.y\nmore", "c.md": "https://x.y/?utm_source=z\nHead\nbody", "d.pdf": "no", "e.md": "---\nbroken", "f.md": " "})
    ledger = spark.createDataFrame([], LEDGER)
    ledger.write.parquet(f"{tmp_path}/ledger/v=0")
    query = ingest_stream(inbox_stream(spark, inbox), f"{tmp_path}/ledger", f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    got = {(r["name"], r["action"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = I.ingest_decisions(I.inbox_documents(markdown.read_files(spark, inbox, "*")), ledger)
    assert got == {(r["name"], r["action"]) for r in batch.collect()} == {("a.md", "new"), ("b.txt", "new"), ("c.md", "update")}
    assert spark.read.parquet(f"{tmp_path}/ledger/v=1").count() == 2


def test_windows_of_a_table(spark):
    events = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts, 'x' as event_type, 1.5D as value union all select timestamp_ntz'2024-01-01 00:50:00', 'x', 2D union all select null, 'x', 1D")
    assert [(r["n"], r["total"]) for r in windowed_counts(events).collect()] == [(2, 3.5)]


def test_the_ledger_gets_the_time_of_its_batch(spark, tmp_path):
    inbox = files(tmp_path / "in", {"one.md": "# One\n\nbody of one"})
    ledger = spark.createDataFrame([], LEDGER)
    ledger.write.parquet(f"{tmp_path}/ledger/v=0")
    ingest_stream(inbox_stream(spark, inbox), f"{tmp_path}/ledger", f"{tmp_path}/decisions", f"{tmp_path}/check", vectors_path=f"{tmp_path}/vectors").awaitTermination()
    (row,) = spark.read.parquet(f"{tmp_path}/ledger/v=1").collect()
    assert row["updated_at"] > "2024" and row["created_at"] == row["updated_at"]
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/vectors").collect()} == {row["last_doc_id"]}


def test_upsert_and_lookup(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {tuple(r) for r in I.upsert(old, new, "k").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    keyed = spark.createDataFrame([("d2", "url:x"), ("d1", "url:x"), ("d3", "url:y")], "id string, source_key string")
    asked = spark.createDataFrame([("url:x",), ("url:z",), (None,)], "source_key string")
    assert [tuple(r) for r in I.find_by_source_key(keyed, asked).collect()] == [("url:x", "d1")]


def test_blobs_are_put_once(spark, tmp_path):
    blobs = spark.createDataFrame([(b"one",), (b"one",), (b"two",), (None,), (b"",)], "content binary")
    for _ in range(2):
        put = sinks.put_blobs(blobs, str(tmp_path)).collect()
    assert sorted(r["length"] for r in put) == [0, 3, 3] and all(open(r["path"], "rb").read() in (b"one", b"two", b"") for r in put)
    # Empty files are stored, and skipped when files are read.
    assert sinks.read_blobs(spark, str(tmp_path)).count() == 2


def test_more_papers(spark):
    typed = spark.createDataFrame([("https://arxiv.org/html/2401.12345v2",), ("raw text",)], "t string")
    assert [tuple(r["p"]) for r in typed.select(parsers.classify_paper(F.col("t")).alias("p")).collect()] == [("arxiv", "2401.12345v2"), ("raw", "raw text")]
    record = json.dumps({"title": "On x", "DOI": "10.1/AB", "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2020, 1]]}, "abstract": "<p>Short</p>"})
    got = [tuple(r)[1:] for r in parsers.doi_records(spark.createDataFrame([(record,), ("{",)], "record string")).collect()]
    assert got == [("On x", "A B", "2020", "Short", "10.1/ab"), ("", "", None, "", None)]


def test_problems_of_files(spark):
    whole = "---\nid: a\ntitle: t\nsource_type: web\nsource_key: k\ncontent_hash: h\nanalysis:\n  confidence: 1\n---\n\nx"
    rows = spark.createDataFrame([("a", whole), ("b", whole.replace("title: t\n", "")), ("c", "none"), ("d", None)], "path string, content string")
    assert {tuple(r) for r in file_problems(rows).collect()} == {("b", "no title"), ("c", "no front matter"), ("c", "no analysis"), ("d", "no front matter")}


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session)
