"""Taking documents in: inbox files, decisions against the ledger, and the index they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.keys import content_hash, source_key
from quillmesh.functions.text import broken_front_matter, classify_file, inbox_body

# Extensions that the inbox takes.
EXTENSIONS = (".md", ".txt", ".url")


def inbox_documents(files: DataFrame) -> DataFrame:
    """Usable inbox files (``name``, ``content``) as ``name, title, url, source_type, body, content_hash, doc_id, source_key``.

    Other extensions, blank files and files whose front matter never ends are
    left out.  The id is a hash of name and content, so that reading a file
    again gives the same one.
    """
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    usable = files.where(F.col("content").isNotNull() & extension.isin(*EXTENSIONS) & F.rlike("content", F.lit(r"\S"))).where(~broken_front_matter(F.col("content")))
    rows = usable.select("name", "content", classify_file(F.col("name"), F.col("content")).alias("c"))
    rows = rows.select("name", F.col("c.title").alias("title"), F.col("c.url").alias("url"), F.col("c.source_type").alias("source_type"), inbox_body(F.col("content"), F.col("c.url")).alias("body"))
    rows = rows.withColumn("doc_id", F.upper(F.left(F.sha2(F.concat_ws("\n", "name", "body"), 256), F.lit(26))))
    return rows.withColumn("content_hash", content_hash(F.col("body"))).withColumn("source_key", source_key(F.col("source_type"), F.col("url"), F.col("title"), F.col("doc_id")))


def ingest_decisions(incoming: DataFrame, ledger: DataFrame, order: str = "name") -> DataFrame:
    """What each incoming document does: ``new``, ``skip`` (same content as the state before it) or ``update``.

    Documents of one key follow each other in ``order``; the state before the
    first is the ledger's.  ``doc_id`` becomes the one the key already has.
    """
    known = ledger.select("source_key", F.col("content_hash").alias("known_hash"), F.col("last_doc_id").alias("known_id"))
    in_turn = Window.partitionBy("source_key").orderBy(order, "doc_id")
    rows = incoming.join(known, "source_key", "left")
    rows = rows.withColumn("first_id", F.coalesce("known_id", F.first("doc_id").over(in_turn)))
    before = F.coalesce(F.lag("content_hash").over(in_turn), "known_hash")
    is_first = F.row_number().over(in_turn) == 1
    action = F.when(is_first & F.col("known_id").isNull(), "new").when(before == F.col("content_hash"), "skip").otherwise("update")
    return rows.withColumn("action", action).withColumn("doc_id", F.col("first_id")).drop("known_hash", "known_id", "first_id")


def update_ledger(ledger: DataFrame, decided: DataFrame, now: str, order: str = "name") -> DataFrame:
    """The ledger after the decisions: known keys keep their first document and creation, others come in."""
    last = Window.partitionBy("source_key").orderBy(F.desc(order), F.desc("doc_id"))
    changed = decided.where("action <> 'skip'").withColumn("_place", F.row_number().over(last)).where("_place = 1")
    new = changed.select("source_key", F.col("url").alias("canonical_url"), F.col("doc_id").alias("last_doc_id"), "content_hash", F.lit(now).alias("updated_at"))
    kept = ledger.select("source_key", F.col("first_doc_id").alias("_first"), F.col("created_at").alias("_created"))
    new = new.join(kept, "source_key", "left").select(
        "source_key", "canonical_url", F.coalesce("_first", "last_doc_id").alias("first_doc_id"), "last_doc_id", "content_hash", F.coalesce("_created", F.lit(now)).alias("created_at"), "updated_at"
    )
    return ledger.select(*new.columns).join(new.select("source_key"), "source_key", "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key isn't among them; write the result elsewhere than it was read from."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def snapshot_changes(old: DataFrame, new: DataFrame, path: str = "rel_path", digest: str = "content_hash") -> DataFrame:
    """Changes between two listings (path, hash), ``path, change``: A added, M modified, D deleted; equal rows don't come out."""
    a, b = old.select(F.col(path).alias("path"), F.col(digest).alias("was")).distinct(), new.select(F.col(path).alias("path"), F.col(digest).alias("is")).distinct()
    joined = a.withColumn("old", F.lit(True)).join(b.withColumn("new", F.lit(True)), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(~F.col("was").eqNullSafe(F.col("is")), "M")
    return joined.select("path", change.alias("change")).where("change is not null")


def verify_index(index: DataFrame, files: DataFrame) -> DataFrame:
    """``id, problem``: ghosts are indexed without a file, missing ones have a file and aren't indexed."""
    ghosts = index.select("id").distinct().join(files.select("id"), "id", "left_anti").withColumn("problem", F.lit("ghost"))
    missing = files.select("id").distinct().join(index.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing"))
    return ghosts.unionByName(missing)


def repair_index(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index without ghosts and with what was missing; both have the same columns."""
    return index.join(files.select("id"), "id", "left_semi").unionByName(files.join(index.select("id"), "id", "left_anti").select(*index.columns))


def find_by_source_key(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``source_key, doc_id``: the smallest id among the documents (``keyed``: id, source_key) of each of ``keys`` that has any."""
    return keyed.join(keys.select("source_key").distinct(), "source_key", "left_semi").groupBy("source_key").agg(F.min("id").alias("doc_id"))
