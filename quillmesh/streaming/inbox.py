"""Continuous ingestion of an inbox folder."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.ingest import inbox_documents, ingest_decisions, update_ledger
from quillmesh.operators.vectors import hash_embedding
from quillmesh.session import cut


def inbox_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """``name, content`` of files as they arrive below ``path``."""
    rows = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).format("text").load(path)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("content"))


def ingest_stream(stream: DataFrame, ledger_path: str, decisions_path: str, checkpoint: str, once: bool = True, every: str = "300 seconds", vectors_path: str | None = None) -> StreamingQuery:
    """Run ingestion over a stream of files: decisions are appended, the ledger is rewritten as a new version per batch.

    Each batch writes to a path named by its number, so a batch that is run
    again after a failure replaces its own output and nothing else.  The ledger
    gets the time of the batch.  With ``vectors_path`` the hash embeddings of
    new and changed documents are written as well, so that search sees them.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(f"{ledger_path}/v={number}")
        decided = cut(ingest_decisions(inbox_documents(rows), before))
        decided.write.mode("overwrite").parquet(f"{decisions_path}/batch={number}")
        if vectors_path:
            changed = decided.where("action <> 'skip'")
            hash_embedding(changed, text="body", doc_id="doc_id").write.mode("overwrite").parquet(f"{vectors_path}/batch={number}")
        now = datetime.now(UTC).isoformat(timespec="seconds")
        update_ledger(before, decided, now).write.mode("overwrite").parquet(f"{ledger_path}/v={number + 1}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, with late ones up to ``late``; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a streaming aggregate to its end and read what it holds then; the files stay in the shared folder."""
    spark = stream.sparkSession
    name = uuid.uuid4().hex
    target = f"{folder}/{name}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/state")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{target}/state")
