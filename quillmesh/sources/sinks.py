"""Sinks: Parquet tables, JSON lines, blobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def export_parquet(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write each table below ``path`` and return its rows, counted while it is written."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"export_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = int(seen.get["n"])
    return counts


def export_jsonl(df: DataFrame, path: str) -> None:
    """One JSON record a line; other scripts stay as they are, nulls are left out."""
    df.write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors in long or array form as Parquet, clustered by dimension or id for later scans."""
    key = "dim" if "dim" in vectors.columns else vectors.columns[0]
    vectors.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified, content`` of raw files on any file system that Spark reaches."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def put_blobs(blobs: DataFrame, root: str) -> DataFrame:
    """Store ``content`` bytes below ``root``, a folder all executors reach, under the digest of what they hold; gives ``digest, path, length``.

    A blob has two levels of folders, is written under another name first and
    then renamed, so that equal or repeated blobs and lost tasks do no harm.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            rows = []
            for digest, content in zip(batch["digest"], batch["content"]):
                path = f"{base}/{digest[:2]}/{digest[2:4]}/{digest}"
                store.create_dir(path.rsplit("/", 1)[0])
                unfinished = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished) as out:
                    out.write(content)
                store.move(unfinished, path)
                rows.append((digest, path, len(content)))
            yield pd.DataFrame(rows, columns=["digest", "path", "length"])

    distinct = blobs.where("content is not null").select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
    return distinct.mapInPandas(put, "digest string, path string, length long")
