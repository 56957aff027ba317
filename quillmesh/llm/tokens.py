"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import SparkSession

#: Vocabulary file (tiktoken ranks) and the folder it is taken from; both are parameters of each operator.
VOCABULARY = "byte_bpe_50k.tiktoken"
DEFAULT_FOLDER = "/opt/tokenizers"
# How texts are split before the merges of the rank files apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship_vocabulary(spark: SparkSession, folder: str, vocabulary: str) -> None:
    """Send the vocabulary file to every executor with the job; only the driver needs the folder."""
    path = os.path.join(folder, vocabulary)
    if not any(name.endswith(vocabulary) for name in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)


@lru_cache(maxsize=4)
def encoding(folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, read once per Python worker from the file that came with the job, or else from the folder."""
    import tiktoken
    from pyspark import SparkFiles

    try:
        path = SparkFiles.get(vocabulary)
    except Exception:
        path = ""
    if not os.path.exists(path):
        path = os.path.join(folder, vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, folder: str = DEFAULT_FOLDER) -> int:
    """Tokens of the whole text; none for a null or blank one."""
    return len(encoding(folder).encode_ordinary(text)) if text and not text.isspace() else 0
