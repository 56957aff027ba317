"""Items that appear together: co-occurrence counts by stripes, with significance.

Every record (document, basket, session) is turned into stripes: per item an
associative array of the items that stand beside it.  Map tasks merge the
stripes they see in memory, so that a frequent pair leaves a task once and not
once per record; the partial arrays are then merged entry by entry with a hash
aggregate, so that not even the stripe of a hot item has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest piece of a record that is handled as one array.
BLOCK = 256
#: Distinct pairs a map task keeps before it hands its stripes on.
HELD_PAIRS = 1_000_000


def clean_memberships(df: DataFrame, record: str, item: str) -> DataFrame:
    """Distinct (record, item) rows; items trimmed and lower-cased, blank or null ones dropped."""
    blank = F.lit(r"^\s*$")
    return (
        df.select(F.col(record).cast("string").alias("record"), F.lower(F.trim(F.regexp_replace(F.col(item).cast("string"), r"^\s+|\s+$", ""))).alias("item"))
        .where(F.col("record").isNotNull() & F.col("item").isNotNull() & ~F.rlike("record", blank) & ~F.rlike("item", blank))
        .distinct()
    )


def _local_stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the stripes of a map task.  Rows are (left block, right block); equal blocks give each pair once."""
    codes: dict[str, int] = {}
    names: list[str] = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def encode(words) -> np.ndarray:
        out = np.empty(len(words), dtype=np.int64)
        for k, word in enumerate(words):
            code = codes.get(word)
            if code is None:
                code = codes[word] = len(names)
                names.append(word)
            out[k] = code
        return out

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate(parts), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

    def stripes(keys: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        left, right = keys >> 32, keys & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.array([], dtype=np.int64)
        ends = np.r_[starts[1:], len(left)]
        rows = [(names[left[s]], [names[c] for c in right[s:e]], n[s:e].tolist()) for s, e in zip(starts, ends)]
        for at in range(0, len(rows), 4096):
            yield pd.DataFrame(rows[at : at + 4096], columns=["item", "beside", "n"])

    for batch in batches:
        new = []
        for left, right in zip(batch["left"], batch["right"]):
            a = encode(left)
            if right is None:
                i, j = np.triu_indices(len(a), 1)
                x, y = a[i], a[j]
            else:
                b = encode(right)
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            # The smaller name owns the entry; arrays of one block come sorted, two blocks need not.
            if right is not None:
                swap = np.fromiter((names[p] > names[q] for p, q in zip(x, y)), dtype=bool, count=len(x))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
            new.append((x << 32) | y)
        if new:
            keys, n = np.unique(np.concatenate(new), return_counts=True)
            parts.append(keys)
            counts.append(n)
            held += len(keys)
        if held > HELD_PAIRS:
            keys, n = merged()
            if len(keys) > HELD_PAIRS // 2:
                yield from stripes(keys, n)
                parts, counts, held = [], [], 0
                codes.clear()
                names.clear()
            else:
                parts, counts, held = [keys], [n], len(keys)
    if parts:
        yield from stripes(*merged())


def log_likelihood(k11: Column, a: Column, b: Column, n: Column) -> Column:
    """G² of a pair seen together ``k11`` times, its items ``a`` and ``b`` times, in ``n`` records."""

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    k11, a, b, n = (c.cast("double") for c in (k11, a, b, n))
    k12, k21 = a - k11, b - k11
    k22 = n - a - b + k11
    rows = xlogx(a) + xlogx(n - a)
    columns = xlogx(b) + xlogx(n - b)
    cells = xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22)
    return F.greatest(F.lit(0.0), 2.0 * (cells - rows - columns + xlogx(n)))


def cooccurrence(df: DataFrame, record: str, item: str, min_together: int = 1, block: int = BLOCK) -> DataFrame:
    """Pairs of items with the records they share, the ratio to chance and the log-likelihood ratio.

    Returns ``concept_a < concept_b, n_ab, n_a, n_b, n_records, ratio, llr``.

    Null or blank records and items are left out, an item counts once per
    record however often it is repeated, names are compared trimmed and in
    lower case; extra columns are ignored; an empty input gives no rows.
    Items that occur in fewer than ``min_together`` records can't be part of a
    wanted pair and leave before any pair is formed.  A record with more than
    ``block`` items is cut into blocks whose pairs of blocks spread over tasks.
    """
    members = clean_memberships(df, record, item)
    sizes = members.groupBy("item").agg(F.count("*").alias("n_item"))
    total = members.agg(F.countDistinct("record").alias("n_records"))
    kept = members
    if min_together > 1:
        kept = members.join(sizes.where(F.col("n_item") >= min_together).select("item"), "item", "left_semi")
    # Only records longer than a block are cut; their items are dealt by hash, so no task orders a record.
    long = kept.groupBy("record").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = kept.join(long, "record", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("record", "block", "blocks").agg(F.sort_array(F.collect_list("item")).alias("items"))
    alone = blocks.where(F.size("items") > 1).select(F.col("items").alias("left"), F.lit(None).cast("array<string>").alias("right"))
    # Each two blocks of a record meet under a key of their own.
    two = blocks.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    two = two.groupBy("record", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    across = two.agg(F.first(F.when(F.col("block") < F.col("other"), F.col("items")), True).alias("left"), F.first(F.when(F.col("block") > F.col("other"), F.col("items")), True).alias("right"))
    across = across.where("left is not null and right is not null").select("left", "right")
    stripes = alone.unionByName(across).mapInPandas(_local_stripes, "item string, beside array<string>, n array<bigint>")
    entries = stripes.select("item", F.explode(F.arrays_zip("beside", "n")).alias("e")).select("item", F.col("e.beside").alias("beside"), F.col("e.n").alias("n"))
    pairs = entries.groupBy("item", "beside").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_together)
    n_a = sizes.select(F.col("item"), F.col("n_item").alias("n_a"))
    n_b = sizes.select(F.col("item").alias("beside"), F.col("n_item").alias("n_b"))
    out = pairs.join(n_a, "item").join(n_b, "beside").crossJoin(F.broadcast(total))
    ratio = F.col("n_ab").cast("double") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select(
        F.col("item").alias("concept_a"), F.col("beside").alias("concept_b"), "n_ab", "n_a", "n_b", "n_records",
        ratio.alias("ratio"), log_likelihood(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_records")).alias("llr"),
    )


def significant_pairs(df: DataFrame, record: str, item: str, min_together: int = 5, min_ratio: float = 4.0, min_llr: float = 3.84) -> DataFrame:
    """Pairs that occur together at least ``min_together`` times, ``min_ratio`` times as often as chance, and significantly.

    The default ``min_llr`` is the 5 % point of the test.  With r times chance
    and k common records the statistic is at least 2k(ln r - 1 + 1/r), that is
    6.4 for the defaults, so there it excludes nothing the counts let pass.
    """
    pairs = cooccurrence(df, record, item, min_together)
    enough = F.col("n_ab").cast("double") * F.col("n_records") >= F.lit(min_ratio) * F.col("n_a") * F.col("n_b")
    return pairs.where(enough & (F.col("llr") >= min_llr))
