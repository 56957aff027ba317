"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut

#: Rounds after which something must be wrong; the rounds needed grow with the logarithm of the size.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Large-star and small-star rounds alternate until nothing changes.  Each
    works on edges only, so no neighbourhood has to fit a task, and each
    round's edges are written to the checkpoint folder.  Null ends and self
    edges are ignored; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mirrored.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = mirrored.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").where("v <> m").unionByName(low.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = cut(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == state:
            break
        state = (seen["n"], seen["s"])
    own = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select("node", F.col("node").alias("component")))
