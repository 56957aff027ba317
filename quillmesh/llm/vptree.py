"""Most similar vectors for every vector: vantage-point trees, one per shard.

A shallow vantage-point tree, fitted on a bounded sample, deals the vectors of
every model to shards.  A shard builds its own tree over all its vectors.
Every vector first searches its own shard; the distance it reaches there
decides, by the triangle inequality at each vantage point on the way down,
which other shards it still has to visit.  ``prune`` relaxes the inequality in
both trees: a side is skipped when ``prune`` times the distance to its border
exceeds the distance already reached, so one gives the exact answer and more
than one trades recall for visits.  Distances are Euclidean between unit
vectors, which order as cosines do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.vectors import usable_vectors  # noqa: F401
from quillmesh.session import cut

#: Rows of the sample that the shard tree is fitted on (all rows are indexed), and those a shard needs at least.
SAMPLE_ROWS, SAMPLE_SHARD = 32_768, 16
#: Rows a shard aims at.
SHARD_ROWS = 16_384
#: Rows of a leaf inside a shard.
LEAF_ROWS = 512
#: Queries that visit a shard together.
QUERY_BLOCK = 32_768


def _unit(values: Iterable) -> np.ndarray:
    x = np.array(list(values), dtype=np.float64)
    if not len(x):
        return x.reshape(0, 1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x @ y.T
    d *= -2.0
    d += 2.0
    np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


def plant(x: np.ndarray, leaf: int, rng: np.random.Generator, most: int = 1 << 30) -> tuple[np.ndarray, list[tuple]]:
    """A vantage-point tree over ``x``: its vantage points, and nodes ``(pivot, radius, inside, outside)``; a child below zero is leaf ``-1 - child``."""
    pivots: list[np.ndarray] = []
    nodes: list[tuple] = []
    leaves = 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal leaves
        if len(rows) <= leaf or parts < 2:
            leaves += 1
            return -leaves
        tries = x[rows[rng.choice(len(rows), min(5, len(rows)), replace=False)]]
        seen = _distances(x[rows[:: max(1, len(rows) // 512)]], tries)
        best = tries[int(np.argmax(seen.var(axis=0)))]
        d = _distances(x[rows], best[None, :])[:, 0]
        radius = float(np.median(d))
        near = d <= radius
        if near.all() or not near.any():
            leaves += 1
            return -leaves
        at = len(nodes)
        pivots.append(best)
        nodes.append((len(pivots) - 1, radius, 0, 0))
        inside = grow(rows[near], parts - parts // 2)
        outside = grow(rows[~near], parts // 2)
        nodes[at] = (nodes[at][0], radius, inside, outside)
        return at

    grow(np.arange(len(x)), most)
    return np.array(pivots).reshape(len(pivots), x.shape[1]), nodes


def descend(nodes: list[tuple], to_pivots: np.ndarray) -> np.ndarray:
    """The leaf of each row, from its distances to the vantage points."""
    out = np.zeros(len(to_pivots), dtype=np.int32)
    todo = [(0, np.arange(len(to_pivots)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -1 - at
            continue
        pivot, radius, inside, outside = nodes[at]
        near = to_pivots[rows, pivot] <= radius
        todo += [(inside, rows[near]), (outside, rows[~near])]
    return out


def visited(nodes: list[tuple], to_pivots: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves, where a row visits each side of a node that lies within its slack of the border."""
    if not nodes:
        return np.arange(len(to_pivots)), np.zeros(len(to_pivots), dtype=np.int32)
    out = []
    todo = [(0, np.arange(len(to_pivots)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, np.full(len(rows), -1 - at, dtype=np.int32)))
            continue
        pivot, radius, inside, outside = nodes[at]
        beyond = to_pivots[rows, pivot] - radius
        todo += [(inside, rows[beyond <= slack[rows]]), (outside, rows[beyond > -slack[rows]])]
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int32))


class ShardTree:
    """The vantage-point tree of one shard, searched for blocks of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        pivots, self.nodes = plant(x, LEAF_ROWS, np.random.default_rng(len(x)))
        leaf = descend(self.nodes, _distances(x, pivots)) if self.nodes else np.zeros(len(x), dtype=np.int32)
        order = np.lexsort((ids, leaf))
        self.ids, self.x, self.pivots = ids[order], x[order], pivots
        self.cuts = np.searchsorted(leaf[order], np.arange(leaf.max() + 2))

    def search(self, q: np.ndarray, k: int, reach: np.ndarray, prune: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to ``k`` nearest within ``reach``; missing ones have id -1."""
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), -1, dtype=np.int64)
        to_pivots = _distances(q, self.pivots) if self.nodes else None
        reach = reach.copy()

        def scan(rows: np.ndarray, leaf: int) -> None:
            s, e = self.cuts[leaf], self.cuts[leaf + 1]
            d = _distances(q[rows], self.x[s:e])
            some = np.flatnonzero((d <= reach[rows, None]).any(axis=1))
            if not len(some):
                return
            rows, d = rows[some], d[some]
            d[d > reach[rows, None]] = np.inf
            if d.shape[1] > k:
                keep = np.argpartition(d, k - 1, axis=1)[:, :k]
                ids, d = self.ids[s:e][keep], np.take_along_axis(d, keep, axis=1)
            else:
                ids = np.broadcast_to(self.ids[s:e], d.shape)
            both_d, both_i = np.concatenate([best_d[rows], d], axis=1), np.concatenate([best_i[rows], ids], axis=1)
            order = np.lexsort((both_i, both_d), axis=1)[:, :k]
            best_d[rows], best_i[rows] = np.take_along_axis(both_d, order, axis=1), np.take_along_axis(both_i, order, axis=1)
            reach[rows] = np.minimum(reach[rows], best_d[rows, k - 1])

        def walk(at: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if at < 0:
                scan(rows, -1 - at)
                return
            pivot, radius, inside, outside = self.nodes[at]
            beyond = to_pivots[rows, pivot] - radius
            near = beyond <= 0
            # The side a query lies on comes first; what it finds there narrows the other.
            walk(inside, rows[near])
            walk(outside, rows[~near])
            also = np.abs(beyond) * prune <= reach[rows]
            walk(outside, rows[near & also])
            walk(inside, rows[~near & also])

        walk(0 if self.nodes else -1, np.arange(len(q)))
        best_i[np.isinf(best_d)] = -1
        return best_i, best_d


def _found(q_ids: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    at, slot = np.nonzero(ids >= 0)
    return pd.DataFrame({"rep": q_ids[at], "other": ids[at, slot], "distance": d[at, slot]})


def nearest(vectors: DataFrame, k: int = 10, min_cosine: float = -1.0, prune: float = 1.25, queries: DataFrame | None = None) -> DataFrame:
    """The ``k`` most similar vectors of the same model for every vector (or for ``queries``), as ``vec_id, other, cosine, rank``.

    ``vectors`` and ``queries`` hold ``vec_id, model, embedding`` as
    ``usable_vectors`` gives them; ``queries`` must be some of the vectors.
    Equal cosines rank by id.  ``min_cosine`` bounds the search: what is
    farther isn't looked for.  Exact copies of a vector are indexed once, with
    the ``k + 1`` smallest of their ids, which are all that the order by
    cosine and id can ever put among the first ``k``.  Fewer than ``k``
    neighbours come out where there are fewer; an empty input gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "model", "embedding")
    # Copies collapse through partial aggregates, so that a vector that makes up a third of the rows is no hot group.
    reps = cut(vectors.groupBy("model", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "vec_id long, other long, cosine double, rank int")
    # A hash decides who is in the sample, so its size is about SAMPLE_ROWS however many rows there are.
    chance = min(1.0, SAMPLE_ROWS / total)
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(chance * (1 << 30))).select("rep", "embedding").limit(2 * SAMPLE_ROWS).toPandas()
    x = _unit(sample.sort_values("rep")["embedding"])
    shards = max(1, min(round(total / SHARD_ROWS), len(x) // SAMPLE_SHARD))
    tree = spark.sparkContext.broadcast(plant(x, 1, np.random.default_rng(7), shards) if shards > 1 else (x[:1], []))
    asked = reps.withColumn("asked", F.lit(True)) if queries is None else None
    if queries is not None:
        wanted = queries.select("model", "embedding").distinct().withColumn("asked", F.lit(True))
        asked = reps.join(wanted, ["model", "embedding"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, nodes = tree.value
        for batch in batches:
            shard = descend(nodes, _distances(_unit(batch["embedding"]), pivots)) if nodes and len(batch) else np.zeros(len(batch), dtype=np.int32)
            yield batch.assign(shard=shard)

    placed = asked.select("model", "rep", "asked", "embedding").mapInPandas(place, "model string, rep long, asked boolean, embedding array<float>, shard int")
    # A tree fitted on a sample leaves uneven shards; parts of bounded size keep every task small.
    sizes = cut(placed.groupBy("model", "shard").agg(F.ceil(F.count("*") / (2 * SHARD_ROWS)).cast("int").alias("parts")))
    placed = cut(placed.join(sizes, ["model", "shard"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts"))
    farthest = float(np.sqrt(max(0.0, 2.0 - 2.0 * min_cosine))) + 1e-9
    more = k + 1  # the first is the vector itself

    def at_home(rows: pd.DataFrame) -> pd.DataFrame:
        x, ids, mine = _unit(rows["embedding"]), rows["rep"].to_numpy(), rows["asked"].to_numpy()
        if not mine.any():
            return pd.DataFrame({"rep": [], "other": [], "distance": []})
        found, d = ShardTree(ids, x).search(x[mine], more, np.full(int(mine.sum()), farthest), prune)
        return _found(ids[mine], found, d)

    home = cut(placed.groupBy("model", "shard", "part").applyInPandas(at_home, "rep long, other long, distance double"))
    near = home
    if shards > 1 or sizes.where("parts > 1").limit(1).count():
        # With fewer than k + 1 found at home, the reach stays the bound of the search.
        reach = home.groupBy("rep").agg(F.count("*").alias("n"), F.max("distance").alias("d")).select("rep", F.when(F.col("n") >= more, F.col("d")).otherwise(F.lit(farthest)).alias("reach"))

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, nodes = tree.value
            for batch in batches:
                if not len(batch):
                    continue
                rows, shard = visited(nodes, _distances(_unit(batch["embedding"]), pivots), batch["reach"].to_numpy() / prune)
                yield batch.iloc[rows].rename(columns={"shard": "own", "part": "own_part"}).assign(shard=shard)

        fields = "model string, own int, own_part int, rep long, embedding array<float>, reach double, shard int"
        going = placed.where("asked").join(reach, "rep").select("model", "shard", "part", "rep", "embedding", "reach").mapInPandas(visits, fields)
        to = sizes.select("model", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        going = going.join(to, ["model", "shard"]).where("shard <> own or part <> own_part").select("model", "shard", "part", "rep", "embedding", "reach")
        going = cut(going)
        # Queries meet a shard in blocks.  Only shards that are asked come, once for each block of their own visitors.
        blocks = going.groupBy("model", "shard", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        going = going.join(blocks, ["model", "shard", "part"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
        open_ = placed.select("model", "shard", "part", "rep", "embedding").join(blocks, ["model", "shard", "part"])
        open_ = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def abroad(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if asking.empty or rows.empty:
                return pd.DataFrame({"rep": [], "other": [], "distance": []})
            held = ShardTree(rows["rep"].to_numpy(), _unit(rows["embedding"]))
            out = []
            for at in range(0, len(asking), 4096):
                some = asking.iloc[at : at + 4096]
                found, d = held.search(_unit(some["embedding"]), more, some["reach"].to_numpy(), prune)
                out.append(_found(some["rep"].to_numpy(), found, d))
            return pd.concat(out)

        key = ["model", "shard", "part", "block"]
        away = going.groupBy(*key).cogroup(open_.groupBy(*key)).applyInPandas(abroad, "rep long, other long, distance double")
        near = home.unionByName(away)
    by_distance = Window.partitionBy("rep").orderBy("distance", "other")
    near = near.withColumn("at", F.row_number().over(by_distance)).where(F.col("at") <= more)

    # Copies: a member sees the smallest ids behind each representative, itself left out.
    members = vectors.join(reps, ["model", "embedding"]).select("rep", "vec_id", "copies")
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("at") <= more)
    seen = near.select("rep", "other", "distance").join(first.select(F.col("rep").alias("other"), F.col("vec_id").alias("seen")), "other")
    seen = seen.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("distance", "seen"))).where(F.col("at") <= more)
    askers = members if queries is None else members.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    rows = askers.select("rep", "vec_id").join(seen.select("rep", "seen", "distance"), "rep").where(F.col("vec_id") != F.col("seen"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "seen"))).where(F.col("rank") <= k)
    cosine = 1.0 - F.col("distance") * F.col("distance") / 2.0
    return ranked.select("vec_id", F.col("seen").alias("other"), cosine.alias("cosine"), "rank").where(F.col("cosine") >= min_cosine - 1e-12)


def similar_pairs(vectors: DataFrame, k: int = 10, min_cosine: float = 0.9, prune: float = 6.0) -> DataFrame:
    """Pairs ``vec_a < vec_b`` of at least ``min_cosine`` of which one is among the other's ``k`` most similar.

    The distance to a vantage point seldom differs between two near vectors by
    as much as the triangle inequality allows, so the default factor is large;
    one searches exactly.
    """
    near = nearest(vectors, k, min_cosine, prune)
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
