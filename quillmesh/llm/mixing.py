"""Mixing sources to target shares by min-cost flow.

A text that was collected under several sources can count for any of them.
Texts are aggregated by the set of their sources; the flow sends each set's
tokens, once per allowed repetition, to the quotas of its sources.  The r-th
use of a text costs more than the one before.  Since only uses cost anything,
augmenting with cheap uses first, and dearer ones after, is a flow of least
cost.  What the flow decides is then carried out on the texts themselves, in a
seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.tokens import DEFAULT_FOLDER, VOCABULARY, encoding, ship_vocabulary
from quillmesh.session import cut

#: Texts of a part; the parts of a set are summed up first, so that no task orders a whole set.
PART_TEXTS = 50_000
#: The most sources that may have a target; more raise an error.
TARGETS = 10_000


class Flow:
    """Maximum flow by layered augmenting paths, with capacities that can grow between runs."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = []
        self.at: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, capacity])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level = {source: 0}
            todo = deque([source])
            while todo:
                a = todo.popleft()
                for e in self.at[a]:
                    b, room = self.edges[e]
                    if room > 0 and b not in level:
                        level[b] = level[a] + 1
                        todo.append(b)
            if sink not in level:
                return total
            tried = [0] * len(self.at)
            while pushed := self._push(source, sink, level, tried):
                total += pushed

    def _push(self, source: int, sink: int, level: dict[int, int], tried: list[int]) -> int:
        path: list[int] = []
        a = source
        while a != sink:
            while tried[a] < len(self.at[a]):
                e = self.at[a][tried[a]]
                b, room = self.edges[e]
                if room > 0 and level.get(b, -1) == level[a] + 1:
                    path.append(e)
                    a = b
                    break
                tried[a] += 1
            else:
                if not path:
                    return 0
                a = self.edges[path.pop() ^ 1][0]
                tried[a] += 1
        least = min(self.edges[e][1] for e in path)
        for e in path:
            self.edges[e][1] -= least
            self.edges[e ^ 1][1] += least
        return least


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], uses: dict[str, int]) -> tuple[dict[tuple[int, str], int], int]:
    """Tokens that each pattern gives to each of its sources, at least total cost, and the sum that reaches the quotas.

    A pattern's texts are used at most as often as every one of its sources allows.
    """
    names = {s: i for i, s in enumerate(sorted(quotas))}
    first = 2 + len(patterns)
    flow = Flow(first + len(names))
    entry, out = [], {}
    for p, (sources, _) in enumerate(patterns):
        entry.append(flow.add(0, 2 + p, 0))
        for s in sources:
            out[p, s] = flow.add(2 + p, first + names[s], 1 << 62)
    for s, i in names.items():
        flow.add(first + i, 1, quotas[s])
    most = [min(uses[s] for s in sources) for sources, _ in patterns]
    reached = 0
    for use in range(1, max(most, default=0) + 1):
        for p, (_, tokens) in enumerate(patterns):
            if use <= most[p]:
                flow.edges[entry[p]][1] += tokens
        reached += flow.run(0, 1)
        if reached == sum(quotas.values()):
            break
    return {k: flow.edges[e ^ 1][1] for k, e in out.items() if flow.edges[e ^ 1][1] > 0}, reached


def largest_mix(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], uses: dict[str, int]) -> tuple[dict[tuple[int, str], int], dict[str, int]]:
    """The flow and quotas of the largest total at which every source reaches its share exactly."""
    top = sum(tokens * min(uses[s] for s in sources) for sources, tokens in patterns)

    def quotas(total: int) -> dict[str, int]:
        return {s: int(share * total) for s, share in shares.items()}

    low, high = 0, top + 1
    while high - low > max(1, top // 100_000):
        middle = (low + high) // 2
        wanted = quotas(middle)
        if route(patterns, wanted, uses)[1] == sum(wanted.values()):
            low = middle
        else:
            high = middle
    return route(patterns, quotas(low), uses)[0], quotas(low)


def _sized(folder: str, vocabulary: str):
    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [len(encoding(folder, vocabulary).encode_ordinary(t)) if t and not t.isspace() else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "text_key": batch["text_key"], "tokens": tokens})

    return sized


def mix_sources(
    documents: DataFrame, targets: DataFrame, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizers: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """A selection ``doc_id, source, use_no, tokens`` and a report ``source, target_share, actual_share, tokens, texts, most_uses``.

    Sources are compared trimmed and in lower case.  Equal texts are one text,
    which belongs to all the listed sources it was collected under and is used
    at most ``max_repeats`` times in all.  Sources without a target give
    nothing; a target without texts is reported with a share of nothing, and
    the others keep their proportions.  The total is the largest at which all
    proportions can be met; whole texts are taken, so a share may miss its
    target by a text.  Null and blank texts and null sources are left out.
    """
    spark = documents.sparkSession

    def name(column: str) -> Column:
        return F.lower(F.trim(F.col(column).cast("string")))

    listed = [
        (r["source"], float(r["target_share"]), int(r["max_repeats"]))
        for r in targets.select(name("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").limit(TARGETS + 1).collect()
    ]
    if len(listed) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    ship_vocabulary(spark, tokenizers, vocabulary)
    uses = {s: max(1, n) for s, _, n in listed}
    wanted = spark.createDataFrame([(s,) for s in uses], "source string")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), name(source).alias("source"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.join(F.broadcast(wanted), "source").select("doc_id", "source", F.sha2("text", 256).alias("text_key"), "text")
    sized = cut(rows.mapInPandas(_sized(tokenizers, vocabulary), "doc_id long, source string, text_key string, tokens int").where("tokens > 0"))
    # One row per text and source first, then one per text: a text copied a million times stays a short row.
    held = sized.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = held.groupBy("text_key").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("copies"))
    texts = cut(texts.withColumn("pattern", F.concat_ws("\n", F.transform("copies", lambda c: c.source))))
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("pattern").collect()
    patterns = [(tuple(r["pattern"].split("\n")), int(r["tokens"])) for r in sums]
    present = {s for sources, _ in patterns for s in sources}
    scale = sum(share for s, share, _ in listed if s in present)
    shares = {s: share / scale for s, share, _ in listed if s in present}
    given, _ = largest_mix(patterns, shares, uses) if shares else ({}, {})
    plan = []
    for p, (sources, tokens) in enumerate(patterns):
        at = 0
        for s in sources:
            if amount := given.get((p, s), 0):
                plan.append(("\n".join(sources), tokens, -(-sums[p]["n"] // PART_TEXTS), s, at, at + amount))
                at += amount
    # The plan has at most a row for each set and each of its sources.
    plans = spark.createDataFrame(plan, "pattern string, whole long, parts int, source string, low long, high long")
    reach = plans.groupBy("pattern").agg(F.max("whole").alias("whole"), F.max("parts").alias("parts"), F.max("high").alias("reach"), F.collect_list(F.struct("low", "high", "source")).alias("stretches"))

    # Running sums in seeded order: over parts of a set first, then inside each part.
    ordered = texts.join(reach, "pattern").withColumn("seeded", F.xxhash64(F.lit(seed), "text_key")).withColumn("part", F.pmod(F.shiftrightunsigned("seeded", 20), F.col("parts")).cast("int"))
    parts = ordered.groupBy("pattern", "part").agg(F.sum("tokens").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("part")) - F.col("n")).select("pattern", "part", "before")
    inside = Window.partitionBy("pattern", "part").orderBy("seeded", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.withColumn("up_to", F.sum("tokens").over(inside)).join(before, ["pattern", "part"])
    placed = placed.withColumn("start", F.col("before") + F.col("up_to") - F.col("tokens"))
    # A text is taken where its middle lies inside a stretch, so the cuts err by half a text either way.
    passes = placed.withColumn("use_no", F.explode(F.sequence(F.lit(1), F.ceil(F.col("reach") / F.col("whole")).cast("int")))).withColumn(
        "middle", (F.col("use_no") - 1) * F.col("whole") + F.col("start") + F.floor(F.col("tokens") / 2)
    )
    chosen = passes.withColumn("to", F.filter("stretches", lambda x: (x.low <= F.col("middle")) & (F.col("middle") < x.high))).where(F.size("to") > 0)
    chosen = chosen.withColumn("source", F.col("to")[0].source).withColumn("doc_id", F.filter("copies", lambda c: c.source == F.col("source"))[0].doc_id)
    selection = cut(chosen.select("doc_id", "source", "use_no", "tokens", "text_key"))
    counted = selection.groupBy("source", "text_key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    by_source = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    whole = by_source.agg(F.sum("tokens").alias("whole"))
    aims = spark.createDataFrame([(s, share) for s, share, _ in listed], "source string, target_share double")
    report = aims.join(by_source, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "texts", "most_uses")),
    )
    return selection.drop("text_key"), report
