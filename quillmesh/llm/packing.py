"""Filling fixed-capacity containers with texts by lexical retrieval.

The largest text left becomes a seed; BM25 over the unused texts returns those
most like it, and they fill its container in that order as long as they fit.
What remains open when no text that shares a term fits is closed with the
largest texts that still fit, so that little room is lost.

The inverted index is sharded by content: a tree of halves, fitted on a bounded
sample of the texts' term vectors, sends texts that share terms to the same
shard, so that a seed finds its neighbours there.  All texts are indexed, term
statistics are those of the whole collection, and a seed asks with all of its
terms.  Work and shuffle follow the number of texts.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import DEFAULT_FOLDER, VOCABULARY, encoding, ship_vocabulary
from quillmesh.session import cut

#: Texts a shard aims at; larger ones are cut by hash.
SHARD_TEXTS = 3000
#: Texts of the sample that shards are fitted on (all texts are indexed), and those a shard needs of them at least.
SAMPLE_TEXTS, SAMPLE_SHARD = 16_384, 8
#: Counters of the term statistics, and length of the vectors that shards are fitted on.
COUNTERS, WIDTH = 1 << 20, 256
#: Characters of texts that are measured at once, and of their parts that a worker remembers.
CHARACTERS = 1 << 22
#: Postings that are summed up at once.
POSTINGS = 1 << 20
K1, B = 1.2, 0.75

_TERM = re.compile(r"[^\W\d_]{3,}|[぀-ヿ㐀-鿿]{2}")


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's terms in rising order and how often each occurs."""
    words: dict[str, int] = {}
    for word in _TERM.findall(text.lower()):
        words[word] = words.get(word, 0) + 1
    codes = np.fromiter((hash_word(w) for w in words), dtype=np.int64, count=len(words))
    order = np.argsort(codes)
    return codes[order], np.fromiter(words.values(), dtype=np.int32, count=len(words))[order]


_WORD_CODES: dict[str, int] = {}


def hash_word(word: str) -> int:
    """A code that is the same in every process; the words of a worker are remembered up to a bound."""
    code = _WORD_CODES.get(word)
    if code is None:
        # Python's own string hash is salted per process.
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        if len(_WORD_CODES) < 500_000:
            _WORD_CODES[word] = code
    return code


class Index:
    """Texts by number with the BM25 weights of their terms."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.n = len(terms)
        owner = np.repeat(np.arange(self.n), [len(t) for t in terms])
        term = np.concatenate(terms) if self.n else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.owner = owner[order]
        self.weight = (np.concatenate(weights) if self.n else np.empty(0)).astype(np.float32)[order]
        self.codes, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(term))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """The score of every text for each query of distinct terms, all of which are in the index."""
        held = np.diff(self.starts)
        asker = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        at = np.searchsorted(self.codes, np.concatenate(queries)) if len(asker) else np.empty(0, np.int64)
        # Frequent terms by one product of matrices, the others posting by posting.
        often = np.flatnonzero(held * 32 > self.n)
        place = np.full(len(held), -1)
        place[often] = np.arange(len(often))
        left = np.zeros((len(queries), len(often)), dtype=np.float32)
        right = np.zeros((len(often), self.n), dtype=np.float32)
        dense, of = place[at] >= 0, np.repeat(place, held)
        left[asker[dense], place[at[dense]]] = 1
        right[of[of >= 0], self.owner[of >= 0]] = self.weight[of >= 0]
        out = left @ right
        asker, at = asker[~dense], at[~dense]
        n = held[at]
        ends = np.cumsum(n)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + POSTINGS, "right")))
            m = n[low:high]
            postings = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.starts[at[low:high]], m)
            first, last = asker[low], asker[high - 1] + 1
            cell = np.repeat(asker[low:high] - first, m) * self.n + self.owner[postings]
            out[first:last] += np.bincount(cell, weights=self.weight[postings], minlength=(last - first) * self.n).reshape(last - first, self.n)
            low = high
        return out


def close(room: int, rising: list[tuple[int, int]]) -> list[int]:
    """Texts taken from ``rising`` (size, number), the largest that fits each time."""
    taken = []
    while rising and room >= rising[0][0]:
        size, i = rising.pop(bisect.bisect_right(rising, (room, 1 << 63)) - 1)
        taken.append(i)
        room -= size
    return taken


def fill(sizes: np.ndarray, numbers: np.ndarray, scores: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each text, from sizes in falling order; no size exceeds the capacity.

    ``scores`` are those of all texts of a shard for each other, ``numbers``
    the places of these texts among them.
    """
    container = np.full(len(sizes), -1, dtype=np.int64)
    # Sizes of the unused texts in rising order, with their numbers, for closing what stays open.
    rising = [(int(s), i) for i, s in sorted(enumerate(sizes), key=lambda x: (x[1], x[0]))]

    def use(i: int, number: int) -> None:
        container[i] = number
        del rising[bisect.bisect_left(rising, (int(sizes[i]), i))]

    number = 0
    for seed in range(len(sizes)):
        if container[seed] >= 0:
            continue
        use(seed, number)
        room = capacity - int(sizes[seed])
        if rising and room >= rising[0][0]:
            score = scores[numbers[seed]][numbers]
            score[(container >= 0) | (sizes > room)] = 0
            hits = np.flatnonzero(score)
            for i in hits[np.argsort(-score[hits], kind="stable")]:
                if sizes[i] <= room:
                    use(i, number)
                    room -= int(sizes[i])
                    if not rising or room < rising[0][0]:
                        break
        container[close(room, rising)] = number
        number += 1
    return container


class Parts(dict):
    """Numbers of what stands between the spaces of texts, with its tokens and terms, which are found once for each.

    Neither a term nor a token reaches over a space that has no other white
    space beside it, and there a token begins.
    """

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode, self.characters = encode, 0
        self.tokens: list[int] = []
        self.broken: list[bool] = []
        self.terms: list[list[int]] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self.tokens)
        self.characters += len(part)
        self.tokens.append(len(self.encode(" " + part)))
        self.broken.append(not part or part[0].isspace() or part[-1].isspace())
        self.terms.append([hash_word(word) for word in _TERM.findall(part.lower())])
        return number

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Tokens and words of each text, and its terms and their counts as ``term_counts`` gives them."""
        split = [text.split(" ") for text in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n.sum()))
        starts = np.cumsum(n) - n
        tokens = np.array(self.tokens)[number]
        # No space stands before a text's first part.
        tokens[starts] = [len(self.encode(parts[0])) for parts in split]
        tokens = np.add.reduceat(tokens, starts)
        for i in np.flatnonzero(np.logical_or.reduceat(np.array(self.broken)[number], starts)):
            tokens[i] = len(self.encode(texts[i]))
        held = np.fromiter(map(len, self.terms), dtype=np.int64, count=len(self.terms))
        codes, rank = np.unique(np.fromiter(chain.from_iterable(self.terms), dtype=np.int64, count=int(held.sum())), return_inverse=True)
        m = held[number]
        at = np.repeat((np.cumsum(held) - held)[number] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        words = np.add.reduceat(m, starts)
        rows = np.repeat(np.arange(len(texts)) << 32, words) | rank[at]
        rows.sort()
        fresh = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
        counts = np.diff(np.r_[fresh, len(rows)]).astype(np.int32)
        ends = np.searchsorted(rows[fresh] >> 32, np.arange(1, len(texts)))
        return tokens, words, np.split(codes[rows[fresh] & 0xFFFFFFFF], ends), np.split(counts, ends)


_PARTS: dict[tuple[str, str], Parts] = {}


def _measure(folder: str, vocabulary: str):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[np.array([bool(text) and not text.isspace() for text in batch["text"]], dtype=bool)]
            ids, texts = batch["doc_id"].to_numpy(), list(batch["text"])
            ends = np.cumsum([len(text) for text in texts])
            s = 0
            while s < len(texts):
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + CHARACTERS, "right")))
                parts = _PARTS.get((folder, vocabulary))
                if parts is None or parts.characters > CHARACTERS:
                    parts = _PARTS[folder, vocabulary] = Parts(encoding(folder, vocabulary).encode_ordinary)
                tokens, words, terms, counts = parts.measure(texts[s:e])
                yield pd.DataFrame({"doc_id": ids[s:e], "tokens": tokens, "words": words, "terms": terms, "counts": counts})[tokens > 0]
                s = e

    return measure


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        if len(batch):
            total += np.bincount(np.concatenate(list(batch["terms"])) & (COUNTERS - 1), minlength=COUNTERS)
    at = np.flatnonzero(total)
    for s in range(0, len(at), 65_536):
        yield pd.DataFrame({"at": at[s : s + 65_536], "n": total[at[s : s + 65_536]]})


def vectors_of(terms: Sequence[np.ndarray], weights: Sequence[np.ndarray]) -> np.ndarray:
    """Unit vectors of texts: their weighted terms, dealt to ``WIDTH`` places with a sign."""
    out = np.zeros((len(terms), WIDTH), dtype=np.float32)
    for row, t, w in zip(out, terms, weights):
        row += np.bincount((t >> 20) & (WIDTH - 1), weights=np.where((t >> 40) & 1, w, -w), minlength=WIDTH)
    return out / np.maximum(1e-9, np.sqrt((out * out).sum(axis=1, keepdims=True)))


def halve(x: np.ndarray, leaves: int, rng: np.random.Generator) -> tuple[np.ndarray, list[tuple]]:
    """A tree that parts ``x`` into about equal leaves: directions, and nodes ``(border, below, above)``; a child below zero is leaf ``-1 - child``."""
    directions: list[np.ndarray] = []
    nodes: list[tuple] = []
    made = 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal made
        if parts < 2 or len(rows) < 2:
            made += 1
            return -made
        start = x[rng.choice(rows)]
        centres = np.stack([start, x[rows[np.argmin(x[rows] @ start)]]])
        for _ in range(5):
            side = (x[rows] @ (centres[1] - centres[0])) > ((centres[1] ** 2).sum() - (centres[0] ** 2).sum()) / 2
            if side.all() or not side.any():
                break
            centres = np.stack([x[rows[~side]].mean(axis=0), x[rows[side]].mean(axis=0)])
        # Where the two centres tell one small group from all others, any direction parts the groups better.
        for direction in (centres[1] - centres[0], rng.normal(size=x.shape[1])):
            direction = direction.astype(np.float32)
            seen = x[rows] @ direction
            values = np.unique(seen)
            if len(values) < 2:
                continue
            # Texts that look alike stay together, so the sides may differ in size, and get leaves in proportion.
            border = float(min(np.quantile(seen, 0.5), values[-2]))
            low = seen <= border
            if 0.25 <= low.mean() <= 0.75:
                break
        if len(values) < 2:
            made += 1
            return -made
        share = min(parts - 1, max(1, round(parts * float(low.mean()))))
        at = len(nodes)
        directions.append(direction)
        nodes.append((border, 0, 0))
        nodes[at] = (border, grow(rows[low], share), grow(rows[~low], parts - share))
        return at

    grow(np.arange(len(x)), leaves)
    return np.array(directions, dtype=np.float32).reshape(len(directions), x.shape[1]), nodes


def shard_of(x: np.ndarray, directions: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(x), dtype=np.int32)
    seen = x @ directions.T
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -1 - at
            continue
        border, below, above = nodes[at]
        low = seen[rows, at] <= border
        todo += [(below, rows[low]), (above, rows[~low])]
    return out


def pack_containers(documents: DataFrame, capacity: int | Sequence[int], doc_id: str = "doc_id", text: str = "text", tokenizers: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Assignment ``doc_id, piece, first_token, tokens, container, capacity`` of every text that has tokens, for one capacity or each of several.

    A text larger than ``capacity`` is cut into full pieces, which are
    containers of their own, and a rest, which is packed like a text; every
    other text stays whole.  Null and blank texts have no tokens and no
    container; rows without an id are left out; equal texts under several ids
    are packed each.  Containers are named ``capacity-shard.part-number``.
    """
    capacities = sorted({int(c) for c in ([capacity] if isinstance(capacity, int) else capacity)})
    if not capacities or capacities[0] < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    ship_vocabulary(spark, tokenizers, vocabulary)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    measured = cut(rows.mapInPandas(_measure(tokenizers, vocabulary), "doc_id long, tokens int, words long, terms array<long>, counts array<int>"))
    whole = measured.agg(F.count("*").alias("n"), F.avg("words").alias("average")).first()
    n, average = whole["n"], max(whole["average"] or 0.0, 1.0)
    # Sizes that don't grow: counters of terms, vectors of a sample, borders of shards.
    counted = measured.select("terms").mapInPandas(_frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(COUNTERS)
    frequency[counted["at"].to_numpy()] = counted["n"].to_numpy()
    rarity = spark.sparkContext.broadcast(np.where(frequency > 1, np.log1p((n - frequency + 0.5) / (frequency + 0.5)), 0).astype(np.float32))

    def weighted(batch: pd.DataFrame) -> list[np.ndarray]:
        return [
            rarity.value[t & (COUNTERS - 1)] * c * (K1 + 1) / (c + K1 * (1 - B + B * words / average))
            for t, c, words in zip(batch["terms"], batch["counts"], batch["words"])
        ]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "vector": list(vectors_of(list(batch["terms"]), weighted(batch)))})

    shards = max(1, round(n / SHARD_TEXTS))
    directions, nodes, parts = np.zeros((0, WIDTH), np.float32), [], np.ones(1, dtype=np.int64)
    if shards > 1:
        # A hash decides who is in the sample, so its size is about SAMPLE_TEXTS however many texts there are.
        chance = min(1.0, SAMPLE_TEXTS / n)
        sampled = measured.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(chance * (1 << 30))).limit(2 * SAMPLE_TEXTS)
        sample = sampled.mapInPandas(look, "doc_id long, vector array<float>").toPandas().sort_values("doc_id")
        x = np.array(list(sample["vector"]), dtype=np.float32)
        directions, nodes = halve(x, max(1, min(shards, len(x) // SAMPLE_SHARD)), np.random.default_rng(11))
        # Many texts may be alike; a shard that the sample shows to be large is cut into parts.
        parts = np.maximum(1, np.ceil(np.bincount(shard_of(x, directions, nodes), minlength=len(nodes) + 1) * (n / len(x)) / (2 * SHARD_TEXTS)).astype(np.int64))
    tree = spark.sparkContext.broadcast((directions, nodes, parts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights, (*halves, cut_into) = weighted(batch), tree.value
            shard = shard_of(vectors_of(list(batch["terms"]), weights), *halves)
            dealt = (batch["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": batch["tokens"], "shard": shard, "part": dealt % cut_into[shard], "terms": batch["terms"], "weights": weights})

    placed = measured.mapInPandas(place, "doc_id long, tokens int, shard int, part int, terms array<long>, weights array<float>")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        terms = list(rows["terms"])
        # A part has a bounded number of texts, so that their scores fit.
        scores = Index(terms, list(rows["weights"])).scores(terms)
        ids, tokens, out = rows["doc_id"].to_numpy(), rows["tokens"].to_numpy(), []
        name = f"{rows['shard'].iloc[0]}.{rows['part'].iloc[0]}"
        for size in capacities:
            rest = tokens % size
            numbers = np.lexsort((ids, -rest))
            numbers = numbers[rest[numbers] > 0]
            container = fill(rest[numbers], numbers, scores, size)
            piece = tokens[numbers] // size
            names = [f"{size}-{name}-{c}" for c in container]
            out.append(pd.DataFrame({"doc_id": ids[numbers], "piece": piece, "first_token": piece * size, "tokens": rest[numbers], "container": names, "capacity": size}))
        return pd.concat(out)

    fields = "doc_id long, piece int, first_token int, tokens int, container string, capacity int"
    rests = placed.groupBy("shard", "part").applyInPandas(pack, fields)
    full = measured.select("doc_id", "tokens", F.explode(F.array(*map(F.lit, capacities))).alias("capacity")).where("tokens >= capacity")
    pieces = full.select("doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.floor(F.col("tokens") / F.col("capacity")).cast("int") - 1)).alias("piece"))
    name = F.concat("capacity", F.lit("-full-"), "doc_id", F.lit("."), "piece")
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"), name.alias("container"), "capacity")
    return rests.unionByName(pieces)
