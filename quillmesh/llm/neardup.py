"""Near-duplicate texts by adaptive multi-match prefixes.

Texts become sets of character runs.  The runs are dealt to parts by hash, and
a pair that is similar as a whole is as similar in one part at least: if every
part shared less than ``share`` of its union, so would their sum.  So each part
is joined by itself, over sets of some twenty runs, and a text is sent to a
part once, however many texts there are.

Inside a part, runs are ordered from rare to frequent.  Two sets that overlap
enough must share at least l runs within the first ``n - overlap + l`` of each;
the longer that prefix, the more shared runs a pair needs before it is worth
verifying.  The rarest run that a pair shares sets its l: a rare run alone
makes a candidate, a frequent one only together with a second, a very frequent
one with a second and third, which the prefixes are lengthened for.  Since runs
stand in order, both sides agree on that without knowing of each other, and
nothing is lost.

Candidates of a part must be similar in it, first by parity bits and then by
their runs; distinct ones are verified against whole texts.  Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.components import connected_components
from quillmesh.session import cut

RUN = 5
#: Runs that a part of the smallest texts of a size class has on average, as a power of two.
PART_POWER = 4
#: Texts up to which a run makes candidates alone, and together with one more; beyond, it takes two more.
ALONE, PAIRED = 64, 4096
#: Texts that two runs may share by chance and still make candidates together: with more texts, ``PAIRED`` grows by the root of their number.
BY_CHANCE = 200
#: Fewest and most counters of the frequency sketch that orders the runs, as powers of two; there are about 16 for a text.
SKETCH_POWERS = (16, 22)
#: Sets of a part that a task joins; larger parts are cut by the run that keys begin with, and into blocks.
PIECE_ROWS = 400_000
#: Runs that keys of a set of a part begin with, about.
BEGINNINGS = 14
#: Members of a class of copies that are listed against another class at once.
LISTED = 1024
#: Matches and characters that are worked on at once, and keys of a part that are held.
HELD, KEYS = 1 << 18, 1 << 23
#: Texts whose runs are sorted at once, as a power of two, and bits that are left for the hash of a run.
AT_ONCE_POWER = 10
HASH_BITS = 64 - AT_ONCE_POWER

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_and_digits(text: str | None) -> str:
    """The Unicode letters and digits of ``text`` in lower case."""
    return _OTHER.sub("", text.lower()) if text else ""


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Whether each code point is a letter or digit, by the same pattern."""
    kept = np.zeros(0x110000, dtype=bool)
    kept[list(map(ord, _OTHER.sub("", "".join(map(chr, range(0x110000))))))] = True
    return kept


def all_reduced(texts: list[str]) -> list[str]:
    """``letters_and_digits`` of each text, of all at once."""
    lower = [t.lower() for t in texts]
    a = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = _kept()[a]
    whole = a[kept].tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.r_[0, np.cumsum(kept)][np.cumsum([len(t) for t in lower])].tolist() if lower else []
    return [whole[s:e] for s, e in zip([0, *ends], ends)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def run_hashes(text: str, run: int = RUN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``run`` characters."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(a) - run + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(run):
        h = h * _MIX + a[i : i + n]
    return np.unique(mixed(h))


def text_classes(docs: DataFrame, doc_id: str, content: str, run: int = RUN) -> DataFrame:
    """Distinct ``id, key``: documents with at least ``run`` letters and digits, and the key of their reduced text, which is ``reduced``."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = list(batch["content"])
            reduced = [t for s, e in stretches(contents) for t in all_reduced(contents[s:e])]
            yield pd.DataFrame({"id": batch["id"], "reduced": reduced})[[len(t) >= run for t in reduced]]

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(content).cast("string").alias("content")).where("id is not null and content is not null")
    return rows.mapInPandas(reduce, "id string, reduced string").withColumn("key", F.sha2("reduced", 256))


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that are worked on at once, by their number and their characters."""
    s = held = 0
    for e, text in enumerate(texts):
        if e > s and (e - s == 1 << AT_ONCE_POWER or held + len(text) > HELD):
            yield s, e
            s, held = e, 0
        held += len(text)
    if s < len(texts):
        yield s, len(texts)


def all_runs(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``HASH_BITS`` bits of all runs of all texts, repeated ones too, and the text that each is of."""
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    n = max(0, len(a) - run + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(run):
        h *= _MIX
        h += a[i : i + n]
    # Runs that reach into the next text are of none.
    whole = owner[:n] == owner[run - 1 :][:n]
    return mixed(h[whole]) >> np.uint64(64 - HASH_BITS), owner[:n][whole]


def run_sets(texts: list[str], run: int = RUN) -> np.ndarray:
    """Distinct runs of each text, rising: the text's number and, in the last ``HASH_BITS`` bits, the run's hash."""
    runs, owner = all_runs(texts, run)
    rows = (owner << np.uint64(HASH_BITS)) | runs
    rows.sort()
    return rows[np.r_[True, rows[1:] != rows[:-1]][: len(rows)]]


def _sketch(slots: int, run: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            texts = list(batch["reduced"])
            for s, e in stretches(texts):
                np.add.at(total, (all_runs(texts[s:e], run)[0] & np.uint64(slots - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for s in range(0, len(at), 65_536):
            yield pd.DataFrame({"at": at[s : s + 65_536], "n": total[at[s : s + 65_536]]})

    return sketch


def size_class(n: int) -> int:
    """The power of two that ``n`` reaches.  Sets of similar texts are of one class or of neighbouring ones."""
    return n.bit_length() - 1


def parts_of(size: int) -> int:
    """Parts that runs of a size class are dealt to."""
    return 1 << max(0, size - PART_POWER)


def _octave(n: float) -> int:
    """A frequency in eighths of a power of two."""
    return min(255, round(8 * math.log2(max(n, 1))))


class PartSets:
    """The sets of one part, each in order from rare to frequent runs, and the keys under which they meet.

    ``flat`` holds the runs of all sets, one set behind the other, ``k`` how
    many are of each and ``rank`` the places that the sets get.  ``bounds`` are
    the frequencies up to which a run makes keys alone and with one more.
    """

    def __init__(self, flat: np.ndarray, k: np.ndarray, levels: np.ndarray, share: float, bounds: tuple[float, float], rank: np.ndarray | None = None) -> None:
        self.share = share
        self.k = k
        order = np.repeat(np.arange(len(k), dtype=np.uint64) << np.uint64(40) if rank is None else rank.astype(np.uint64) << np.uint64(40), k)
        for s in range(0, len(flat), HELD):
            some = flat[s : s + HELD]
            order[s : s + HELD] |= levels[some & np.uint32(len(levels) - 1)].astype(np.uint64) << np.uint64(32) | some
        order.sort()
        self.flat = order.astype(np.uint32)
        order >>= np.uint64(32)
        level = order.astype(np.uint8)
        if rank is not None:
            self.k = np.empty_like(k)
            self.k[rank] = k
        self.starts = np.r_[0, np.cumsum(self.k)[:-1]]
        # Kinds rise along a set, so a key's kind is told by where its first run stands.
        self.alone, self.paired = (np.add.reduceat(level <= _octave(bound), self.starts, dtype=np.int64) for bound in bounds)

    def parity(self) -> list[np.ndarray]:
        """Parity of the runs at each of 128 bits: as many bits of two sets differ as runs do, or fewer."""
        bits = [np.zeros(len(self.k), dtype=np.uint64) for _ in range(2)]
        step = max(1, HELD // int(self.k.max()))
        for s in range(0, len(self.k), step):
            starts = self.starts[s : s + step]
            h = mixed(self.flat[starts[0] : starts[-1] + self.k[s : s + step][-1]] * _MIX)
            one = np.uint64(1) << (h & np.uint64(63))
            first = (h >> np.uint64(6)) & np.uint64(1) == 0
            for out, side in zip(bits, (first, ~first)):
                out[s : s + step] = np.bitwise_xor.reduceat(np.where(side, one, np.uint64(0)), starts - starts[0])
        return bits

    def prefix(self, k: int, need: int, asks: bool) -> int:
        """Runs of a prefix in which a set shares ``need`` runs with any similar one, that is not larger if it asks and not smaller if not."""
        least = self.share * k if asks else 2 * self.share / (1 + self.share) * k
        return min(k, k - math.ceil(least - 1e-9) + need)

    def _begins(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each size and number of runs asked for, the sets and the places where their keys begin, from low to high."""
        for k in np.unique(self.k):
            rows = np.flatnonzero(self.k == k)
            for need in (1, 2, 3):
                if need > k:
                    break
                # A single run has no company to ask for; of two or three, a similar set may lack a third.
                low = (np.zeros_like(rows), self.alone[rows], self.paired[rows])[need - 1]
                high = (self.alone[rows] if k > 1 else self.k[rows], self.paired[rows] if k > 3 else self.k[rows], self.k[rows])[need - 1]
                with_any = (low < high) & (low <= self.prefix(k, need, True) - need)
                if with_any.any():
                    yield int(k), need, rows[with_any], low[with_any], high[with_any]

    def n_keys(self) -> int:
        """How many keys there are."""
        n = 0
        for k, need, _, low, high in self._begins():
            most = self.prefix(k, need, True)
            before = np.r_[0, np.cumsum([math.comb(most - 1 - at, need - 1) for at in range(most)])]
            n += int((before[np.minimum(high, most)] - before[low]).sum())
        return n

    def keys(self, here: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, the sets they are of, and whether sets that don't ask have them too; with ``here``, those that begin with runs of which it is true."""
        for k, need, rows, low, high in self._begins():
            most, own = self.prefix(k, need, True), self.prefix(k, need, False)
            chosen = np.array(list(combinations(range(most), need)), dtype=np.int32)
            mine = chosen[:, -1] < own
            first = chosen[:, 0].astype(np.int16)
            low, high = low.astype(np.int16), high.astype(np.int16)
            step = max(1, HELD // len(chosen))
            for s in range(0, len(rows), step):
                some = rows[s : s + step]
                begins = (first >= low[s : s + step, None]) & (first < high[s : s + step, None])
                if here is not None:
                    begins &= here[self.starts[some][:, None] + np.arange(most)][:, first]
                r, c = np.nonzero(begins)
                base = self.starts[some][r]
                key = self.flat[base + chosen[c, 0]].astype(np.uint64) + np.uint64(need << 32)
                for i in range(1, need):
                    key = mixed(key * _MIX) + self.flat[base + chosen[c, i]]
                yield mixed(key * _MIX), some[r], mine[c]

    def pieces(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets and the pieces, of ``count`` for each, that the runs deal them to with which their keys begin."""
        prefix = np.array([0] + [self.prefix(k, min(3, k), True) for k in range(1, int(self.k.max()) + 1)])[self.k]
        owner = np.repeat(np.arange(len(self.k)), prefix)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(prefix) - prefix, prefix) + self.starts[owner]
        both = np.unique(owner.astype(np.uint64) << np.uint64(32) | piece_of(self.flat[at], count[owner].astype(np.uint64)))
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Runs that pairs of sets share."""
        out = np.zeros(len(x), dtype=np.int64)
        for s in range(0, len(x), 1 << 15):
            both = []
            for side in (x[s : s + (1 << 15)], y[s : s + (1 << 15)]):
                n = self.k[side]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[side], n)
                both.append((np.repeat(np.arange(len(side), dtype=np.uint64), n) << np.uint64(32)) | self.flat[at])
            rows = np.sort(np.concatenate(both))
            out[s : s + (1 << 15)] = np.bincount((rows[1:][rows[1:] == rows[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(x[s : s + (1 << 15)]))
        return out


def piece_of(runs: np.ndarray, pieces: np.ndarray | np.uint64) -> np.ndarray:
    """The piece of a part that keys beginning with each run meet in."""
    return mixed(runs * _MIX) % pieces


def pieces_of(rows: int) -> int:
    """Pieces of a part of so many sets, each of about ``PIECE_ROWS`` or fewer."""
    return 1 if rows <= PIECE_ROWS else math.ceil(1 / (1 - (1 - PIECE_ROWS / rows) ** (1 / BEGINNINGS)))


def part_pairs(no: np.ndarray, size: np.ndarray, side: np.ndarray, flat: np.ndarray, k: np.ndarray, levels: np.ndarray, share: float, bounds: tuple[float, float], piece: int = 0, pieces: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of sets (their ``no``, the larger first) that are similar in their part and meet in this piece of it.

    ``flat`` holds the runs of all sets, ``k`` how many are of each.  ``side``
    is twice the block of a set, and one more for a guest of the next size
    class; two guests meet elsewhere, and so do sets of one block where a cell
    joins two.
    """
    # Sets stand by size, so that the one that asks is always the later one.
    order = np.lexsort((no, k))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    sets = PartSets(flat, k, levels, share, bounds, rank)
    no, size, side, k = no[order], size[order], side[order], sets.k
    bits = sets.parity()
    guest, block = side & 1 == 1, side >> 1
    apart = bool(block.max() != block.min())
    both = np.arange(2 * int(k.max()) + 1)
    differ = both - 2 * np.ceil(share / (1 + share) * both - 1e-9).astype(np.int64)
    # A key's hash, its set, and whether that doesn't ask: one number, so that sorting brings together what meets.
    width = max(1, len(k).bit_length())
    of, turns = np.uint64((1 << width) - 1), max(1, round(sets.n_keys() / pieces / KEYS))
    found: list[np.ndarray] = []
    for turn in range(turns):
        # What is a piece of a part is a turn of a piece, too: the runs that its keys begin with.
        here = piece_of(sets.flat, np.uint64(pieces * turns)) == np.uint64(piece + pieces * turn) if pieces * turns > 1 else None
        made = [(key >> np.uint64(width + 1) << np.uint64(width + 1)) | (owner.astype(np.uint64) << np.uint64(1)) | mine for key, owner, mine in sets.keys(here)]
        rows = np.concatenate(made) if made else np.empty(0, np.uint64)
        del made
        rows.sort()
        key = rows >> np.uint64(width + 1)
        fresh = np.r_[True, key[1:] != key[:-1]][: len(key)]
        mine = rows & np.uint64(1) == 1
        owner = (rows >> np.uint64(1) & of).astype(np.int32)
        del rows, key
        # Those that an earlier set of the same key stores are asked, each by all later ones.
        stored = owner[mine]
        before = np.cumsum(mine) - mine
        first = before[np.maximum.accumulate(np.where(fresh, np.arange(len(owner)), 0))]
        n = before - first
        asking = np.flatnonzero(n)
        owner, first, n = owner[asking], first[asking], n[asking]
        ends = np.cumsum(n)
        s = 0
        while s < len(n):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + HELD, "right")))
            # A key that more sets have than are held at once is met in stretches.
            for skip in range(0, int(n[s:e].max()), HELD):
                m = np.minimum(np.maximum(n[s:e] - skip, 0), HELD)
                x = np.repeat(owner[s:e], m)
                y = stored[np.arange(len(x)) + np.repeat(first[s:e] + skip - (np.cumsum(m) - m), m)]
                odd = np.bitwise_count(bits[0][x] ^ bits[0][y]) + np.bitwise_count(bits[1][x] ^ bits[1][y])
                near = np.flatnonzero(odd <= differ[k[x] + k[y]])
                x, y = x[near], y[near]
                near = ~(guest[x] & guest[y]) & (np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y]) - 1e-9) & (x != y)
                if apart:
                    near &= block[x] != block[y]
                found.append(x[near].astype(np.int64) * len(k) + y[near])
            s = e
            if sum(map(len, found)) > HELD:
                found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    x, y = pairs // len(k), pairs % len(k)
    common = sets.common(x, y)
    near = common >= share * (k[x] + k[y] - common) - 1e-9
    return np.maximum(no[x[near]], no[y[near]]), np.minimum(no[x[near]], no[y[near]])


def candidate_pairs(texts: DataFrame, share: float, run: int = RUN) -> DataFrame:
    """Distinct pairs ``x > y`` of ``no`` from ``texts`` (no, reduced) that may reach Jaccard similarity ``share``; none that does is missing."""
    if not 0.6 <= share <= 1:
        raise ValueError("share must lie between 0.6 and 1")
    spark = texts.sparkSession
    # Lengths tell about how many sets each size class will have.
    lengths = texts.groupBy(F.floor(F.log2(F.greatest(F.length("reduced") - (run - 1), F.lit(1)))).cast("int").alias("size")).agg(F.count("*").alias("n"))
    counts = {r["size"]: r["n"] for r in lengths.collect()}
    slots = 1 << min(SKETCH_POWERS[1], max(SKETCH_POWERS[0], (16 * sum(counts.values())).bit_length()))
    counted = texts.select("reduced").mapInPandas(_sketch(slots, run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.ones(slots)
    frequency[counted["at"].to_numpy()] = counted["n"].to_numpy()
    # At most 4 MB, whatever the collection.
    levels = spark.sparkContext.broadcast(np.minimum(255, np.round(8 * np.log2(frequency))).astype(np.uint8))
    bounds = (ALONE, max(PAIRED, math.sqrt(BY_CHANCE * sum(counts.values()))))
    # A set goes to all pieces that its keys begin in, so that a few pieces would hold nearly all sets each.
    pieces = {c: pieces_of(counts.get(c, 0) + counts.get(c + 1, 0)) for c in range(max(counts, default=0) + 2)}

    widths = np.array([parts_of(c).bit_length() - 1 for c in range(64)], dtype=np.uint64)
    cuts = np.array([pieces.get(c, 1) for c in range(64)])

    def dealt(no: np.ndarray, size: np.ndarray, at: np.ndarray, runs: np.ndarray, owner: np.ndarray, guest: int) -> pa.RecordBatch:
        # Runs stand by text and hash, and the first bits of a hash name the part.
        part = runs >> (np.uint64(HASH_BITS) - widths[at[owner]])
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
        k = np.diff(np.r_[starts, len(runs)])
        flat = (runs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        text, part = owner[starts], part[starts].astype(np.int64)
        tokens = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((4 * np.r_[starts, len(runs)]).astype(np.int32)), pa.py_buffer(flat)])
        cell = (at[text] << 56) | (part << 28)
        if cuts[at[text]].max() > 1:
            rows, piece = PartSets(flat, k, levels.value, share, bounds).pieces(cuts[at[text]])
            cell, text, tokens = cell[rows] | piece, text[rows], tokens.take(pa.array(rows))
        side = np.full(len(text), guest, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(no[text]), pa.array(size[text].astype(np.int32)), pa.array(side), tokens], names=["cell", "no", "size", "side", "tokens"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column("no").to_numpy(), batch.column("reduced").to_pylist()
            for s, e in stretches(texts):
                rows = run_sets(texts[s:e], run)
                owner, runs = (rows >> np.uint64(HASH_BITS)).astype(np.int64), rows & np.uint64((1 << HASH_BITS) - 1)
                size = np.bincount(owner, minlength=e - s)
                own = np.array([size_class(n) for n in size.tolist()])
                # A set that one of the class below may resemble is a guest there.
                guest = (own > 0) & (size * share <= (1 << np.maximum(own, 0)) - 1 + 1e-9)
                if len(runs):
                    yield dealt(numbers[s:e], size, own, runs, owner, 0)
                if guest.any():
                    yield dealt(numbers[s:e], size, own - 1, runs[guest[owner]], owner[guest[owner]], 1)

    cells = texts.select("no", "reduced").mapInArrow(sets, "cell long, no long, size int, side int, tokens binary").withColumn("pair", F.lit(0))
    if max(pieces.values(), default=1) > 1:
        # A run that very many sets begin with makes a large piece; its blocks meet two by two.
        blocks = cells.groupBy("cell").agg(F.ceil(F.count("*") / (2 * PIECE_ROWS)).cast("int").alias("blocks")).where("blocks > 1")
        cells = cells.drop("pair").join(cut(blocks), "cell", "left").withColumn("block", F.pmod(F.xxhash64("no"), F.coalesce("blocks", F.lit(1))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        cells = cells.withColumn("other", other).withColumn("pair", F.least("block", "other") * 65_536 + F.greatest("block", "other")).withColumn("side", F.col("side") + 2 * F.col("block"))
        cells = cells.select("cell", "no", "size", "side", "tokens", "pair")

    def met(rows: pa.Table) -> pa.Table:
        tokens = pa.concat_arrays(rows.column("tokens").cast(pa.binary()).chunks)
        ends = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        flat = np.frombuffer(tokens.buffers()[2], dtype=np.uint32)[ends[0] // 4 : ends[-1] // 4]
        no, size, side = (rows.column(c).to_numpy() for c in ("no", "size", "side"))
        cell = rows.column("cell")[0].as_py()
        x, y = part_pairs(no, size, side, flat, np.diff(ends).astype(np.int64) // 4, levels.value, share, bounds, cell & (1 << 28) - 1, pieces.get(cell >> 56, 1))
        return pa.table({"x": x, "y": y})

    found = cells.groupBy("cell", "pair").applyInArrow(met, "x long, y long")
    return found.distinct()


def _verify(share: float, run: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = list(batch["a"]), list(batch["b"])
            keep = [np.empty(0)]
            for s, e in stretches(b):
                one, other = run_sets(a[s:e], run), run_sets(b[s:e], run)
                both = np.sort(np.concatenate([one, other]))
                common, runs = (np.bincount((x >> np.uint64(HASH_BITS)).astype(np.int64), minlength=e - s) for x in (both[1:][both[1:] == both[:-1]], both))
                keep.append(common / (runs - common))
            similarity = np.concatenate(keep)
            ok = similarity >= share - 1e-12
            yield pd.DataFrame({"x": batch["x"][ok], "y": batch["y"][ok], "similarity": similarity[ok]})

    return verify


def near_duplicate_links(docs: DataFrame, doc_id: str = "id", content: str = "content", share: float = 0.6, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Membership ``id, no`` of each document in a class of equal reduced texts, and links ``x > y`` (``no``) between classes with their ``similarity``.

    Documents without an id, or with fewer than ``run`` letters and digits
    (null and empty contents too), belong to no class.  Rows repeated under one
    id count once.  Links are direct; every pair of classes whose sets of runs
    have a Jaccard similarity of ``share`` (0.6 at least) or more is among them.
    """
    # Both are written once: the numbers given here have to stay the same in every later stage.
    rows = cut(text_classes(docs, doc_id, content, run))
    texts = cut(rows.select("key", "reduced").dropDuplicates(["key"]).withColumn("no", F.monotonically_increasing_id()))
    members = rows.select("id", "key").distinct().join(texts.select("key", "no"), "key").select("id", "no")
    pairs = candidate_pairs(texts, share, run)
    with_y = pairs.join(texts.select(F.col("no").alias("y"), F.col("reduced").alias("b")), "y")
    both = with_y.join(texts.select(F.col("no").alias("x"), F.col("reduced").alias("a")), "x").select("x", "y", "a", "b")
    links = both.mapInPandas(_verify(share, run), "x long, y long, similarity double")
    return cut(members), cut(links)


def near_duplicate_pairs(docs: DataFrame, doc_id: str = "id", content: str = "content", share: float = 0.6, copies: str = "all") -> DataFrame:
    """Pairs ``id_a < id_b`` of documents whose texts are equal or similar by ``share``.

    With ``copies="all"`` every pair of documents is listed, those of equal
    texts included, large classes in blocks.  ``copies="representatives"``
    lists links between the smallest ids of classes, and each copy with the
    smallest id of its class, at every size of class alike.
    """
    if copies not in ("all", "representatives"):
        raise ValueError("copies must be all or representatives")
    members, links = near_duplicate_links(docs, doc_id, content, share)
    sizes = members.groupBy("no").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    if copies == "representatives":
        first = sizes.select("no", "first")
        ends = links.select("x", "y").join(first.select(F.col("no").alias("x"), F.col("first").alias("p")), "x").join(first.select(F.col("no").alias("y"), F.col("first").alias("q")), "y").select("p", "q")
        star = members.join(sizes.where("n > 1").select("no", "first"), "no").select(F.col("first").alias("p"), F.col("id").alias("q"))
        pairs = ends.unionByName(star).where("p <> q")
        return pairs.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
    blocks = sizes.select("no", F.ceil(F.col("n") / LISTED).cast("int").alias("blocks"), "n")
    dealt = members.join(blocks.select("no", "blocks"), "no").select("no", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id")
    ends = links.select("x", "y").unionByName(blocks.where("n > 1").select(F.col("no").alias("x"), F.col("no").alias("y")))
    for side in ("x", "y"):
        spread = blocks.select(F.col("no").alias(side), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"b{side}"))
        ends = ends.join(spread, side)
    pairs = ends.join(dealt.select(F.col("no").alias("x"), F.col("block").alias("bx"), F.col("id").alias("p")), ["x", "bx"])
    pairs = pairs.join(dealt.select(F.col("no").alias("y"), F.col("block").alias("by"), F.col("id").alias("q")), ["y", "by"]).where("p <> q")
    return pairs.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()


def near_duplicate_groups(docs: DataFrame, doc_id: str = "id", content: str = "content", share: float = 0.6) -> DataFrame:
    """One row per document: ``id``, its ``class_id`` (smallest id of its equal texts), ``group_id`` (smallest id of its connected classes), ``copies`` and ``links`` to other classes."""
    members, links = near_duplicate_links(docs, doc_id, content, share)
    named = members.groupBy("no").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    degree = links.select(F.col("x").alias("no")).unionByName(links.select(F.col("y").alias("no"))).groupBy("no").agg(F.count("*").alias("links"))
    groups = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = named.join(groups.withColumnRenamed("node", "no"), "no", "left").join(degree, "no", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "no")).withColumn("links", F.coalesce("links", F.lit(0)))
    least = labelled.groupBy("component").agg(F.min("class_id").alias("group_id"))
    labelled = labelled.join(least, "component")
    return members.join(labelled, "no").select("id", "class_id", "group_id", "copies", "links")
