import random

import numpy as np
import pytest

from quillmesh.llm import neardup
from quillmesh.llm.neardup import letters_and_digits, near_duplicate_groups, near_duplicate_pairs
from quillmesh.operators.components import connected_components

FIELDS = "id string, content string, key string, no long, reduced string"
WORDS = "shard index graph schema buffer cursor window record parser router kernel queue memo token filter vector trace cache note edge".split()


def texts(seed=3, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", str(i)]) for _ in range(rng.randint(20, 60))]
        out.append((f"a{i:03}", " ".join(words)))
        edited = list(words)
        for _ in range(rng.randint(0, 14)):
            edited[rng.randrange(len(edited))] = rng.choice(WORDS)
        out.append((f"b{i:03}", ", ".join(edited).upper()))
    return out


def brute(rows, share=0.6):
    def runs(t):
        t = letters_and_digits(t)
        return {t[i : i + 5] for i in range(len(t) - 4)}

    sets = {}
    for i, t in rows:
        if i is not None and len(letters_and_digits(t)) >= 5:
            sets.setdefault(i, set()).add(frozenset(runs(t)))
    out = set()
    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in rows], FIELDS)


@pytest.mark.parametrize("seed", [3, 4])
def test_pairs_equal_brute_force(spark, seed):
    rows = texts(seed)
    assert {tuple(r) for r in near_duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


@pytest.mark.parametrize("rows_a_piece", [9, 2])
def test_pieces_and_blocks_lose_nothing(spark, monkeypatch, rows_a_piece):
    monkeypatch.setattr(neardup, "PIECE_ROWS", rows_a_piece)
    rows = texts(5, 30)
    assert {tuple(r) for r in near_duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


@pytest.mark.parametrize("alone, paired", [(1, 4), (1, 1), (1000, 5000)])
def test_any_choice_of_prefix_loses_nothing(spark, monkeypatch, alone, paired):
    monkeypatch.setattr(neardup, "ALONE", alone)
    monkeypatch.setattr(neardup, "PAIRED", paired)
    rows = texts(6) + [(f"s{i}", w) for i, w in enumerate(["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "bcdefghi", "xabcdefghi"])]
    assert {tuple(r) for r in near_duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_share_has_a_least_value(spark):
    with pytest.raises(ValueError):
        near_duplicate_pairs(frame(spark, texts(1, 2)), share=0.5)


def test_nulls_short_repeated_and_long(spark):
    long = " ".join(f"word{i}" for i in range(20000))
    rows = [("a", None), ("b", ""), ("c", "ab-c"), ("d", "ABC de"), ("d", "ABC  de"), ("e", "abcde!"), (None, "abcde"), ("f", long), ("g", long + " tail"), ("h", "日本語のテキスト"), ("i", "日本語の テキスト。")]
    assert {tuple(r) for r in near_duplicate_pairs(frame(spark, rows)).collect()} == {("d", "e"), ("f", "g"), ("h", "i")}


def test_empty_table(spark):
    assert near_duplicate_pairs(frame(spark, [])).count() == 0
    assert near_duplicate_groups(frame(spark, [])).count() == 0


def test_a_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LISTED", 4)
    rows = [(f"x{i:02}", "the same text again") for i in range(20)] + [("y", "the same text agaim")]
    got = {tuple(r) for r in near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows) and len(got) == 210
    got = {tuple(r) for r in near_duplicate_pairs(frame(spark, rows), copies="representatives").collect()}
    assert got == {("x00", f"x{i:02}") for i in range(1, 20)} | {("x00", "y")}


def test_groups(spark):
    rows = [("a", "one text that is here"), ("b", "one text that is here!"), ("c", "one text that is hers"), ("d", "something else altogether")]
    got = {r["id"]: (r["class_id"], r["group_id"], r["copies"], r["links"]) for r in near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == {"a": ("a", "a", 2, 1), "b": ("a", "a", 2, 1), "c": ("c", "a", 1, 1), "d": ("d", "d", 1, 0)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def made_part(n=400, seed=2):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 40)).astype(np.uint32)) for _ in range(n)]
    sets += [s[rng.random(len(s)) > 0.15] for s in sets[::3]]
    sets = [s for s in sets if len(s)]
    flat, k = np.concatenate(sets), np.array([len(s) for s in sets])
    levels = np.round(8 * np.log2(np.maximum(1, np.bincount(flat, minlength=512)))).astype(np.uint8)
    true = {(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b))}
    return flat, k, levels, true


@pytest.mark.parametrize("bounds", [(64, 4096), (8, 24), (1, 30)])
@pytest.mark.parametrize("pieces, keys", [(1, 1 << 23), (5, 1 << 23), (1, 1000), (3, 1000)])
def test_pieces_and_turns_share_the_work_and_lose_nothing(monkeypatch, bounds, pieces, keys):
    monkeypatch.setattr(neardup, "KEYS", keys)
    flat, k, levels, true = made_part()
    no, size, side = np.arange(len(k)), np.full(len(k), 100), np.zeros(len(k), dtype=np.int32)
    got = [neardup.part_pairs(no, size, side, flat, k, levels, 0.6, bounds, piece, pieces) for piece in range(pieces)]
    assert {pair for x, y in got for pair in zip(x.tolist(), y.tolist())} == true
    # A key is made in one piece only, and that is a piece which its set is sent to.
    sets = neardup.PartSets(flat, k, levels, 0.6, bounds)
    sent = set(zip(*(x.tolist() for x in sets.pieces(np.full(len(k), pieces)))))
    made = 0
    for piece in range(pieces):
        for key, owner, _ in sets.keys(neardup.piece_of(sets.flat, np.uint64(pieces)) == np.uint64(piece)):
            made += len(key)
            assert {(o, piece) for o in owner.tolist()} <= sent
    assert made == sets.n_keys() == sum(len(key) for key, _, _ in sets.keys())


def test_a_part_has_no_more_pieces_than_it_needs():
    rows = neardup.PIECE_ROWS
    assert neardup.pieces_of(0) == neardup.pieces_of(rows) == 1
    for n in (2 * rows, 30 * rows):
        pieces = neardup.pieces_of(n)
        assert n * (1 - (1 - 1 / pieces) ** neardup.BEGINNINGS) <= rows < n * (1 - (1 - 1 / (0.9 * pieces)) ** neardup.BEGINNINGS)


def test_texts_of_a_batch_are_read_as_each_alone(monkeypatch):
    rows = ["", "ab", "İΣΣ ß 12", "\ud800x①", "a\U0001F600b", *(t for _, t in texts(7, 9)), "abcabcabcabc", "日本語の テキスト。"]
    assert neardup.all_reduced(rows) == [letters_and_digits(t) for t in rows] and neardup.all_reduced([]) == []
    bits = np.uint64(neardup.HASH_BITS)
    for held in (1 << 18, 40):
        monkeypatch.setattr(neardup, "HELD", held)
        ranges = list(neardup.stretches(rows))
        assert [i for s, e in ranges for i in range(s, e)] == list(range(len(rows)))
        for s, e in ranges:
            sets = neardup.run_sets(rows[s:e])
            for i, text in enumerate(rows[s:e]):
                mine = sets[sets >> bits == np.uint64(i)] & ((np.uint64(1) << bits) - np.uint64(1))
                assert mine.tolist() == sorted({int(h) >> (64 - neardup.HASH_BITS) for h in neardup.run_hashes(text)})
    assert list(neardup.stretches([])) == []
