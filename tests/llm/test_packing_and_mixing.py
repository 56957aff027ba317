import random

import numpy as np
import pandas as pd
import pytest

from quillmesh.llm import mixing, packing
from quillmesh.llm.mixing import largest_mix, mix_sources, route
from quillmesh.llm.packing import pack_containers
from quillmesh.llm.tokens import count_tokens

WORDS = "shard index graph schema buffer cursor window record parser router".split()


def made(n=120, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150)))) for i in range(n)]


def packed(spark, rows, capacity=200):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, tokens int, container string")
    return pack_containers(df, capacity).collect()


@pytest.mark.parametrize("shard", [3000, 25])
def test_every_text_is_packed_once_and_fits(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TEXTS", shard)
    rows = made()
    got = packed(spark, rows)
    sizes = {i: count_tokens(t) for i, t in rows}
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_container[r["container"]] = by_container.get(r["container"], 0) + r["tokens"]
    assert {i: sum(r["tokens"] for r in rs) for i, rs in by_doc.items()} == {i: s for i, s in sizes.items() if s}
    assert all(len(rs) == 1 for i, rs in by_doc.items() if sizes[i] <= 200) and max(by_container.values()) <= 200
    if shard == 3000:
        assert sum(sizes.values()) / (200 * len(by_container)) > 0.95


def test_large_texts_are_cut_without_a_gap(spark):
    text = "shard " * 950
    got = sorted(packed(spark, [(1, text), (2, "index")], 300), key=lambda r: (r["doc_id"], r["piece"]))
    mine = [r for r in got if r["doc_id"] == 1]
    assert [r["first_token"] for r in mine] == [300 * r["piece"] for r in mine] and sum(r["tokens"] for r in mine) == count_tokens(text)
    assert all(r["tokens"] == 300 for r in mine[:-1])
    (rest,) = {r["container"] for r in got if r["doc_id"] == 2}
    assert rest == mine[-1]["container"]


def test_similar_texts_share_a_container(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "uno dos tres cuatro ") * 12) for i in range(12)]
    got = packed(spark, rows, 4 * max(count_tokens(t) for _, t in rows))
    sides = {}
    for r in got:
        sides.setdefault(r["container"], set()).add(r["doc_id"] % 2)
    assert sum(len(s) == 1 for s in sides.values()) >= 2


def test_nulls_blanks_equal_texts_and_empty(spark):
    got = packed(spark, [(1, None), (2, "  "), (3, ""), (4, "same text"), (5, "same text"), (None, "lost"), (6, "!!")])
    assert {r["doc_id"] for r in got} == {4, 5, 6} and packed(spark, []) == []
    with pytest.raises(ValueError):
        packed(spark, [], 0)


def test_terms_are_the_same_everywhere_and_whole():
    terms, counts = packing.term_counts("Shard shard index 日本語")
    assert counts.sum() == 4 and len(terms) == len(counts) and (np.diff(terms) > 0).all() and (terms >= 0).all()
    long = "donaudampfschifffahrtsgesellschaft"
    assert packing.hash_word(long + "skapitän") != packing.hash_word(long + "sverband")


def test_several_capacities_at_once(spark):
    rows = made(60, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack_containers(df, [100, 400]).collect()
    sizes = {i: count_tokens(t) for i, t in rows}
    for capacity in (100, 400):
        mine = [r for r in got if r["capacity"] == capacity]
        held = {}
        for r in mine:
            held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
        assert sum(held.values()) == sum(sizes.values()) and max(held.values()) <= capacity


def test_a_hot_text_is_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TEXTS", 10)
    rows = [(i, "shard index graph schema buffer") for i in range(90)] + [(100 + i, t) for i, t in made(60, 5)]
    got = packed(spark, rows)
    assert sorted({r["doc_id"] for r in got}) == sorted(i for i, t in rows if count_tokens(t))


def test_halves_are_about_equal_and_alike():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 8)) * 0.1 + rng.normal(size=8) * 3 for _ in range(4)]).astype(np.float32)
    leaf = packing.shard_of(x, *packing.halve(x, 4, rng))
    assert (np.bincount(leaf) > 150).all() and sum(np.bincount(leaf[i * 200 : (i + 1) * 200]).max() for i in range(4)) > 700


def brute_cost(patterns, quotas, uses):
    """Least cost by trying all amounts; sizes are tiny."""
    from itertools import product

    arcs = [(p, s) for p, (sources, _) in enumerate(patterns) for s in sources]
    best = None
    for amounts in product(range(max(quotas.values()) + 1), repeat=len(arcs)):
        if any(sum(a for a, (_, s) in zip(amounts, arcs) if s == name) != q for name, q in quotas.items()):
            continue
        cost = 0
        for p, (sources, tokens) in enumerate(patterns):
            used, most = sum(a for a, (x, _) in zip(amounts, arcs) if x == p), min(uses[s] for s in sources)
            if used > most * tokens:
                break
            cost += sum(k // tokens for k in range(used))
        else:
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_has_least_cost(seed):
    rng = random.Random(seed)
    patterns = [(("a",), rng.randint(1, 3)), (("b",), rng.randint(1, 3)), (("a", "b"), rng.randint(1, 3))]
    quotas, uses = {"a": rng.randint(1, 4), "b": rng.randint(1, 4)}, {"a": rng.randint(1, 3), "b": rng.randint(1, 3)}
    given, reached = route(patterns, quotas, uses)
    best = brute_cost(patterns, quotas, uses)
    assert (reached == sum(quotas.values())) == (best is not None)
    if best is not None:
        cost = sum(k // tokens for p, (_, tokens) in enumerate(patterns) for k in range(sum(a for (x, _), a in given.items() if x == p)))
        assert cost == best


def test_largest_mix():
    _, quotas = largest_mix([(("a",), 100), (("b",), 1000)], {"a": 0.5, "b": 0.5}, {"a": 3, "b": 1})
    assert 295 <= quotas["a"] == quotas["b"] <= 300


def test_selection_meets_shares_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, f"{' '.join(rng.choice(WORDS) for _ in range(20))} {i}", rng.choice(["a", "A ", "b", "b", "b"])) for i in range(400)]
    rows += [(1000 + i, rows[i][1], "b") for i in range(40)] + [(2000, None, "a"), (2001, " ", "a"), (2002, "text", None), (2003, "text", "other"), (None, "text", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("none", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    selection, report = mix_sources(df, targets)
    texts, listed = dict((r[0], r[1]) for r in rows), {}
    for r in selection.collect():
        listed.setdefault(texts[r["doc_id"]], []).append(r["source"])
        assert r["tokens"] == count_tokens(texts[r["doc_id"]])
    assert all(len(s) <= min({"a": 3, "b": 1}[x] for x in s) for s in listed.values())
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["a"]["actual_share"] - 2 / 3) < 0.02 and abs(shares["b"]["actual_share"] - 1 / 3) < 0.02 and shares["none"]["actual_share"] == 0
    again, _ = mix_sources(df, targets)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in selection.collect()}


def test_too_many_targets_are_not_dropped_silently(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TARGETS", 1)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame([(1, "text", "a")], "doc_id long, text string, source string"), targets)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mix_sources(df, targets)
    assert selection.count() == 0 and [(r["source"], r["actual_share"]) for r in report.collect()] == [("a", 0.0)]
    selection, report = mix_sources(df, targets.limit(0))
    assert selection.count() == 0 and report.count() == 0


def test_neighbours_are_found_in_the_whole_collection(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TEXTS", 20)
    # Families of four texts fill a container each; what tells them apart is two words among frequent ones.
    rows = [(i, f"the shard and the index {'alpha' * (1 + i // 4 % 8)}x{chr(97 + i // 32)} " + "with the buffer " * 5) for i in range(160)]
    got = packed(spark, rows, 4 * max(count_tokens(t) for _, t in rows))
    holds = {}
    for r in got:
        holds.setdefault(r["container"], []).append(rows[r["doc_id"]][1])
    beside = [max(texts.count(t) for t in texts) for texts in holds.values()]
    assert len(got) == 160 and sum(n >= 3 for n in beside) > 0.9 * 40


def test_rare_sets_of_sources_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_TEXTS", 7)
    # Only texts of both sources can reach b, and a's single repetition bounds them.
    rows = [(i, f"shard index graph schema {i}", "a") for i in range(60)] + [(100 + i, f"record parser router cursor {i // 2}", "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 4)], "source string, target_share double, max_repeats int")
    selection, report = mix_sources(df, targets)
    texts = dict((r[0], r[1]) for r in rows)
    used = [texts[r["doc_id"]] for r in selection.collect()]
    size = {t: count_tokens(t) for t in texts.values()}
    # The optimum takes everything, or as much as lets b's texts be two fifths.
    most = min(sum(size.values()), sum(n for t, n in size.items() if t.startswith("record")) / 0.4)
    assert max(map(used.count, used)) == 1 and sum(size[t] for t in used) > 0.97 * most
    assert abs({r["source"]: r["actual_share"] for r in report.collect()}["b"] - 0.4) < 0.02


def test_parts_between_spaces_are_measured_once_and_as_in_whole_texts(monkeypatch):
    whole = packing.encoding().encode_ordinary
    odd = ["a", " lead", "tail ", "two  spaces", "\n x", "x \n", "tab\t end", "it's 's 'll", "日本語のテキスト。 次の文\n\nΣΑΣ ΟΔΟΣ", "x  y", "  z", "\x1c a", "!! ?? 12 3a", "under_score a-b word,Word", "one\r\n\r\ntwo three", "İstanbul ß 😀 é é"]
    texts = odd + [t for _, t in made(40, 4)] + [" ".join(odd)]
    calls = []
    parts = packing.Parts(lambda text: calls.append(text) or whole(text))
    for some in (texts[:9], texts[9:], texts):
        tokens, words, terms, counts = parts.measure(some)
        assert tokens.tolist() == [len(whole(t)) for t in some]
        for t, w, mine, n in zip(some, words, terms, counts):
            codes, times = packing.term_counts(t)
            assert mine.tolist() == codes.tolist() and n.tolist() == times.tolist() and w == times.sum()
    assert sum(c == " index" for c in calls) == 1
    monkeypatch.setattr(packing, "CHARACTERS", 30)
    monkeypatch.setattr(packing, "_PARTS", {})
    frame = pd.DataFrame({"doc_id": range(len(texts) + 2), "text": [None, " \n", *texts]})
    got = pd.concat(packing._measure(packing.DEFAULT_FOLDER, packing.VOCABULARY)([frame, frame[:0]]))
    assert got["doc_id"].tolist() == list(range(2, len(texts) + 2)) and got["tokens"].tolist() == [len(whole(t)) for t in texts]
