"""Personal data in free text: detection, typed placeholders and keyed surrogates.

Names are found by forms of address, by a lexicon, and by what the collection
says of their surroundings: words that stand beside many names of the lexicon
introduce other names as well.  Each detected item gets a surrogate of its own type, script and format that
depends only on a key and on the item's parts, so the same person keeps one
name throughout the collection and a family name alone keeps the one of the
full name.  Surrogates are checked against each other and against the real
values, as they come out, and drawn again until they are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.pii_scan import Names, look, settle
from quillmesh.session import cut

FOUND = "doc_id long, start int, stop int, pii_type string, pii_text string"
#: The most names a lexicon may hold to be sent to every task; more raise an error.
LEXICON_ROWS = 5_000_000
#: Known names that must stand beside words for them to introduce names, and the least share of all that is shaped like a name there.
CUE_NAMES, CUE_SHARE = 2, 0.1
#: Draws after which a part that still shares its surrogate gets one with a growing number behind it.
DRAWS = 12
#: Digits of the seed from which items other than names are rendered; a number may follow them.
SEED_DIGITS = 30

# Syllables and characters that surrogate names are made of.
_ONSETS = "bal dor fen gal hes jun kor lun mar nev ost per quin ril sev tam ulm ven wil yar".split()
_MIDDLES = "a e i o u ai ei".split()
_ENDS_FAMILY = "berg den field grund holm kamp land mark ner rand stead thal vall wood".split()
_ENDS_OPEN, _ENDS_CLOSED = "na ra la ne ria da".split(), "n r l ric mund win".split()
_KANJI_FAMILY = "青石岩上内江大岡小梶河北木黒坂島杉高竹田谷中西野橋畑浜東広藤星堀前松水南森柳山横吉"
_KANJI_GIVEN = "明綾勇恵織和香桂幸紗沙志潤翔真澄直尚夏菜希陽春久英文誠政美光実康由優悠結理良"
# Words of an address that say what it is and stay.
_ADDRESS_WORDS = frozenset("flat apt apartment unit suite street road lane terrace close avenue ave st rd ln drive court square way place rue chemin bis ter de la du des str strasse straße gasse weg platz allee".split())


def lexicon_names(lexicon: DataFrame) -> Names:
    """The name lexicon (name, kind, script) as the scanner wants it; it goes to every task, so its size is checked."""
    rows = lexicon.select("name", "kind", "script").where("name is not null").limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the name lexicon has more than {LEXICON_ROWS} rows")
    return Names([(r["name"], r["kind"] or "", r["script"] or "") for r in rows])


def find_pii(documents: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text", cues: DataFrame | None = None) -> DataFrame:
    """Every item as ``doc_id, start, stop, pii_type, pii_text`` (offsets in characters).

    What is shaped like a full name counts as one when the lexicon has both of
    its parts, or when the words before or behind it introduce names: those
    beside which the collection has at least ``CUE_NAMES`` names of the
    lexicon, a tenth or more of what is shaped like a name there.  ``cues``
    (side ``before`` or ``behind``, words) adds to what is learnt.  Null and
    blank texts hold nothing, rows without an id are left out, texts are read
    whole however long, and extra columns are ignored.
    """
    names = documents.sparkSession.sparkContext.broadcast(lexicon_names(lexicon))
    span = "struct<start:int,stop:int,kind:string,text:string>"
    shape = "struct<start:int,stop:int,text:string,known:boolean,before:string,behind:string>"

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"]):
                sure, shaped = look(t, names.value)
                if sure or shaped:
                    spans = [{"start": s, "stop": e, "kind": k, "text": t[s:e]} for s, e, k in sure]
                    rows.append((i, spans, [{"start": s, "stop": e, "text": t[s:e], "known": known, "before": b, "behind": a} for s, e, known, b, a in shaped]))
            yield pd.DataFrame(rows, columns=["doc_id", "sure", "shaped"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    # Texts are read once; a row of this is numbered, so that two texts of one id stay apart.
    seen = cut(rows.mapInPandas(looked, f"doc_id long, sure array<{span}>, shaped array<{shape}>").withColumn("row", F.monotonically_increasing_id()))
    shaped = seen.select("row", F.explode("shaped").alias("s")).select("row", "s.*")
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("words")) for side in ("before", "behind")))).alias("c")
    beside = shaped.select("row", "start", "stop", "text", "known", sides).select("row", "start", "stop", "text", "known", "c.side", "c.words").where("words <> ''")
    learnt = beside.groupBy("side", "words").agg(F.count("*").alias("n"), F.count_if("known").alias("names")).where((F.col("names") >= CUE_NAMES) & (F.col("names") >= CUE_SHARE * F.col("n"))).select("side", "words")
    if cues is not None:
        learnt = learnt.unionByName(cues.select("side", "words"))
    introduced = beside.join(learnt.distinct(), ["side", "words"], "left_semi").select("row", "start", "stop", "text")
    named = shaped.where("known").select("row", "start", "stop", "text").unionByName(introduced).distinct()
    named = named.groupBy("row").agg(F.collect_list(F.struct("start", "stop", F.lit("name").alias("kind"), "text")).alias("named"))
    both = seen.select("row", "doc_id", "sure").join(named, "row", "left").where("size(sure) > 0 or named is not null")

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, sure, named in zip(batch["doc_id"], batch["sure"], batch["named"]):
                texts = {(x["start"], x["stop"], x["kind"]): x["text"] for x in [*sure, *(named if named is not None else ())]}
                rows += [(i, *s, texts[s]) for s in settle(list(texts))]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "pii_type", "pii_text"])

    return both.select("doc_id", "sure", "named").mapInPandas(settled, FOUND)


def parts_of(kind: str, text: str) -> list[tuple[str, str]]:
    """The parts of an item that get surrogates, as (kind of part, part in one spelling)."""
    plain = unicodedata.normalize("NFKC", text)
    if kind == "name":
        if re.match(r"[一-龥々]", plain):
            bare = re.sub(r"\s", "", plain)
            return [("ja_family", bare[:2])] + ([("ja_given", bare[2:])] if len(bare) > 2 else [])
        words = [w for w in re.split(r"[,\s]+", plain) if w]
        if "," in plain:
            words = words[1:] + words[:1]
        kinds = ["given"] * (len(words) - 1) + ["family"]
        return [(k, w.casefold()) for k, w in zip(kinds, words) if not re.fullmatch(r"\w\.", w)]
    if kind == "email":
        return [(kind, re.sub(r"\s?(?:&#64;|&commat;|[\[({]?\s?\bat\b\s?[\])}]?)\s?", "@", re.sub(r"\s?[\[({]?\s?\bdot\b\s?[\])}]?\s?", ".", plain.lower())).replace(" ", ""))]
    if kind == "phone":
        return [(kind, re.sub(r"^00", "+", re.sub(r"[^\d+a-z]", "", plain.lower())))]
    return [(kind, re.sub(r"[\W_]+", "", plain.casefold()))]


def _bits(key: bytes, kind: str, part: str, draw: int) -> int:
    return int.from_bytes(hmac.new(key, f"{kind}\0{part}\0{draw}".encode(), hashlib.sha256).digest(), "big")


def _pick(bits: int, *lists: str | list[str]) -> str:
    out = ""
    for choices in lists:
        bits, at = divmod(bits, len(choices))
        out += choices[at]
    return out


def surrogate_part(key: bytes, kind: str, part: str, draw: int) -> str:
    """The surrogate of a part.  Names follow the script, and given names the ending that tells their gender; other items become a seed of digits."""
    bits = _bits(key, kind, part, draw)
    counted = str(_bits(key, kind, part, -draw) % 10 ** (draw - DRAWS + 2)) if draw > DRAWS else ""
    if kind == "ja_family":
        return _pick(bits, _KANJI_FAMILY, _KANJI_FAMILY) + counted
    if kind == "ja_given":
        return _pick(bits, *[_KANJI_GIVEN] * max(1, min(2, len(part)))) + counted
    if kind == "family":
        return _pick(bits, _ONSETS, _MIDDLES, _ONSETS, _ENDS_FAMILY) + counted
    if kind == "given":
        return _pick(bits, _ONSETS, _MIDDLES, _ENDS_OPEN if part[-1:] in "aeiy" else _ENDS_CLOSED) + counted
    return str(bits % 10**SEED_DIGITS).zfill(SEED_DIGITS) + counted


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word.capitalize()


def render(kind: str, text: str, surrogates: dict[tuple[str, str], str]) -> str:
    """``text`` with its parts replaced, in the same order, spacing and letter case."""
    if kind == "name":
        if re.match(r"[一-龥々]", text):
            found = dict(parts_of(kind, text))
            gap = re.search(r"\s", text)
            new = [surrogates[k, p] for k, p in found.items()]
            return (gap[0] if gap else "").join(new)
        by_word = {p: surrogates[k, p] for k, p in parts_of(kind, text)}
        return re.sub(r"[^\s,]+", lambda m: _cased(m[0], by_word[m[0].casefold()]) if m[0].casefold() in by_word else m[0], text)
    ((part_kind, part),) = parts_of(kind, text)
    seed, counted = int(surrogates[part_kind, part][:SEED_DIGITS]), surrogates[part_kind, part][SEED_DIGITS:]
    taken = 0

    def draw(size: int) -> int:
        nonlocal seed, taken
        taken += 1
        if not taken % 24:
            seed = int.from_bytes(hashlib.sha256(str((seed, taken)).encode()).digest(), "big")
        seed, at = divmod(seed, size)
        return at

    if kind == "email":
        at = re.search(r"\s?(?:@|＠|&#64;|&commat;|[\[({]\s?\w+\s?[\])}]|\bat\b)\s?", text)
        local = re.sub(r"[A-Za-z]", lambda m: _cased(m[0], "abcdefghijklmnopqrstuvwxyz"[draw(26)]), text[: at.start()]) if at else text
        local = re.sub(r"\d", lambda m: str(draw(10)), local)
        # Every name below the reserved domain belongs to nobody.
        host = _pick(draw(1 << 40), _ONSETS, _MIDDLES, _ONSETS, _MIDDLES)
        return f"{local}{counted}{at[0]}{host}.example" if at else local + counted
    if kind == "phone":
        head = re.match(r"(?:\+|＋|00)?\d{1,2}(?=\D)|[+＋]\d{2}|0", text)
        keep = head.end() if head else 0
        return text[:keep] + re.sub(r"\d", lambda m: chr(ord(m[0]) - int(m[0]) + draw(10)), text[keep:]) + counted
    if kind == "address":
        out = re.sub(r"\d", lambda m: chr(ord(m[0]) - int(m[0]) + draw(10)), text)
        out = re.sub(r"[一-龥]+(?=[都道府県市区町村])", lambda m: _KANJI_FAMILY[draw(len(_KANJI_FAMILY))] + _KANJI_FAMILY[draw(len(_KANJI_FAMILY))], out)

        def word(m: re.Match) -> str:
            if m[0].casefold() in _ADDRESS_WORDS or m[0].isupper() and len(m[0]) < 4:
                return m[0]
            tail = re.search(r"(straße|strasse|str|gasse|weg|platz|allee)$", m[0])
            return _cased(m[0], _ONSETS[draw(len(_ONSETS))] + _MIDDLES[draw(len(_MIDDLES))] + _ENDS_FAMILY[draw(len(_ENDS_FAMILY))]) + (tail[0] if tail else "")

        return re.sub(r"[A-ZÀ-Ý][\w'’-]+", word, out) + (f" {counted}" if counted else "")
    out = re.sub(r"\d", lambda m: chr(ord(m[0]) - int(m[0]) + draw(10)), text)
    return re.sub(r"[A-Z]", lambda m: "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw(26)], out) + counted


def shown(kind: str, part: str, text: str | None, surrogate: str) -> str:
    """What a part's surrogate comes out as in ``text``, in one spelling; a name's part is its surrogate."""
    return surrogate if text is None else parts_of(kind, render(kind, text, {(kind, part): surrogate}))[0][1]


def _surrogates(items: DataFrame, key: str) -> DataFrame:
    """``kind, part, surrogate`` without two parts of a kind that come out alike in any text, and without one that comes out as a real part."""
    secret = key.encode()

    @F.pandas_udf("string")
    def made(kind: pd.Series, part: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series([surrogate_part(secret, k, p, d) for k, p, d in zip(kind, part, draw)])

    @F.pandas_udf("string")
    def out(kind: pd.Series, part: pd.Series, text: pd.Series, surrogate: pd.Series) -> pd.Series:
        return pd.Series([shown(*x) for x in zip(kind, part, text.astype(object).where(text.notna(), None), surrogate)])

    def drawn(df: DataFrame, n: Column) -> DataFrame:
        new = df.select("kind", "part", "text", n.alias("draw")).withColumn("surrogate", made("kind", "part", "draw"))
        return new.withColumn("shown", out("kind", "part", "text", "surrogate"))

    texts = items.select("kind", "part", F.when(F.col("pii_type") != "name", F.col("pii_text")).alias("text")).distinct()
    state = cut(drawn(texts, F.lit(0)))
    real = cut(state.select("kind", F.col("part").alias("shown"), F.lit(True).alias("real")).distinct())
    while True:
        # Of parts that come out alike the smallest keeps its surrogate.
        keeper = state.groupBy("kind", "shown").agg(F.min("part").alias("keeper"), F.max("part").alias("other")).where("keeper <> other").select("kind", "shown", "keeper")
        marked = state.join(keeper, ["kind", "shown"], "left").join(real, ["kind", "shown"], "left")
        bad = marked.where(F.col("real") | (F.col("keeper") != F.col("part"))).select("kind", "part").distinct().withColumn("again", F.lit(True))
        marked = cut(state.join(bad, ["kind", "part"], "left"))
        if marked.where("again").isEmpty():
            return state.select("kind", "part", "surrogate").distinct()
        state = cut(marked.where("again is null").drop("again").select(*state.columns).unionByName(drawn(marked.where("again"), F.col("draw") + 1)))


def replace_pii(documents: DataFrame, lexicon: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", cues: DataFrame | None = None) -> DataFrame:
    """Every document as ``doc_id, items, redacted, surrogate``: with typed placeholders such as ``[EMAIL]``, and with surrogates drawn by the secret ``key``.

    Texts without an item, null ones included, come out as they are.
    """
    if not key:
        raise ValueError("a key is needed")
    found = cut(find_pii(documents, lexicon, doc_id, text, cues))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t, part_kind, part) for k, t in zip(batch["pii_type"], batch["pii_text"]) for part_kind, part in parts_of(k, t)]
            yield pd.DataFrame(rows, columns=["pii_type", "pii_text", "kind", "part"])

    # Distinct items first: an item that stands in a third of all texts is one row from here on.
    items = found.select("pii_type", "pii_text").distinct().mapInPandas(split, "pii_type string, pii_text string, kind string, part string")
    items = cut(items)
    drawn = _surrogates(items, key)
    bundles = items.join(drawn, ["kind", "part"]).groupBy("pii_type", "pii_text").agg(F.collect_list(F.struct("kind", "part", "surrogate")).alias("drawn"))

    @F.pandas_udf("string")
    def rendered(kind: pd.Series, item: pd.Series, drawn: pd.Series) -> pd.Series:
        return pd.Series([render(k, t, {(d["kind"], d["part"]): d["surrogate"] for d in ds}) for k, t, ds in zip(kind, item, drawn)])

    renderings = bundles.select("pii_type", "pii_text", rendered("pii_type", "pii_text", "drawn").alias("new"))
    spans = found.join(renderings, ["pii_type", "pii_text"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "pii_type", "new"))).alias("spans"))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                if t is None or spans is None or not len(spans):
                    out.append((i, 0, t, t))
                    continue
                at, placed, replaced = 0, [], []
                for s in spans:
                    placed += [t[at : s["start"]], f"[{s['pii_type'].upper()}]"]
                    replaced += [t[at : s["start"]], s["new"]]
                    at = s["stop"]
                out.append((i, len(spans), "".join(placed) + t[at:], "".join(replaced) + t[at:]))
            yield pd.DataFrame(out, columns=["doc_id", "items", "redacted", "surrogate"])

    return rows.join(spans, "doc_id", "left").mapInPandas(rewrite, "doc_id long, items int, redacted string, surrogate string")
