import pandas as pd
import pytest

from quillmesh.llm import pii as P
from quillmesh.llm.pii import find_pii, parts_of, render, replace_pii, surrogate_part
from quillmesh.llm.pii_scan import Names, scan

LEXICON = [("Dario", "given", "latin"), ("Rose", "given", "latin"), ("Dawn", "given", "latin"), ("Talorbel", "family", "latin"), ("砂坂", "family", "ja"), ("律花", "given", "ja")]
NAMES = Names(LEXICON)
#: What a collection would have taught.
CUES = frozenset({("before", "We thank"), ("behind", "gave the"), ("before", "According to"), ("behind", "によるレ"), ("before", "記録者："), ("behind", "a relu"), ("behind", "hat den"), ("before", "Reviewed-by:")})
CASES = {
    "Write to a.b+kb@mail.example for it.": [("email", "a.b+kb@mail.example")], "連絡先はelodie53@example.netです。": [("email", "elodie53@example.net")], "<x_y (at) corp[dot]invalid>": [("email", "x_y (at) corp[dot]invalid")],
    "Contact: me at mail dot example": [("email", "me at mail dot example")], "Contact: a＠post.test": [("email", "a＠post.test")], "[m](mailto:a&#64;b.test)": [("email", "a&#64;b.test")],
    "Call 503-555-0154 ext. 11 before noon.": [("phone", "503-555-0154 ext. 11")], "Tel. +44 1632 960 357.": [("phone", "+44 1632 960 357")], "Telefon: (030) 23125 443": [("phone", "(030) 23125 443")], "TEL: ０９０－００００－４９２８。": [("phone", "０９０－００００－４９２８")],
    "Their tax id (933.04.7006) was left.": [("id_number", "933.04.7006")], "passport no.: XZ 2780110": [("id_number", "XZ 2780110")], "Le numéro de sécurité sociale est le 1 91 17 99 753 757 42.": [("id_number", "1 91 17 99 753 757 42")],
    "個人番号は0362-3740-0441と記入": [("id_number", "0362-3740-0441")], "Im Scan steht Ausweisnummer X04C4680X.": [("id_number", "X04C4680X")],
    "Parcels go to Flat 4, 30B Juniper Street, Sundermoor 00261.": [("address", "Flat 4, 30B Juniper Street, Sundermoor 00261")], "They moved from 68 Lantern St. last spring.": [("address", "68 Lantern St.")], "Parcels go to 52 Fennel St. Ask them.": [("address", "52 Fennel St")],
    "Anschrift: Birchmereweg 163 b, 02269 Sundermoor.": [("address", "Birchmereweg 163 b, 02269 Sundermoor")], "Adresse : 151 bis place Pinfold, 00501 Estrabel.": [("address", "151 bis place Pinfold, 00501 Estrabel")], "住所は〒000-8206 霧島原県鈴原市苔野町1-13-13。": [("address", "〒000-8206 霧島原県鈴原市苔野町1-13-13")],
    "We thank Zoran S. Hulwexalep for it.": [("name", "Zoran S. Hulwexalep")], "Briaquist, Elodie gave the talk.": [("name", "Briaquist, Elodie")], "Ask Ms. Fenkelanlane about it.": [("name", "Fenkelanlane")], "According to M. Huluwick, yes.": [("name", "M. Huluwick")],
    "M. Zelimdane a gardé la copie.": [("name", "Zelimdane")], "榛窪さんに確認済み。": [("name", "榛窪")], "楓峰奏多によるレビュー済み。": [("name", "楓峰奏多")], "記録者：燕渕 紬葉。": [("name", "燕渕 紬葉")], "Here Dario Talorbel waits.": [("name", "Dario Talorbel")],
}
NOTHING = [
    "Clone it with git@forge.example:tools/a.git now.", "Use user@host as a placeholder.", "Thanks to @a_bot.", "Install a@1.379.0 or newer.", "Totals: 844 995 4232 rows.", "Ports 6731-9487 stay closed.", "Ticket 014-47-A is open.", "ISBN 978-0-959411-45-0",
    "See arXiv 2313.01285.", "The digest starts with 5539431610586955.", "Build 2024-06-16, revision 2320.081.73.", "Dawn Patrol is the name of the job.", "Rose plots may mark it.", "The route has 50 St. markers and 268 Lane detectors.", "皆さんに感謝する。", "受付番号は741-77。", "Node 192.0.2.61 was slow.", "", None,
]


@pytest.mark.parametrize("text", CASES)
def test_items(text):
    assert [(k, text[s:e]) for s, e, k in scan(text, NAMES, CUES)] == CASES[text]


@pytest.mark.parametrize("text", NOTHING)
def test_no_items(text):
    assert scan(text, NAMES, CUES) == []


@pytest.fixture(scope="module")
def tables(spark):
    texts = ["Mr Talorbel wrote. We thank Dario Talorbel for it (dario@mail.example).", "We thank Dario Talorbel for more. Call +1 503 555 0189.", None, "", "Nothing here.", "砂坂律花によるレビュー済み。" * 2000 + "楓峰奏多によるレビュー済み。"]
    documents = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a@b.test", "x", 1)], "doc_id long, text string, kind string, start int")
    return documents, spark.createDataFrame(LEXICON + [(None, "given", "latin")], "name string, kind string, script string")


def test_operator_on_a_table(spark, tables):
    found = find_pii(*tables).collect()
    assert {(r["doc_id"], r["pii_type"], r["pii_text"]) for r in found} == {
        (0, "name", "Talorbel"), (0, "name", "Dario Talorbel"), (0, "email", "dario@mail.example"), (1, "name", "Dario Talorbel"), (1, "phone", "+1 503 555 0189"), (5, "name", "砂坂律花"), (5, "name", "楓峰奏多"),
    }
    assert sum(r["doc_id"] == 5 for r in found) == 2001
    # Without a lexicon nothing teaches what introduces names; forms of address still tell some.
    assert find_pii(tables[0].limit(0), tables[1]).count() == 0
    assert {r["pii_text"] for r in find_pii(tables[0], tables[1].limit(0)).collect()} == {"Talorbel", "dario@mail.example", "+1 503 555 0189"}


def test_introductions_are_learnt_from_the_collection(spark):
    known, unknown = ["Dario Talorbel", "Rose Talorbel", "TALORBEL, DAWN"], ["Priya Natarajan", "Q. Fischer", "Iolan B. Ames"]
    texts = [f"Late pencils were sharpened by {n} on Monday." for n in known + unknown] + [f"Gestern kam {n} aus dem Archiv zurück." for n in known + unknown]
    texts += ["The morning build of Green Growth failed.", "The morning build of Apache Spark failed.", "The morning build of Dario Talorbel failed."]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = spark.createDataFrame(LEXICON, "name string, kind string, script string")
    got = {(r["doc_id"], r["pii_text"]) for r in find_pii(documents, lexicon).collect()}
    assert got == {(i, (known + unknown)[i % 6]) for i in range(12)} | {(14, "Dario Talorbel")}
    cues = spark.createDataFrame([("before", "build of")], "side string, words string")
    assert {t for i, t in {(r["doc_id"], r["pii_text"]) for r in find_pii(documents, lexicon, cues=cues).collect()} if i > 11} == {"Green Growth", "Apache Spark", "Dario Talorbel"}


def test_a_key_is_needed(tables):
    with pytest.raises(ValueError):
        replace_pii(*tables, key="")


def test_placeholders_and_surrogates(spark, tables):
    got = {r["doc_id"]: r for r in replace_pii(*tables, key="k").collect()}
    assert got[0]["redacted"] == "Mr [NAME] wrote. We thank [NAME] for it ([EMAIL])." and got[2]["redacted"] is None and got[3]["surrogate"] == "" and got[4]["items"] == 0
    family = got[0]["surrogate"].split()[1]
    full = got[0]["surrogate"].split("We thank ")[1].split(" for")[0]
    # One person keeps one name, in part and in whole, in every document.
    assert full.split()[1] == family and full in got[1]["surrogate"] and "Talorbel" not in got[0]["surrogate"] + got[1]["surrogate"]
    assert got[0]["surrogate"].endswith(".example).") and "mail.example" not in got[0]["surrogate"] and "dario" not in got[0]["surrogate"]
    again = {r["doc_id"]: r["surrogate"] for r in replace_pii(*tables, key="k").collect()}
    other = {r["doc_id"]: r["surrogate"] for r in replace_pii(*tables, key="else").collect()}
    assert again[0] == got[0]["surrogate"] != other[0]


def test_surrogates_stay_distinct(spark):
    people = [f"We thank Dario {chr(65 + i // 26)}{chr(97 + i % 26)}nor for it." for i in range(300)]
    documents = spark.createDataFrame(list(enumerate(people)), "doc_id long, text string")
    lexicon = spark.createDataFrame(LEXICON, "name string, kind string, script string")
    cues = spark.createDataFrame([("before", "We thank")], "side string, words string")
    got = replace_pii(documents, lexicon, key="k", cues=cues).collect()
    assert len({r["surrogate"] for r in got}) == len(set(people))


def test_format_is_kept():
    made = {p: surrogate_part(b"k", *p, 0) for t in ("ANNA B. Kell", "+49 30 23125 612", "12 Fennel St., Valdris 00206", "QX 4138981", "霧守 蒼司") for p in parts_of({"A": "name", "+": "phone", "1": "address", "Q": "id_number", "霧": "name"}[t[0]], t)}
    name = render("name", "ANNA B. Kell", made).split()
    assert name[0].isupper() and name[1] == "B." and name[2].istitle()
    assert render("phone", "+49 30 23125 612", made).startswith("+49 ") and len(render("phone", "+49 30 23125 612", made)) == 16
    assert render("address", "12 Fennel St., Valdris 00206", made).split()[2] == "St.,"
    new = render("id_number", "QX 4138981", made)
    assert new[2] == " " and new[:2].isalpha() and new[3:].isdigit()
    assert len(render("name", "霧守 蒼司", made)) == 5


@pytest.mark.parametrize("kind", ["email", "phone", "id_number", "address", "name"])
def test_many_surrogates_come_out_distinct(spark, kind):
    # A hundred thousand items of the kinds with most letters to choose, fewer of the others to keep the test short.
    made = {"email": "u{}@host.test", "phone": "+44 1632 {:06}", "id_number": "QX {:07}", "address": "{} Fennel Street, Valdris", "name": "Dario K{}"}[kind]
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    items = [made.format(letters(i) if kind == "name" else i) for i in range(100_000 if kind in ("email", "address") else 20_000)]
    rows = [(kind, t, k, p) for t in items for k, p in parts_of(kind, t)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["pii_type", "pii_text", "kind", "part"]))
    drawn = {(r["kind"], r["part"]): r["surrogate"] for r in P._surrogates(df, "k").collect()}
    assert len({render(kind, t, drawn) for t in items}) == len(items)


@pytest.mark.parametrize("kind, items", {
    "email": [f"{a}@{b}.test" for a in "abcdefghijklmnopqrst" for b in ("one", "two")],
    "phone": [f"+1 {i}" for i in range(10, 50)],
    "id_number": [f"A{i}" for i in range(8)] + [f"{i}{i}" for i in range(1, 10)] + ["Q"],
    "address": [f"{i} Lane" for i in range(1, 10)] + ["Lane", "St."],
    "name": [f"{chr(65 + i // 26)}{chr(97 + i % 26)}na" for i in range(300)],
}.items())
def test_surrogates_of_every_type_come_out_distinct(spark, kind, items):
    rows = [(kind, t, k, p) for t in items for k, p in parts_of(kind, t)]
    df = spark.createDataFrame(rows, "pii_type string, pii_text string, kind string, part string")
    drawn = {(r["kind"], r["part"]): r["surrogate"] for r in P._surrogates(df, "k").collect()}
    new = [render(kind, t, drawn) for t in items]
    assert len(set(new)) == len(items) and not {parts_of(kind, t)[0][1] for t in new} & {parts_of(kind, t)[0][1] for t in items}
