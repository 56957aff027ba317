import pytest

from quillmesh.llm import pairs as P
from quillmesh.llm.pair_checks import copied_share, ending, is_empty, language
from quillmesh.llm.pairs import defective_pairs

FIELDS = "pair_id long, instruction string, context string, response string, prompt string, opening string"
LONG = "The parser reads every record before the writer closes the file. It keeps the index small and the cache warm. "
ASK = "Explain how the parser of unit {} reads a record."


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FIELDS)
    return {r["pair_id"]: r["defect"] for r in defective_pairs(df).collect()}


def test_kinds(spark):
    rows = [
        (1, ASK.format(1), None, None), (2, ASK.format(2), "", " \n"), (3, ASK.format(3), None, "**Answer:**"), (4, ASK.format(4), None, "n/a"), (5, ASK.format(5), None, "```\n```"),
        (11, ASK.format(11), None, ASK.format(11).upper()), (12, ASK.format(12), "Only one node is free.", f"Question: {ASK.format(12)} Only one node is free."),
        (13, ASK.format(13), None, f"{ASK.format(13)}\n\n{ASK.format(13)}"),
        (21, ASK.format(21), None, "I'm sorry, but I can't help with that."), (22, "Erkläre den Index.", None, "Diese Frage darf ich leider nicht beantworten."), (23, "索引を説明してください。", None, "申し訳ありませんが、お答えできません。"),
        (31, ASK.format(31), None, "Der Leser prüft den Eintrag, bevor er den Puffer mit dem Index vergleicht."), (32, ASK.format(32), None, "まず記録を検証する。次に索引を更新する。"),
        (41, ASK.format(41), None, LONG + "Then the wri"), (42, ASK.format(42), None, LONG + "\n\n```\nrun --now"), (43, ASK.format(43), None, LONG + "\n\n1. one item\n2. two items\n3. "), (44, ASK.format(44), None, LONG + "See (https://a.b/c"),
    ]
    kinds = {0: "empty", 1: "copy", 2: "refusal", 3: "wrong_language", 4: "truncated"}
    assert found(spark, rows) == {r[0]: kinds[r[0] // 10] for r in rows}


def test_no_cases(spark):
    rows = [
        (1, ASK.format(1), None, LONG), (2, ASK.format(2), None, LONG + "\n\n1. small index\n2. warm cache"), (3, ASK.format(3), None, LONG + "(https://docs.a.example/b)"), (4, ASK.format(4), None, LONG + "\n\n```\nrun --now\n```"),
        (5, ASK.format(5), None, "small index + warm cache"), (6, ASK.format(6), None, f"{ASK.format(6)} {LONG}"), (7, ASK.format(7), None, f"The document does not say how large it is. {LONG}"),
        (8, "Write one polite sentence by which the desk declines a request.", None, "I cannot assist with this request."), (9, ASK.format(9) + " Answer in German.", None, "Der Leser prüft den Eintrag, bevor er den Puffer mit dem Index vergleicht."),
        (10, ASK.format(10), "Please reply in Japanese.", "まず記録を検証する。次に索引を更新する。"), (11, ASK.format(11), None, LONG + "The unit is not able to help a graph that refuses every lattice."), (12, None, None, LONG),
        (13, "5 small warm index cache", None, "small index + warm cache"),
    ]
    assert found(spark, rows) == {}


def test_unknown_refusal_is_found_by_its_template(spark, monkeypatch):
    text = "This matter is closed to further remarks from our side."
    rows = [(i, ASK.format(i), None, text + (" Thank you." if i % 2 else "")) for i in range(8)]
    rows += [(100 + i, ASK.format(i) + " And why?", None, "The note states what follows. " + LONG + LONG) for i in range(8)]
    assert found(spark, rows) == {i: "refusal" for i in range(8)}
    # The same pair under many ids is one prompt, and no template; nor is an answer that takes up its prompt.
    assert found(spark, [(i, ASK.format(1), None, "The parser of unit one reads every record.") for i in range(8)]) == {}
    assert found(spark, [(i, ASK.format(i), None, "The parser of each unit reads a record.") for i in range(8)]) == {}


def test_lone_refusal_is_told_by_its_words(spark):
    full = [(10 + i, ASK.format(i), None, LONG + f"Unit {i} keeps its cache small.") for i in range(6)]
    assert found(spark, full + [(1, ASK.format(9), None, "Regrettably nobody here may comment upon such matters.")]) == {1: "refusal"}
    # The same length in words that answers use is none.
    assert found(spark, full + [(1, ASK.format(9), None, "It keeps the cache warm before the writer closes the file.")]) == {}


def test_openings_are_compared_whole(spark):
    start = "This matter stays closed to remarks " + "and to every further question of the desk " * 12
    rows = [(i, ASK.format(i), None, start + w + ".") for i, w in enumerate(("alpha " * 90, "omega " * 90))]
    assert P.opening_templates is not None and len({r[3][:400] for r in rows}) == 1
    looked = spark.createDataFrame([(i, r[3].lower().replace(" ", ""), 0, 0.0) for i, r in enumerate(rows)], "prompt long, opening string, more int, shared double")
    assert {r["prompts"] for r in P.opening_templates(looked).collect()} == {1}


def test_templates_join_near_variants(spark):
    rows = [(i, ASK.format(i), None, "This long matter is closed to any further remarks from our side today" + ("" if i else ", sir") + ".") for i in range(6)]
    assert found(spark, rows) == {i: "refusal" for i in range(6)}


def test_empty_table_and_repeats(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, ASK, None, ""), (1, ASK, None, ""), (None, ASK, None, "")]) == {1: "empty"}


def test_very_long_text(spark):
    assert found(spark, [(1, ASK.format(1), None, LONG * 3000), (2, ASK.format(2), None, LONG * 3000 + "and then the")]) == {2: "truncated"}


@pytest.mark.parametrize("text, code", [("the index is read by the parser", "en"), ("der Index ist nicht mit dem Puffer verbunden", "de"), ("le lot est avec les index de la table", "fr"), ("索引を更新する", "ja"), ("alpha beta + gamma", ""), ("el lote no se guarda en los registros por ahora", "es"), ("il lotto non si trova nella tabella che è del nodo", "it"), ("индекс хранит запись", "ru"), ("索引更新记录缓存节点表格查询语句", "zh"), ("要約", "")])
def test_language(text, code):
    assert language(text) == code


def test_helpers():
    assert is_empty("回答：") and is_empty("...") and is_empty("<empty>") and not is_empty("Yes.") and not is_empty("42")
    assert copied_share("What is a shard index?", None, "what is a shard index") == 1.0 and copied_share("What is a shard?", None, LONG) == 0.0
    assert ending("One two")[0] == "open" and ending("One, two")[0] == "cut" and ending("Yes.")[0] == "ended"
    assert P.RECURS > 1


def test_template_that_never_recurs_verbatim(spark):
    text = "Our desk has closed the matter of topic {} and leaves every further remark on it to the people who keep the ledger."
    rows = [(i, ASK.format(i), None, text.format(w)) for i, w in enumerate("amber birch cedar drift ember flint".split())]
    assert found(spark, rows) == {i: "refusal" for i in range(6)}
