"""Small helpers that look at one instruction, context and response."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

from quillmesh.llm.neardup import letters_and_digits, run_hashes

# What stands for an answer that isn't there.
PLACEHOLDERS = frozenset(
    "na none null nil nan tbd tba todo empty blank noanswer noresponse notavailable notapplicable undefined placeholder pending "
    "なし 無し 未定 回答なし 該当なし 未回答 空欄 ka keineantwort keine leer entfällt offen néant aucune vide sansréponse aucuneréponse àcompléter".split()
)
# Headings under which an answer was to follow.
HEADINGS = frozenset("answer response reply output result solution antwort lösung ergebnis réponse résultat solution 回答 答え 解答 返答 応答 assistant".split())

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": frozenset("the a an of and is are to in for with that this which when each by not only does it its at most before after more than what how why from every both yet one be as on our".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer und ist nicht mit von zu im in für auch mehr als jeden wird nur sondern wer was wie warum hat weil sobald zwischen liegt laut rund bevor uns keine kein etwa".split()),
    "fr": frozenset("le la les un une des de du et est que qui dans pour pas plus avec jamais mais car en au aux sur se dès quand chaque comment pourquoi il nous selon nos entre ne déjà tout suffit".split()),
    "es": frozenset("el los las una unos del y es que por para con no se su como más pero cuando cada donde entre desde hasta muy ya esta este todo".split()),
    "it": frozenset("il lo gli una di del della dei delle e è che per con non si suo come più ma quando ogni dove tra fra nel nella alla dal sono questa questo".split()),
    "pt": frozenset("o os as uma do da dos das e é que por para com não se seu como mais mas quando cada onde entre desde até muito já esta este são".split()),
    "nl": frozenset("de het een van en is dat die voor met niet zijn op aan bij ook maar als elke wordt naar uit meer dan door wat hoe waarom wanneer tussen".split()),
}
# Scripts that tell the language, or the family that is compared as one.
SCRIPTS = {"ko": "Hangul", "ru": "Cyrillic", "el": "Greek", "ar": "Arabic", "he": "Hebrew", "th": "Thai", "hi": "Devanagari"}
# Names of the languages as requests use them.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|英語",
    "de": r"german|deutsch\w*|allemand\w*|ドイツ語|独語",
    "fr": r"french|französisch\w*|français\w*|フランス語|仏語",
    "ja": r"japanese|japanisch\w*|japonais\w*|日本語",
    "es": r"spanish|spanisch\w*|espagnol\w*|español|スペイン語",
    "it": r"italian|italienisch\w*|italien\w*|italiano|イタリア語",
    "pt": r"portuguese|portugiesisch\w*|portugais\w*|português|ポルトガル語",
    "nl": r"dutch|niederländisch\w*|néerlandais\w*|nederlands|オランダ語",
    "zh": r"chinese|chinesisch\w*|chinois\w*|中文|汉语|中国語",
    "ko": r"korean|koreanisch\w*|coréen\w*|한국어|韓国語",
    "ru": r"russian|russisch\w*|russe\w*|русск\w*|ロシア語",
}
_NAMES = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)" if k else v, re.I) for k, v in LANGUAGE_NAMES.items()}
_JA_NAMES = {"en": "英語", "de": "ドイツ語", "fr": "フランス語", "ja": "日本語", "es": "スペイン語", "it": "イタリア語", "pt": "ポルトガル語", "nl": "オランダ語", "zh": "中国語", "ko": "韓国語", "ru": "ロシア語"}
_SCRIPT = {code: regex.compile(rf"\p{{{name}}}") for code, name in SCRIPTS.items()}
_ANY_SCRIPT = regex.compile("[" + "".join(rf"\p{{{name}}}" for name in SCRIPTS.values()) + "]")
_LETTER_RUN = regex.compile(r"\p{L}+")

# Instructions whose wanted answer declines something.
WANTS_REFUSAL = re.compile(
    r"(?:declin|refus|reject|turn(?:s|ing)? down|say(?:s|ing)? no)\w* (?:a|an|the|this|any|une|un|la|le|cette)? ?(?:polite )?(?:request|offer|demande|requête|invitation)"
    r"|(?:polite|politely|poliment|polie|höflich\w*)\b.{0,80}(?:declin|refus|ablehn|absag|reject)|(?:anfrage|bitte|wunsch)\b.{0,30}(?:ablehn|absag|abgelehnt)|(?:依頼|要望|要求|申し出)を?.{0,6}(?:断|辞退)",
    re.I | re.S,
)

_KANA = re.compile(r"[぀-ヿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？]+(?:[\"'”’」』)）]*)|\n|$)", re.S)
_ENDED = re.compile(r"[.!?。！？:：…]['\"”’»」』*_)）\]]*$")
_LIST = re.compile(r"^\s*(?:[-*•・]|\d{1,3}[.)])(?:\s+(.*))?$")
_URL = re.compile(r"(?:https?://|www\.)\S*$")
_ADDRESS = re.compile(r"(?:https?://\S+\.\S+|[\w.+-]+@[\w-]+\.[\w.]+)[/\w]$")


def language(text: str) -> str:
    """The code of a language, told by script or by frequent words, or '' where neither tells."""
    kana, cjk = len(_KANA.findall(text)), len(_CJK.findall(text))
    words = [w.lower() for w in _WORDS.findall(text) if not _CJK.search(w)]
    if cjk and (kana >= 3 or cjk >= 4) and cjk >= len(words):
        # Without any kana a short text may still be Japanese.
        return "ja" if kana else "zh" if cjk >= 12 else ""
    if not text.isascii() and _ANY_SCRIPT.search(text):
        letters = sum(map(len, words))
        for code, script in _SCRIPT.items():
            if (n := len(script.findall(text))) >= 4 and 2 * n > letters:
                return code
    score = {k: sum(w in f for w in words) for k, f in FUNCTION_WORDS.items()}
    score["de"] += sum(c in text for c in "äöüß") if score["de"] else 0
    order = sorted(score.values(), reverse=True)
    if order[0] >= 2 and order[0] >= 0.08 * len(words) and order[0] > 1.5 * order[1]:
        return max(score, key=lambda k: score[k])
    return ""


def languages_asked(*texts: str | None) -> set[str]:
    """Languages that a text names."""
    both = "\n".join(t for t in texts if t)
    return {k for k, p in _NAMES.items() if p.search(both) or _JA_NAMES[k] in both}


def terms_of(text: str | None) -> set[str]:
    """Words of a text, and pairs of neighbouring characters where words aren't set apart."""
    out = set()
    for word in _LETTER_RUN.findall((text or "").lower()):
        out |= {word[i : i + 2] for i in range(max(1, len(word) - 1))} if _CJK.search(word) else {word}
    return out


def sentences(text: str) -> list[str]:
    return [s for s in (m.group().strip() for m in _SENTENCE.finditer(text)) if letters_and_digits(s)]


def is_empty(response: str | None) -> bool:
    """Nothing but blanks, marks, a placeholder, or a heading without an answer."""
    if response is None:
        return True
    text = unicodedata.normalize("NFKC", response)
    text = re.sub(r"^\s*```\w*\s*\n?|\n?\s*```\s*$", "", text)
    bare = letters_and_digits(text)
    if not bare or bare in PLACEHOLDERS:
        return True
    lines = [x for x in text.splitlines() if letters_and_digits(x)]
    if len(lines) != 1:
        return False
    heading = re.fullmatch(r"\s*(?:#{1,6}\s*\S.*|[*_]{0,2}[^\n]{1,40}[:：]\s*[*_]{0,2})\s*", lines[0]) is not None
    return bare in HEADINGS and len(bare) <= 12 or heading and len(bare) <= 40


def copied_share(instruction: str | None, context: str | None, response: str) -> float:
    """Share of the response's distinct character runs that instruction and context hold, however often they are repeated; 0 where little of the instruction comes back."""
    source, own = letters_and_digits(f"{instruction or ''}\n{context or ''}"), letters_and_digits(response)
    if not instruction:
        return 0.0
    run = 3 if _CJK.search(response) else 4
    a, b = run_hashes(own, run), run_hashes(source, run)
    if not len(a):
        return float(bool(own) and own in source)
    from_instruction = np.intersect1d(a, run_hashes(letters_and_digits(instruction), run), assume_unique=True)
    # Names alone may come from the instruction; a copy gives most of it back.
    if len(from_instruction) < 0.5 * len(run_hashes(letters_and_digits(instruction), run)):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def opening(response: str) -> str:
    """The first sentence, reduced to letters and digits."""
    parts = sentences(response)
    return letters_and_digits(unicodedata.normalize("NFKC", parts[0])) if parts else ""


def last_word(text: str) -> str:
    words = _WORDS.findall(text)
    return words[-1].lower() if words else ""


def ending(response: str) -> tuple[str, str]:
    """How a response ends: ``ended``, ``cut``, or ``open`` with the last word, which decides."""
    text = response.rstrip()
    if text.count("```") % 2:
        return "cut", ""
    if text.endswith("```"):
        return "ended", ""
    last_line = text.splitlines()[-1] if text else ""
    for left, right in ("()", "（）", "「」", "『』", "“”"):
        if text.count(left) > text.count(right):
            return "cut", ""
    if text[-1:] in ",;:、，；：-–—":
        return "cut", ""
    if item := _LIST.match(last_line):
        body = (item[1] or "").strip()
        if not letters_and_digits(body) or re.fullmatch(r"\d+[.)]", last_line.strip()):
            return "cut", ""
        if _ENDED.search(body):
            return "ended", ""
        others = [m[1] for m in (_LIST.match(x) for x in text.splitlines()[:-1]) if m and m[1]]
        if others and not _CJK.search(body) and len(body.split()) < min(len(o.split()) for o in others):
            return "cut", ""
        return "open", "" if _CJK.search(body) else last_word(body)
    if text.endswith((")", "）", "]", "」", "』")) or _ADDRESS.search(text):
        return "ended", ""
    if _ENDED.search(text):
        return "ended", ""
    # A line without any sentence, such as a bare term, is a short answer unless its last word is broken.
    whole = len(sentences(response)) == 1 and not re.search(r"[.!?。！？、,]", text)
    if whole and (len(text.split()) <= 8 and not _CJK.search(text) or _CJK.search(text) and len(text) <= 30):
        word = last_word(text)
        if any(word in f for f in FUNCTION_WORDS.values()) or re.search(r"[をにがはでとのへ]$", text):
            return "cut", ""
        return "open", "" if _CJK.search(text) else word
    return "cut", ""
