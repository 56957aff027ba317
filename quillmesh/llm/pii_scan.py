"""Finding personal data in one text.

Most rules start from a literal that the text must hold (an at sign, a label,
a street word, a form of address), found with plain string search, and then
look at a short stretch around it, so the cost follows the hits.  Whatever is
shaped like a full name is a candidate, with the words before and behind it;
which of those introduce names is for the collection to say.
"""

from __future__ import annotations

import re
import unicodedata

Span = tuple[int, int, str]

# --- e-mail ---------------------------------------------------------------
_AT = re.compile(r"\s?(?:@|＠|&#64;|&commat;|[\[({]\s?(?:at|ät|arobase)\s?[\])}])\s?| at ", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?$")
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point)\s?[\])}]\s?|\sdot\s)"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9@-])", re.I)
# Local parts that belong to a service or stand for any address.
_NO_PERSON = frozenset({"git", "user", "username", "svn", "hg"})


def emails(text: str) -> list[Span]:
    out = []
    plain = "@" in text or "＠" in text or "&#64;" in text or "&commat;" in text
    if not plain and " at " not in text and not re.search(r"[\[({]\s?(?:at|ät|arobase)", text, re.I):
        return out
    for at in _AT.finditer(text):
        local = _LOCAL.search(text, max(0, at.start() - 72), at.start())
        if not local:
            continue
        domain = _DOMAIN.match(text, at.end())
        if not domain or local[0].lower() in _NO_PERSON and at[0] == "@":
            continue
        if text[domain.end() : domain.end() + 1] == ":" and re.match(r"[\w/~]", text[domain.end() + 1 : domain.end() + 2]):
            continue
        out.append((local.start(), domain.end(), "email"))
    return out


# --- identity numbers -----------------------------------------------------
# What such numbers are called.
_ID_LABELS = (
    "ssn", "social security n", "social insurance n", "national insurance", "tax id", "tax number", "taxpayer id", "tin:", "passport", "national id", "identity card", "identity number", "id card", "driver's licen",
    "sécurité sociale", "numéro fiscal", "carte d'identité", "passeport", "ausweis", "reisepass", "steuer-id", "steueridentifikation", "steuernummer", "sozialversicherung", "rentenversicherung",
    "個人番号", "マイナンバー", "旅券番号", "パスポート番号", "免許証番号", "保険証番号", "基礎年金番号",
)
_ID_JOIN = re.compile(
    r"[^\W\d_は]{0,16}(?:[ 　]?(?:no|nr|number|numbers|num|nummer|numéro|id|card)\b\.?)?[ 　]?(?:is|was|ist|lautet|est|:|：|は|\()?[ 　]?(?:le|la|:|：)?[ 　]?[(:：]?[ 　]?", re.I
)
_D = "[0-9０-９]"
_ID_VALUE = re.compile(
    rf"[12](?:[ .-]?{_D}){{14}}(?![0-9])|{_D}{{4}}[ \-－]?{_D}{{4}}[ \-－]?{_D}{{4}}(?![0-9０-９])|{_D}{{6}}/{_D}{{3}}-[A-Z]|{_D}{{3}}[ .-]?{_D}{{2}}[ .-]?{_D}{{4}}(?![0-9])"
    rf"|[A-Z]{{1,3}} ?{_D}{{6,9}}(?![0-9A-Z])|[A-Z]{_D}[0-9A-Z]{{5,9}}(?![0-9A-Z])|{_D}{{2}}[ ]?{_D}{{3}}[ ]?{_D}{{3}}[ ]?{_D}{{3}}(?![0-9])|[A-Z]{{2}}[ ]?{_D}{{2}}[ ]?{_D}{{2}}[ ]?{_D}{{2}}[ ]?[A-Z]"
    rf"|(?=(?:[A-Z./-]*{_D}){{6}})[0-9A-Z](?:[0-9A-Z./-]*[0-9A-Z])"
)


def id_numbers(text: str, lower: str) -> list[Span]:
    out = []
    for label in _ID_LABELS:
        at = lower.find(label)
        while at >= 0:
            join = _ID_JOIN.match(text, at + len(label.rstrip(":")))
            # The word may go on after the label (Ausweisnummer), so the join is tried from its end and from the label's.
            for start in {join.end(), at + len(label.rstrip(":"))}:
                if value := _ID_VALUE.match(text, start):
                    out.append((value.start(), value.end(), "id_number"))
                    break
            at = lower.find(label, at + len(label))
    return out


# --- telephone ------------------------------------------------------------
_NUMBER = re.compile(r"[+＋(（]?[0-9０-９][0-9０-９ ()（）./\-－]{5,}[0-9０-９]")
_EXTENSION = re.compile(r",? ?(?:ext\.?|extension|x|poste|durchwahl|app\.|内線) ?[0-9]{1,6}", re.I)
_PHONE_CUE = re.compile(
    r"(?:\b(?:tel|tél|phone|telephone|téléphone|telefon|fon|fax|mobile?|handy|cell|call(?:ing)?|dial|ring|line(?: is)?|maintainer under|under|appeler le|appelez le|joindre au|erreichbar unter|rufnummer|unter)|電話|携帯|緊急時|ファックス|内線)[^0-9０-９]{0,12}$", re.I
)
_GROUPED = re.compile(r"\(\d{3}\) ?\d{3}[-. ]\d{4}|0[789]0-\d{4}-\d{4}|0\d{1,3}\(\d{3,4}\)\d{4}")


def phones(text: str, taken: list[Span]) -> list[Span]:
    out = []
    for number in _NUMBER.finditer(text):
        start, end = number.start(), number.end()
        if any(s < end and start < e for s, e, _ in taken):
            continue
        raw = unicodedata.normalize("NFKC", number[0])
        if raw.startswith("(") and ")" not in raw:
            start, raw = start + 1, raw[1:]
        digits = re.sub(r"\D", "", raw)
        cue = _PHONE_CUE.search(text, max(0, start - 40), start)
        if raw.startswith("+"):
            ok = 8 <= len(digits) <= 15
        elif _GROUPED.fullmatch(raw):
            ok = True
        else:
            ok = cue is not None and 8 <= len(digits) <= 15
        if ok:
            if more := _EXTENSION.match(text, end):
                end = more.end()
            out.append((start, end, "phone"))
    return out


# --- street address -------------------------------------------------------
# What streets are called.
_EN_STREETS = (" Lane", " Road", " Street", " St", " Terrace", " Ave", " Close", " Drive", " Court", " Square", " Crescent", " Boulevard", " Blvd", " Rd", " Ln", " Way", " Place")
_EN_BEFORE = re.compile(r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?, ?)?\b\d{1,5}[A-Za-z]? (?:[A-Z][a-z'’]+ ){0,2}[A-Z][a-z'’]+$")
_EN_AFTER = re.compile(r"(?:enue|reet)?(\.?)(?![A-Za-z])(, [A-Z][a-z]+(?: [A-Z][a-z]+)?(?: (?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{5}(?:-\d{4})?))?)?")
_DE_STREETS = ("straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "allee ", "ufer ", "damm ")
_DE_BEFORE = re.compile(r"[A-ZÄÖÜ][\wäöüß-]*$")
_DE_AFTER = re.compile(r"\d{1,4}(?: ?[a-z]\b)?(?:, \d{5} [A-ZÄÖÜ][\wäöüß-]+(?:(?: am | an der |-)[A-ZÄÖÜ][\wäöüß-]+)?)?")
_FR_STREETS = ("rue ", "avenue ", "chemin ", "place ", "boulevard ", "impasse ", "allée ", "quai ", "cours ")
_FR_BEFORE = re.compile(r"\b\d{1,4}(?: ?(?:bis|ter|quater))?,? $")
_FR_AFTER = re.compile(r"(?:(?:de la|de l['’]|des|du|de|d['’]) ?)?[A-ZÀ-Ý][\w'’-]*(?: [A-ZÀ-Ý][\w'’-]*)?(?:, \d{5} [A-ZÀ-Ý][\w'’-]+)?")
_JA = re.compile(r"(?:〒 ?[0-9０-９]{3}[-－][0-9０-９]{4}[ 　]?)?[一-龥]{1,5}[都道府県][一-龥ぁ-んァ-ヶー]{1,8}?[市区郡村][一-龥ぁ-んァ-ヶー]{1,10}?[0-9０-９]+(?:丁目|番地|番|号|[-－ー][0-9０-９]+)*(?:号室|号)?")
_JA_LEAD = re.compile(r"^.*?(?:住所|送付先|所在地|宛先|届け先|会場|自宅)(?:は|：|:)?")


def addresses(text: str) -> list[Span]:
    out = []
    for street in _EN_STREETS:
        at = text.find(street)
        while at >= 0:
            after = _EN_AFTER.match(text, at + len(street))
            if after and (before := _EN_BEFORE.search(text, max(0, at - 60), at)):
                end = after.end()
                if after[2] is None and after[1]:
                    # "St." keeps its point inside a sentence and loses it at the end of one.
                    end -= not re.match(r" [a-z]", text[end : end + 2])
                # In "50 St. markers" there is no name between number and street.
                out.append((before.start(), end, "address"))
            at = text.find(street, at + len(street))
    for street in _DE_STREETS:
        at = text.find(street)
        while at >= 0:
            before, after = _DE_BEFORE.search(text, max(0, at - 40), at), _DE_AFTER.match(text, at + len(street))
            if before and after:
                out.append((before.start(), after.end(), "address"))
            at = text.find(street, at + len(street))
    for street in _FR_STREETS:
        at = text.find(street)
        while at >= 0:
            before, after = _FR_BEFORE.search(text, max(0, at - 14), at), _FR_AFTER.match(text, at + len(street))
            if before and after:
                out.append((before.start(), after.end(), "address"))
            at = text.find(street, at + len(street))
    at = min((i for i in (text.find(c) for c in "県都府道") if i >= 0), default=-1)
    if at >= 0:
        for found in _JA.finditer(text, max(0, at - 20)):
            lead = _JA_LEAD.match(found[0])
            out.append((found.start() + (lead.end() if lead else 0), found.end(), "address"))
    return out


# --- names ----------------------------------------------------------------
_L = "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
_W = rf"[A-ZÀ-ÖØ-Þ][{_L}'’-]*[{_L}]"
_I = r"[A-ZÀ-ÖØ-Þ]\."
_END = rf"(?![{_L}0-9_])"
_FULL = rf"(?:{_W}, {_W}(?: {_I})*|{_W}(?: {_I})+ {_W}|{_I}(?: ?{_I})* ?{_W}|{_W} {_W}){_END}"
_SHAPED = re.compile(rf"(?<![{_L}0-9_.'’@/-])(?=({_FULL}))")
_KANJI_SHAPED = re.compile(r"(?<![一-龥々ァ-ヺー])([一-龥々]{2}[ 　]?[一-龥々]{1,3})(?![一-龥々])")
_INITIAL = re.compile(r"(?:\w\.)+")
_CJK = re.compile(r"[ぁ-ゖァ-ヺ一-龥々]")
_BREAK = re.compile(r"[\n\r。！？]|[.!?](?:\s|$)")
# Forms of address before and after a name.
_TITLES = ("Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Miss ", "Mx ", "Dr ", "Dr. ", "Prof ", "Prof. ", "Professor ", "Professorin ", "Herr ", "Herrn ", "Frau ", "Mme ", "Mlle ", "Monsieur ", "Madame ", "Mademoiselle ", "Docteur ", "Professeur ", "Doktor ", "M. ")
_HONORIFICS = ("さん", "様", "氏", "先生", "殿", "教授", "博士")
_TITLE_WORDS = frozenset(t.strip(" .") for t in _TITLES) - {"M"}
_TITLED = re.compile(rf"(?:(?:Dr|Prof|Med|Ing)\.? )*(?:(?:{_W}(?: {_I})+ {_W}|{_I}(?: ?{_I})* ?{_W}){_END}|{_W})")
_HONORED = re.compile(rf"([一-龥々]{{2,6}}|[A-ZÀ-Þ][{_L}'’-]+(?: [A-ZÀ-Þ][{_L}'’-]+)?)[ 　]?$")
# Words that take an honorific without being a name.
_NOT_NAMES = frozenset("皆 皆々 客 お客 担当 担当者 関係者 読者 利用者 参加者 著者 作者 両 同 各 神 仏 王 奥 部長 課長 社長 会長 医師 教師 学生 生徒 先 御社 貴社 当社 弊社 同様 多様 仕様 模様 異様 一様 有様".split())

#: A name-shaped stretch: start, end, whether both of its parts are known, and the words before and behind it in its sentence.
Shaped = tuple[int, int, bool, str, str]


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before and behind a stretch, or four characters where words aren't set apart; '' at the borders of a sentence."""
    before = _BREAK.split(text[max(0, start - 40) : start])[-1]
    before = before[-4:] if _CJK.search(before[-1:]) or before.endswith("：") else " ".join(before.split()[-2:])
    behind = _BREAK.split(text[end : end + 40])[0]
    behind = behind[:4] if _CJK.match(behind) else " ".join(behind.split()[:2]) if behind[:1] == " " else ""
    return before, behind


class Names:
    """Name rules with a lexicon of given and family names by script."""

    def __init__(self, lexicon: list[tuple[str, str, str]]) -> None:
        self.given = {n.casefold() for n, kind, script in lexicon if kind == "given" and script != "ja" and n}
        self.family = {n.casefold() for n, kind, script in lexicon if kind == "family" and script != "ja" and n}
        self.ja_family = {n for n, kind, script in lexicon if kind == "family" and script == "ja" and n}
        self.ja_given = {n for n, kind, script in lexicon if kind == "given" and script == "ja" and n}

    def shaped(self, text: str) -> list[Shaped]:
        """Everything shaped like a full name."""
        out = []
        for found in _SHAPED.finditer(text):
            start, end = found.span(1)
            words = [w for w in re.split(r"[\s,]+", found[1]) if not _INITIAL.fullmatch(w)]
            if found[1].split()[0].strip(".,") in _TITLE_WORDS:
                continue
            if "," in found[1]:
                words = words[1:] + words[:1]
            known = len(words) > 1 and words[0].casefold() in self.given and words[-1].casefold() in self.family
            out.append((start, end, known, *around(text, start, end)))
        if _CJK.search(text):
            for found in _KANJI_SHAPED.finditer(text):
                start, end = found.span(1)
                bare = re.sub(r"\s", "", found[1])
                if not bare.endswith(_HONORIFICS):
                    out.append((start, end, bare[:2] in self.ja_family and bare[2:] in self.ja_given, *around(text, start, end)))
        return out

    def addressed(self, text: str) -> list[Span]:
        """Names with a form of address."""
        out: list[Span] = []
        for title in _TITLES:
            at = text.find(title)
            while at >= 0:
                before = text[max(0, at - 2) : at]
                apart = not before or not (before[-1].isalnum() or before[-1] in "._-'’@")
                # "M." after a word is somebody's initial, at the start of a sentence a form of address.
                if title == "M. ":
                    apart = apart and (not before.strip() or before.strip()[-1] in ".!?。:>]\"«(")
                if apart and (name := _TITLED.match(text, at + len(title))):
                    start = name.start() + len(re.match(r"(?:(?:Dr|Prof|Med|Ing)\.? )*", name[0])[0])
                    if not text[start : name.end()].isdigit():
                        out.append((start, name.end(), "name"))
                at = text.find(title, at + len(title))
        for honorific in _HONORIFICS:
            at = text.find(honorific)
            while at > 0:
                if name := _HONORED.search(text, max(0, at - 40), at):
                    word = name[1]
                    known = word[:2] in self.ja_family if not word.isascii() and "一" <= word[0] <= "龥" else True
                    short = len(word) == 2 or word[0].isascii() or not "一" <= word[0] <= "龥"
                    if word not in _NOT_NAMES and (known or short) and (short or len(word) <= 5):
                        out.append((name.start(1), name.end(1), "name"))
                at = text.find(honorific, at + 1)
        return out


def look(text: str | None, names: Names) -> tuple[list[Span], list[Shaped]]:
    """What a text holds for certain, overlaps included, and what is shaped like a name."""
    if not text:
        return [], []
    mail = emails(text)
    ids = id_numbers(text, text.lower() if len(text.lower()) == len(text) else text)
    street = addresses(text)
    return mail + ids + street + phones(text, mail + ids + street) + names.addressed(text), names.shaped(text)


def settle(spans: list[Span]) -> list[Span]:
    """Spans in order and without overlap.

    Where two overlap, the earlier kind of e-mail, identity number, address,
    telephone and name stays, and of one kind the longer.
    """
    rank = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "name": 4}
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (rank[s[2]], s[0] - s[1], s[0])):
        if span[0] < span[1] and not any(s < span[1] and span[0] < e for s, e, _ in kept):
            kept.append(span)
    return sorted(kept)


def scan(text: str | None, names: Names, cues: frozenset[tuple[str, str]] = frozenset()) -> list[Span]:
    """All personal data of one text as ``start, end, type``; ``cues`` are the (side, words) that introduce names."""
    sure, shaped = look(text, names)
    named = [(s, e, "name") for s, e, known, before, behind in shaped if known or ("before", before) in cues or ("behind", behind) in cues]
    return settle(sure + named)
