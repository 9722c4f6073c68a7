"""Character tables and folds shared by the operators that compare text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin letter (Unicode confusables, the visually identical ones).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухԁԛԝһѵ", "ABESIJKMHOPCTYXYGQWaesijopcyxdqwhv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρ", "ABEZHIKMNOPTYXoviap", strict=True))
ARMENIAN = dict(zip("ՍՏՕսոօհցզԼ", "USOunohgqL", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᎽᏃ", "ABCDEGHJKLMPRSTVWYZ", strict=True))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | {"ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l"}
# Kana that look like an ideograph.
KANA_LOOKALIKE = dict(zip("カエニロハタトオチセミヌヒリ", "力工二口八夕卜才千七三又匕刂", strict=True))
# CJK radicals without a decomposition of their own, and the ideographs that look the same.
RADICALS = dict(zip("⺠⻄⻅⻆⻉⻋⻑⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⺝⺪⺼⻁⻂⻖⻏", "民西见角贝车長长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙月疋月虎衤阝阝", strict=True))
# Characters without a shape, and blanks and dashes other than the ASCII ones.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ﻿ﾠ"
BLANKS = "               　"
DASHES = "‐‑‒−﹘﹣－"
# Traditional characters of schools and skills.
TRADITIONAL = dict(zip("學醫財經範師業與術漢數據機體網絡開發項計產質設營銷資訊電腦語處國際華東門關係維護運優蘇廣雲臨澤嵐墨蒼橋陵", "学医财经范师业与术汉数据机体网络开发项计产质设营销资讯电脑语处国际华东门关系维护运优苏广云临泽岚墨苍桥陵", strict=True))

_SINGLE = (
    {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in DASHES} | {ord(k): v for k, v in RADICALS.items()}
)
_TRADITIONAL = {ord(k): v for k, v in TRADITIONAL.items()}
_WORD = re.compile(r"[^\W\d_]+")


def is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "\U00020000" <= c <= "\U0003ffff"


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


_OTHER_SCRIPTS = {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE"}


def genuine_scripts(text: str) -> set[str]:
    """Other scripts of which the text has a genuine word: one with a letter that looks like no Latin letter, and with no Latin letter."""
    found: set[str] = set()
    for m in _WORD.finditer(text):
        others = {script(c) for c in m[0] if c not in LOOKALIKE}
        if "LATIN" not in others:
            found |= others & _OTHER_SCRIPTS
    return found


def plain_letters(text: str, genuine: set[str] | None = None) -> str:
    """Replaces look-alike letters: in words that mix scripts, and in words made of look-alikes alone unless the text has a genuine word of that script."""
    if text.isascii():
        return text
    genuine = genuine_scripts(text) if genuine is None else genuine
    words = [m.span() for m in _WORD.finditer(text)]
    todo = []
    for a, b in words:
        word = text[a:b]
        foreign = [c for c in word if c in LOOKALIKE]
        others = {script(c) for c in word if c not in LOOKALIKE}
        if foreign and ("LATIN" in others or not others & _OTHER_SCRIPTS):
            todo.append((a, b, "LATIN" in others))
    out = list(text)
    for a, b, mixed in todo:
        for i in range(a, b):
            if text[i] in LOOKALIKE and (mixed or script(text[i]) not in genuine):
                out[i] = LOOKALIKE[text[i]]
    for i, c in enumerate(out):
        if c in KANA_LOOKALIKE:
            near = [x for x in out[max(0, i - 1) : i] + out[i + 1 : i + 2]]
            if any(is_han(x) for x in near) and not any("ぁ" <= x <= "ヿ" and x not in KANA_LOOKALIKE for x in out):
                out[i] = KANA_LOOKALIKE[c]
    return "".join(out)


@lru_cache(maxsize=65536)
def looks_otherwise(c: str) -> bool:
    """True of raised, lowered, circled, squared letters and digits and of fractions: their compatibility form does not look the same."""
    return unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<circle>", "<square>", "<fraction>"))


def settled(text: str) -> str:
    """Everything of the plain form but the replacement of look-alike letters."""
    plain = text.translate(_SINGLE)
    if not any(looks_otherwise(c) for c in plain):
        return unicodedata.normalize("NFKC", plain)
    out, part = [], ""
    for c in plain:
        if looks_otherwise(c):
            out += [unicodedata.normalize("NFKC", part), c]
            part = ""
        else:
            part += c
    return unicodedata.normalize("NFC", "".join([*out, unicodedata.normalize("NFKC", part)]))


def plain_form(text: str, genuine: set[str] | None = None) -> str:
    """Half-width, composed, with ordinary blanks and dashes, no invisible characters and no look-alikes; otherwise unchanged."""
    if text.isascii():
        return text
    # a mark on a replaced letter composes with the letter it now stands on
    return unicodedata.normalize("NFC", plain_letters(settled(text), genuine))


def fold(text: str) -> str:
    """A key under which equal-looking values are equal whatever their case, blanks and character variants."""
    plain = plain_form(text).translate(_TRADITIONAL)
    return " ".join(plain.split()).casefold()
