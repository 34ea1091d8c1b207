"""Folding of texts to comparable words: case, script, apostrophes, punctuation, tags, digits."""

from __future__ import annotations

import re
import unicodedata

from sozmill.functions import text as T

# Cyrillic letters of the corpus languages and the Latin letters they are compared as.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "x", "ц": "s", "ч": "ch", "ш": "sh",
    "щ": "sh", "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ў": "o", "қ": "q", "ғ": "g", "ҳ": "h", "ә": "a", "і": "i",
    "ң": "n", "ө": "o", "ұ": "u", "ү": "u", "һ": "h", "ӣ": "i", "ӯ": "u", "ҷ": "j",
}
# Characters that serve as apostrophes or modifier marks inside words.
APOSTROPHES = "'`´’‘ʼʻʽ‛′ʹˈ＇"
# Characters without width.
INVISIBLE = "­​‌‍‎‏⁠﻿‪‫‬‭‮"

_TABLE = str.maketrans({**CYRILLIC_TO_LATIN, **{c: "" for c in APOSTROPHES + INVISIBLE}})
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_TAG = re.compile(r"\[[^\[\]\n]*\]|<[^<>\n]*>")
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")
#: In plain Latin text anything but letters and digits parts words.
_PARTS = {c: None if chr(c) in APOSTROPHES else c if chr(c).isalnum() else " " for c in range(128)}


def _bare(words: list[str]) -> list[str]:
    """Number words as folded text spells them."""
    return [w.translate(_TABLE).replace("ye", "e") for w in words]


_ONES, _TENS, _SCALES = _bare(T.ONES), _bare(T.TENS), _bare(T.SCALES)


def number_words(digits: str) -> str:
    """Uzbek words of a whole number, spelled as folded text is; numbers beyond the largest scale are read digit by digit."""
    digits = digits.lstrip("0") or "0"
    if len(digits) > 3 * len(_SCALES):
        return " ".join(_ONES[int(d)] or "nol" for d in digits)
    n = int(digits)
    if n == 0:
        return "nol"
    groups = []
    for scale in _SCALES:
        if not n:
            break
        n, part = divmod(n, 1000)
        if part:
            hundreds, rest = divmod(part, 100)
            words = ([] if hundreds < 2 else [_ONES[hundreds]]) + (["yuz"] if hundreds else []) + [_TENS[rest // 10], _ONES[rest % 10]]
            if scale == "ming" and part == 1:
                words = []
            groups.append(" ".join(w for w in [*words, scale] if w))
    return " ".join(reversed(groups))


def fold(text: str) -> str:
    """Lower-cased Latin text without apostrophes and width-less characters; ``ye`` and ``ts`` count as ``e`` and ``s``.

    Most texts are plain Latin or have few other characters, so each kind takes the shortest way to the same result.
    """
    if text.isascii():
        low = text.lower().replace("'", "").replace("`", "")
    else:
        low = unicodedata.normalize("NFKC", text.replace("´", "'")).lower()
        if _CYRILLIC.search(low):
            low = low.translate(_TABLE)
        else:
            for c in APOSTROPHES + INVISIBLE:
                low = low.replace(c, "")
    return low.replace("ye", "e").replace("ts", "s")


def split_words(low: str) -> list[str]:
    """Words of a folded text."""
    return low.translate(_PARTS).split() if low.isascii() else _WORD.findall(low)


def words(text: str | None, numbers: bool = True) -> list[str]:
    """The comparable words of a text: tags in brackets dropped, punctuation ignored, digits spelled as Uzbek words."""
    if not text:
        return []
    low = fold(_TAG.sub(" ", text) if "[" in text or "<" in text else text)
    if numbers and _DIGITS.search(low):
        low = _DIGITS.sub(lambda m: " " + number_words(m.group()) + " ", low)
    return split_words(low)
