"""Text functions of the corpus as Catalyst expressions: apostrophes, transliteration, numbers, punctuation, targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

OKINA = "ʻ"
TUTUQ = "ʼ"
# Apostrophe characters of the front end and of corpus preparation; the two sets differ on purpose.
FRONTEND_APOSTROPHES = "'`´’ʼ‘ʽ‛′"
CORPUS_APOSTROPHES = "'`´’ʼʻ‘"
# Cyrillic letters with one Latin letter each, and those with several.
SINGLE_FROM = "абвгджзийклмнопрстуфхэқҳ"
SINGLE_TO = "abvgdjziyklmnoprstufxeqh"
SEVERAL = {"ё": "yo", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ю": "yu", "я": "ya", "ў": "o" + OKINA, "ғ": "g" + OKINA}
E_AFTER = "аеёиоуэюяўъьАЕЁИОУЭЮЯЎЪЬ"
# Number words.
ONES = ["", "bir", "ikki", "uch", "toʻrt", "besh", "olti", "yetti", "sakkiz", "toʻqqiz"]
TENS = ["", "oʻn", "yigirma", "oʻttiz", "qirq", "ellik", "oltmish", "yetmish", "sakson", "toʻqson"]
SCALES = ["", "ming", "million", "milliard", "trillion", "kvadrillion"]
# Clitics written apart, event tags, kept punctuation.
CLITICS = ("da", "ku", "chi", "mi", "yu", "ya", "ta")
EVENT_TAGS = {"laughter": "[kulgu]", "music": "[musiqa]", "applause": "[qarsak]", "cough": "[yoʻtal]"}
PUNCTUATION = ".,?!"
ALLOWED_RAW = r"^[a-zA-Zʻʼ .,!?—–:;\"'()…-]*$"
DIGIT = r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]"

_MARK = "\u0001"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse(c: Column) -> Column:
    """One blank for every run of Unicode white space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _apostrophes(c: Column, marks: str) -> Column:
    marked = F.regexp_replace(c, f"([ogOG])[{marks}{OKINA}]", "$1" + _MARK)
    return F.replace(F.translate(marked, marks, TUTUQ * len(marks)), F.lit(_MARK), F.lit(OKINA))


def apostrophes_frontend(c: Column) -> Column:
    """ʻ after o and g, ʼ for any other apostrophe of the front end's set."""
    return _apostrophes(c, FRONTEND_APOSTROPHES)


def apostrophes_corpus(c: Column) -> Column:
    """As the front end, with the corpus' set: ʻ elsewhere becomes ʼ, rarer marks stay."""
    return _apostrophes(c, CORPUS_APOSTROPHES)


def normalize_text(c: Column) -> Column:
    """Lower-case Latin words with ʻ and ʼ, single blanks."""
    return collapse(F.regexp_replace(F.lower(apostrophes_corpus(c)), f"[^a-z{OKINA}{TUTUQ} ]", " "))


def clean_raw(c: Column) -> Column:
    return collapse(apostrophes_corpus(c))


def transliterate(c: Column) -> Column:
    """Cyrillic to Latin; е is ye at the start of a word and after vowels and signs, capitals follow their neighbours.

    Texts without Cyrillic pass through, and only texts with adjacent capitals take the longer chain.
    """
    capitals = "[ЁЦЧШЩЮЯЕ]\\p{Lu}"
    return bind(c, lambda x: F.when(~x.rlike("[Ѐ-ӿ]"), x).when(x.rlike(capitals), _latin(x, True)).otherwise(_latin(x, False)))


def _latin(c: Column, capitals: bool) -> Column:
    here = rf"(?:(?<!\p{{L}})|(?<=[{E_AFTER}]))"
    c = F.regexp_replace(c, here + "е", "ye")
    if capitals:
        c = F.regexp_replace(c, here + r"Е(?=\p{Lu})", "YE")
    c = F.regexp_replace(c, here + "Е", "Ye")
    for letter, latin in SEVERAL.items():
        upper = letter.upper()
        c = F.replace(c, F.lit(letter), F.lit(latin))
        if capitals:
            c = F.regexp_replace(c, upper + r"(?=\p{Lu})", latin.upper())
        c = F.replace(c, F.lit(upper), F.lit(latin[0].upper() + latin[1:]))
    plain, target = SINGLE_FROM + "е", SINGLE_TO + "e"
    return F.translate(c, plain + plain.upper() + "ъЪьЬ", target + target.upper() + TUTUQ * 2)


def _triples() -> list[str]:
    out = []
    for n in range(1000):
        hundreds, rest = divmod(n, 100)
        parts = [ONES[hundreds] if hundreds > 1 else "", "yuz" if hundreds else "", TENS[rest // 10], ONES[rest % 10]]
        out.append(" ".join(p for p in parts if p))
    return out


def int_to_words(digits: Column) -> Column:
    """Words of a string of digits, a minus sign before it allowed; null beyond 18 significant digits or for anything else."""
    table = F.array(*[F.lit(t) for t in _triples()])
    negative = F.startswith(digits, F.lit("-"))
    plain = F.when(negative, F.substring(digits, 2, 1 << 30)).otherwise(digits)
    short = F.ltrim(plain, F.lit("0"))
    padded = F.lpad(short, 18, "0")
    groups = []
    for i in range(6):
        n = F.substring(padded, 3 * i + 1, 3).cast("int")
        scale = SCALES[5 - i]
        if not scale:
            words = F.element_at(table, n + 1)
        else:
            words = F.when(n == 1, F.lit(scale if scale == "ming" else f"bir {scale}")).otherwise(F.concat(F.element_at(table, n + 1), F.lit(f" {scale}")))
        groups.append(F.when(n > 0, words))
    ok = plain.rlike("^[0-9]+$") & (F.length(short) <= 18)
    return F.when(ok, F.when(short == "", F.lit("nol")).otherwise(F.concat_ws(" ", F.when(negative, F.lit("minus")), *groups)))


def _other_digits() -> tuple[str, str]:
    """Decimal digits of all other scripts, and the plain digits they stand for."""
    import sys
    import unicodedata

    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


NUMBER = r"(\p{Nd}{1,3}(?:[ ,]\p{Nd}{3})+(?!\p{Nd})|\p{Nd}+)([\s\x0B\x1C-\x1F\x85\p{Z}]*%)?"


def expand_numbers(c: Column) -> Column:
    """Numbers as words; grouped thousands are one number, a percent sign is spelled. Too large numbers stay as digits."""
    return bind(c, _expand)


def _expand(c: Column) -> Column:
    between = F.split(c, NUMBER, -1)
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))

    other, plain = _other_digits()

    def spelled(m: Column) -> Column:
        digits = F.translate(F.regexp_replace(m, r"[\s\x0B\x1C-\x1F\x85\p{Z}]*%$", ""), " ,", "")
        percent = F.when(F.endswith(m, F.lit("%")), F.lit(" foiz")).otherwise(F.lit(""))
        return F.coalesce(F.concat(bind(F.translate(digits, other, plain), int_to_words), percent), m)

    pieces = F.zip_with(between, F.transform(found, spelled), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(~c.rlike(r"\p{Nd}"), c).otherwise(F.array_join(pieces, ""))


def frontend_normalize(c: Column) -> Column:
    """The front end's whole chain: apostrophes, Latin script, numbers, lower case, letters only."""
    converted = F.lower(expand_numbers(transliterate(apostrophes_frontend(c))))
    return collapse(F.regexp_replace(converted, f"[^a-z{OKINA}{TUTUQ} ]", " "))


def join_clitics(c: Column) -> Column:
    """Clitics glued to the word before them; the first word never is one."""
    return F.regexp_replace(collapse(c), f"(?<=[^ ]) (?=(?:{'|'.join(CLITICS)})(?: |$))", "")


SENTENCE_START = r"(?:^[\s\x0B\x1C-\x1F\x85\p{Z}]*|[.?!][\s\x0B\x1C-\x1F\x85\p{Z}]+)[a-z]"


def capitalize_sentences(c: Column) -> Column:
    """First letter a-z of the text, and after . ? ! and any white space, as a capital."""
    return bind(c, _capitalized)


def _capitalized(c: Column) -> Column:
    starts = F.transform(F.regexp_extract_all(c, F.lit(SENTENCE_START), F.lit(0)), lambda m: F.concat(F.left(m, F.length(m) - 1), F.upper(F.right(m, F.lit(1)))))
    return F.array_join(F.zip_with(F.split(c, SENTENCE_START, -1), starts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def punct_target(c: Column) -> Column:
    """Lower-case training target that keeps words, . , ? ! and inner marks; no blank before punctuation."""
    kept = F.regexp_replace(F.lower(c), rf"(?U)[^\w\s.,?!{OKINA}{TUTUQ}'-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", " "), " ?([.,?!])", "$1"))


def strip_punct(c: Column) -> Column:
    return collapse(F.translate(c, PUNCTUATION, "    "))


def strip_event_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in EVENT_TAGS.values()), " "))


def vocabulary_clean(c: Column) -> Column:
    return collapse(F.translate(F.translate(c, "ʻʼ’‘`´", "''''''"), "-—–", "   "))


def encode(c: Column, vocabulary: list[str]) -> Column:
    """Ids of the cleaned text's characters; null if any is outside the vocabulary."""
    cleaned = vocabulary_clean(c)
    index = F.create_map(*[F.lit(x) for i, v in enumerate(vocabulary) for x in (v, i)])
    ids = F.transform(F.filter(F.split(cleaned, ""), lambda x: x != ""), lambda x: index[x])
    return F.when(~F.exists(ids, lambda x: x.isNull()), ids)


def words(c: Column) -> Column:
    """Words of single-blank text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def reject_reason(raw: Column, normalized: Column, duration: Column) -> Column:
    """First reason to reject a row, in fixed order; null keeps it."""
    count = F.size(words(normalized))
    rate = F.try_divide(count, duration)
    return (
        F.when(normalized == "", "empty")
        .when(raw.rlike(DIGIT), "digits")
        .when(~apostrophes_corpus(raw).rlike(ALLOWED_RAW), "charset")
        .when(duration.isNull() | ~duration.between(0.5, 30.0), "duration")
        .when(F.try_divide(F.length(normalized), duration) > 18.0, "char_rate")
        .when(~rate.between(0.3, 2.67), "word_rate")
    )


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def hash_bucket(c: Column, buckets: int = 100) -> Column:
    """Bucket of the first 32 bits of a key's SHA-1."""
    return F.conv(F.substring(F.sha1(c.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def hash_split(c: Column) -> Column:
    """train, val, test as 96, 2, 2 of a hundred hash buckets."""
    b = hash_bucket(c)
    return F.when(b < 96, "train").when(b < 98, "val").otherwise("test")


def word_distance(a: Column, b: Column) -> Column:
    """Word edit distance: every distinct word becomes one character, and characters are compared inside the JVM.

    ``a`` and ``b`` are arrays of words with fewer than 20,000 distinct words together.
    """
    vocabulary = F.array_distinct(F.concat(a, b))
    code = lambda x: F.array_join(F.transform(x, lambda w: _char(F.array_position(vocabulary, w))), "")
    return F.levenshtein(code(a), code(b))


def _char(n: Column) -> Column:
    """A character of the CJK block by number, below the surrogates."""
    return F.decode(F.unhex(F.lpad(F.hex(n + 0x4E00), 4, "0")), "UTF-16BE")


def zip_strict(a: Column, b: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    """Pairs of two arrays of one length, in order; arrays that differ in length raise."""
    message = F.format_string("lengths differ: %d and %d", F.size(a), F.size(b))
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias(names[0]), b.alias(names[1]))).otherwise(F.raise_error(message))


@F.pandas_udf(DoubleType())
def round_half_even(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounded by the exact binary value, exact halves to the even digit; ``round`` rounds the shortest decimal spelling half up."""
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(value, digits)], dtype="float64")
