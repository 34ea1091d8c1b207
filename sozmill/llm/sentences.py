"""Sentence boundaries across languages and scripts by a maximum-entropy classifier trained on reliable boundaries.

Candidates are runs of terminators with their closing marks. Layout decides some of them outright (blank lines, list
numbers, raw lines, quotations, Thai blanks); the classifier decides the rest from the tokens around a candidate, their
case, length, digits and script. It learns from boundaries that layout makes certain: a terminator that ends a paragraph
is one, a terminator before a lower-cased word isn't. What a period before a capital means is learned by contrast: a
token that often stands there but never ends a paragraph is an abbreviation.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozmill.functions.keys import key
from sozmill.llm.sample import bounded_sample

#: Documents of the sample that the classifier is fitted on.
FIT_DOCUMENTS = 12_000
#: Documents are read for fitting up to this many characters; segmentation reads whole texts.
FIT_CHARS = 4_000

_CLUSTER = re.compile(r"[.!?…。！？।؟]+[»”\"’“)\]」』]*")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n\s*")
_ITEM = re.compile(r"(?:^|(?<=\n))[^\S\n]*(\d{1,3})[.)](?=\s)")
_QUOTE = re.compile(
    r"«[^«»]*»|„[^„“”]*[“”]|“[^“”„]*”|「[^「」]*」|『[^『』]*』"
    r"|(?<![^\s(\[—–:-])\"(?=\S)[^\"]*\"|(?<!\w)‘(?=\w)[^‘]*?[.,!?…]’(?!\w)"
)
_THAI_BLANK = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
_THAI_DIGIT = re.compile(r"[\d๐-๙]")
#: Tokens are compared without width-less characters and with one apostrophe.
_GLUED = re.compile(r"[^\W\d_]['\w]{2}.*[.!?…](\w.*)$")
_DROP = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff")) | dict.fromkeys(map(ord, "`´’‘ʼʻʽ‛′"), "'")
#: Periods that a token must be seen before a contrast with paragraph ends counts.
CONTRAST_LEAST = 8
_FULL = set("。！？।؟")
_CLOSERS = "»”\"’“)]」』"
_OPENERS = "«“„\"(‘[「『—–-•"


_BLANKS = re.compile(r"\s*")
#: Characters from the next token on, and up to the end of the last one, that features are taken from; longer tokens count by these.
AHEAD, BEHIND = 48, 28


def _script(c: str) -> str:
    if c < "ɐ":
        return "l"
    o = ord(c)
    return "c" if 0x400 <= o < 0x530 else "a" if 0x600 <= o < 0x780 else "h" if 0x900 <= o < 0x980 else "t" if 0xE00 <= o < 0xE80 else "j" if 0x2E80 <= o else "o"


def _shape(token: str) -> str:
    if " " in token:
        return "pair" + token[-1:].isupper() * "U"
    if len(token) == 1:
        return "1d" if token.isdigit() else "1U" if token.isupper() else "1l"
    if "." in token:
        return "dots"
    if token.isdigit():
        return f"d{min(len(token), 3)}"
    if any(c.isdigit() for c in token):
        return "mixed"
    return f"w{min(len(token), 6)}{'U' if token[0].isupper() else ''}"


def _contexts(text: str, lo: int, hi: int, cased: bool):
    """Candidates of text[lo:hi]: (end, feature list, facts) with facts (kind, closing, class of what follows)."""
    quotes = [m.span() for m in _QUOTE.finditer(text, lo, hi)]
    q = 0
    for m in _CLUSTER.finditer(text, lo, hi):
        s, e = m.span()
        marks = m.group()
        first = marks[0]
        after = text[e] if e < hi else ""
        if first == "." and e - s == 1 and after and not after.isspace():
            # A period without a blank: only between two letters before and a capital (or any letter, without case) after.
            if s - 2 < lo or not (text[s - 1].isalpha() and text[s - 2].isalpha() and text[s - 1].islower() and (after.isupper() or not cased and after.isalpha())):
                continue
        while q < len(quotes) and quotes[q][1] < e:
            q += 1
        inside = q < len(quotes) and quotes[q][0] < s and e < quotes[q][1]
        if inside:
            continue
        closing = marks[-1] if marks[-1] in _CLOSERS else ""
        told = ""
        if q < len(quotes) and quotes[q][0] < s and e == quotes[q][1]:
            closing = "q"
            # Speech announced before it needs no attribution after it.
            lead = text[max(lo, quotes[q][0] - 3) : quotes[q][0]].rstrip()
            told = "1" if lead and lead[-1] in ":：,،，、" else "0"
        elif closing in "“\"’" and closing:
            # An opening mark that adjoins the terminator belongs to what follows.
            e -= len(marks) - len(marks.rstrip("“\"’"))
            closing = ""
            after = text[e] if e < hi else ""
        # The next tokens and the last ones, however many blanks lie between.
        begin = _BLANKS.match(text, e, hi).end()
        head, gap = text[begin : min(hi, begin + AHEAD)], begin - e
        if head and head[0] in ",;:)،、，；：%":
            continue
        kind = "f" if first in _FULL else "." if marks.rstrip(_CLOSERS) == "." else "E" if first == "…" else "e" if first == "." else "!"
        last = s
        while last > lo and text[last - 1].isspace():
            last -= 1
        before = text[max(lo, last - BEHIND) : last].rstrip(_CLOSERS)
        tokens = before.translate(_DROP).split()
        token = tokens[-1].lstrip(_OPENERS + "'") if tokens else ""
        glued = _GLUED.match(token) if len(token) > 5 else None
        if glued:
            token = glued.group(1)
        scr = _script(token[-1]) if token else "o"
        if scr == "j":
            token = token[-3:]
        elif len(token) <= 2 and len(tokens) > 1 and len(tokens[-2]) <= 3:
            token = f"{tokens[-2]} {token}"
        dash = ""
        body = head
        while body and body[0] in _OPENERS:
            if body[0] in "—–-•":
                dash = "-"
            body = body[1:].lstrip()
        opener = head[0] if head and head[0] in "«“„\"(‘[「『" else ""
        nxt = body.split(None, 1)[0] if body else ""
        if nxt and _script(nxt[0]) == "j":
            nxt = nxt[:2]
        letter_dot = nxt[1:2] == "." and nxt[:1].isalpha()
        nxt = nxt.translate(_DROP).rstrip(".,!?…;:»”\"")
        follows = "" if not head else "U" if nxt[:1].isupper() else "l" if nxt[:1].islower() else "d" if nxt[:1].isdigit() else "o"
        low = token.lower()
        span = 0
        if closing == "q" or closing == "”":
            stop = _CLUSTER.search(text, e, hi)
            span = min(9, ((stop.start() if stop else hi) - e) // (2 if scr == "j" else 4))
        kq = kind + closing
        case = follows if cased or follows not in ("U", "l") else "a"
        n = nxt.lower()
        yield e, (
            "b",
            "L" + kind + low,
            "S" + _shape(token if cased else low) + kind,
            "K" + kq + dash,
            "N" + n,
            "Q" + kq + dash + n if closing or dash or kind in "eE" else "M" + kind + n,
            "C" + case + dash + opener,
            "D" + kq + case + dash,
            "O" + kq + told if told else "Z" + kind + case if letter_dot else "F" + kq,
            "G" + scr + kq + ("0" if not gap else "1"),
            f"X{kq}{span}" if span or closing == "q" else "Y" + scr + case,
            "T" + _shape(token if cased else low) + case + kind,
        ), (kind, closing, follows, told, low, gap, span)


def _is_cased(text: str) -> bool:
    """Whether capitals mark sentences here: at least one among 200 letters, as a lower-cased text may hold a stray one."""
    letters = sum(map(str.islower, text))
    return sum(map(str.isupper, text)) * 200 > letters


def _paragraphs(text: str, lines: bool):
    """Spans that layout closes: paragraphs, or raw lines."""
    at = 0
    for m in (_LINE if lines else _BLANK).finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _items(text: str, lo: int, hi: int, last: int) -> tuple[list[tuple[int, int]], int]:
    """(start, end of the number) of list items: line-initial numbers that count on from the one before."""
    out = []
    for m in _ITEM.finditer(text, lo, hi):
        number = int(m.group(1))
        if number == 1 or number == last + 1:
            out.append((m.start(), m.end()))
            last = number
    return out, last


class MaxEnt:
    """Logistic weights of string features."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, rows: list[tuple[str, ...]], labels: np.ndarray, sizes: np.ndarray | None = None, rounds: int = 120, penalty: float = 0.3) -> MaxEnt:
        seen: Counter = Counter()
        for row, n in zip(rows, [1] * len(rows) if sizes is None else sizes.tolist()):
            for f in row:
                seen[f] += n
        index = {f: i for i, f in enumerate(f for f, n in seen.items() if n > 1)}
        width = max((len(r) for r in rows), default=1)
        x = np.full((len(rows), width), len(index), np.int64)
        for i, row in enumerate(rows):
            for j, f in enumerate(row):
                x[i, j] = index.get(f, len(index))
        w = np.zeros(len(index) + 1)
        total = np.full(len(index) + 1, 1e-6)
        weight = np.ones(len(rows)) if sizes is None else sizes
        for _ in range(rounds if len(rows) else 0):
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
            g = np.bincount(x.ravel(), np.repeat((p - labels) * weight, width), len(w)) + penalty * w
            g[-1] = 0
            total += g * g
            w -= 0.5 * g / np.sqrt(total)
        return cls({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3})

    def score(self, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])


def examples(text: str, raw: bool) -> tuple[list, list, list, list, list]:
    """What one text teaches: certain candidates with their labels, tokens before periods with what follows them, and unsure candidates."""
    sure, labels, left, left_label, unsure = [], [], [], [], []
    if raw:
        return sure, labels, left, left_label, unsure
    text = text[:FIT_CHARS]
    cased, last = _is_cased(text), 0
    for lo, hi in _paragraphs(text, False):
        found, last = _items(text, lo, hi, last)
        starts = [s for s, _ in found]
        numbers = {e for _, e in found}
        for e, features, (kind, closing, follows, told, low, gap, span) in _contexts(text, lo, hi, cased):
            if e in numbers:
                continue
            final = e >= hi or not follows and not text[e:hi].strip() or any(e <= s <= e + 8 and not text[e:s].strip() for s in starts)
            if final:
                if e >= len(text) and len(text) == FIT_CHARS:
                    continue
                sure.append(tuple(f for f in features if f[0] in "bLSKGF"))
                labels.append(1)
                if kind in ".eE" and not closing:
                    left.append((kind, low))
                    left_label.append(1)
            elif cased and follows == "l":
                sure.append(features)
                labels.append(0)
            elif told and follows == "o":
                # Without case: a short tail after speech that opens a sentence attributes it.
                sure.append(features)
                labels.append(0 if text[e] == "と" or told == "0" and span <= 5 else 1)
            elif kind in "f!" and not closing and (follows != "l" or kind == "f"):
                sure.append(features)
                labels.append(1)
            elif low.isdigit() and follows == "d" and kind == ".":
                sure.append(features)
                labels.append(0)
            elif cased or follows == "o":
                unsure.append((features, kind, closing, low))
                if kind in ".eE" and not closing:
                    left.append((kind, low))
                    left_label.append(0)
    return sure, labels, left, left_label, unsure


def fit_boundaries(texts: list[tuple[str, bool]]) -> MaxEnt:
    """Train on (text, raw lines) pairs; only certain candidates are labels, periods before capitals by contrast."""
    return fit_examples([examples(text, raw) for text, raw in texts])


def fit_examples(taught: list[tuple[list, list, list, list, list]]) -> MaxEnt:
    """The model of the examples of all texts."""
    sure, labels, left, left_label, unsure = ([x for part in taught for x in part[i]] for i in range(5))
    often = Counter(left)
    seen = [_left(k, low, often[k, low] >= CONTRAST_LEAST) for k, low in left]
    known = MaxEnt.fit(seen, np.array(left_label, float), penalty=0.1)
    finals = sorted(known.score(r) for r, y in zip(seen, left_label) if y)
    middle = finals[len(finals) // 2] if finals else 0.0
    for features, kind, closing, low in unsure:
        sure.append(features)
        if kind in ".eE" and not closing:
            labels.append(1.0 if known.score(_left(kind, low, often[kind, low] >= CONTRAST_LEAST)) > middle - 2.0 else 0.0)
        else:
            labels.append(1.0)
    # Every example also without case, for texts that lost it; equal examples count as one of that size.
    changed: dict[str, str] = {}
    sizes: Counter = Counter(zip(sure, labels))
    for (row, label), n in list(sizes.items()):
        for f in row:
            if f not in changed:
                changed[f] = _without_case(f)
        sizes[tuple(changed[f] for f in row), label] += n
    return MaxEnt.fit([row for row, _ in sizes], np.array([label for _, label in sizes], float), np.array(list(sizes.values()), float))


def _left(kind: str, low: str, often: bool) -> tuple[str, ...]:
    """What the contrast sees: the token where it is frequent, and its shape."""
    return ("b", "K" + kind, "S" + _shape(low) + kind, "L" + kind + low if often else "R" + kind)


def _without_case(f: str) -> str:
    if f[0] == "C" and f[1:2] in ("U", "l"):
        return "Ca" + f[2:]
    if f[0] == "D":
        return re.sub("[Ul](-?)$", r"a\1", f)
    if f[0] in "YZ" and f[-1] in "Ul":
        return f[:-1] + "a"
    if f[0] in "ST":
        return f.replace("1U", "1l").replace("U", "", 1) if f[0] == "S" else re.sub(r"[Ul]([.eE!f])$", r"a\1", f.replace("1U", "1l"))
    return f


def segment(text: str, raw_lines: bool, model: MaxEnt) -> list[tuple[int, int]]:
    """Spans of the sentence units of one text."""
    cased, last, spans = _is_cased(text), 0, []
    score = model.score
    for lo, hi in _paragraphs(text, raw_lines):
        if raw_lines:
            cuts = []
        else:
            found, last = _items(text, lo, hi, last)
            numbers = {e for _, e in found}
            cuts = [s for s, _ in found if s > lo]
            for e, features, facts in _contexts(text, lo, hi, cased):
                if e < hi and e not in numbers and score(features) > 0:
                    cuts.append(e)
            if any("฀" <= c <= "๿" for c in text[lo:hi]):
                quotes = [m.span() for m in _QUOTE.finditer(text, lo, hi)]
                for m in _THAI_BLANK.finditer(text, lo, hi):
                    s, e = m.span()
                    if s == lo or s in numbers or _THAI_DIGIT.match(text[s - 1]) or _THAI_DIGIT.match(text[e]) or text[s - 1] in "]:—–-([" or any(a < s < b for a, b in quotes):
                        continue
                    cuts.append(s)
            cuts.sort()
        at = lo
        for c in [*cuts, hi]:
            a, b = at, c
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                spans.append((a, b))
            at = c
    return spans


def sentence_units(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", raw_source: str = "asr_raw_lines", fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, start_pos, end_pos): the sentence units of every document, as code points, end exclusive.

    Units have no outer white space and together hold all other characters. Null ids, null texts and texts of white space
    have no units; texts of any length are cut whole; repeated rows give repeated units; other columns are ignored; an
    empty table gives an empty result. The classifier is fitted on a hashed sample of at most about ``fit_documents`` rows.
    """
    raw = F.coalesce(key(source) == raw_source, F.lit(False))
    rows = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), raw.alias("raw")).dropna()
    sample = bounded_sample(rows, "doc_id", fit_documents).select(F.substring("text", 1, FIT_CHARS).alias("text"), "raw")

    def teach(batches):
        for pdf in batches:
            found = [pickle.dumps(examples(t, r)) for t, r in zip(pdf["text"], pdf["raw"].tolist())]
            yield pd.DataFrame({"at": [xxhash.xxh3_64_intdigest(t) >> 1 for t in pdf["text"]], "taught": found})

    # Examples are found in the cluster; the sample bounds what reaches the driver. Their order is that of a hash, at any partitioning.
    taught = sorted(sample.mapInPandas(teach, "at long, taught binary").collect())
    model = fit_examples([pickle.loads(r["taught"]) for r in taught])
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)

    def cut_batches(batches):
        fitted = MaxEnt(shared.value)
        for pdf in batches:
            ids, starts, ends = [], [], []
            for i, t, r in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["raw"].tolist()):
                spans = segment(t, r, fitted)
                ids += [i] * len(spans)
                starts += [a for a, _ in spans]
                ends += [b for _, b in spans]
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "start_pos": np.array(starts, np.int64), "end_pos": np.array(ends, np.int64)})

    return rows.mapInPandas(cut_batches, "doc_id long, start_pos long, end_pos long")
