"""Languages of documents and of their runs by compression: per-language zstandard raw-content dictionaries.

Text is cut into short blocks of words of one script; a block is compressed with the dictionary of every language written
in that script and costs what it then takes. Blocks whose two best languages are close are rejected and follow their
neighbours; a cheapest path with a price for every change of language turns blocks into runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sozmill.functions.keys import key

# Languages of the corpus and other spellings of their labels.
LANGUAGES = ("uz", "ru", "en", "tr", "kk", "tg", "de", "ar", "hi", "zh", "ja", "th")
LABEL_ALIASES = {
    "uzb": "uz", "rus": "ru", "eng": "en", "tur": "tr", "kaz": "kk", "tgk": "tg", "deu": "de", "ger": "de", "ara": "ar", "hin": "hi",
    "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja", "tha": "th",
}

#: Labelled documents per language, and characters of each, that the dictionaries are built from.
FIT_PER_LABEL = 500
FIT_CHARS = 3_000
DICTIONARY_BYTES = 131_072
LEVEL = 3
#: A script counts for a label if it holds this share of the label's text.
SCRIPT_SHARE = 0.1
#: Share of a minor script's text that its own dictionary must pack better by this share of its bytes.
OWN_WINS = 0.4
OWN_MARGIN = 0.08
#: Words of a block; least bytes, and share of the best cost, between the two best languages of a block that counts.
BLOCK_WORDS = 5
MARGIN_BYTES = 4
MARGIN_SHARE = 0.1
#: A block of at least so many words is cut into shorter ones.
LONG_WORDS = 8
#: A block cut from a longer one is looked at word by word unless its best language is ahead by this share of the next one's cost.
CLEAR_SHARE = 0.3
#: Words of the window that names the languages within such blocks, and words that are compressed in one go there.
WINDOW_WORDS = 4
STRETCH_WORDS = 18
#: Bytes by which a word beside a run that is just too short may cost more in the run's language and still be its.
LEVEL_BYTES = 1
#: Bytes that a change of language costs, within a sentence and between two.
SWITCH_INSIDE = 5
SWITCH_BETWEEN = 9
#: Words of the shortest run that isn't a whole sentence.
RUN_WORDS = 5

#: Language of a text that can't be told.
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_APOSTROPHES = "`´’‘ʼʻʽ‛′"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_TAG = re.compile(r"\[[^\[\]\n]*\]")
_SENTENCE = re.compile(r"[.!?…](?=[\s»”\"’“)\]']|$)[.!?…»”\"’“)\]']*|[。！？।؟]+[」』”»]*|\n[^\S\n]*\n")
_PIECE = re.compile(
    r"(?P<l>[a-zß-öø-ɏ']+(?:[\s,;:–—-]+[a-zß-öø-ɏ']+)*)|(?P<c>[Ѐ-ԯ']+(?:[\s,;:–—-]+[Ѐ-ԯ']+)*)|(?P<j>[぀-ヿㇰ-ㇿ㐀-鿿\uf900-\ufaffー々〆][぀-ヿㇰ-ㇿ㐀-鿿\uf900-\ufaffー々〆，、：；\s]*)"
    r"|(?P<a>[؀-ۿݐ-ݿ]+(?:[\s،؛:–—-]+[؀-ۿݐ-ݿ]+)*)|(?P<h>[ऀ-ॣॱ-ॿ]+(?:[\s,;:–—-]+[ऀ-ॣॱ-ॿ]+)*)|(?P<t>[ก-๎]+(?:\s+[ก-๎]+)*)"
)
_BETWEEN = re.compile(r"[\s,;:،؛–—-]+")
_SPACED = set("lcah")
_CHARS_PER_WORD = {"j": 2, "t": 4}
_SINGLE = {"a", "h", "t", "j"}


def label_language(label: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Language of a label: two or three letters, any case, script and region suffixes dropped; null where it names none of ``languages``."""
    head = F.substring_index(F.regexp_replace(key(label), "_", "-"), "-", 1)
    mapping = F.create_map(*[x for pair in {**{k: k for k in languages}, **LABEL_ALIASES}.items() for x in map(F.lit, pair)])
    return mapping[F.coalesce(head, F.lit(""))]


def _shorter(block: tuple[str, str, int, bool, bool]) -> list[tuple[str, str, int, bool, bool]]:
    """A block of many words as blocks of about BLOCK_WORDS."""
    script, body, n, fresh, whole = block
    words = body.split()
    parts = max(1, round(n / BLOCK_WORDS))
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(script, " " + " ".join(words[a:b]) + " ", b - a, fresh and not a, False) for a, b in zip(cuts, cuts[1:])]


def blocks(text: str) -> list[tuple[str, str, int, bool, bool]]:
    """Blocks of a text in order: (script, normalised text, words, starts a sentence, is a whole sentence).

    A block is what a sentence has of one script in a row.
    """
    low = unicodedata.normalize("NFC", text).lower()
    if not low.isascii():
        # One scan per character is faster than a translation table here.
        for c in _APOSTROPHES:
            low = low.replace(c, "'")
        for c in _INVISIBLE:
            low = low.replace(c, "")
    else:
        low = low.replace("`", "'")
    if "[" in low:
        low = _TAG.sub(" ", low)
    out = []
    at = 0
    for m in [*_SENTENCE.finditer(low), None]:
        sentence = low[at : m.start() if m else len(low)]
        at = m.end() if m else at
        pieces = []
        for p in _PIECE.finditer(sentence):
            script = p.lastgroup
            body = p.group()
            if script in _SPACED:
                words = [w for w in _BETWEEN.split(body) if w.strip("'")]
                if not words:
                    continue
                if pieces and pieces[-1][0] == script:
                    pieces[-1][1].extend(words)
                else:
                    pieces.append((script, words))
            else:
                pieces.append((script, [re.sub(r"[，、：；\s]+", "", body)]))
        fresh = True
        # Pieces of one script joined over digits, as 50 foiz; a lone piece is the whole sentence.
        for script, words in pieces:
            whole = len(pieces) == 1
            if script in _SPACED:
                out.append((script, " " + " ".join(words) + " ", len(words), fresh, whole))
                fresh = False
            else:
                body = words[0]
                out.append((script, body, max(1, len(body) // _CHARS_PER_WORD[script]), fresh, whole))
                fresh = False
    return out


class Compressor:
    """Compressed sizes of blocks by (script, language)."""

    def __init__(self, dictionaries: dict[tuple[str, str], bytes]) -> None:
        import zstandard as zstd

        options = zstd.ZstdCompressionParameters.from_level(LEVEL, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.by_script: dict[str, list] = defaultdict(list)
        for (script, language), raw in sorted(dictionaries.items()):
            content = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=options)
            self.by_script[script].append((language, zstd.ZstdCompressor(dict_data=content, compression_params=options).compress))
        for of_script in self.by_script.values():
            # Equal costs go to the language that comes first.
            of_script.sort(key=lambda x: _rank(x[0]))

    def costs(self, script: str, text: str) -> tuple[dict[str, int], int]:
        raw = text.encode()
        return {language: len(compress(raw)) for language, compress in self.by_script.get(script, ())}, len(raw)


def _by_word(stretch: list[tuple[str, str, int, bool, bool]], compressor: Compressor) -> tuple[list, list, set[str]]:
    """Blocks of one word in place of successive blocks of a sentence, what each word adds to the size in every language, and
    the languages that are certain in some window."""
    script, fresh = stretch[0][0], stretch[0][3]
    words = [w for block in stretch for w in block[1].split()]
    added: dict[str, list[int]] = {}
    for language, compress in compressor.by_script[script]:
        sizes = [len(compress(b" "))]
        for k in range(1, len(words) + 1):
            sizes.append(len(compress(f" {' '.join(words[:k])} ".encode())))
        added[language] = [b - a for a, b in zip(sizes, sizes[1:])]
    sure = set()
    for k in range(max(1, len(words) - WINDOW_WORDS + 1)):
        first, second = sorted((sum(v[k : k + WINDOW_WORDS]), _rank(language), language) for language, v in added.items())[:2]
        if second[0] - first[0] >= max(MARGIN_BYTES, MARGIN_SHARE * second[0]):
            sure.add(first[2])
    found, costs = [], []
    for k, word in enumerate(words):
        c = {language: v[k] for language, v in added.items()}
        low, next_ = sorted(c.values())[:2]
        raw = len(word.encode()) + 1
        found.append((script, f" {word} ", 1, fresh and not k, False))
        costs.append((c, raw + 4, next_ - low))
    return found, costs, sure


def _runs(path: list[str], found: list, whole: list[tuple[int, int]]) -> list[list]:
    """Runs [language, first block, last block + 1, words] of a path, those too short given to a neighbour."""
    runs: list[list] = []
    for i, language in enumerate(path):
        if runs and runs[-1][0] == language:
            runs[-1][2] = i + 1
            runs[-1][3] += found[i][2]
        else:
            runs.append([language, i, i + 1, found[i][2]])
    sentences = dict(whole)

    def stands(run) -> bool:
        if run[3] >= RUN_WORDS:
            return True
        # A whole sentence inside the run: it begins with a block and ends with the run or before.
        return any(run[1] <= i and end <= run[2] for i, end in sentences.items() if run[1] <= i < run[2])

    while len(runs) > 1:
        weak = [k for k, run in enumerate(runs) if not stands(run)]
        if not weak:
            break
        k = min(weak, key=lambda k: runs[k][3])
        runs[k][0] = runs[k - 1][0] if k else runs[1][0]
        merged: list[list] = []
        for run in runs:
            if merged and merged[-1][0] == run[0]:
                merged[-1][2] = run[2]
                merged[-1][3] += run[3]
            else:
                merged.append(run)
        runs = merged
    return runs


def language_runs(text: str, compressor: Compressor, default: str | None = None) -> list[tuple[str, float, int]]:
    """Runs (language, confidence, words) of a text; without any certain block the cheapest language, or ``default``.

    A text whose letters are of no known script, or whose blocks tell nothing, is one run of ``und`` with confidence 0.
    """
    found: list[tuple[str, str, int, bool, bool]] = []
    costs, sure = [], []
    languages = set()
    raws: list[int] = []

    def keep(block: tuple[str, str, int, bool, bool], c: dict[str, int], raw: int) -> None:
        script, _, n, _, whole = block
        found.append(block)
        raws.append(raw)
        single = script in _SINGLE
        good, gap, best = False, 0, None
        if c:
            ordered = sorted(c.values())
            second = ordered[1] if len(ordered) > 1 else raw
            gap = second - ordered[0]
            good = len(c) == 1 or single or n >= 3 and gap >= max(MARGIN_BYTES, MARGIN_SHARE * second)
            if good:
                best = min(c, key=c.get)
                languages.add(best)
        sure.append(good)
        # A whole sentence in a script of its own is a run however short it is.
        costs.append((c, raw + 4 + (4 * SWITCH_INSIDE if whole and single else 0), gap))

    def keep_words(stretch: list[tuple[str, str, int, bool, bool]]) -> None:
        words, sizes, certain = _by_word(stretch, compressor)
        found.extend(words)
        costs.extend(sizes)
        sure.extend([bool(certain)] * len(words))
        languages.update(certain)
        raws.extend(len(word[1].encode()) - 1 for word in words)

    def keep_parts(block: tuple[str, str, int, bool, bool]) -> None:
        """A long block in shorter ones, those that aren't clear word by word."""
        stretch: list[tuple[str, str, int, bool, bool]] = []
        for part in _shorter(block):
            c, raw = compressor.costs(part[0], part[1])
            low, next_ = sorted(c.values())[:2]
            unclear = next_ - low < CLEAR_SHARE * next_
            if stretch and (not unclear or sum(b[2] for b in stretch) + part[2] > STRETCH_WORDS):
                keep_words(stretch)
                stretch = []
            if unclear:
                stretch.append(part)
            else:
                keep(part, c, raw)
        if stretch:
            keep_words(stretch)

    for block in blocks(text):
        script, body, n, *_ = block
        if n >= LONG_WORDS and script in _SPACED and len(compressor.by_script.get(script, ())) > 1:
            # Perhaps of several languages: look at it in shorter blocks.
            keep_parts(block)
        else:
            keep(block, *compressor.costs(script, body))
    if not found:
        # Letters, but none of a script that any dictionary or pattern knows.
        others = len(_LETTERS.findall(text))
        return [(UNKNOWN, 0.0, others)] if others else []
    if not languages:
        n = sum(f[2] for f in found)
        total: dict[str, int] = defaultdict(int)
        for (c, _, _), raw in zip(costs, raws):
            for language, size in c.items():
                total[language] += size - raw
        if default:
            return [(default, 0.5, n)]
        if not total:
            return [(UNKNOWN, 0.0, n)]
        ordered = sorted(total.items(), key=lambda x: (x[1], x[0]))
        gap = (ordered[1][1] if len(ordered) > 1 else 0) - ordered[0][1]
        # Rejected in every block: the cheapest language if the whole text tells any, with the little confidence it deserves.
        if not gap:
            return [(UNKNOWN, 0.0, n)]
        return [(ordered[0][0], float(round(1 / (1 + np.exp(-gap / 8)), 4)), n)]
    path, runs = _cut(found, costs, sure, languages)
    beside = _beside_changes(path, found)
    if beside:
        # The borders of a change to the word: the blocks on both sides again, word by word.
        before = found, costs, sure
        found, costs, sure = [], [], []
        stretch: list[tuple[str, str, int, bool, bool]] = []
        for i, (block, cost, good) in enumerate(zip(*before)):
            again = i in beside or block[2] == 1 and bool(stretch) and block[0] == stretch[0][0]
            if stretch and (not again or block[3] or sum(b[2] for b in stretch) + block[2] > STRETCH_WORDS):
                keep_words(stretch)
                stretch = []
            if again:
                stretch.append(block)
            else:
                found.append(block)
                costs.append(cost)
                sure.append(good)
        if stretch:
            keep_words(stretch)
        _, runs = _cut(found, costs, sure, languages)
    out = []
    for language, a, b, n in runs:
        margin = 0.0
        for i in range(a, b):
            if sure[i]:
                c, other, gap = costs[i]
                margin += gap if c.get(language, other) <= min(c.values()) else -gap
        out.append((language, float(round(1 / (1 + np.exp(-min(max(margin, -200), 200) / 8)), 4)), n))
    return out


def _cut(found, costs, sure, languages: set[str]) -> tuple[list[str], list[list]]:
    """The cheapest path over blocks and its runs."""
    path = _cheapest(found, costs, sure, sorted(languages, key=_rank)) if len(languages) > 1 else [*languages] * len(found)
    _level(path, found, costs)
    whole, begin = [], 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i][3]:
            # Short sentences count as a run only where their script or margin is certain.
            if all(sure[begin:i]):
                whole.append((begin, i))
            begin = i
    return path, _runs(path, found, whole)


def _level(path: list[str], found, costs) -> None:
    """A run just too short takes the words beside it that cost about as little in its language, until it is long enough."""
    borders = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
    for begin, end in zip(borders, borders[1:]):
        n, language = sum(block[2] for block in found[begin:end]), path[begin]
        if not RUN_WORDS - 2 <= n < RUN_WORDS:
            continue
        for at, step in ((begin - 1, -1), (end, 1)):
            while n < RUN_WORDS and 0 <= at < len(path) and found[at][2] == 1 and not found[at + (step < 0)][3]:
                c, other, _ = costs[at]
                if c.get(language, other) > c.get(path[at], other) + LEVEL_BYTES:
                    break
                path[at] = language
                n += 1
                at += step


def _beside_changes(path: list[str], found: list) -> set[int]:
    """Blocks beside a change of language within a sentence and script; empty if none of them has several words."""
    beside = set()
    for i in range(1, len(path)):
        if path[i] != path[i - 1] and not found[i][3] and found[i][0] == found[i - 1][0] and found[i][0] in _SPACED:
            beside |= {i - 1, i}
    return beside if any(found[i][2] > 1 for i in beside) else set()


def _rank(language: str) -> tuple[bool, str]:
    """Order among equals: text without kana is Chinese sooner than Japanese."""
    return language == "ja", language


def _cheapest(found, costs, sure, languages: list[str]) -> list[str]:
    """Cheapest path of languages over blocks; rejected blocks cost nothing in any language."""
    best = [0.0] * len(languages)
    back = []
    for i, (block, (c, other, _)) in enumerate(zip(found, costs)):
        switch = SWITCH_BETWEEN if block[3] else SWITCH_INSIDE
        low = min(range(len(languages)), key=lambda k: best[k])
        step, row = [], []
        for k, language in enumerate(languages):
            if best[k] <= best[low] + switch or not i:
                row.append(k)
                value = best[k]
            else:
                row.append(low)
                value = best[low] + switch
            step.append(value + (c.get(language, other) if sure[i] else 0))
        back.append(row)
        best = step
    k = min(range(len(languages)), key=lambda k: best[k])
    path = []
    for row in reversed(back):
        path.append(languages[k])
        k = row[k]
    return path[::-1]


def _content(bodies: list[str], most: int = DICTIONARY_BYTES) -> bytes:
    """Distinct texts end to end, the last ``most`` bytes, cut at a character."""
    return " ".join(dict.fromkeys(bodies)).encode()[-most:].decode("utf-8", "ignore").encode()


def fit_dictionaries(labelled: list[tuple[str, str]], rounds: int = 2) -> dict[tuple[str, str], bytes]:
    """Dictionaries by (script, language) from (label, text) rows of which some are wrong.

    A label's scripts below a share are dropped. Then two halves judge each other: text whose cheapest language by the other
    half's dictionaries isn't its label is taken out, and the dictionaries are built again.
    """
    parts: dict[tuple[str, str], list[tuple[int, str]]] = defaultdict(list)
    for number, (label, text) in enumerate(labelled):
        grouped: list[tuple[str, list[str]]] = []
        for script, body, *_ in [b for block in blocks(text) for b in (_shorter(block) if block[0] in _SPACED else [block])]:
            if grouped and grouped[-1][0] == script and len(grouped[-1][1]) < 4:
                grouped[-1][1].append(body)
            else:
                grouped.append((script, [body]))
        for script, bodies in grouped:
            parts[script, label].append((number % 2, "".join(bodies).replace("  ", " ")))
    size = {k: sum(len(t) for _, t in v) for k, v in parts.items()}
    of_label: dict[str, int] = defaultdict(int)
    for (_, label), n in size.items():
        of_label[label] += n
    parts = {k: v for k, v in parts.items() if size[k] >= SCRIPT_SHARE * of_label[k[1]]}
    main = {k for k in parts if size[k] >= 0.5 * of_label[k[1]]}
    parts = {k: v for k, v in parts.items() if k in main or _own(k, parts, size)}
    kept = parts
    for _ in range(rounds):
        judges = [Compressor({k: raw for k, v in kept.items() if (raw := _content([t for fold, t in v if fold != half]))}) for half in (0, 1)]
        kept = {k: [(fold, t) for fold, t in v if _cheapest_language(judges[fold], k[0], t) in (None, k[1])] for k, v in parts.items()}
        # A minor script of which most was taken out isn't one of the language; its main script always stays.
        kept = {k: v if 2 * sum(len(t) for _, t in v) >= size[k] else parts[k] for k, v in kept.items() if k in main or 2 * sum(len(t) for _, t in v) >= size[k]}
        parts = {k: v for k, v in parts.items() if k in kept}
    return {k: raw for k, v in kept.items() if (raw := _content([t for _, t in v]))}


def _cheapest_language(compressor: Compressor, script: str, text: str) -> str | None:
    costs, _ = compressor.costs(script, text)
    return min(costs, key=lambda x: (costs[x], x)) if costs else None


def _own(part: tuple[str, str], parts: dict, size: dict) -> bool:
    """Whether a label's minor script holds text of its own, rather than wrongly labelled text of a language at home there.

    One half's dictionaries, equally large, are held against each other on the other half. Text of its own wins
    clearly, text of a language at home there about equals that language's.
    """
    script = part[0]
    homes = [k for k in parts if k[0] == script and k != part and size[k] > size[part]]
    half = max(1000, min(size[part] // 2, DICTIONARY_BYTES // 2))
    compressor = Compressor({k: _content([t for fold, t in parts[k] if not fold], half) for k in [part, *homes]})
    held = [t for fold, t in parts[part] if fold][:500]
    return _clear_wins(compressor, part, held) > OWN_WINS * len(held)


def _clear_wins(compressor: Compressor, part: tuple[str, str], texts: list[str]) -> int:
    """Texts that the part's own dictionary packs clearly better than any other."""
    won = 0
    for text in texts:
        costs, raw = compressor.costs(part[0], text)
        own = costs.pop(part[1], raw)
        won += own + OWN_MARGIN * raw <= min(costs.values(), default=raw)
    return won


def fit_on(documents: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", languages: tuple[str, ...] = LANGUAGES) -> dict[tuple[str, str], bytes]:
    """Dictionaries from a hashed sample of at most about FIT_PER_LABEL labelled documents of each of ``languages``."""
    rows = documents.select(label_language(F.col(label), languages).alias("label"), F.col(text).alias("text"), F.col(id_col).alias("id")).where("label is not null and text is not null and text <> ''")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(min(1.0, FIT_PER_LABEL / n) * (1 << 30)))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share[F.col("label")]).limit(2 * FIT_PER_LABEL * len(languages))
    sample = chosen.select("label", F.substring("text", 1, FIT_CHARS).alias("text"), "id").collect()
    return fit_dictionaries([(r["label"], r["text"]) for r in sorted(sample, key=lambda r: (r["label"], str(r["id"])))])


RUNS = "record_kind string, record_key string, label string, part_no int, parts int, lang string, confidence double, words int"


def identify(records: DataFrame, dictionaries: dict[tuple[str, str], bytes], default: str | None = None) -> DataFrame:
    """One row per language run of (record_kind, record_key, label, text): part_no, parts, lang, confidence, words.

    Null texts and texts without letters have no run, texts of no known script one run of ``und``; texts of any length are read whole; repeated rows
    give repeated runs; other columns are ignored; an empty table gives an empty result. Without dictionaries nothing is
    identified. ``default`` is the language of texts of which no block is certain.
    """
    shared = records.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        compressor = Compressor(shared.value)
        for pdf in batches:
            rows = []
            for kind, k, label, text in zip(pdf["record_kind"], pdf["record_key"], pdf["label"], pdf["text"]):
                runs = language_runs(text, compressor, default) if shared.value else []
                for i, (language, confidence, words) in enumerate(runs):
                    rows.append((kind, k, label, i + 1, len(runs), language, confidence, words))
            yield pd.DataFrame(rows, columns=["record_kind", "record_key", "label", "part_no", "parts", "lang", "confidence", "words"])

    return records.select("record_kind", "record_key", "label", "text").where("text is not null and record_key is not null").mapInPandas(run, RUNS)
