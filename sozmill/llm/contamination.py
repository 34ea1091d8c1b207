"""Same or near-same records across splits, found by passages that must occur unchanged.

Two texts of n and m folded words match if their word edit distance is at most max(n, m) // 6. A held-out text that may
differ by k words is cut into k + 1 passages, one of which must then occur unchanged, so passages lose no pair. Training
texts are never sent to the passages: a filter of bounded size says in the scan which of a text's windows a passage may be,
and only these go on, as a row of numbers each (hash, text, place, set of words), to be joined by hash. What length, places
and words in common allow to be near is a candidate, and only texts of candidates are fetched and compared word by word.
A passage that many held-out texts share is replaced by its combinations with parts of the rest, so a common opening is no
product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozmill.functions.keys import key, latest, split_name
from sozmill.llm.coded import Coder, mixed, passage_filter, runs, slices, window_hashes
from sozmill.llm.fold import words
from sozmill.session import cut, cut_to_table

MIN_WORDS = 8
ONE_IN = 6
#: Passages of one shard, and words of the training texts that a task looks up at once.
PASSAGES_PER_SHARD = 100_000
WORDS_PER_TASK = 1_000_000
#: Edits of a stretch of a long text within which its passages are looked for.
STRETCH_EDITS = 32
#: Words a passage may have: a fifth of the stretch's words are edits.
LENGTHS = (3, 4, 5, 6)
#: A passage counts as common above this many held-out texts, and above this part of all passages.
COMMON_TEXTS = 200
COMMON_ONE_IN = 50_000

_FOLDED = "id string, split string, source string, class binary, n int, text string"
_PATTERN = "key long, held long, n int, at int, length int, other int, size int, sig0 long, sig1 long"
_HIT = "key long, train long, m int, here int, place int, own0 long, own1 long"
_MATCHED = "train_class binary, held_class binary, edits int, covered int, held_words int"
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def max_edits(n: int) -> int:
    """Most word edits of a text of n words and any partner of m: m - n <= m // ONE_IN holds up to m // ONE_IN = n // (ONE_IN - 1)."""
    return n // (ONE_IN - 1)


def passages(n: int) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(begin, end, edits, passages) of the stretches of a text of n words.

    The text's edits can't exceed the stretch's number in all of them; within such a stretch one passage is unchanged.
    """
    k = max_edits(n)
    stretches = k // STRETCH_EDITS + 1
    bounds = [n * i // stretches for i in range(stretches + 1)]
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        parts = k // stretches + 1
        cuts = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
        out.append((lo, hi, parts - 1, list(zip(cuts, cuts[1:]))))
    return out


def others(lo: int, hi: int, edits: int, a: int, b: int, common: np.ndarray) -> list[tuple[int, int]]:
    """(start, words 1 or 2) within edits + 1 disjoint parts of a stretch outside [a, b), one of which is unchanged.

    Words of common pairs are left out (``common`` says of each word whether it is in one), unless the rest is too short.
    """
    want = edits + 1
    outside = [i for i in range(lo, hi) if not a <= i < b]
    free = [i for i in outside if not common[i]]
    if len(free) < want:
        free = outside
    ends = [k for k in range(len(free)) if k + 1 == len(free) or free[k + 1] != free[k] + 1]
    pieces = [(free[k0], free[k1] + 1) for k0, k1 in zip([0, *(k + 1 for k in ends)], ends)]
    size = len(free) // want
    while sum((y - x) // size for x, y in pieces) < want:
        size -= 1
    return [(x + size * i, min(size, 2)) for x, y in pieces for i in range((y - x) // size)][:want]


def _fold_batches(batches):
    for pdf in batches:
        rows = []
        for i, split, source, text in zip(pdf["id"], pdf["split"], pdf["source"], pdf["text"]):
            w = words(text)
            if len(w) < MIN_WORDS:
                continue
            folded = " ".join(w)
            rows.append((i, split, source, xxhash.xxh3_128_digest(folded), len(w), folded))
        yield pd.DataFrame(rows, columns=["id", "split", "source", "class", "n", "text"])


def _signatures(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128-bit sets of words, as two numbers, of the texts that begin there in ``flat``."""
    h = (flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    bit = np.uint64(1) << (h & np.uint64(63))
    sides = [np.bitwise_or.reduceat(np.where(side, bit, np.uint64(0)), begin) for side in (h < 64, h >= 64)]
    return np.stack(sides, axis=1)


def _flat(texts: pd.Series, coder: Coder) -> np.ndarray:
    """Numbers of the words of folded texts end to end."""
    return coder(" ".join(texts).split(" ")) if len(texts) else np.empty(0, np.uint64)


def _isin(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys if len(ordered) else np.zeros(len(keys), bool)


def _joint(passage: np.ndarray, part: np.ndarray, words: int) -> np.ndarray:
    """Key of a common passage together with one or two words outside it."""
    return mixed(passage * _PAIR + np.uint64(words), part)


def _patterns(common: np.ndarray, pairs: np.ndarray):
    """Held-out classes as passages; a common passage once with each of the parts outside it."""

    def run(batches):
        coder = Coder()
        for pdf in (part for whole in batches for part in slices(whole, whole["n"].to_numpy())):
            rows = []
            for held, text in zip(pdf["short"], pdf["text"]):
                w = coder(text.split(" "))
                two, often = window_hashes(w, 2), np.zeros(len(w), bool)
                sig = _signatures(w, np.zeros(1, np.int64))[0].view(np.int64).tolist()
                if len(common):
                    at = _isin(two, pairs)
                    often[:-1] |= at
                    often[1:] |= at
                for lo, hi, edits, cuts in passages(len(w)):
                    for a, b in cuts:
                        passage = window_hashes(w[a:b], b - a)
                        rest = [held, len(w), a, b - a]
                        if _isin(passage, common)[0]:
                            for other, size in others(lo, hi, edits, a, b, often):
                                joint = _joint(passage, (two if size == 2 else w)[other : other + 1], size)
                                rows.append((int(joint.view(np.int64)[0]), *rest, other, size, *sig))
                        else:
                            rows.append((int(passage.view(np.int64)[0]), *rest, -1, 0, *sig))
            yield pd.DataFrame(rows, columns=["key", "held", "n", "at", "length", "other", "size", "sig0", "sig1"])

    return run


def _hits(known, common: np.ndarray):
    """Windows of training texts that a passage may be; a task looks copies up once while its memory of texts lasts."""

    def run(batches):
        passes, sent, coder = known.value, set(), Coder()
        for whole in batches:
            fresh = [c not in sent and not sent.add(c) for c in whole["short"]]
            if len(sent) > 500_000:
                sent.clear()
            whole = whole[fresh]
            for pdf in slices(whole, whole["n"].to_numpy(), WORDS_PER_TASK):
                n, train = pdf["n"].to_numpy(np.int64), pdf["short"].to_numpy(np.int64)
                flat = _flat(pdf["text"], coder)
                start = np.cumsum(n) - n
                row = np.repeat(np.arange(len(n)), n)
                pairs = window_hashes(flat, 2)
                sig = _signatures(flat, start).view(np.int64)

                def hits(r: np.ndarray, keys: np.ndarray, here: np.ndarray, place: np.ndarray) -> pd.DataFrame:
                    good = passes(keys, n[r], here, max_edits(n[r]))
                    r, keys, here, place = r[good], keys[good], here[good], place[good]
                    return pd.DataFrame({"key": keys.view(np.int64), "train": train[r], "m": n[r].astype(np.int32), "here": here.astype(np.int32), "place": place.astype(np.int32), "own0": sig[r, 0], "own1": sig[r, 1]})

                for size in LENGTHS:
                    h = window_hashes(flat, size)
                    inside = np.flatnonzero(row[: len(h)] == row[len(row) - len(h) :])
                    r = row[inside]
                    yield hits(r, h[inside], inside - start[r], np.full(len(r), -1))
                    hit = inside[_isin(h[inside], common)]
                    for part in _parts(n[row[hit]]):
                        p = hit[part]
                        at, owner = runs(start[row[p]], n[row[p]])
                        r, p = row[p][owner], p[owner]
                        for words_, other in ((1, flat[at]), (2, np.append(pairs, pairs[-1:])[at])):
                            yield hits(r, _joint(h[p], other, words_), p - start[r], at - start[r])

    return run


def _parts(many: np.ndarray, most: int = 500_000) -> list[np.ndarray]:
    """Places of ``many`` in parts whose numbers add up to about ``most``, those of nothing left out."""
    some = np.flatnonzero(many)
    return np.split(some, np.flatnonzero(np.diff(np.cumsum(many[some]) // most)) + 1) if len(some) else []


def _near():
    """What length, places and words in common allow to be near, of a hit and a passage with the same hash."""
    most = F.expr(f"greatest(m, n) div {ONE_IN}")
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    placed = F.when(F.col("other") < 0, F.col("place") < 0).otherwise((F.col("place") >= 0) & (F.abs(F.expr("(place - here) - (other - at)")) <= most))
    missing, added = apart("sig0", "own0") + apart("sig1", "own1"), apart("own0", "sig0") + apart("own1", "sig1")
    return (F.abs(F.expr("m - n")) <= most) & (F.abs(F.expr("here - at")) <= most) & placed & (missing <= most) & (added <= most)


def _wanted(known):
    """Rows of texts whose number a filter of candidates has."""

    def run(batches):
        passes = known.value
        for batch in batches:
            keys = batch.column("short").to_numpy().view(np.uint64)
            none = np.zeros(len(keys), np.int64)
            yield batch.take(pa.array(passes(keys, batch.column("n").to_numpy().astype(np.int64), none, none)))

    return run


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance, or most + 1 if it is greater; common ends are dropped and the band doubles until it holds the path."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    size = min(n, m)
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:size] != b[::-1][:size])
    tail = int(differ[0]) if len(differ) else size
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    band = max(1, abs(n - m))
    while True:
        band = min(band, most)
        found = _banded(a, b, band)
        if found <= band or band == most:
            return min(found, most + 1)
        band *= 2


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Distance within the diagonals -band .. band; anything above ``band`` says only that it is greater."""
    n, m, width = len(a), len(b), 2 * band + 1
    far = n + m + 1
    steps = np.arange(width)
    # Cell d of row i is column i + d - band; the band beyond b's ends never matches and is too far.
    padded = np.concatenate([np.zeros(band, b.dtype), b, np.zeros(band + max(0, n - m) + 1, b.dtype)])
    row = np.where(steps >= band, steps - band, far)
    row[band + m + 1 :] = far
    for i in range(1, n + 1):
        fresh = row + (padded[i - 1 : i - 1 + width] != a[i - 1])
        np.minimum(fresh[:-1], row[1:] + 1, out=fresh[:-1])
        first = band - i
        if first >= 0:
            fresh[:first] = far
            fresh[first] = i
        if i + band > m:
            fresh[m - i + band + 1 :] = far
        row = np.minimum.accumulate(fresh - steps) + steps
        if row.min() > band:
            return band + 1
    return int(row[m - n + band])


def _verify(batches):
    """Exact word distance of candidates, and the held-out words inside unchanged passages."""
    for pdf in batches:
        rows = []
        for train, held, text, other, spans in zip(pdf["train_class"], pdf["held_class"], pdf["train_text"], pdf["text"], pdf["spans"]):
            # The pair's own words by number, so words are compared as they are.
            numbers: dict[str, int] = {}
            a, b = (np.array([numbers.setdefault(w, len(numbers) + 1) for w in t.split(" ")], np.int64) for t in (text, other))
            limit = max(len(a), len(b)) // ONE_IN
            edits = edit_distance(a, b, limit)
            if edits <= limit:
                covered, reach = 0, 0
                for x, y in sorted((s // 8, s // 8 + s % 8) for s in spans):
                    covered += max(0, y - max(x, reach))
                    reach = max(reach, y)
                rows.append((train, held, edits, covered, len(b)))
        yield pd.DataFrame(rows, columns=["train_class", "held_class", "edits", "covered", "held_words"])


def current_utterances(segments: DataFrame, splits: DataFrame) -> DataFrame:
    """Latest version of every segment with each split it is assigned to."""
    text = latest(segments, "id", "written_at", {"text": F.col("text"), "source": key("source")}).where(F.col("text").isNotNull())
    named = splits.select(key("id").alias("id"), split_name("split").alias("split")).dropna().distinct()
    return text.join(named, "id").select("id", "split", "source", "text")


def _word_pairs(batches):
    coder = Coder()
    for pdf in batches:
        found = [np.unique(window_hashes(coder(text.split(" ")), 2)) for text in pdf["text"]]
        yield pd.DataFrame({"pair": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)})


def _common(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Sorted hashes that more than COMMON_TEXTS rows and one in COMMON_ONE_IN have, hence at most that many; rows in all."""
    counted = cut(hashes.groupBy(column).agg(F.count(F.lit(1)).alias("texts")))
    total = counted.agg(F.sum("texts").alias("n")).first()["n"] or 0
    often = counted.where(F.col("texts") > max(COMMON_TEXTS, total // COMMON_ONE_IN)).select(column).collect()
    return np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)), total


def routed_texts(folded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held classes, their patterns, hits of training texts); a class goes by the number ``short`` until texts are compared.

    Two classes of one number are no harm: both texts are compared then. A pattern's shard says which share of about
    PASSAGES_PER_SHARD patterns it is of; each is one block, since the join needs no copies of patterns.
    """
    spark = folded.sparkSession
    held = cut_to_table(folded.where("split <> 'train'").groupBy("class").agg(F.first("n").alias("n"), F.first("text").alias("text")).withColumn("short", F.xxhash64("class")), freed=True)
    none = np.empty(0, np.uint64)
    patterns = cut_to_table(held.mapInPandas(_patterns(none, none), _PATTERN))
    common, count = _common(patterns, "key")
    if len(common):
        patterns = cut_to_table(held.mapInPandas(_patterns(common, _common(held.mapInPandas(_word_pairs, "pair long"), "pair")[0]), _PATTERN))
        count = patterns.count()
    known = spark.sparkContext.broadcast(passage_filter(patterns, count))
    hits = folded.where("split = 'train'").select(F.xxhash64("class").alias("short"), "n", "text").mapInPandas(_hits(known, common), _HIT)
    return held, patterns.withColumns({"shard": F.pmod("key", F.lit(count // PASSAGES_PER_SHARD + 1)).cast("int"), "block": F.lit(0)}), hits


def cross_split_overlaps(utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and class pairs of all overlaps between train and val or test.

    ``utterances`` has id, split (train, val, test), source and text; other columns are ignored. Null texts and texts
    below eight folded words match nothing; very long texts are compared whole; exact copies share a class and are
    compared once. Returns (members: id, split, source, class) and (pairs: train_class, held_class, edits, covered,
    held_words), ``covered`` being the held-out words inside unchanged passages. Empty inputs give empty results.
    """
    folded = cut_to_table(utterances.select("id", "split", "source", "text").mapInPandas(_fold_batches, _FOLDED), freed=True)
    members = folded.select("id", "split", "source", "class")
    held, patterns, hits = routed_texts(folded)
    # Unchanged stretches as eight times their first word and their words, of which there are less than eight.
    stretches = F.concat(F.collect_set(F.expr("at * 8L + length")), F.collect_set(F.expr("if(other < 0, null, other * 8L + size)")))
    met = hits.join(patterns, (hits["key"] == patterns["key"]) & _near()).groupBy("train", "held").agg(stretches.alias("spans"), F.first("m").alias("m"))
    met = cut_to_table(met, freed=True)
    wanted = met.select(F.col("train").alias("key"), F.col("m").alias("n"), F.lit(0).alias("at"))
    known = folded.sparkSession.sparkContext.broadcast(passage_filter(wanted, met.count()))
    texts = folded.where("split = 'train'").select(F.xxhash64("class").alias("short"), "class", "n", "text")
    texts = texts.mapInArrow(_wanted(known), texts.schema).groupBy("short", "class").agg(F.first("text").alias("train_text"))
    texts = texts.select(F.col("short").alias("train"), F.col("class").alias("train_class"), "train_text")
    candidates = met.join(texts, "train").join(held.select(F.col("short").alias("held"), F.col("class").alias("held_class"), "text"), "held")
    return members, cut(candidates.mapInPandas(_verify, _MATCHED))


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = members.where("split = 'train'").select(F.col("class").alias("train_class"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    held = members.where("split <> 'train'").select(F.col("class").alias("held_class"), F.col("id").alias("held_id"), F.col("split").alias("held_split"), F.col("source").alias("held_source"))
    return train, held


def overlap_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of records (train_id, held_id with splits and sources) of matched classes."""
    train, held = _sides(members)
    return pairs.join(train, "train_class").join(held, "held_class").where(F.col("train_id") != F.col("held_id"))


def overlap_records(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(held_id, held_split, held_source, partners, edits, coverage) of the held-out records with a partner.

    Partners are counted from the sizes of the classes, so copies on both sides are never paired. An id that is also in
    train isn't its own partner.
    """
    train, held = _sides(members)
    sizes = train.groupBy("train_class").agg(F.count(F.lit(1)).alias("size"))
    share = F.col("covered") / F.col("held_words")
    same = F.col("train_class") == F.col("held_class")
    met = pairs.join(sizes, "train_class").groupBy("held_class").agg(
        F.coalesce(F.sum(F.when(same, F.col("size"))), F.lit(0)).alias("copies"), F.coalesce(F.sum(F.when(~same, F.col("size"))), F.lit(0)).alias("others"),
        F.min(F.when(~same, F.col("edits"))).alias("edits"), F.max(F.when(~same, share)).alias("coverage"), F.max(F.when(same, share)).alias("own_coverage"),
    )
    own = train.select(F.col("train_id").alias("held_id"), F.col("train_class").alias("held_class"), F.lit(1).alias("itself")).distinct()
    rows = held.join(own, ["held_id", "held_class"], "left").join(met, "held_class")
    copies = F.col("copies") - F.coalesce("itself", F.lit(0))
    rows = rows.withColumn("copies", copies).withColumn("partners", F.col("copies") + F.col("others")).where("partners > 0")
    exact = F.col("copies") > 0
    return rows.select(
        "held_id", "held_split", "held_source", "partners", F.when(exact, 0).otherwise(F.col("edits")).alias("edits"),
        F.when(exact, F.greatest("own_coverage", F.coalesce("coverage", F.lit(0.0)))).otherwise(F.col("coverage")).alias("coverage"),
    )
