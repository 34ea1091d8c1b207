"""Evaluation passages leaking into a corpus: rare n-gram seeds, Smith-Waterman alignment, then the exact window rule.

A window of 18 words with at most two edits keeps a run of at least six words, so the six-word seeds of all items lose
nothing. Seeds are joined with the corpus' six-word windows inside the scan while the items' seeds are within a stated
bound; beyond it the scan drops windows that no item holds, and documents meet the shards of the seeds left. Hits of a document and item that lie on near diagonals
make one stretch; rarer seeds come first, and a stretch is aligned once.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozmill.llm.coded import Coder, passage_filter, window_hashes
from sozmill.llm.fold import fold, split_words
from sozmill.session import cut_to_table

WINDOW = 18
MAX_EDITS = 2
SEED = 6
#: Seeds (24 bytes each) that are sent to every task; beyond, hashes are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
#: Beyond, seeds of one shard, and words of the documents that one task holds against them.
SEEDS_PER_SHARD = 100_000
WORDS_PER_TASK = 2_000_000
#: Windows of an item that are compared in one go.
WINDOWS_AT_ONCE = 512

_TIME = re.compile(r"[\[(<]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])>]?")
#: One or two words and a colon where a sentence can start: after a terminator, a closing mark, a dash or a blank line.
_LABEL = re.compile(r"(\A|[.!?…。！？।؟»”\"“)\]—–-]|\n[^\S\n]*\n)\s*(?:[^\W\d_]+ )?[^\W\d_]+:(?=\s)")


def plain_words(text: str | None) -> list[str]:
    """Words of a text without speaker labels and time marks, folded over case, script, apostrophes and invisible marks."""
    if not text:
        return []
    return split_words(fold(_LABEL.sub(r"\1 ", _TIME.sub(" ", text)) if ":" in text else text))


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, differ: int = -1, skip: int = -1) -> np.ndarray:
    """Best local alignment score of each pair of rows; 0 pads rows of ``a`` and 1 rows of ``b``."""
    best = np.zeros(len(a), np.int32)
    row = np.zeros((len(a), b.shape[1] + 1), np.int32)
    steps = -skip * np.arange(b.shape[1] + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        fresh = row + skip
        np.maximum(fresh[:, 1:], row[:, :-1] + np.where(b == a[:, i, None], np.int32(match), np.int32(differ)), out=fresh[:, 1:])
        # Gaps along the row: a running maximum of the score with the steps' cost taken out.
        row = np.maximum.accumulate(np.maximum(fresh, 0) + steps, axis=1) - steps
        np.maximum(best, row.max(axis=1), out=best)
    return best


def best_window(item: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> int:
    """Least number of word edits between any ``window`` consecutive item words and the stretch of the document aligned with the item.

    Windows advance together, one row of the edit table per window word, free start and end in the document; long items
    in parts, each against the part of the stretch its words can meet.
    """
    count = len(item) - window + 1
    if count <= 0 or not len(doc):
        return window
    if count > WINDOWS_AT_ONCE:
        pad = abs(len(doc) - len(item)) + 6 * MAX_EDITS
        parts = [(a, min(a + WINDOWS_AT_ONCE, count)) for a in range(0, count, WINDOWS_AT_ONCE)]
        return min(best_window(item[a : b + window - 1], doc[max(0, a - pad) : b + window + pad], window) for a, b in parts)
    same = item[:, None] == doc[None, :]
    steps = np.arange(len(doc) + 1)
    row = np.zeros((count, len(doc) + 1), np.int64)
    for i in range(window):
        fresh = row + 1
        np.minimum(fresh[:, 1:], row[:, :-1] + ~same[i : i + count], out=fresh[:, 1:])
        row = np.minimum.accumulate(fresh - steps, axis=1) + steps
    return int(row.min())


LEAST_SCORE = 2 * (WINDOW - MAX_EDITS) - MAX_EDITS


def _stretches(hits: list[tuple[int, int]], item_words: int, doc_words: int) -> list[tuple[int, int]]:
    """Document ranges to align with an item: hits whose diagonals lie close share one, the rarest seed opens it."""
    out: list[list[int]] = []
    near = 3 * MAX_EDITS
    for p, q in hits:
        for known in out:
            if known[0] - near <= p - q <= known[1] + near:
                known[0], known[1] = min(known[0], p - q), max(known[1], p - q)
                break
        else:
            out.append([p - q, p - q])
    return [(max(0, a - near), min(doc_words, b + item_words + near)) for a, b in out]


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]) -> list[tuple[int, int] | None]:
    """(score, edits) of the best stretch per (item, document, hits) if it holds a whole window; pairs of like size together."""
    jobs = [(k, lo, hi) for k, (item, doc, hits) in enumerate(pairs) if len(item) >= WINDOW for lo, hi in _stretches(hits, len(item), len(doc))]
    jobs.sort(key=lambda j: (len(pairs[j[0]][0]), j[2] - j[1]))
    out: list[tuple[int, int] | None] = [None] * len(pairs)
    at = 0
    while at < len(jobs):
        block, cells = [], 0
        while at < len(jobs) and (not block or cells < 400_000):
            block.append(jobs[at])
            cells = len(block) * (jobs[at][2] - jobs[at][1] + 1)
            at += 1
        a = np.zeros((len(block), max(len(pairs[k][0]) for k, _, _ in block)), np.uint64)
        b = np.ones((len(block), max(hi - lo for _, lo, hi in block)), np.uint64)
        for r, (k, lo, hi) in enumerate(block):
            a[r, : len(pairs[k][0])] = pairs[k][0]
            b[r, : hi - lo] = pairs[k][1][lo:hi]
        for (k, lo, hi), score in zip(block, smith_waterman(a, b).tolist()):
            # A window with two edits scores at least 16 matches and two penalties.
            if score >= LEAST_SCORE:
                edits = best_window(pairs[k][0], pairs[k][1][lo:hi])
                if edits <= MAX_EDITS and (out[k] is None or (-score, edits) < (-out[k][0], out[k][1])):
                    out[k] = (score, edits)
    return out


def _seed_table(items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed hashes with item number and position."""
    hashes = [window_hashes(codes, SEED) for _, codes in items]
    h = np.concatenate([np.empty(0, np.uint64), *hashes])
    owner = np.concatenate([np.empty(0, np.int64), *[np.full(len(x), i, np.int64) for i, x in enumerate(hashes)]])
    at = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in hashes]])
    order = np.argsort(h, kind="stable")
    return h[order], owner[order], at[order]


def _joined(codes: np.ndarray, seeds) -> list[tuple[int, list[tuple[int, int]]]]:
    """Item numbers with hits (document position, item position), rarest seed first."""
    h, owner, at = seeds
    mine = window_hashes(codes, SEED)
    if not len(mine) or not len(h):
        return []
    low = np.searchsorted(h, mine, "left")
    hit = np.flatnonzero(h[np.minimum(low, len(h) - 1)] == mine)
    if not len(hit):
        return []
    high = np.searchsorted(h, mine[hit], "right")
    by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for p, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist()):
        for s in range(a, b):
            by_item[int(owner[s])].append((b - a, p, int(at[s])))
    return [(i, [(p, q) for _, p, q in sorted(found)]) for i, found in by_item.items()]


def find_leaks(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, score, edits): documents holding 18 consecutive words of an item with at most two edits.

    ``score`` is the Smith-Waterman score of the best stretch (match 2, change, addition and loss -1 each). Null ids and
    null or empty texts match nothing, texts of any length are read whole, repeated items or documents with one id give one
    row with the best score; other columns are ignored. Items below 18 words match nothing. Empty tables give an empty result.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).dropna()
    wanted = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).alias("text")).dropna().distinct()
    size = wanted.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    schema = "doc_id long, item_id long, score int, edits int"
    if size / 4 <= broadcast_seeds:
        coder = Coder()
        local = [(r["item_id"], coder(plain_words(r["text"]))) for r in wanted.collect()]
        shared = spark.sparkContext.broadcast((local, _seed_table(local)))

        def scan(batches):
            coder = Coder()
            kept, seeds = shared.value
            for pdf in batches:
                keys, pairs = [], []
                for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    codes = coder(plain_words(t))
                    for i, hits in _joined(codes, seeds):
                        keys.append((d, kept[i][0]))
                        pairs.append((kept[i][1], codes, hits))
                rows = [(*k, *f) for k, f in zip(keys, _aligned(pairs)) if f]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "edits"])

        found = docs.mapInPandas(scan, schema)
    else:
        found = _sharded(docs, wanted, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.min("edits").alias("edits"))


def _surroundings(batches):
    """Every seed of an item with the words around it, in which all windows that hold it lie."""
    coder = Coder()
    around = WINDOW - SEED
    for pdf in batches:
        rows = []
        for i, t in zip(pdf["item_id"].tolist(), pdf["text"]):
            codes = coder(plain_words(t))
            if len(codes) >= WINDOW:
                for q, h in enumerate(window_hashes(codes, SEED).view(np.int64).tolist()):
                    rows.append((h, i, codes[max(0, q - around) : q + SEED + around].tobytes(), 1, 0))
        yield pd.DataFrame(rows, columns=["key", "item_id", "around", "n", "at"])


def _routed(shards: int, known):
    """Documents with each shard that has a seed they may hold, and their words."""

    def run(batches):
        passes, coder = known.value, Coder()
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                words = plain_words(t)
                h = window_hashes(coder(words), SEED)
                hit = h[passes(h, np.ones(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64))]
                rows += [(int(s), d, len(words), " ".join(words)) for s in np.unique(hit % np.uint64(shards))]
            yield pd.DataFrame(rows, columns=["shard", "doc_id", "n", "words"])

    return run


def _meet(docs: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block and items of a shard of which some window lies around a common seed."""
    out = []
    if len(docs) and len(seeds):
        coder, back = Coder(), WINDOW - SEED + MAX_EDITS
        seeds = seeds.drop_duplicates(["key", "item_id", "around"])
        h = seeds["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h, kind="stable")
        h, owner, around = h[order], seeds["item_id"].to_numpy()[order], seeds["around"].to_numpy()[order]
        for d, text in zip(docs["doc_id"].tolist(), docs["words"]):
            codes = coder(text.split(" "))
            mine = window_hashes(codes, SEED)
            low, high = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            found: set[int] = set()
            # The rarest seeds first: an item once found isn't looked at again.
            hits = np.flatnonzero(high > low)
            for p in hits[np.argsort((high - low)[hits], kind="stable")].tolist():
                near = codes[max(0, p - back) : p + SEED + back]
                # Items that share their words here share the verdict.
                verdicts: dict[bytes, bool] = {}
                for s in range(low[p], high[p]):
                    if owner[s] not in found:
                        words = around[s]
                        if words not in verdicts:
                            item = np.frombuffer(words, np.uint64)
                            verdicts[words] = bool(np.isin(item, near).sum() >= WINDOW - MAX_EDITS and best_window(item, near) <= MAX_EDITS)
                        if verdicts[words]:
                            found.add(owner[s])
            out += [(d, int(i), text) for i in found]
    return pd.DataFrame(out, columns=["doc_id", "item_id", "words"])


def _sharded(docs: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    """As the scan with broadcast seeds, for any number of items.

    The scan drops what a bit filter of bounded size knows to hold no seed. A document is shuffled once for each shard of
    seeds that it may hold, a shard meets its documents in bounded blocks, and only windows found go on to be scored.
    """
    spark = docs.sparkSession
    seeds = cut_to_table(wanted.mapInPandas(_surroundings, "key long, item_id long, around binary, n int, at int"))
    count = seeds.count()
    shards = count // SEEDS_PER_SHARD + 1
    known = spark.sparkContext.broadcast(passage_filter(seeds, count))
    routed = cut_to_table(docs.mapInPandas(_routed(shards, known), "shard int, doc_id long, n long, words string"))
    blocks = routed.groupBy("shard").agg(F.ceil(F.sum("n") / WORDS_PER_TASK).cast("int").alias("blocks"))
    left = routed.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id", "words")
    shard = F.pmod(F.pmod("key", F.lit(shards)) + F.when(F.col("key") < 0, F.lit((1 << 64) % shards)).otherwise(F.lit(0)), F.lit(shards))
    copies = blocks.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = seeds.select(shard.cast("int").alias("shard"), "key", "item_id", "around").join(copies, "shard")
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_meet, "doc_id long, item_id long, words string")
    pairs = met.groupBy("doc_id", "item_id").agg(F.collect_set("words").alias("texts"))
    full = pairs.select("doc_id", "item_id", F.explode("texts").alias("words")).join(wanted.withColumnRenamed("text", "item_text"), "item_id")

    def align(batches):
        coder = Coder()
        for pdf in batches:
            keys, pairs = list(zip(pdf["doc_id"].tolist(), pdf["item_id"].tolist())), []
            for text, item in zip(pdf["words"], pdf["item_text"]):
                codes, mine = coder(text.split(" ")), coder(plain_words(item))
                pairs.append((mine, codes, [hit for _, hits in _joined(codes, _seed_table([(0, mine)])) for hit in hits]))
            rows = [(*k, *f) for k, f in zip(keys, _aligned(pairs)) if f]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "edits"])

    return full.mapInPandas(align, schema)
