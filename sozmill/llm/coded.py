"""Words as 64-bit numbers, hashes of word windows, and a filter over the hashes of placed passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)
_BITS = np.uint64(0xD6E8FEB86659FD93)
#: Words that a task works on at once, whatever the number of rows they come from.
WORDS_AT_ONCE = 1_000_000
#: A filter has this many slots of 32 bits for each passage, between the two bounds, and half as many sets of 64 bits; both together
#: are 64 MB at most, which every task gets.
SLOTS_PER_HASH = 4
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 23


class Coder:
    """Word numbers: a stable 64-bit hash per word, remembered while the vocabulary stays small."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(out, np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    out = (a ^ b) * _MIX
    return out ^ (out >> _FOLD)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mixed(out, codes[i : i + n])
    return out


def runs(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers start[i] .. start[i] + length[i] - 1 of all i end to end, and the i of each."""
    owner = np.repeat(np.arange(len(start)), length)
    return np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + start[owner], owner


def slices(pdf: pd.DataFrame, n: np.ndarray, most: int = WORDS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """A batch in parts of at most ``most`` words, given the words of its rows; a longer row is a part of its own."""
    begin, held = 0, 0
    for i, size in enumerate(n.tolist()):
        if held and held + size > most:
            yield pdf.iloc[begin:i]
            begin, held = i, 0
        held += size
    if begin < len(pdf):
        yield pdf.iloc[begin:]


def _turned(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sixteen bits of which ``width`` are set from number ``low`` on, going round."""
    width = np.minimum(width, 16).astype(np.uint32)
    bits = ((np.uint32(1) << width) - np.uint32(1)) << (low % 16).astype(np.uint32)
    return (bits | (bits >> np.uint32(16))) & np.uint32(0xFFFF)


def _length_bucket(n: np.ndarray) -> np.ndarray:
    """Texts whose lengths differ by a fifth at most are in the same or neighbouring buckets."""
    return (np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int64)


class PassageFilter:
    """Says of a hash at a place of a text whether a passage of a near text may have it; never a wrong no.

    A hash has four bits of one set, and a slot with the buckets of text length and of place of all passages that share it.
    """

    def __init__(self, slots: np.ndarray, sets: np.ndarray) -> None:
        self.slots, self.sets = slots, sets

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        """The bits that a hash has in its set."""
        h = (keys * _BITS) >> np.uint64(40)
        return np.bitwise_or.reduce([np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63)) for i in range(4)])

    @staticmethod
    def places(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot and set of a hash."""
        return (keys & np.uint64(slots - 1)).astype(np.int64), ((keys >> np.uint64(23)) & np.uint64(slots // 2 - 1)).astype(np.int64)

    @staticmethod
    def marks(n: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = np.ones(len(n), np.int64)
        return _turned(_length_bucket(n), one) | (_turned(at // 4, one) << np.uint32(16))

    def __call__(self, keys: np.ndarray, n: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """``most`` is by how much places may differ."""
        slot, place = self.places(keys, len(self.slots))
        bits = self.bits(keys)
        out = np.flatnonzero((self.sets[place] & bits) == bits)
        seen = self.slots[slot[out]]
        low = np.maximum(at[out] - most[out], 0) // 4
        length, place = _turned(_length_bucket(n[out]) - 1, np.full(len(out), 3)), _turned(low, (at[out] + most[out]) // 4 - low + 1)
        return out[((seen & length) != 0) & (((seen >> np.uint32(16)) & place) != 0)]


def passage_filter(passages: DataFrame, count: int) -> PassageFilter:
    """A filter of ``count`` passages (key long, n int, at int), summed up in the cluster; the driver gets MOST_SLOTS slots at most.

    Beyond MOST_SLOTS / SLOTS_PER_HASH passages it lets more through, and loses nothing.
    """
    size = LEAST_SLOTS
    while size < min(MOST_SLOTS, SLOTS_PER_HASH * count):
        size *= 2

    def touched(batches):
        for pdf in batches:
            keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
            marks = PassageFilter.marks(pdf["n"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)).astype(np.uint64)
            slot, place = PassageFilter.places(keys, size)
            # Sets are numbered after the slots.
            slot, marks = np.concatenate([slot, place + size]), np.concatenate([marks, PassageFilter.bits(keys)])
            order = np.argsort(slot, kind="stable")
            slot, first = np.unique(slot[order], return_index=True)
            ored = np.bitwise_or.reduceat(marks[order], first) if len(slot) else marks
            yield pd.DataFrame({"slot": slot.astype(np.int32), "marks": ored.view(np.int64)})

    found = passages.select("key", "n", "at").mapInPandas(touched, "slot int, marks long").groupBy("slot").agg(F.bit_or("marks").alias("marks")).toArrow()
    slots, sets = np.zeros(size, np.uint32), np.zeros(size // 2, np.uint64)
    for batch in found.to_batches():
        slot, marks = batch.column("slot").to_numpy(), batch.column("marks").to_numpy().view(np.uint64)
        low = slot < size
        slots[slot[low]] = marks[low].astype(np.uint32)
        sets[slot[~low] - size] = marks[~low]
    return PassageFilter(slots, sets)
