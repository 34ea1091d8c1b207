"""What the search for cross-split overlaps writes to disk."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from sozmill.llm import coded, contamination
from sozmill.session import cut_to_table


def test_texts_are_not_copied_when_the_filter_is_full(spark, monkeypatch):
    """With as many passages as the filter has slots, what goes on is less than the texts, and no pair is lost."""
    monkeypatch.setattr(coded, "LEAST_SLOTS", 1 << 11)
    monkeypatch.setattr(coded, "MOST_SLOTS", 1 << 11)
    monkeypatch.setattr(contamination, "PASSAGES_PER_SHARD", 50)
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abdefghiklmnoprsuvxz") for _ in range(9)) for _ in range(20))
    rows = [(f"t{i}", "train", "s", text()) for i in range(2_000)] + [(f"v{i}", "val", "s", text()) for i in range(500)]
    rows += [(f"c{i}", "test", "s", rows[i][3].replace(rows[i][3].split(" ")[7], "yangi")) for i in range(40)]
    folded = cut_to_table(spark.createDataFrame(rows, "id string, split string, source string, text string").mapInPandas(contamination._fold_batches, contamination._FOLDED))
    _, patterns, sent = contamination.routed_texts(folded)
    assert patterns.count() >= 1 << 11
    size = sum((F.length(c) if kind in ("string", "binary") else F.lit(8) for c, kind in sent.dtypes), F.lit(0))
    assert sent.agg(F.sum(size).alias("n")).first()["n"] < sum(len(r[3]) for r in rows) / 4
    pairs = contamination.overlap_pairs(*contamination.cross_split_overlaps(spark.createDataFrame(rows, "id string, split string, source string, text string")))
    assert {(r["train_id"], r["held_id"]) for r in pairs.collect()} == {(f"t{i}", f"c{i}") for i in range(40)}


def test_filter_says_no_wrong_no():
    import numpy as np

    rng = np.random.default_rng(4)
    keys, n = rng.integers(0, 1 << 64, 5_000, np.uint64), rng.integers(8, 60, 5_000)
    at = rng.integers(0, 40, 5_000)
    for slots in (1 << 4, 1 << 10, 1 << 16):
        slot, place = coded.PassageFilter.places(keys, slots)
        marks, sets = np.zeros(slots, np.uint32), np.zeros(slots // 2, np.uint64)
        np.bitwise_or.at(marks, slot, coded.PassageFilter.marks(n, at))
        np.bitwise_or.at(sets, place, coded.PassageFilter.bits(keys))
        passes = coded.PassageFilter(marks, sets)
        most = n // 5
        assert len(passes(keys, n, at, most)) == len(keys)
        assert len(passes(keys, n, np.maximum(at - most, 0), most)) == len(keys)
    others = rng.integers(0, 1 << 64, 5_000, np.uint64)
    assert len(passes(others, n, at, most)) < 50


def test_shuffle_files_of_a_freed_table_go(spark):
    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {p for p in root.rglob("shuffle_*.data")}
    rows = spark.range(0, 50_000, 1, 40).groupBy((F.col("id") % 9_999).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = files()
    assert cut_to_table(rows, freed=True).agg(F.sum("n")).first()[0] == 50_000
    for _ in range(150):
        left = len(files() - before)
        if left < 20:  # the sum's own; the table's shuffle has 40
            break
        time.sleep(0.2)
    assert left < 20
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
