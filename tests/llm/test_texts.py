"""Language runs, sentence units, leaks, cross-split overlaps and mixing on small fixtures with known answers."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sozmill.llm import contamination, language, leakage, sentences
from sozmill.llm.fold import number_words, words

BASE = "/root/testdata/sf0.01"


# --- folding ---------------------------------------------------------------------------------------------------------


def test_fold():
    assert words("Қўшни бола [kulgu] 124 нафар!") == words("qo‘shni bola yuz yigirma to'rt nafar") == ["qoshni", "bola", "yuz", "yigirma", "tort", "nafar"]
    assert words(None) == [] and words("") == [] and words("...") == []
    assert number_words("0") == "nol" and number_words("1000") == "ming" and number_words("1002000") == "bir million ikki ming"
    assert len(number_words("9" * 30).split()) == 30


# --- languages -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def compressor(spark):
    return language.Compressor(language.fit_on(spark.read.parquet(f"{BASE}/documents.parquet")))


EN = "At the stadium the photographer showed the lost project to our guest before sunrise"
UZ = "Mehmonxonada birinchi qor yoqqanda akamning do‘sti eskirgan bahsni saqlab qo‘ydi"
RU = "Старый садовник после урока объясняет незнакомый результат в старой студии"


def seen(compressor, text, default=None):
    return [r[0] for r in language.language_runs(text, compressor, default)]


def test_runs(compressor):
    assert seen(compressor, f"{UZ}.") == ["uz"]
    assert seen(compressor, f"{UZ}. {EN}. {UZ}.") == ["uz", "en", "uz"]
    assert seen(compressor, f"{UZ} {RU} {UZ}") == ["uz", "ru", "uz"]
    assert seen(compressor, UZ.replace("eskirgan", "кстати eskirgan feedback") + ".") == ["uz"]
    assert seen(compressor, f"{UZ}. 当然！ {UZ}.") == ["uz", "zh", "uz"]
    assert seen(compressor, "ha albatta", "uz") == ["uz"]
    assert seen(compressor, "") == [] and seen(compressor, "123 !!", "uz") == []
    assert seen(compressor, f"{EN}. " * 3000) == ["en"]
    assert all(0 <= r[1] <= 1 for r in language.language_runs(f"{UZ}. {RU}.", compressor))


def test_runs_inside_unpunctuated_text(compressor):
    uz, en = UZ.lower().split(), EN.lower().split()
    assert seen(compressor, " ".join(uz[:6] + en[2:8] + uz[4:])) == ["uz", "en", "uz"]
    assert seen(compressor, " ".join(uz + en[:7] + uz)) == ["uz", "en", "uz"]
    assert seen(compressor, " ".join(uz + en[3:5] + uz)) == ["uz"]


def test_short_run_after_a_long_block(compressor):
    long = "заргар синфхонада совуқ эртакни ёмғир тинганда баҳам кўрди шанба оқшоми сайёҳ янги бинода узун қўшиқни таъмирлади нонушта вақтида тоғ этагида кичик жияним қувноқ куйни мақтади"
    assert seen(compressor, f"{long} старый садовник после урока объясняет незнакомый") == ["uz", "ru"]
    assert seen(compressor, long) == ["uz"]


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("uz", " UZ", "uzb", "uz-Latn", "zh_Hans", "und", "mul", "", None, "az")], "l string")
    assert [r["v"] for r in rows.select(language.label_language(F.col("l")).alias("v")).collect()] == ["uz", "uz", "uz", "uz", "zh", None, None, None, None, None]


def test_texts_of_no_known_script(compressor):
    for text in ("오늘은 날씨가 매우 좋습니다", "Ο καιρός είναι καλός σήμερα", "היום מזג האוויר נעים"):
        assert language.language_runs(text, compressor) == [("und", 0.0, len(text.split()))]
    assert language.language_runs("", compressor) == language.language_runs("12 — 3!", compressor) == []


def test_held_out_accuracy(spark):
    """Labelled documents that the dictionaries have not seen; labels are wrong in some rows, so agreement stays below 1."""
    rows = spark.read.parquet(f"{BASE}/documents.parquet").where("text <> ''").withColumn("label", language.label_language(F.col("lang"))).where("label is not null").collect()
    train, test = [r for r in rows if r["doc_id"] % 2], [r for r in rows if not r["doc_id"] % 2]
    fitted = language.Compressor(language.fit_dictionaries([(r["label"], r["text"]) for r in train]))
    good = sum(seen(fitted, r["text"])[:1] == [r["label"]] for r in test)
    assert good > 0.9 * len(test)


def test_identify_edges(spark, compressor):
    schema = "record_kind string, record_key string, label string, text string, lang string"
    df = spark.createDataFrame([("document", "1", "en", None, "x"), ("document", None, "en", "text", "x"), ("document", "2", None, EN, "x"), ("document", "2", None, EN, "x")], schema)
    dictionaries = {("l", "en"): EN.lower().encode() * 3, ("l", "uz"): UZ.lower().encode() * 3}
    assert [(r["record_key"], r["lang"]) for r in language.identify(df, dictionaries).collect()] == [("2", "en"), ("2", "en")]
    assert language.identify(df, {}).collect() == [] and language.identify(df.limit(0), dictionaries).collect() == []


# --- sentences -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet(f"{BASE}/documents.parquet").select("text", "source").collect()
    return sentences.fit_boundaries([(r["text"], r["source"] == "asr_raw_lines") for r in rows])


@pytest.mark.parametrize(
    "text, units",
    [
        ("Yangi son\n\nProf. Zelbekov oshxonada 4.54 km narida kitobni topdi. Ha! Keyin\ntarjimon keldi.", ["Yangi son", "Prof. Zelbekov oshxonada 4.54 km narida kitobni topdi.", "Ha!", "Keyin\ntarjimon keldi."]),
        ("«Mehmonim keldi! U kim?» — dedi Zelbekov. Rahmat.", ["«Mehmonim keldi! U kim?» — dedi Zelbekov.", "Rahmat."]),
        ("1. Да. \n2. Нет.\n3. [10:20] Верно.", ["1. Да.", "2. Нет.", "3. [10:20] Верно."]),
        ("在桥下主持人朗读了文章。真的吗？！当然！", ["在桥下主持人朗读了文章。", "真的吗？！", "当然！"]),
        ("เวลา 3.57 น.คนสวนลืมบทความ คนสวนลืมเพลง", ["เวลา 3.57 น.คนสวนลืมบทความ", "คนสวนลืมเพลง"]),
        ("", []),
        (" \n\n ", []),
    ],
)
def test_units(model, text, units):
    assert [text[a:b] for a, b in sentences.segment(text, False, model)] == units


def test_raw_lines(model):
    assert sentences.segment("bir. ikki\n uch \n\n", True, model) == [(0, 9), (11, 14)]


def test_units_hold_all_characters(spark, model):
    for r in spark.read.parquet(f"{BASE}/documents.parquet").limit(400).collect():
        text = r["text"]
        spans = sentences.segment(text, r["source"] == "asr_raw_lines", model)
        rest, at = "", 0
        for a, b in spans:
            assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace()
            rest += text[at:a]
            at = b
        assert not (rest + text[at:]).strip()


def test_sentence_edges(spark):
    schema = "doc_id long, text string, source string, start_pos string"
    df = spark.createDataFrame([(1, None, "x", ""), (None, "A b.", "x", ""), (2, "A b. C d.", None, ""), (3, "", "x", ""), (4, "Word. " * 20000, "x", "")], schema)
    rows = sentences.sentence_units(df).collect()
    assert {r["doc_id"] for r in rows} == {2, 4} and max(r["end_pos"] for r in rows) == 6 * 20000 - 1
    assert sentences.sentence_units(df.limit(0)).collect() == []


# --- leaks -----------------------------------------------------------------------------------------------------------

WORDS = [f"{a}{b}" for a in ("bara", "kelo", "mustu", "sari", "toni") for b in ("dan", "gul", "kor", "lim", "mash", "nur", "shi", "vat", "zor")]


def passage(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]


def edited(rng, seq, edits):
    seq = list(seq)
    for _ in range(edits):
        i = rng.randrange(2, len(seq) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            seq[i] = "qqq" + str(rng.randrange(9))
        elif kind == 1:
            del seq[i]
        else:
            seq.insert(i, "zzz" + str(rng.randrange(9)))
    return seq


def direct_window(item, doc):
    """Least edits of any 18 words of an item against the document, by the plain table."""
    best = 99
    for s in range(len(item) - 17):
        row = [0] * (len(doc) + 1)
        for i, x in enumerate(item[s : s + 18], 1):
            new = [i]
            for j, y in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        best = min(best, min(row))
    return best


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, passage(rng, rng.choice([12, 18, 25, 40]))) for i in range(12)]
    docs = []
    for d in range(60):
        _, source = rng.choice(items)
        a = rng.randrange(0, max(1, len(source) - 19))
        part = source[a : a + rng.choice([17, 18, 19, 24])]
        docs.append((d, passage(rng, 30) + edited(rng, part, rng.randrange(4)) + passage(rng, 20)))
    want = {(d, i) for d, doc in docs for i, item in items if len(item) >= 18 and direct_window(item, doc) <= 2}
    assert len(want) > 10
    left = spark.createDataFrame([(d, " ".join(doc), 1) for d, doc in docs] + [(99, None, 1), (98, "", 1), (None, "x", 1)], "doc_id long, text string, score int")
    right = spark.createDataFrame([(i, " ".join(item), 1) for i, item in items] + [(50, None, 1), (51, "", 1)], "item_id long, text string, edits int")
    for bound, shard in ((leakage.BROADCAST_SEEDS, 100_000), (0, 100_000), (0, 30)):  # seeds sent to the scan, and seeds in one and many shards
        monkeypatch.setattr(leakage, "SEEDS_PER_SHARD", shard)
        monkeypatch.setattr(leakage, "WORDS_PER_TASK", 20 * shard)
        got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(left, right, broadcast_seeds=bound).collect()}
        assert got == want
    assert leakage.find_leaks(left.limit(0), right).collect() == [] and leakage.find_leaks(left, right.limit(0)).collect() == []


def test_both_ways_find_the_same_leaks(spark):
    docs, items = (spark.read.parquet(f"{BASE}/{name}.parquet") for name in ("documents", "eval_items"))
    few, many = (sorted(map(tuple, leakage.find_leaks(docs, items, broadcast_seeds=bound).collect())) for bound in (leakage.BROADCAST_SEEDS, 0))
    assert few == many and len(few) > 20


def test_long_items_are_aligned_in_parts():
    rng = np.random.default_rng(4)
    item = rng.integers(1, 1 << 60, 3_000).astype(np.uint64)
    doc = np.concatenate([rng.integers(1, 1 << 60, 40).astype(np.uint64), item[1_900:1_950], rng.integers(1, 1 << 60, 900).astype(np.uint64)])
    assert leakage.best_window(item, doc) == 0 and leakage.best_window(item, doc[60:75]) == 3 and leakage.best_window(item[:800], doc) == 18


def test_leaks_ignore_layout(spark):
    rng = random.Random(9)
    seq = [rng.choice(["qo‘shni", "bola", "eskirgan", "ta’mirladi", "shahar", "yozib", "oldi", "choy"]) + "a" * rng.randrange(3) for _ in range(24)]
    text = "[10:20] Muxbir: " + " ".join(seq[:10]).upper() + ",\n" + "­".join(" ".join(seq[10:]).replace("’", "ʼ").rsplit("a", 1))
    left = spark.createDataFrame([(1, text)], "doc_id long, text string")
    right = spark.createDataFrame([(7, " ".join(seq))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in leakage.find_leaks(left, right).collect()] == [(1, 7, 0)]


def test_smith_waterman():
    a, b = np.array([[5, 6, 7, 8, 0]], np.uint64), np.array([[9, 5, 6, 3, 7, 8, 1]], np.uint64)
    assert leakage.smith_waterman(a, b).tolist() == [7]


# --- overlaps --------------------------------------------------------------------------------------------------------


def test_overlaps_match_brute_force(spark, monkeypatch):
    rng = random.Random(10)
    base = [passage(rng, rng.choice([7, 8, 11, 12, 18, 23])) for _ in range(40)]
    rows = []
    for n in range(160):
        seq = rng.choice(base)
        rows.append((f"i{n:03d}", rng.choice(["train", "train", "val", "test"]), "s", " ".join(edited(rng, seq, rng.randrange(5)))))
    rows += [("nul", "val", "s", None), ("emp", "train", "s", ""), ("lng", "train", None, " ".join(passage(rng, 3000)))]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    folded = {i: words(t) for i, _, _, t in rows}
    train, held = [r[0] for r in rows if r[1] == "train" and len(folded[r[0]]) >= 8], [r[0] for r in rows if r[1] != "train" and len(folded[r[0]]) >= 8]
    want = {(a, b) for a in train for b in held if abs(len(folded[a]) - len(folded[b])) < 9 and plain(folded[a], folded[b]) <= max(len(folded[a]), len(folded[b])) // 6}
    assert len(want) > 20
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, split string, source string, text string, class int")
    # Large and many small shards and blocks, and every passage shared by two texts taken as common.
    for shard, block, common in ((200_000, 2_000_000, 200), (20, 300, 200), (20, 300, 1)):
        monkeypatch.setattr(contamination, "PASSAGES_PER_SHARD", shard)
        monkeypatch.setattr(contamination, "WORDS_PER_TASK", block)
        monkeypatch.setattr(contamination, "COMMON_TEXTS", common)
        pairs = contamination.overlap_pairs(*contamination.cross_split_overlaps(df)).collect()
        assert {(r["train_id"], r["held_id"]) for r in pairs} == want
        assert all(0 < r["covered"] <= r["held_words"] for r in pairs)
    members, matched = contamination.cross_split_overlaps(df)
    records = {r["held_id"]: r["partners"] for r in contamination.overlap_records(members, matched).collect()}
    assert records == Counter(b for _, b in want)
    assert contamination.overlap_pairs(*contamination.cross_split_overlaps(df.limit(0))).collect() == []


def test_passages_lose_nothing():
    for n in [*range(8, 400), 1999, 30_000]:
        stretches = contamination.passages(n)
        flat = [p for *_, cuts in stretches for p in cuts]
        assert flat[0][0] == 0 and flat[-1][1] == n and all(a[1] == b[0] for a, b in zip(flat, flat[1:]))
        assert all(b - a in contamination.LENGTHS for a, b in flat)
        # Were each stretch to have one edit more than it may, the text would have more than it may.
        assert sum(edits + 1 for _, _, edits, _ in stretches) > contamination.max_edits(n)
        often = np.arange(n) % 7 < 3
        for lo, hi, edits, cuts in stretches[:3]:
            for a, b in cuts:
                for common in (often, ~often, often | True):
                    places = contamination.others(lo, hi, edits, a, b, common)
                    assert len(places) == edits + 1 and all(lo <= p and p + s <= hi and (p + s <= a or p >= b) for p, s in places)
                    assert all(p + s <= q for (p, s), (q, _) in zip(places, places[1:]))


def test_edit_distance_of_long_texts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(1, 4, rng.integers(1, 14)).astype(np.uint64)
        b = rng.integers(1, 4, rng.integers(1, 14)).astype(np.uint64)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(x != y)))
            row = new
        for most in (1, 3, 20):
            assert contamination.edit_distance(a, b, most) == min(row[-1], most + 1)
    a = rng.integers(1, 1 << 60, 30_000).astype(np.uint64)
    b = np.delete(a, rng.choice(30_000, 700, replace=False))
    began = time.time()
    assert contamination.edit_distance(a, b, 5_000) == 700
    assert time.time() - began < 20


def test_routes_grow_with_the_rows(spark, monkeypatch):
    """Texts sent to automata, and automata, at most double when the rows do; an opening that all texts share makes no difference."""
    monkeypatch.setattr(contamination, "PASSAGES_PER_SHARD", 20)
    monkeypatch.setattr(contamination, "WORDS_PER_TASK", 5_000)
    monkeypatch.setattr(contamination, "COMMON_TEXTS", 10)
    rng = random.Random(14)
    letters = ["".join(rng.choice("abdefghiklmnoprstuvxz") for _ in range(7)) for _ in range(150_000)]
    text = lambda n: [rng.choice(letters) for _ in range(n)]
    opening = text(6)
    for shared in (False, True):
        sent, automata, held_rows = [], [], []
        for n in (1_000, 2_000, 4_000, 8_000):
            rows = [(i, "val" if i % 20 == 0 else "train", "s", " ".join((opening if shared and i % 3 == 0 else []) + text(14))) for i in range(n)]
            rows += [(n + i, "train", "s", rows[20 * i][3]) for i in range(n // 40)]
            df = spark.createDataFrame([(str(i), *r) for i, *r in rows], "id string, split string, source string, text string")
            folded = contamination.cut_to_table(df.mapInPandas(contamination._fold_batches, contamination._FOLDED))
            _, patterns, train = contamination.routed_texts(folded)
            sent.append(train.count())
            automata.append(patterns.select("shard", "block").distinct().count())
            held_rows.append(patterns.count())
        for counts in (sent, automata, held_rows):
            assert all(b <= 2.3 * a + 20 for a, b in zip(counts, counts[1:])), (shared, sent, automata, held_rows)


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_many_sources_take_the_other_scale(spark, monkeypatch):
    from sozmill.llm import mixing

    monkeypatch.setattr(mixing, "GRAM_SOURCES", 1)
    rng = random.Random(16)
    docs = spark.createDataFrame([(n, " ".join(passage(rng, rng.randrange(20, 120))), s) for n, s in enumerate(["a"] * 150 + ["b"] * 60)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["actual_share"] for r in mixing.mix(docs, targets)[1].collect()}
    assert all(abs(v - 0.5) < 0.02 for v in got.values())
    alone = mixing.mix(docs, targets.where("source = 'a'"), label_noise=0.0)[1].collect()
    assert [(r["source"], r["actual_share"], r["expected_share"]) for r in alone] == [("a", 1.0, 1.0)]


def test_mix(spark):
    from sozmill.llm.mixing import mix

    rng = random.Random(11)
    rows = [(n, " ".join(passage(rng, rng.randrange(20, 200))), s) for n, s in enumerate(["big"] * 300 + ["Mid "] * 120 + ["small"] * 40 + ["odd"] * 20)]
    rows += [(9001, None, "big"), (9002, "", "mid"), (None, "x", "mid"), (9003, "text", None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("mid", 0.3, 2), ("small", 0.25, 3), ("gone", 0.1, 2), ("none", None, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"big", "mid", "small", "gone", "none"} and got["gone"]["copies"] == got["none"]["copies"] == 0
    for s, want in (("big", 0.5 / 1.05), ("mid", 0.3 / 1.05), ("small", 0.25 / 1.05)):
        assert abs(got[s]["target_share"] - want) < 1e-9 and abs(got[s]["actual_share"] - want) < 0.01
        assert abs(got[s]["expected_share"] - got[s]["target_share"]) < 0.05
    assert abs(sum(r["expected_share"] for r in got.values()) - 1) < 1e-6
    limit = {"big": 1, "mid": 2, "small": 3}
    full = {r["source"]: r for r in mix(docs, targets, fill=1.0)[1].collect()}
    assert full["mid"]["tokens"] > got["mid"]["tokens"] and abs(full["mid"]["actual_share"] - 0.3 / 1.05) < 0.02
    picked = chosen.collect()
    assert picked and all(1 <= r["copies"] <= limit[r["source"]] and r["tokens"] > 0 for r in picked)
    assert mix(docs.limit(0), targets)[0].collect() == [] and mix(docs, targets.limit(0))[0].collect() == []


def test_minor_scripts_of_wrong_labels_are_dropped():
    """A sixth of one label's text is another language's; its dictionary there must go, and a true second script must stay."""
    rng = random.Random(12)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(300)] for k, letters in {"uz": "abdehilmnoqrstuvxyz", "kk": "абвгдежзиклмнопрст", "uzc": "ўқғҳабдеилмнорт", "tr": "çşığüöabcdefgklmn"}.items()}
    text = lambda k: ". ".join(" ".join(rng.choice(vocabulary[k]) for _ in range(15)) for _ in range(6))
    rows = [("uz", text("uz")) for _ in range(150)] + [("uz", text("uzc")) for _ in range(40)]
    rows += [("kk", text("kk")) for _ in range(150)] + [("kk", text("uz")) for _ in range(30)] + [("tr", text("tr")) for _ in range(150)]
    rng.shuffle(rows)
    assert set(language.fit_dictionaries(rows)) == {("l", "uz"), ("c", "uz"), ("c", "kk"), ("l", "tr")}
