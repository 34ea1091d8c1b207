"""Scorers with retries and cuts, strict pairs, exact rounding, ranks and sums over hot groups, nested playlists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.functions import urls as U
from sozmill.operators import manifest as M
from sozmill.operators import sampling as S
from sozmill.operators.ranking import newest, spread_before
from sozmill.sources import scorers


def test_transcribers_retry_cut_and_report(spark):
    def factory():
        state = {"calls": 0}

        def call(samples):
            if len(samples) > 20_000:
                raise ValueError("too long")
            if len(samples) == 7:
                raise OSError("broken")
            state["calls"] += 1
            if state["calls"] == 1:
                raise OSError("first call fails")
            return f"n{len(samples)}"

        return call

    clips = spark.createDataFrame([("a", [0.5] * 10), ("b", [0.1] * 30_000), ("c", [0.0] * 7), ("d", None)], "clip_id string, samples array<float>").coalesce(1)
    rows = {r["clip_id"]: r for r in scorers.transcribe(clips, factory, punctuated=True).collect()}
    assert rows["a"]["text"] == "N10" and rows["b"]["text"].startswith("N") and sum(int(w[1:]) for w in rows["b"]["text"].split()) == 30_000
    assert "failed 3 times: broken" in rows["c"]["error"] and rows["d"]["error"] == "no audio"
    quiet = np.concatenate([np.ones(15_000), np.zeros(2_000), np.ones(15_000)]).astype(np.float32)
    lengths = []
    scorers.splitting(lambda s: lengths.append(len(s)) or "x" if len(s) < 20_000 else (_ for _ in ()).throw(ValueError()))(quiet)
    assert lengths[0] in range(15_000, 17_001)
    with pytest.raises(ValueError):
        scorers.splitting(lambda s: (_ for _ in ()).throw(ValueError("no")))(np.zeros(10))


def test_strict_pairs_and_rounding(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(p) for p in df.select(T.zip_strict(F.col("x"), F.col("y")).alias("z")).first()["z"]] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="lengths differ: 2 and 1"):
        df.select(T.zip_strict(F.col("x"), F.array(F.lit("a")))).collect()
    values = [2.675, 0.5, 1.5, -2.5, 1.0005, None]
    got = spark.createDataFrame([(v, d) for v in values for d in (0, 2, 3)], "v double, d int").select("v", "d", T.round_half_even("v", "d").alias("r")).collect()
    assert all(r["r"] == (None if r["v"] is None else round(r["v"], r["d"])) for r in got)


def test_sums_before_rows_of_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["x", "y", None]), n, rng.choice([None, 1, 2, 5]), rng.random()) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, v int, w double")
    got = spread_before(df, ["g"], [F.col("n").desc()], {"s": "v", "t": "w", "c": None}, 7).collect()
    seen: dict = {}
    for g, n, v, w in sorted(rows, key=lambda r: -r[1]):
        s, t, c = seen.get(g, (0, 0.0, 0))
        seen[g] = (s + (v or 0), t + w, c + 1)
        row = next(r for r in got if r["n"] == n) if n % 97 == 0 else None
        if row:
            assert (row["s"], row["c"]) == (s, c) and abs(row["t"] - t) < 1e-9
    assert len(got) == 3000 and spread_before(df.limit(0), ["g"], [F.col("n")], {"c": None}).collect() == []


def test_caps_count_what_is_there(spark):
    rows = spark.createDataFrame([("a", 1, 50), ("a", 2, 50), ("a", 3, 50), ("b", 1, 50), (None, 1, 5)], "g string, n int, v int")
    base = spark.createDataFrame([("a", 10)], "g string, base int")
    got = {(r["g"], r["n"]): r["taken"] for r in S.cap_from_base(rows, "g", base, "v", [F.col("n")], 100).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, (None, 1): True}
    kept = newest(rows, "g", F.col("n"), 2).collect()
    assert sorted((r["g"], r["n"]) for r in kept) == [("a", 2), ("a", 3), ("b", 1)]


def test_playlists_and_exclusions(spark):
    lists = [('{"entries":[{"id":"a"},null,{"entries":[{"id":"b"},{"entries":[{"id":"c"}]}]},{"id":""},{"x":1}]}', ["a", "b", "c"]), ("{}", []), ("broken", []), (None, [])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lists)], "i int, t string").select("i", U.playlist_ids(F.col("t")).alias("v")).collect()
    assert {r["i"]: r["v"] for r in got} == {i: v for i, (_, v) in enumerate(lists)}
    maps = spark.createDataFrame([('{"a": [1, 2], "b": []}',), ('{"a": [2]}',), ("nothing",), (None,)], "j string")
    assert sorted(tuple(r) for r in M.exclusion_rows(maps, "j").collect()) == [("a", 1), ("a", 2)]
    bounds = spark.createDataFrame([(1.0,), (28.5,), (5.0,), (None,)], "d double").select(M.outside_bounds(F.col("d"), 2, 20).alias("v"), M.outside_bounds(F.col("d"), 0, None).alias("w")).collect()
    assert [r["v"] for r in bounds] == ["duration 1s < min 2s", "duration 28s > max 20s", None, None] and all(r["w"] is None for r in bounds)


def test_video_descriptions(spark):
    from sozmill.functions.metadata import parse_info

    rows = [
        ('{"id": "v", "duration": 5, "channel": " ", "uploader": "Ali", "upload_date": "20240131", "subtitles": {"ru": "x"}, "automatic_captions": {"uz-Cyrl": "x"}}', ("v", "u", "", "Ali", 5.0, None, "2024-01-31", "automatic", None)),
        ('{"id": "v", "duration": 5, "webpage_url": "w", "title": "T", "language": "uz", "upload_date": "soon", "subtitles": {"uz": "x"}, "automatic_captions": {"uz": "x"}}', ("v", "w", "T", None, 5.0, "uz", None, "manual", None)),
        ('{"id": "v"}', ("v", "u", "", None, None, None, None, None, "no duration")), ("{}", (None, "u", "", None, None, None, None, None, "no video id")), (None, (None, "u", "", None, None, None, None, None, "no video id")),
    ]
    got = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(rows)], "i int, j string").select("i", parse_info(F.col("j"), F.lit("u")).alias("m")).collect()
    assert {r["i"]: tuple(r["m"]) for r in got} == {i: want for i, (_, want) in enumerate(rows)}


def test_listers_and_resolvers(spark):
    from sozmill.sources.listing import acknowledgement, fetched_stats, resolved

    def lister():
        return lambda url: {"a": [3600.0, 1800.0], "b": []}[url]

    channels = spark.createDataFrame([("ch_a", "a"), ("ch_b", "b"), ("ch_c", "c")], "channel_id string, url string")
    got = {r["channel_id"]: tuple(r)[1:3] for r in fetched_stats(channels, lister).collect()}
    assert got == {"ch_a": (2, 1.5), "ch_b": (0, 0.0), "ch_c": (None, None)}
    assert "failed 3 times" in fetched_stats(channels.where("url = 'c'"), lister).first()["error"]

    def resolver():
        return lambda url: {"x": "https://video.example/@x"}.get(url)

    links = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), (None, 4)], "link string, n int")
    rows = {r["n"]: (r["resolved"], r["error"]) for r in resolved(links, resolver).collect()}
    assert rows == {1: ("https://video.example/@x", None), 2: (None, "no channel"), 3: ("https://video.example/@x", None), 4: (None, None)}
    line = spark.range(1).select(acknowledgement(F.lit("ch_a"), F.lit(None).cast("string"), F.lit("u")).alias("v")).first()["v"]
    assert line == "+ ch_a [other] u"
