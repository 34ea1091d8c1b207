"""Small worked cases of the core operators and functions."""

import io
import json
import math
import tarfile
import wave

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.functions import urls as U
from sozmill.operators import intervals as I
from sozmill.operators import manifest as M
from sozmill.operators import sampling as S
from sozmill.operators.ranking import spread_rank


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, seconds, reason",
    [
        ("salom dunyo", 2.0, None), ("", 2.0, "empty"), ("700 soʻm", 2.0, "digits"), ("привет salom", 2.0, "charset"), ("salom dunyo", 0.2, "duration"),
        ("salom dunyo azizlar yaxshimisiz hammangiz", 1.0, "char_rate"), ("salom", 10.0, "word_rate"), ("salom dunyo", None, "duration"),
    ],
)
def test_reject_reason(spark, raw, seconds, reason):
    c = F.lit(raw)
    assert one(spark, T.reject_reason(c, T.normalize_text(c), F.lit(seconds).cast("double"))) == reason


@pytest.mark.parametrize(
    "text, want",
    [
        ("O'zbek g`alaba ma’no", "oʻzbek gʻalaba maʼno"), ("Ўзбек Ерда объект поезд", "oʻzbek yerda obʼyekt poyezd"), ("0 va 1000", "nol va ming"), ("2 345 678 so'm", "ikki million uch yuz qirq besh ming olti yuz yetmish sakkiz soʻm"),
        ("30% va 5 2026", "oʻttiz foiz va besh ikki ming yigirma olti"), ("", ""), ("!?", ""),
    ],
)
def test_frontend_normalize(spark, text, want):
    assert one(spark, T.frontend_normalize(F.lit(text))) == want


def test_numbers_beyond_the_scales_stay(spark):
    assert one(spark, T.int_to_words(F.lit("1" + "0" * 18))) is None
    assert one(spark, T.expand_numbers(F.lit("n " + "9" * 25))) == "n " + "9" * 25


def test_text_functions(spark):
    assert one(spark, T.join_clitics(F.lit("da bor da ku men chi"))) == "da bordaku menchi"
    assert one(spark, T.capitalize_sentences(F.lit("salom. qalay? yaxshi"))) == "Salom. Qalay? Yaxshi"
    assert one(spark, T.capitalize_sentences(F.lit(" salom.  qalay?\nyaxshi!\tha.yo‘q . o"))) == " Salom.  Qalay?\nYaxshi!\tHa.yo‘q . O"
    assert one(spark, T.capitalize_sentences(F.lit(""))) == "" and one(spark, T.capitalize_sentences(F.lit("Привет. да"))) == "Привет. да"
    assert one(spark, T.int_to_words(F.lit("-7"))) == "minus yetti" and one(spark, T.int_to_words(F.lit("1000001000"))) == "bir milliard ming" and one(spark, T.int_to_words(F.lit("-"))) is None
    assert one(spark, T.expand_numbers(F.lit("٣ kun, १२ % va 1 000"))) == "uch kun, oʻn ikki foiz va ming"
    assert one(spark, T.punct_target(F.lit("Salom , dunyo !  «ha»"))) == "salom, dunyo! ha"
    assert one(spark, T.word_distance(F.split(F.lit("a b c d e"), " "), F.split(F.lit("a x c d e"), " "))) == 1
    assert one(spark, T.encode(F.lit("ab–a"), ["a", "b", " "])) == [0, 1, 2, 0]
    assert one(spark, T.encode(F.lit("az"), ["a"])) is None
    assert one(spark, T.transliterate(F.lit("ШУМ Шум"))) == "SHUM Shum"


def test_urls(spark):
    u = F.lit("https://www.video.example/@Soz/videos?x=1")
    assert one(spark, U.canonical_channel(u, "https://video.example", "v.example")) == "https://video.example/@Soz/videos"
    assert one(spark, U.mint_id(u)) == "ch_soz"
    assert one(spark, U.video_id(F.lit("https://v.example/abcdefghijk"), "v.example")) == "abcdefghijk"
    assert one(spark, U.video_id(F.lit("https://video.example/shorts/abcdefghijk"), "v.example")) == "abcdefghijk"
    assert one(spark, U.video_id(F.lit("https://video.example/watch?v=short"), "v.example")) is None
    assert one(spark, U.extract_tags(F.lit("#Podkast #ta'lim #vlog #vlog"))) == ["podkast", "talim", "vlog"]
    assert one(spark, U.extract_links(F.lit("see https://a.b/c, (https://a.b/d) https://a.b/c!"))) == ["https://a.b/c", "https://a.b/d"]
    assert one(spark, U.is_video_host(F.lit("not a url"), "video.example", "v.example")) is False


def test_median_and_runs(spark):
    assert one(spark, I.median(F.array(*map(F.lit, [0.0, 1.0, 0.0, 0.0])), 3)) == [0.0, 0.0, 0.0, 0.0]
    assert one(spark, I.median(F.array(*map(F.lit, [0.0, 1.0, 2.0])), 2)) == [0.0, 0.5, 1.5]
    track = [0.1] * 10 + [0.8] * 10 + [0.1] * 10
    df = spark.createDataFrame([(1, track)], "k int, t array<double>")
    assert [tuple(r) for r in I.runs(df, "k", "t", "t", 0.5).collect()] == [(1, 10, 20, 0.8)]


def test_clamp_spans(spark):
    df = spark.createDataFrame([(0, 1000), (10_000, 15_000), (20_000, 65_000)], "s long, e long")
    rows = I.clamp_spans(df, "s", "e", 2_000, 20_000).collect()
    assert sorted((r["part_start"], r["part_end"]) for r in rows) == [(10_000, 15_000), (20_000, 35_000), (35_000, 50_000), (50_000, 65_000)]


def test_nearest_takes_the_lowest_of_equals(spark):
    assert one(spark, I.nearest(F.array(F.lit(0), F.lit(10), F.lit(20)), F.lit(15))) == 1


def test_budget_and_batches(spark):
    rows = spark.createDataFrame([("a", i, 1800) for i in range(3)] + [("b", i, 1800) for i in range(2)], "source string, id int, sec long")
    budgets = spark.createDataFrame([("a", 3600)], "source string, budget long")
    kept = S.cap_by_budget(rows, "source", budgets, "sec", [F.col("id")])
    assert sorted((r["source"], r["id"]) for r in kept.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    batched = S.greedy_batches(rows.where("source = 'a'"), "source", ["id"], "sec", 4500, [])
    assert sorted(r["batch"] for r in batched.collect()) == [0, 0, 1]


def test_spread_rank_over_a_hot_group(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else None, i % 50, i) for i in range(600)], "g string, v int, id int")
    got = {r["id"]: r["rank"] for r in spread_rank(rows, ["g"], [F.col("v").desc(), F.col("id")], partitions=7).collect()}
    want = {}
    for g in ("hot", None):
        ordered = sorted((i for i in range(600) if ("hot" if i % 3 else None) == g), key=lambda i: (-(i % 50), i))
        want |= {i: n + 1 for n, i in enumerate(ordered)}
    assert got == want


def test_segment_issues(spark):
    schema = "id string, speaker_id string, channel_id string, text string, text_normalized string, style_caption string, source string, duration double, sample_rate int, quality_tag string, license string, asr_cer double, asr_compression_ratio double, lang_prob double"
    good = ("a1", "s1", None, None, None, None, "x", 1.0, 16000, None, "owned", 1.4, None, None)
    bad = {"id": "A b", "duration": -1.0, "asr_cer": -0.1, "lang_prob": 1.5, "text_normalized": "x", "license": "y"}
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [good] + [tuple(bad[k] if k == n else v for n, v in zip(names, good)) for k in bad]
    issues = [r["i"] for r in spark.createDataFrame(rows, schema).select(M.segment_issues().alias("i")).collect()]
    assert issues[0] == "" and all(issues[1:])


def test_json_lines(spark, tmp_path):
    from pyspark.sql.types import StructType

    from sozmill.sources.jsonl import ManifestError, append_then_compact, manifest_issues, numbered_lines, scan_strict

    path = tmp_path / "m.jsonl"
    path.write_text('{"id": "b", "n": 1}\n\n{"id": "a", "n": 2}\n', "utf-8")
    schema = StructType.fromDDL("id string, n int")
    assert [r["line_no"] for r in numbered_lines(spark, str(path)).orderBy("line_no").collect()] == [1, 3]
    rows = scan_strict(spark, str(path), schema)
    assert rows.count() == 2
    out = str(tmp_path / "out")
    assert append_then_compact(spark, rows, out, "id", schema) == 2
    assert append_then_compact(spark, rows, out, "id", schema) == 2
    assert [r["id"] for r in spark.read.schema(schema).json(out).collect()] == ["a", "b"]
    path.write_text('{"id": "b"}\nnot json\n{"id": "c", "zz": 1}\n', "utf-8")
    assert [r["line_no"] for r in manifest_issues(numbered_lines(spark, str(path)), schema).where("issue is not null").orderBy("line_no").collect()] == [2, 3]
    with pytest.raises(ManifestError, match="m.jsonl:2"):
        scan_strict(spark, str(path), schema)


def test_strict_scan_applies_the_rules(spark, tmp_path):
    from sozmill.sources.jsonl import ManifestError, manifest_issues, numbered_lines, scan_strict

    schema = spark.read.parquet("/root/testdata/sf0.001/segments.parquet").drop("written_at").schema
    good = {"id": "a1", "audio_path": "x.wav", "speaker_id": "s1", "duration": 1.0, "sample_rate": 24000, "source": "s", "license": "owned"}
    path = tmp_path / "m.jsonl"
    lines = [good, good | {"id": "B"}, good, {}, good | {"id": "a2", "lang_prob": 1.5}, good | {"id": "a2"}]
    path.write_text("\n".join(map(json.dumps, lines)), "utf-8")
    found = {r["line_no"]: r["issue"] for r in manifest_issues(numbered_lines(spark, str(path)), schema, M.segment_issues(), "id").where("issue is not null").collect()}
    # The second a1 repeats the first; a2 on line 5 is broken, so line 6 is its first.
    assert set(found) == {2, 3, 4, 5} and found[3] == "duplicate id: a1" and "duration" in found[4]
    with pytest.raises(ManifestError, match="m.jsonl:2: id: bad identifier"):
        scan_strict(spark, str(path), schema, M.segment_issues(), "id")
    path.write_text("{}\n", "utf-8")
    with pytest.raises(ManifestError, match="m.jsonl:1"):
        scan_strict(spark, str(path), schema, M.segment_issues())


def test_manifest_survives_what_cannot_be_read(spark, tmp_path):
    from pyspark.sql.types import StructType

    from sozmill.sources import jsonl

    schema = StructType.fromDDL("id string, n int")
    out, rows = tmp_path / "out", spark.createDataFrame([("b", 1), ("b", 1), ("a", 2)], schema)
    assert jsonl.append_then_compact(spark, rows, str(out), "id", schema) == 2
    held = sorted(p.read_text() for p in out.glob("*.json"))
    broken = out / "part-broken.json"
    broken.write_text("not json\n")
    with pytest.raises(jsonl.ManifestError):
        jsonl.append_then_compact(spark, rows, str(out), "id", schema)
    broken.unlink()
    (out / ".part-broken.json.crc").unlink(missing_ok=True)
    failing = rows.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        jsonl.publish(failing, str(out))
    assert sorted(p.read_text() for p in out.glob("*.json")) == held


def _wav(seconds, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * int(seconds * rate))
    return out.getvalue()


def test_media(spark, tmp_path):
    from sozmill.sources import media

    for name, content, done in (("v1", _wav(2), True), ("v2", b"broken", True), ("v3", _wav(1), False)):
        folder = tmp_path / "raw" / "ch" / name
        folder.mkdir(parents=True)
        (folder / "audio.wav").write_bytes(content)
        if done:
            (folder / ".done").write_text("x")
        if name != "v2":
            (folder / "meta.json").write_text(json.dumps({"id": name, "title": "T", "channel": " ", "uploader": "Ali", "duration": 2}), "utf-8")
    rows = {r["video"]: r for r in media.scan_recordings(spark, str(tmp_path / "raw")).collect()}
    assert set(rows) == {"v1", "v2"} and math.isclose(rows["v1"]["duration"], 2.0) and rows["v2"]["issue"] == "unreadable audio"
    assert rows["v1"]["owner"] == "Ali" and rows["v1"]["issue"] is None
    (tmp_path / "raw" / "ch" / "v1" / "v1_00001.wav").write_bytes(_wav(0))
    found = {r["id"]: r["issue"] for r in media.scan_segments(spark, str(tmp_path / "raw")).collect()}
    assert found == {"ch_v1_audio": None, "ch_v1_v1_00001": "empty audio", "ch_v2_audio": "unreadable audio"}
    cut_short = _wav(1)[:44] + b"\0" * 16000
    lengths = spark.createDataFrame([(_wav(2),), (cut_short,), (b"x",), (None,)], "c binary").select(media.duration_of("c").alias("d")).collect()
    assert [r["d"] for r in lengths] == [2.0, 0.5, None, None]
    assert spark.createDataFrame([(_wav(0.001),)], "c binary").select(F.size(media.mono_samples("c")).alias("n")).first()["n"] == 16
    cut = spark.createDataFrame([(_wav(2), 0, 16000), (_wav(1), 20000, 30000), (None, 0, 1)], "c binary, a long, b long").select(media.wav_header(media.wav_cut("c", "a", "b")).alias("h"))
    assert [r["h"]["frames"] for r in cut.collect()] == [16000, None, None]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "dev.tsv").write_text("1\ta.wav\tsalom \"dunyo\nbad line\n", "utf-8")
    with tarfile.open(tmp_path / "t" / "x.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("wav/a.wav")
        info.size = len(_wav(1))
        tar.addfile(info, io.BytesIO(_wav(1)))
    speech = media.read_speech(spark, str(tmp_path / "t" / "*.tsv"), str(tmp_path / "t" / "*.tar.gz")).collect()
    assert [(r["text"], r["split"], len(r["content"])) for r in speech] == [('salom "dunyo', "val", len(_wav(1)))]


def test_dereference(spark, tmp_path):
    from sozmill.sources.media import dereference, scan_corpus

    corpus = tmp_path / "src" / "data"
    corpus.mkdir(parents=True)
    pd.DataFrame({"audio": [{"bytes": f"b{i}".encode(), "path": None} for i in range(10)], "n": range(10)}).to_parquet(corpus / "p.parquet", row_group_size=3)
    (tmp_path / "x.wav").write_bytes(b"w")
    rows = [(1, "a", "src/data/p.parquet", 1, None), (2, "a", None, None, str(tmp_path / "x.wav")), (3, "a", None, None, "/missing"), (4, "a", "src/data/p.parquet", 9, None), (5, "a", "src/data/p.parquet", 10, None)]
    rows += [(6, "a", "src/gone.parquet", 0, None), (7, "a", "src/data/p.parquet", 1, None), (8, "a", "src/data/p.parquet", None, None), (9, "a", None, None, None)]
    manifest = spark.createDataFrame(rows, "sample_id int, source string, parquet string, row_no long, audio_filepath string")
    got = {r["sample_id"]: r["content"] for r in dereference(manifest, str(tmp_path)).collect()}
    assert got == {1: b"b1", 2: b"w", 3: None, 4: b"b9", 5: None, 6: None, 7: b"b1", 8: None, 9: None}
    assert dereference(manifest.limit(0), str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="unknown sources: a"):
        dereference(manifest, str(tmp_path), sources={"b": "b"})
    left = dereference(manifest.where("sample_id in (1, 4)"), str(tmp_path), sources={"a": "."}, finished=manifest.where("sample_id = 1"))
    assert [(r["sample_id"], r["content"]) for r in left.collect()] == [(4, b"b9")]
    scanned = scan_corpus(spark, str(corpus / "*.parquet"), ["n"])
    assert scanned.columns == ["file", "row_no", "n"] and all(r["row_no"] == r["n"] for r in scanned.collect())


def test_shards_and_splits(spark, tmp_path):
    from sozmill.sources.shards import fan_out, write_shards

    rows = spark.createDataFrame([("x/a.parquet", 1, "train"), ("x/a.parquet", 2, "val"), ("y/b.parquet", 3, "train")], "file string, n int, split string")
    out = str(tmp_path / "shards")
    assert sorted(r["rows"] for r in write_shards(rows.where("file = 'x/a.parquet'"), "file", out).collect()) == [2]
    changed = rows.withColumn("n", F.col("n") + 10)
    assert sorted(r["rows"] for r in write_shards(changed, "file", out).collect()) == [1, 2]
    assert sorted(r["n"] for r in spark.read.json(out).collect()) == [1, 2, 13]
    assert fan_out(rows, str(tmp_path / "splits")) == {"train": 2, "val": 1, "test": 0}
    assert (tmp_path / "splits" / "split=test").is_dir()
    with pytest.raises(ValueError, match="unknown split"):
        fan_out(rows.withColumn("split", F.lit("dev")), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_stages_keep_a_record(spark, tmp_path):
    from sozmill.streaming.incremental import journal, mark, pending, progress, response

    rows, audit = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), str(tmp_path / "audit")
    assert pending(spark, rows, audit, "cut", "k").count() == 3
    mark(rows.where("k = 'a'"), audit, "cut", "k")
    mark(rows.where("k = 'b'"), audit, "cut", "k", "filtered", F.lit("short"))
    assert [r["k"] for r in pending(spark, rows, audit, "cut", "k").collect()] == ["c"] and pending(spark, rows, audit, "score", "k").count() == 3
    journal(rows, str(tmp_path / "log"))
    journal(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("at is not null").count() == 6
    lines = [json.loads(x) for x in response(rows.orderBy("k"), {"source": "s"})]
    assert lines[0] == {"type": "meta", "source": "s"} and lines[1] == {"type": "row", "k": "a"} and lines[-1] == {"type": "done", "rows": 3}
    broken = [json.loads(x) for x in response(rows.select(F.raise_error(F.lit("no")).alias("k")), {})]
    assert broken[-1]["type"] == "error"
    assert progress(10, 30, 60.0)["minutes_left"] == 2 and progress(0, 3, 1.0)["per_minute"] is None


def test_scorers(spark):
    from sozmill.sources.scorers import tag_events

    def screen():
        return lambda pdf: pd.DataFrame([(c, l, s) for c in pdf["clip_id"] for l, s in (("laughter", 0.06), ("music", 0.1))], columns=["clip_id", "label", "score"])

    def localize():
        return lambda pdf: pd.DataFrame([(c, l, 0, 500, 0.9) for c, l in zip(pdf["clip_id"], pdf["label"])], columns=["clip_id", "label", "start_ms", "end_ms", "score"])

    clips = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    assert sorted((r["clip_id"], r["label"]) for r in tag_events(clips, screen, localize).collect()) == [("a", "laughter"), ("b", "laughter")]


def test_feed_stream(spark, tmp_path):
    from sozmill.streaming.feed import follow

    updates, registry = tmp_path / "u", tmp_path / "r"
    updates.mkdir()
    spark.createDataFrame([("ch_old", "https://video.example/@old/videos", 0)], "channel_id string, url string, update_id long").write.parquet(str(registry))

    def put(name, *texts):
        lines = [json.dumps({"update_id": i, kind: {"message_id": i, "chat": "c", "text": t}}) for i, (kind, t) in enumerate(texts, 1)]
        (updates / name).write_text("\n".join(lines), "utf-8")

    def pull():
        follow(spark, str(updates), str(registry), str(tmp_path / "c"), "video.example", "v.example", "https://video.example").awaitTermination()
        return sorted(r["channel_id"] for r in spark.read.parquet(str(registry)).collect())

    put("a.json", ("channel_post", "https://video.example/@new #vlog"), ("message", "https://video.example/@old"), ("other", "https://video.example/@no"))
    assert pull() == ["ch_new", "ch_old"]
    put("b.json", ("message", "https://video.example/@new https://video.example/@two, https://elsewhere.example/@x"))
    assert pull() == ["ch_new", "ch_old", "ch_two"]
    assert pull() == ["ch_new", "ch_old", "ch_two"]


def test_session_stream_matches_batch(spark, tmp_path):
    from sozmill.streaming.incremental import consolidate_stream, resume, split_failures

    rows = [("a", 0, 100), ("a", 550, 600), ("a", 5000, 5100), ("b", 0, 10)]
    made = spark.createDataFrame(rows, "k string, s long, e long").selectExpr("k", "timestamp_millis(s) s", "timestamp_millis(e) e")
    made.write.parquet(str(tmp_path / "in"))
    stream = consolidate_stream(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), ["k"], "s", "e")
    stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["k"], r["events"]) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert resume(spark, made, str(tmp_path / "none"), "k").count() == 4
    assert resume(spark, made, str(tmp_path / "in"), "k").count() == 0
    good, failed = split_failures(spark.createDataFrame([(1, None), (2, "x")], "id int, error string"))
    assert good.count() == 1 and failed.count() == 1


def test_llm_is_optional(tmp_path):
    """Without the subpackage the rest imports and lists its queries; a broken dependency isn't taken for its absence."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in (root / "sozmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sozmill.llm" not in path.read_text("utf-8")
    shutil.copytree(root / "sozmill", tmp_path / "sozmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**__import__("os").environ, "PYTHONPATH": ""})
    alone = run()
    assert alone.returncode == 0 and int(alone.stdout) > 100
    (tmp_path / "sozmill" / "llm").mkdir()
    (tmp_path / "sozmill" / "llm" / "queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr
