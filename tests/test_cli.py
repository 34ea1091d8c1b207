"""The command line: results, messages and exit codes."""

import json

import pytest

from sozmill.cli import load_settings, main
from sozmill.plans.report import merged_stats, percent_bar

GOOD = {"id": "a1", "audio_path": "x.wav", "speaker_id": "s1", "duration": 3600.0, "sample_rate": 24000, "source": "s", "license": "owned", "channel_id": "ch_a"}
CHANNEL = {"channel_id": "ch_a", "url": "https://video.example/@a", "name": "A & <b>", "genre": "news", "script": "latin", "est_quality": "clean", "status": "approved"}


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n", "utf-8")
    return str(path)


def test_manifest_commands(spark, tmp_path, capsys):
    path = write(tmp_path / "m.jsonl", [GOOD, GOOD | {"id": "a2", "channel_id": "ch_b", "duration": 1800.0}])
    assert main(["validate", path], spark) == 0 and "2 segment(s) ok" in capsys.readouterr().out
    assert main(["stats", path], spark) == 0
    assert capsys.readouterr().out.splitlines() == [f"{'ch_a':<24} {1:>8.2f} h", f"{'ch_b':<24} {0.5:>8.2f} h", "total: 2 segment(s), 1.50 h"]
    assert main(["hash", path], spark) == 0 and len(capsys.readouterr().out.strip()) == 64
    broken = write(tmp_path / "b.jsonl", [GOOD, {}, GOOD])
    assert main(["validate", broken], spark) == 1
    err = capsys.readouterr().err
    assert "b.jsonl:2: " in err and "b.jsonl:3: duplicate id: a1" in err
    assert main(["validate", str(tmp_path / "none")], spark) == 2 and main(["nonsense"], spark) == 2
    assert main(["query", "/root/testdata/sf0.001", "--name", "nothing", "--out", str(tmp_path / "q")], spark) == 2
    assert main(["query", "/root/testdata/sf0.001", "--name", "split_counts", "--out", str(tmp_path / "q")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3


def test_channel_commands(spark, tmp_path, capsys):
    rows = [CHANNEL, CHANNEL | {"channel_id": "ch_b", "genre": "vlog"}, CHANNEL | {"channel_id": "ch_c", "status": "rejected", "reject_reason": "old"}]
    registry, fetched, out = write(tmp_path / "c.jsonl", rows), write(tmp_path / "f.jsonl", [{"channel_id": "ch_a", "video_count": 3, "hours": 750.0}, {"channel_id": "ch_b", "error": "gone"}]), str(tmp_path / "stats")
    assert main(["channels-stats", registry, "--out", out, "--fetched", fetched], spark) == 1
    said = capsys.readouterr()
    assert "failed: ch_b: gone" in said.err and "gate: 750.00 of 1000 h, not met" in said.out and "missing: 1" in said.out
    write(tmp_path / "f.jsonl", [{"channel_id": "ch_a", "error": "gone"}, {"channel_id": "ch_b", "video_count": 1, "hours": 250.0}])
    assert main(["channels-stats", registry, "--out", out, "--fetched", fetched, "--refresh"], spark) == 1
    assert "gate: 1000.00 of 1000 h, met" in capsys.readouterr().out
    assert main(["report", registry, "--out", str(tmp_path / "p.html"), "--stats", out], spark) == 0
    page = (tmp_path / "p.html").read_text("utf-8")
    assert "A &amp; &lt;b&gt;" in page and "<td>–</td>" in page and "75.0%" in page
    bad = write(tmp_path / "bad.jsonl", [CHANNEL | {"genre": "x"}, CHANNEL | {"url": "https://other.example/"}, CHANNEL | {"status": "rejected"}, CHANNEL | {"reject_reason": "r"}])
    assert main(["channels-validate", bad], spark) == 1
    assert [line.split(": ", 1)[1] for line in capsys.readouterr().err.splitlines()] == ["genre: unknown", "url: other host", "reject_reason missing", "reject_reason without rejection"]


def test_a_failed_fetch_keeps_what_was_known(spark):
    channels = spark.createDataFrame([("a", "approved"), ("b", "candidate"), ("c", "rejected")], "channel_id string, status string")
    known = spark.createDataFrame([("a", 1, 1.0)], "channel_id string, video_count int, hours double")
    fetched = spark.createDataFrame([("a", None, None, "x"), ("b", 2, 2.0, None)], "channel_id string, video_count int, hours double, error string")
    got = {r["channel_id"]: tuple(r)[1:] for r in merged_stats(channels, known, fetched, True).collect()}
    assert got == {"a": (1, 1.0, "x"), "b": (2, 2.0, None)}


def test_settings_and_bars(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"site": "a.example", "wanted_hours": 5}')
    assert load_settings(str(path), site="b.example").site == "b.example" and load_settings(str(path)).wanted_hours == 5
    path.write_text('{"sitee": 1}')
    with pytest.raises(ValueError, match="sitee"):
        load_settings(str(path))
    assert percent_bar(150, 100) == (100.0, "150.0%") and percent_bar(1, 0) == (0.0, "0.0%")
