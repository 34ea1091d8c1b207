"""Command line: manifests, registries, feeds and queries. Exit code 1 is a partial failure, 2 wrong use or missing input."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEGMENT = (
    "id string, audio_path string, text string, text_normalized string, speaker_id string, channel_id string, duration double, sample_rate int, quality_tag string, snr_db double, "
    "separated boolean, source string, license string, style_caption string, asr_cer double, asr_avg_logprob double, asr_compression_ratio double, lang_prob double"
)
CHANNEL = "channel_id string, url string, name string, genre string, script string, est_quality string, status string, reject_reason string, notes string"
STAT = "channel_id string, video_count int, hours double"


@dataclasses.dataclass(frozen=True)
class Settings:
    """Names and targets that differ between deployments."""

    site: str = "video.example"
    short: str = "v.example"
    base_url: str = "https://video.example"
    wanted_hours: float = 1000.0


def load_settings(path: str | None, **given) -> Settings:
    """Defaults, overridden by a JSON file, overridden by what is given; unknown names raise."""
    values = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    values |= {k: v for k, v in given.items() if v is not None}
    unknown = set(values) - {f.name for f in dataclasses.fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return dataclasses.replace(Settings(), **values)


def _checked(spark: SparkSession, path: str, kind: str, settings: Settings) -> DataFrame:
    from sozmill.functions import urls as U
    from sozmill.operators import manifest as M
    from sozmill.sources.jsonl import manifest_issues, numbered_lines

    if kind == "segments":
        return manifest_issues(numbered_lines(spark, path), StructType.fromDDL(SEGMENT), M.segment_issues(), "id")
    return manifest_issues(numbered_lines(spark, path), StructType.fromDDL(CHANNEL), M.channel_issues(U.is_video_host(F.col("url"), settings.site, settings.short)), "channel_id")


def _validate(spark, args, settings, kind) -> int:
    rows = _checked(spark, args.path, kind, settings)
    for r in rows.where("issue is not null").orderBy("file", "line_no").select("file", "line_no", "issue").toLocalIterator():
        print(f"{r['file']}:{r['line_no']}: {r['issue']}", file=sys.stderr)
    total, broken = rows.agg(F.count(F.lit(1)), F.count_if(F.col("issue").isNotNull())).first()
    if broken:
        return 1
    print(f"{total} {'segment' if kind == 'segments' else 'channel'}(s) ok")
    return 0


def _rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    from sozmill.sources.jsonl import scan_strict

    return scan_strict(spark, path, StructType.fromDDL(ddl))


def _hash(spark, args, settings) -> int:
    from sozmill.sources.media import file_digests

    for r in file_digests(spark, args.path).orderBy("path").collect():
        print(r["sha256"])
    return 0


def _scan(spark, args, settings) -> int:
    from sozmill.sources import media
    from sozmill.sources.jsonl import publish

    rows = (media.scan_segments if args.command == "scan-segments" else media.scan_recordings)(spark, args.path)
    print(f"{publish(rows.where('issue is null').drop('issue'), args.out)} row(s) -> {args.out}")
    place = "path" if "path" in rows.columns else "folder"
    broken = rows.where("issue is not null").select(place, "issue").collect()
    for r in broken:
        print(f"skipped: {r[place]}: {r['issue']}", file=sys.stderr)
    return 1 if broken else 0


def _stats(spark, args, settings) -> int:
    from sozmill.operators import manifest as M

    hours = M.hours_by(_rows(spark, args.path, SEGMENT), F.col("channel_id"), F.round(F.col("duration") * 1000).cast("bigint"), "channel_id")
    rows = hours.orderBy(F.col("hours").desc(), "channel_id").collect()
    for r in rows:
        print(f"{r['channel_id']:<24} {r['hours']:>8.2f} h")
    print(f"total: {sum(r['rows'] for r in rows)} segment(s), {sum(r['hours'] for r in rows):.2f} h")
    return 0


def _channel_stats(spark, args, settings) -> int:
    from sozmill.plans import report
    from sozmill.session import cut, exists
    from sozmill.sources.jsonl import publish

    if _validate(spark, args, settings, "channels"):
        return 1
    channels = _rows(spark, args.path, CHANNEL)
    known = _rows(spark, args.out, STAT) if exists(spark, args.out) else spark.createDataFrame([], STAT)
    fetched = spark.read.schema(STAT + ", error string").json(args.fetched) if args.fetched else spark.createDataFrame([], STAT + ", error string")
    merged = cut(report.merged_stats(channels, known, fetched, args.refresh))
    counts = merged.where("hours is not null").select("channel_id", "video_count", "hours")
    publish(counts, args.out, ["channel_id"])
    print(report.text_report(channels, counts, settings.wanted_hours))
    failed = merged.where("error is not null").collect()
    for r in failed:
        print(f"failed: {r['channel_id']}: {r['error']}", file=sys.stderr)
    return 1 if failed else 0


def _report(spark, args, settings) -> int:
    from sozmill.operators import manifest as M
    from sozmill.plans import report

    def hours(path):
        if not path:
            return spark.createDataFrame([], "channel_id string, hours double")
        return M.hours_by(_rows(spark, path, SEGMENT), F.col("channel_id"), F.round(F.col("duration") * 1000).cast("bigint"), "channel_id")

    stats = _rows(spark, args.stats, STAT) if args.stats else spark.createDataFrame([], STAT)
    with open(args.out, "w", encoding="utf-8") as f:
        f.writelines(report.page(_rows(spark, args.path, CHANNEL), stats, hours(args.raw), hours(args.segments), datetime.now().strftime("%Y-%m-%d %H:%M"), settings.wanted_hours))
    print(f"report -> {args.out}")
    return 0


def _pull(spark, args, settings) -> int:
    from sozmill.session import exists
    from sozmill.streaming.feed import follow

    schema = "channel_id string, url string, update_id long"
    if not exists(spark, args.registry):
        spark.createDataFrame([], schema).write.parquet(args.registry)
    before = spark.read.schema(schema).parquet(args.registry).count()
    query = follow(spark, args.path, args.registry, args.checkpoint, settings.site, settings.short, settings.base_url)
    query.awaitTermination()
    added = spark.read.schema(schema).parquet(args.registry).count() - before
    print(f"added={added}")
    return 0


def _normalize(spark, args, settings) -> int:
    from sozmill.functions import text as T

    for r in spark.read.text(args.path).select(T.frontend_normalize(F.col("value")).alias("v")).toLocalIterator():
        print(r["v"])
    return 0


def _query(spark, args, settings) -> int:
    from sozmill.plans import registry

    known = registry.queries()
    if args.name not in known:
        print(f"unknown query: {args.name}", file=sys.stderr)
        return 2
    known[args.name](spark, args.path).write.mode("overwrite").parquet(args.out)
    print(f"{args.name} -> {args.out}")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("sozmill")
    out.add_argument("--settings")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name, run, *options, **kinds):
        p = commands.add_parser(name)
        p.add_argument("path")
        for option in options:
            p.add_argument(option, **({"action": "store_true"} if option == "--refresh" else {"required": option in kinds.get("needs", ())}))
        p.set_defaults(run=run)
        return p

    add("validate", lambda *a: _validate(*a, "segments"))
    add("channels-validate", lambda *a: _validate(*a, "channels"))
    add("hash", _hash)
    add("scan-raw", _scan, "--out", needs=("--out",))
    add("scan-segments", _scan, "--out", needs=("--out",))
    add("stats", _stats)
    add("channels-stats", _channel_stats, "--out", "--fetched", "--refresh", needs=("--out",))
    add("report", _report, "--out", "--stats", "--raw", "--segments", needs=("--out",))
    add("feed-pull", _pull, "--registry", "--checkpoint", needs=("--registry", "--checkpoint"))
    add("normalize", _normalize)
    add("query", _query, "--name", "--out", needs=("--name", "--out"))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; returns its exit code."""
    from sozmill.session import exists, local_session
    from sozmill.sources.jsonl import ManifestError

    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or local_session()
    try:
        settings = load_settings(args.settings)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if not exists(spark, args.path):
        print(f"not found: {args.path}", file=sys.stderr)
        return 2
    try:
        return args.run(spark, args, settings)
    except ManifestError as e:
        print(e, file=sys.stderr)
        return 1
