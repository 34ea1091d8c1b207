"""Manifest operators: validation with messages, duplicates, summaries, resume and exclusion joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = "^[a-z0-9][a-z0-9_-]*$"
# Enumerations of the manifest.
QUALITY_TAGS = ("clean", "medium", "noisy")
LICENSES = ("owned", "licensed", "public_domain", "web_scraped")
GENRES = ("conversation", "news", "education", "vlog", "audiobook", "other")
SCRIPTS = ("latin", "cyrillic", "mixed")
STATUSES = ("candidate", "approved", "rejected")


def _text_missing(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _bad(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def segment_issues() -> Column:
    """Messages of all violated rules of one manifest row, joined by '; '; empty when the row is valid."""
    rules = [
        (F.col("id").isNull() | ~F.col("id").rlike(IDENTIFIER), "id: bad identifier"),
        (F.col("speaker_id").isNull() | ~F.col("speaker_id").rlike(IDENTIFIER), "speaker_id: bad identifier"),
        (~F.col("channel_id").rlike(IDENTIFIER), "channel_id: bad identifier"),
        (F.trim("text") == "", "text: blank"),
        (F.trim("text_normalized") == "", "text_normalized: blank"),
        (F.trim("style_caption") == "", "style_caption: blank"),
        (_text_missing("source"), "source: blank"),
        (F.col("duration").isNull() | F.isnan("duration") | (F.col("duration") <= 0), "duration: not above 0"),
        (F.col("sample_rate").isNull() | (F.col("sample_rate") <= 0), "sample_rate: not above 0"),
        (~F.col("quality_tag").isin(*QUALITY_TAGS), "quality_tag: unknown"),
        (F.col("license").isNull() | ~F.col("license").isin(*LICENSES), "license: unknown"),
        (F.col("asr_cer") < 0, "asr_cer: below 0"),
        (F.col("asr_compression_ratio") <= 0, "asr_compression_ratio: not above 0"),
        (~F.col("lang_prob").between(0.0, 1.0), "lang_prob: outside 0 to 1"),
        (F.col("text_normalized").isNotNull() & F.col("text").isNull(), "text_normalized needs text"),
    ]
    return F.concat_ws("; ", *[F.when(_bad(condition), message) for condition, message in rules])


def channel_issues(host_ok: Column) -> Column:
    """Messages of all violated rules of one registry row; the reason's rule counts only where every field is sound.

    ``host_ok`` says whether the address is of the video site.
    """
    unknown = lambda c, values: (F.col(c).isNull() | ~F.col(c).isin(*values), f"{c}: unknown")
    rules = [
        (F.col("channel_id").isNull() | ~F.col("channel_id").rlike(IDENTIFIER), "channel_id: bad identifier"),
        (~F.coalesce(host_ok, F.lit(False)), "url: other host"),
        (_text_missing("name"), "name: blank"),
        unknown("genre", GENRES), unknown("script", SCRIPTS), unknown("est_quality", QUALITY_TAGS), unknown("status", STATUSES),
        (F.trim("reject_reason") == "", "reject_reason: blank"),
        (F.trim("notes") == "", "notes: blank"),
    ]
    fields = F.concat_ws("; ", *[F.when(_bad(condition), message) for condition, message in rules])
    rejected = F.col("status") == "rejected"
    reason = F.when(rejected & F.col("reject_reason").isNull(), "reject_reason missing").when(~rejected & F.col("reject_reason").isNotNull(), "reject_reason without rejection").otherwise("")
    return F.when(fields != "", fields).otherwise(reason)


def outside_bounds(seconds: Column, least: float | None = None, most: float | None = None) -> Column:
    """Why a duration is rejected, or null; a bound that is None or 0 does not count. Halves are shown as the even second."""
    out = F.lit(None).cast("string")
    if most:
        out = F.when(seconds > most, F.format_string(f"duration %.0fs > max {most:.0f}s", F.bround(seconds, 0))).otherwise(out)
    if least:
        out = F.when(seconds < least, F.format_string(f"duration %.0fs < min {least:.0f}s", F.bround(seconds, 0))).otherwise(out)
    return out


def exclusion_rows(maps: DataFrame, column: str) -> DataFrame:
    """(parquet, row_no) of JSON maps of file to rows, each once; text that isn't such a map excludes nothing."""
    parsed = maps.select(F.explode(F.from_json(column, "map<string, array<bigint>>")).alias("parquet", "rows"))
    return parsed.select("parquet", F.explode("rows").alias("row_no")).dropna().distinct()


def later_duplicates(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows that repeat a key met earlier; the first of a key isn't reported.

    The first is a minimum per key, so a key of any number of rows is reduced before it is shuffled.
    """
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order)).alias("_first"))
    return df.withColumn("_at", F.struct(*order)).join(first, F.col(key) == F.col("_k")).where("_at > _first").drop("_k", "_at", "_first")


def last_wins(df: DataFrame, key: Column, order: Column, columns: list[str]) -> DataFrame:
    """The last row per key by ``order``; partial maxima before the shuffle, ties by content."""
    packed = F.struct(order.alias("_o"), *[F.col(c) for c in columns])
    return df.groupBy(key.alias("key")).agg(F.max(packed).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in columns])


def hours_by(df: DataFrame, group: Column, millis: Column, name: str) -> DataFrame:
    """Rows and hours per group, summed as whole milliseconds; a null group is '(none)'."""
    return df.groupBy(F.coalesce(group, F.lit("(none)")).alias(name)).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(millis) / 3600000.0, 6).alias("hours"))
