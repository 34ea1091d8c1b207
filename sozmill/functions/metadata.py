"""Loosely typed descriptions of videos as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFO = (
    "id string, webpage_url string, title string, channel string, uploader string, duration double, language string, upload_date string, "
    "subtitles map<string, string>, automatic_captions map<string, string>"
)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def iso_date(c: Column) -> Column:
    """Eight digits as a date with dashes; null for anything else."""
    return F.when(c.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def subtitle_kind(manual: Column, automatic: Column, language: str = "uz") -> Column:
    """manual, automatic or null, by the languages (region suffixes ignored) that the two maps have tracks for."""
    has = lambda m: F.coalesce(F.exists(F.map_keys(m), lambda k: F.substring_index(k, "-", 1) == language), F.lit(False))
    return F.when(has(manual), "manual").when(has(automatic), "automatic")


def parse_info(info: Column, url: Column) -> Column:
    """A struct of video_id, url, title, channel (else the uploader), duration, language, upload_date, uz_subtitles, and an issue.

    An id and a duration are required: without them, or for text that isn't such a description, ``issue`` says so.
    """
    p = F.from_json(info, INFO)
    missing = F.when(_filled(p["id"]).isNull(), "no video id").when(p["duration"].isNull(), "no duration")
    return F.struct(
        p["id"].alias("video_id"), F.coalesce(_filled(p["webpage_url"]), url).alias("url"), F.coalesce(p["title"], F.lit("")).alias("title"), F.coalesce(_filled(p["channel"]), _filled(p["uploader"])).alias("channel"),
        p["duration"].alias("duration"), _filled(p["language"]).alias("language"), iso_date(p["upload_date"]).alias("upload_date"), subtitle_kind(p["subtitles"], p["automatic_captions"]).alias("uz_subtitles"), missing.alias("issue"),
    )
