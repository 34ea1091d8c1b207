"""Reports of a registry: aggregates computed in the cluster, laid out as fixed-width text or as a page."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent_bar(value: float, total: float) -> tuple[float, str]:
    """Width of a bar, at most 100, and its label, which isn't capped; nothing of nothing is 0."""
    share = value / total * 100 if total else 0.0
    return min(share, 100.0), f"{share:.1f}%"


def genre_hours(channels: DataFrame, stats: DataFrame) -> DataFrame:
    """genre, channels, videos, hours and missing counts of the channels that aren't rejected; at most one row a genre."""
    joined = channels.where("status <> 'rejected'").join(stats.select("channel_id", "video_count", "hours"), "channel_id", "left")
    hours = F.coalesce(F.sum("hours"), F.lit(0.0))
    return joined.groupBy("genre").agg(F.count(F.lit(1)).alias("channels"), F.coalesce(F.sum("video_count"), F.lit(0)).alias("videos"), hours.alias("hours"), F.count_if(F.col("hours").isNull()).alias("missing"))


def text_report(channels: DataFrame, stats: DataFrame, wanted_hours: float = 1000.0) -> str:
    """Genres by hours with their shares, the total, channels without a count, and whether the wanted hours are reached."""
    rows = sorted(genre_hours(channels, stats).collect(), key=lambda r: (-r["hours"], r["genre"] or ""))
    total, missing = sum(r["hours"] for r in rows), sum(r["missing"] for r in rows)
    lines = [f"{'genre':<14}{'channels':>10}{'videos':>10}{'hours':>12}{'share':>9}"]
    lines += [f"{r['genre'] or '-':<14}{r['channels']:>10}{r['videos']:>10}{r['hours']:>12.2f}{percent_bar(r['hours'], total)[1]:>9}" for r in rows]
    lines.append(f"{'total':<14}{sum(r['channels'] for r in rows):>10}{sum(r['videos'] for r in rows):>10}{total:>12.2f}{percent_bar(total, total)[1]:>9}")
    if missing:
        lines.append(f"missing: {missing} channel(s) without a count")
    lines.append(f"gate: {total:.2f} of {wanted_hours:.0f} h, {'met' if total >= wanted_hours else 'not met'}")
    return "\n".join(lines)


def page(channels: DataFrame, stats: DataFrame, raw: DataFrame, speech: DataFrame, generated_at: str, wanted_hours: float = 1000.0) -> Iterator[str]:
    """The same as an HTML page with a row per channel, in pieces; all text is escaped, missing counts are a dash.

    ``raw`` and ``speech`` have channel_id and hours.
    """
    rows = sorted(genre_hours(channels, stats).collect(), key=lambda r: (-r["hours"], r["genre"] or ""))
    total = sum(r["hours"] for r in rows)
    cell = lambda v: f"<td>{html.escape(str(v), quote=True)}</td>"
    yield f"<!doctype html><meta charset='utf-8'><title>Channels</title><h1>Channels</h1><p>{html.escape(generated_at)}</p>"
    width, label = percent_bar(total, wanted_hours)
    yield f"<p>{total:.2f} h of {wanted_hours:.0f} h</p><div style='width:{width:.1f}%'>{label}</div><table>"
    for r in rows:
        yield f"<tr>{cell(r['genre'] or '-')}{cell(r['channels'])}{cell(f'{r['hours']:.2f}')}{cell(percent_bar(r['hours'], total)[1])}</tr>"
    yield "</table><table>"
    joined = channels.join(stats.select("channel_id", "hours"), "channel_id", "left").join(raw.select("channel_id", F.col("hours").alias("raw")), "channel_id", "left")
    joined = joined.join(speech.select("channel_id", F.col("hours").alias("speech")), "channel_id", "left").orderBy("channel_id")
    for r in joined.select("channel_id", "name", "status", "hours", "raw", "speech").toLocalIterator():
        counted = "–" if r["hours"] is None else f"{r['hours']:.2f}"
        yield f"<tr>{cell(r['channel_id'])}{cell(r['name'])}{cell(r['status'])}{cell(counted)}{cell(f'{r['raw'] or 0:.2f}')}{cell(f'{r['speech'] or 0:.2f}')}</tr>"
    yield "</table>"


def merged_stats(channels: DataFrame, known: DataFrame, fetched: DataFrame, refresh: bool = False) -> DataFrame:
    """channel_id, video_count, hours, error for every channel that isn't rejected.

    ``fetched`` has one row per looked-up channel with the same columns and an ``error``. A known count stays unless
    ``refresh`` brings a new one; a failed fetch never loses what was known.
    """
    side = lambda df, p, *more: df.select("channel_id", *[F.col(c).alias(p + c) for c in ("video_count", "hours", *more)])
    rows = channels.where("status <> 'rejected'").select("channel_id").join(side(known, "k_"), "channel_id", "left").join(side(fetched, "f_", "error"), "channel_id", "left")
    new = F.col("f_error").isNull() & F.col("f_hours").isNotNull()
    take = new if refresh else new & F.col("k_hours").isNull()
    pick: dict[str, Column] = {c: F.when(take, F.col(f"f_{c}")).otherwise(F.col(f"k_{c}")) for c in ("video_count", "hours")}
    failed = F.when(F.lit(refresh) | F.col("k_hours").isNull(), F.col("f_error"))
    return rows.select("channel_id", *[v.alias(c) for c, v in pick.items()], failed.alias("error"))
