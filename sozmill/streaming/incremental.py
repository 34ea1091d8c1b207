"""Incremental runs: sessions of events on a stream, resumable stages, quarantine of failed rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.session import exists


def consolidate_stream(events: DataFrame, entity: list[str], at: str, end: str, gap_ms: int = 500, late: str = "10 minutes") -> DataFrame:
    """Intervals of a stream joined per entity while they are at most ``gap_ms`` apart.

    A session window whose gap is the interval's own length plus the gap gives the same islands as the batch operator; a
    watermark bounds the state. ``at`` and ``end`` are timestamps.
    """
    length = F.unix_millis(F.col(end)) - F.unix_millis(F.col(at)) + gap_ms
    gap = F.concat(length.cast("string"), F.lit(" milliseconds"))
    marked = events.withWatermark(at, late)
    return marked.groupBy(F.session_window(F.col(at), gap).alias("session"), *entity).agg(F.max(end).alias("end_at"), F.count(F.lit(1)).alias("events")).select(*entity, F.col("session.start").alias("start_at"), "end_at", "events")


def resume(spark: SparkSession, source: DataFrame, done: str, key: str) -> DataFrame:
    """Rows of ``source`` whose key is not in the Parquet table at ``done`` (all of them, if there is none yet)."""
    if not exists(spark, done):
        return source
    finished = spark.read.parquet(done).select(key)
    return source.join(finished, key, "left_anti")


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Sound rows without the error column, and the failed rows for a quarantine table."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


# --- stages with a record of what they did --------------------------------------------------------------------------

AUDIT = "stage string, key string, status string, reason string, at timestamp"


def mark(rows: DataFrame, audit: str, stage: str, key: str, status: Column | str = "done", reason: Column | None = None) -> None:
    """Append one row per key to the audit table at ``audit``: ``done`` or ``filtered`` with its reason."""
    state = F.lit(status) if isinstance(status, str) else status
    out = rows.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), state.alias("status"), (F.lit(None) if reason is None else reason).cast("string").alias("reason"), F.current_timestamp().alias("at"))
    out.write.mode("append").parquet(audit)


def pending(spark: SparkSession, source: DataFrame, audit: str, stage: str, key: str) -> DataFrame:
    """Rows of ``source`` that the stage has neither done nor filtered."""
    if not exists(spark, audit):
        return source
    settled = spark.read.schema(AUDIT).parquet(audit).where(F.col("stage") == stage).select(F.col("key").alias("_settled")).distinct()
    return source.join(settled, F.col(key).cast("string") == F.col("_settled"), "left_anti")


def journal(events: DataFrame, path: str) -> None:
    """Append rows with the time of writing as JSON lines."""
    events.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def response(df: DataFrame, meta: dict) -> Iterator[str]:
    """JSON lines of a result as they come: meta, one per row, then done with their number, or an error in its place."""
    yield json.dumps({"type": "meta", **meta}, ensure_ascii=False)
    sent = 0
    try:
        for row in df.select(F.to_json(F.struct(F.lit("row").alias("type"), *df.columns)).alias("line")).toLocalIterator(prefetchPartitions=True):
            yield row["line"]
            sent += 1
    except Exception as e:
        yield json.dumps({"type": "error", "message": str(e).splitlines()[0], "rows": sent}, ensure_ascii=False)
        return
    yield json.dumps({"type": "done", "rows": sent})


def progress(done: int, total: int, seconds: float) -> dict:
    """Rows a minute and the minutes that remain; null before the first row."""
    rate = done / seconds * 60 if seconds > 0 and done else None
    return {"done": done, "total": total, "per_minute": rate, "minutes_left": (total - done) / rate if rate else None}
