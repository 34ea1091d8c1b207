"""Interval and frame operators: consolidation with scores, spans, boundaries, medians, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sozmill.operators.coverage import scored_periods

def consolidate(events: DataFrame, entity: list[str], gap_ms: int = 500, least_ms: int = 200) -> DataFrame:
    """entity..., start_ms, end_ms, score: intervals at most ``gap_ms`` apart joined, shorter results dropped, best score kept.

    ``events`` has the entity columns, start_ms, end_ms and score. Ends are stretched by the gap, covered, and drawn back.
    """
    stretched = events.select(*entity, "start_ms", (F.col("end_ms") + gap_ms).alias("reach"), F.col("score").cast("double").alias("score"))
    periods = scored_periods(stretched, entity, "start_ms", "reach", "score")
    return periods.withColumn("end_ms", F.col("end_ms") - gap_ms).where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def clamp_spans(spans: DataFrame, start: str, end: str, least: int, most: int) -> DataFrame:
    """Spans below ``least`` dropped, above ``most`` cut into equal parts: adds part, part_start, part_end."""
    length = F.col(end) - F.col(start)
    parts = F.greatest(F.ceil(length / most), F.lit(1)).cast("int")
    cut = spans.where(length >= least).withColumn("_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    at = lambda k: F.col(start) + F.floor(length * k / F.col("_parts"))
    return cut.withColumns({"part_start": at(F.col("part")), "part_end": at(F.col("part") + 1)}).drop("_parts")


def nearest(boundaries: Column, point: Column) -> Column:
    """0-based index of the boundary nearest to a point, the lowest of equals."""
    distance = F.transform(boundaries, lambda b: F.abs(b - point))
    return F.array_position(distance, F.array_min(distance)) - 1


def median(values: Column, window: int) -> Column:
    """Centred running median with repeated edge values; an even window averages its two middle values."""
    if window <= 1:
        return values
    half, n = window // 2, F.size(values)
    middle = window // 2

    def at(i: Column) -> Column:
        around = F.array_sort(F.transform(F.sequence(i - half, i - half + window - 1), lambda j: F.element_at(values, F.greatest(F.lit(1), F.least(n, j)))))
        upper = F.element_at(around, middle + 1)
        return upper if window % 2 else (F.element_at(around, middle) + upper) / 2

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), at)).otherwise(values)


def runs(tracks: DataFrame, key: str, smoothed: str, raw: str, threshold: float) -> DataFrame:
    """key, first, last, score: stretches of frames whose smoothed value reaches the threshold, scored by the raw maximum."""
    frames = tracks.select(key, F.posexplode(F.arrays_zip(F.col(smoothed).alias("s"), F.col(raw).alias("r"))).alias("frame", "v")).where(F.col("v.s") >= threshold)
    island = F.col("frame") - F.row_number().over(Window.partitionBy(key).orderBy("frame"))
    return frames.withColumn("island", island).groupBy(key, "island").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("last"), F.least(F.max("v.r"), F.lit(1.0)).alias("score")).drop("island")


def quietest(values: Column, width: int) -> Column:
    """0-based middle of the quietest box of ``width`` values within the middle 30 to 70 %, the first of equals."""
    n = F.size(values)
    low, high = F.floor(n * 0.3).cast("int"), F.floor(n * 0.7).cast("int")
    starts = F.sequence(low, F.greatest(low, high - width))
    sums = F.transform(starts, lambda i: F.aggregate(F.slice(values, i + 1, width), F.lit(0).cast("bigint"), lambda a, x: a + F.abs(x)))
    return low + F.array_position(sums, F.array_min(sums)) - 1 + width // 2
