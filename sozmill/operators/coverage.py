"""Two-level interval coverage: periods and gaps of labelled intervals per entity.

Level one works inside time shards, so a single entity with a third of all rows is spread over many tasks. Level two
only sees what touches a shard boundary (at most two rows per entity and shard) and one summary row per entity and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sozmill.session import cut

SHARD_MS = 600_000
#: Times beyond this (about 290,000 years in ms) are treated as broken rather than overflowing a cast.
_LIMIT_S = 9.0e12


def to_millis(seconds: Column) -> Column:
    """Seconds as double to whole milliseconds; null for null, NaN and absurd values."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < _LIMIT_S)
    return F.when(ok, F.round(seconds * 1000.0)).cast("bigint")


def coverage(events: DataFrame, entity: list[str], start: str, end: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """Maximal covered stretches and the gaps between them.

    ``events`` holds half-open intervals [start, end) as integers; every other column than ``entity``, ``start`` and
    ``end`` is ignored. Returns ``entity..., kind ('period' | 'gap'), start_ms, end_ms``.

    Rows with a null entity part, a null bound or ``end <= start`` count for nothing; touching and repeated intervals
    join; an entity with one period has no gap; an empty input gives an empty result.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    found = cut(_periods(events, entity, start, end, None, shard_ms).drop("score"))
    by_shard = found.withColumn("shard", F.floor(F.col("s") / F.lit(shard_ms).cast("bigint")).cast("bigint"))
    inner = Window.partitionBy(*keys, "shard").orderBy("s")
    ordered = by_shard.withColumn("next_s", F.lead("s").over(inner))
    summary = by_shard.groupBy(*keys, "shard").agg(F.min("s").alias("first_s"))
    across = summary.withColumn("next_first", F.lead("first_s").over(Window.partitionBy(*keys).orderBy("shard")))
    linked = ordered.where(F.col("next_s").isNotNull()).select(*keys, "s", "e", "next_s").unionByName(
        ordered.where(F.col("next_s").isNull())
        .join(across.select(*keys, "shard", "next_first"), [*keys, "shard"])
        .select(*keys, "s", "e", F.col("next_first").alias("next_s"))
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("next_s").alias("b"))
    rows = F.when(F.col("next_s").isNull(), F.array(period)).otherwise(F.array(period, gap))
    out = linked.select(*keys, F.explode(rows).alias("r"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(entity, keys)], F.col("r.kind").alias("kind"), F.col("r.a").alias("start_ms"), F.col("r.b").alias("end_ms"))


def scored_periods(events: DataFrame, entity: list[str], start: str, end: str, score: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """entity..., start_ms, end_ms, score: the periods of ``coverage`` with the greatest score of the intervals in them.

    Scores travel with the pieces of their intervals through both levels; null scores count only where there is no other.
    """
    found = _periods(events, entity, start, end, score, shard_ms)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(entity)], F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "score")


def _periods(events: DataFrame, entity: list[str], start: str, end: str, score: str | None, shard_ms: int) -> DataFrame:
    """(keys..., s, e, score) of the maximal covered stretches."""
    keys = [f"_k{i}" for i in range(len(entity))]
    value = F.col(score) if score else F.lit(None).cast("double")
    base = (
        events.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"), value.alias("score"))
        .dropna(subset=[*keys, "_s", "_e"])
        .where(F.col("_e") > F.col("_s"))
    )
    size = F.lit(shard_ms).cast("bigint")
    shard_of = lambda c: F.floor(c / size).cast("bigint")
    first, last = shard_of(F.col("_s")), shard_of(F.col("_e") - 1)
    # Head and tail are clipped to their shards; whole shards in between stay one row, however long the interval is.
    head = F.struct(F.col("_s").alias("s"), F.least(F.col("_e"), (first + 1) * size).alias("e"), first.alias("shard"), F.lit(False).alias("whole"))
    tail = F.struct((last * size).alias("s"), F.col("_e").alias("e"), last.alias("shard"), F.lit(False).alias("whole"))
    body = F.struct(((first + 1) * size).alias("s"), (last * size).alias("e"), (first + 1).alias("shard"), F.lit(True).alias("whole"))
    parts = F.when(last == first, F.array(head)).when(last == first + 1, F.array(head, tail)).otherwise(F.array(head, body, tail))
    clipped = base.select(*keys, F.explode(parts).alias("p"), "score").select(*keys, "p.*", "score")
    # Map-side combine: repeated and same-start intervals vanish before the shuffle.
    clipped = clipped.groupBy(*keys, "shard", "whole", "s").agg(F.max("e").alias("e"), F.max("score").alias("score"))

    def islands(rows: DataFrame, order: Window, group: list[str]) -> DataFrame:
        reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("reach", reach).withColumn("island", island).groupBy(*group, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("score").alias("score"))

    # Read several times below; the islands are fewer than the events, and the scan is not repeated.
    merged = cut(islands(clipped, Window.partitionBy(*keys, "shard", "whole").orderBy("s"), [*keys, "shard", "whole"]))
    touches = F.col("whole") | (F.col("s") == F.col("shard") * size) | (F.col("e") == (F.col("shard") + 1) * size)
    inside = merged.where(~touches).select(*keys, "shard", "s", "e", "score")
    stitched = islands(merged.where(touches), Window.partitionBy(*keys).orderBy("s", "e"), keys).select(*keys, "s", "e", "score")

    # A stitched period may hold whole shards whose islands touch no boundary. One row per entity and shard meets the
    # long periods in an ordered pass; the islands follow by entity and shard, so a hot entity stays spread.
    shards = inside.groupBy(*keys, "shard").agg(F.max("score").alias("score")).select(*keys, (F.col("shard") * size).alias("at"), F.lit(1).alias("kind"), "shard", F.lit(None).cast("bigint").alias("le"), "score")
    long = stitched.where(F.col("e") - F.col("s") >= size).select(*keys, F.col("s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("shard"), F.col("e").alias("le"), F.lit(None).cast("double").alias("score"))
    pass_ = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    period = F.last(F.when(F.col("kind") == 0, F.struct(F.col("at").alias("s"), F.col("le").alias("e"))), ignorenulls=True).over(pass_)
    held = shards.unionByName(long).withColumn("p", period).where((F.col("kind") == 1) & (F.col("p.e") >= F.col("at") + size)).select(*keys, "shard", F.col("p.s").alias("s"), "score")
    kept = inside.join(held.select(*keys, "shard"), [*keys, "shard"], "left_anti").select(*keys, "s", "e", "score")
    if score:
        inner = held.groupBy(*keys, "s").agg(F.max("score").alias("inner"))
        stitched = stitched.join(inner, [*keys, "s"], "left").select(*keys, "s", "e", F.greatest("score", "inner").alias("score"))
    return kept.unionByName(stitched)
