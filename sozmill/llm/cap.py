"""Capping records per dominant contributor by quality-weighted reservoir sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sozmill.session import cut

#: Resolution of the first pass: key buckets per contributor.
BUCKETS = 2048
#: Contributors above their cap (some 60 bytes each) that are sent to every task; beyond, they are joined by a shuffle.
MOST_CUTS = 500_000


def reservoir_key(weight_log: Column, unit: Column, randomness: float) -> Column:
    """Logarithmic exponential key: log weight plus a Gumbel variate, so that the largest keys form a weighted sample.

    With weight w, ``-log(-log u) + log w`` orders rows as ``u ** (1 / w)`` does. ``randomness`` scales the variate; at 0
    the draw is degenerate and the best scores are kept.
    """
    return weight_log if randomness == 0 else weight_log - F.lit(float(randomness)) * F.log(-F.log(unit))


def cap_contributors(records: DataFrame, id_col: str, contributor: str, score: str, cap: Column | int, sharpness: float = 8.0, randomness: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, contributor, keep) with at most ``cap`` kept rows per contributor.

    A lower ``score`` is better (an error rate): log weight is ``-sharpness * score``. Null and NaN scores rank below all
    others, ties go to the smaller id. Records without contributor are always kept; rows with a null id are dropped;
    repeated ids must be resolved before. Other columns are ignored, an empty table gives an empty result.

    The ``cap`` largest keys per contributor are found without gathering a contributor in one task: key buckets are
    counted per contributor, whole buckets above the cut are kept, whole buckets below dropped, and only the bucket that
    holds the cut is ranked, by the same counting over ranges of its rows.
    """
    from sozmill.operators.ranking import spread_rank

    unit = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    bad = F.col(score).isNull() | F.isnan(score)
    ranked = F.when(bad, F.lit(None).cast("double")).otherwise(reservoir_key(-F.lit(float(sharpness)) * F.col(score).cast("double"), unit, randomness))
    cap_col = cap if isinstance(cap, Column) else F.lit(int(cap))
    rows = records.select(F.col(id_col).alias("id"), F.col(contributor).alias("contributor"), ranked.alias("_key"), cap_col.cast("bigint").alias("_cap")).where(F.col("id").isNotNull())
    rows = cut(rows)
    free = rows.where(F.col("contributor").isNull()).select("id", "contributor", F.lit(True).alias("keep"))
    held = rows.where(F.col("contributor").isNotNull())
    # Larger keys get smaller buckets; exp keeps the order and bounds the range, null keys come last.
    squashed = F.exp(F.least(F.col("_key") / float(sharpness), F.lit(0.0)))
    bucket = F.when(F.col("_key").isNull(), BUCKETS).when(F.col("_key") > 0, -1).otherwise(F.floor((1 - squashed) * BUCKETS)).cast("int")
    held = held.withColumn("_bucket", bucket)
    counts = held.groupBy("contributor", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("_cap").alias("_limit"))
    order = Window.partitionBy("contributor").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    through = counts.withColumn("_through", F.sum("_n").over(order)).where(F.col("_through") > F.col("_limit"))
    # One row for each contributor above its cap: the bucket of the cut, and how many of that bucket stay.
    room = F.greatest(F.col("_limit") - F.col("_through") + F.col("_n"), F.lit(0))
    cuts = cut(through.groupBy("contributor").agg(F.min(F.struct(F.col("_bucket").alias("at"), room.alias("room"))).alias("_cut")))
    # All rows of a contributor would be one join key, so the cuts are sent to them; with a cap above 1 they are few.
    few = cuts.count() <= MOST_CUTS
    marked = held.join(F.broadcast(cuts) if few else cuts, "contributor", "left")
    at_cut = (F.col("_bucket") == F.col("_cut.at")) & (F.col("_cut.room") > 0)
    whole = marked.where(~F.coalesce(at_cut, F.lit(False))).select("id", "contributor", F.coalesce(F.col("_bucket") < F.col("_cut.at"), F.lit(True)).alias("keep"))
    split = marked.where(at_cut).select("id", "contributor", "_key", F.col("_cut.room").alias("_room"))
    exact = spread_rank(split, ["contributor"], [F.col("_key").desc_nulls_last(), F.col("id").asc()]).select("id", "contributor", (F.col("rank") <= F.col("_room")).alias("keep"))
    return free.unionByName(whole).unionByName(exact)
