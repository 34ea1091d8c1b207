"""Sampling queries over the manifest: budgets, orders, batches, learning rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.functions.keys import key
from sozmill.operators import sampling as S
from sozmill.operators.ranking import spread_rank
from sozmill.plans.catalog import Catalog
from sozmill.plans.texts import _CLEAN, _VOC, VOCABULARY
from sozmill.plans.corpus import _M, _MS, _S, _SEG, _V, _millis, manifest, manifest_rows, segments, videos

CATALOG = Catalog()
add = CATALOG.add
SEED = 7
# Hours per source and in all; parameters of the demonstration queries.
HOURS = {"youtube": 0.1, "volunteer": 0.05, "read_aloud": 0.1}
ALL_HOURS = 0.5
CHANNEL_HOURS = 20

_ORDER = f"sha1('{SEED}:' || CAST(sample_id AS VARCHAR))"
_OK = f"WITH {_M}, d AS (SELECT *, {_MS} AS millis FROM m WHERE duration > 0)"


def _timed(spark, base, *columns):
    return manifest_rows(spark, base).where("duration > 0").select("sample_id", *columns, _millis().alias("millis")).distinct()


_CAP = " ".join(f"WHEN '{s}' THEN {int(h * 3_600_000)}" for s, h in HOURS.items())


@add(f"{_OK}, p AS (SELECT *, coalesce(sum(millis) OVER (PARTITION BY source ORDER BY {_ORDER}, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT sample_id, source FROM p WHERE before < CASE source {_CAP} ELSE 1e18 END")
def source_hour_cap(spark, base):
    rows = _timed(spark, base, "source")
    budgets = spark.createDataFrame([(s, int(h * 3_600_000)) for s, h in HOURS.items()], "source string, budget long")
    return S.cap_by_budget(rows, "source", budgets, "millis", [S.seeded(SEED, F.col("sample_id")), F.col("sample_id")]).select("sample_id", "source")


@add(f"{_OK}, p AS (SELECT *, coalesce(sum(millis) OVER (ORDER BY {_ORDER}, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT sample_id FROM p WHERE before < {int(ALL_HOURS * 3_600_000)}")
def global_hour_limit(spark, base):
    rows = _timed(spark, base).select("sample_id", "millis", F.lit(1).alias("all"))
    summed = S.spread_prefix(rows, ["all"], [S.seeded(SEED, F.col("sample_id")), F.col("sample_id")], "millis")
    return summed.where(F.col("before") < int(ALL_HOURS * 3_600_000)).select("sample_id")


_VC = f"{_S('channel_id')}"


@add(
    f"WITH {_V}, {_SEG}, o AS (SELECT {_VC} AS channel_id, video_id, CAST(round(duration * 1000) AS BIGINT) AS millis FROM v WHERE channel_id IS NOT NULL), "
    f"f AS (SELECT channel_id, sum({_MS}) AS base FROM s WHERE channel_id IS NOT NULL GROUP BY 1), "
    f"p AS (SELECT o.channel_id, coalesce(base, 0) + coalesce(sum(millis) OVER (PARTITION BY o.channel_id ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o LEFT JOIN f ON f.channel_id = o.channel_id) "
    f"SELECT channel_id, count(*) FILTER (WHERE before < 72000000) AS taken, count(*) FILTER (WHERE before >= 72000000) AS remaining FROM p GROUP BY ALL"
)
def channel_hour_cap(spark, base):
    """Videos each channel may still bring, its finished speech counting first, and how many remain when the cap is met."""
    rows = videos(spark, base).where("channel_id is not null").select(key("channel_id").alias("channel_id"), "video_id", _millis().alias("millis"))
    finished = segments(spark, base).where("channel_id is not null").groupBy("channel_id").agg(F.sum(_millis()).alias("base"))
    capped = S.cap_from_base(rows, "channel_id", finished, "millis", [F.col("video_id")], CHANNEL_HOURS * 3_600_000)
    return capped.groupBy("channel_id").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("remaining"))


@add(f"WITH {_M} SELECT sample_id FROM m WHERE source IN ('youtube', 'radio_archive') AND regexp_matches(raw, '[.,?!]')")
def keep_rows(spark, base):
    return manifest_rows(spark, base).where(F.col("source").isin("youtube", "radio_archive") & F.col("raw").rlike("[.,?!]")).select("sample_id").distinct()


@add(f"WITH {_M} SELECT sample_id FROM m WHERE source = 'youtube' ORDER BY sample_id LIMIT 50")
def filter_limit(spark, base):
    return manifest(spark, base, "source").where("source = 'youtube'").orderBy("sample_id").limit(50).select("sample_id")


@add(f"{_OK} SELECT sample_id FROM d WHERE millis BETWEEN 500 AND 30000 ORDER BY source, sample_id LIMIT 200")
def kept_limit(spark, base):
    return _timed(spark, base, "source").where("millis between 500 and 30000").orderBy("source", "sample_id").limit(200).select("sample_id")


@add(f"WITH {_M} SELECT sample_id FROM m WHERE split IN ('val', 'dev') ORDER BY {_ORDER}, sample_id LIMIT 20")
def seeded_sample(spark, base):
    return manifest(spark, base, "split").where("split in ('val', 'dev')").orderBy(S.seeded(SEED, F.col("sample_id")), "sample_id").limit(20).select("sample_id")


@add(f"WITH {_M} SELECT sample_id, row_number() OVER (ORDER BY sha1('9:' || CAST(sample_id AS VARCHAR)), sample_id) AS place FROM m")
def epoch_shuffle(spark, base):
    rows = manifest(spark, base).select("sample_id", F.lit(1).alias("all"))
    return spread_rank(rows, ["all"], [S.seeded(SEED + 2, F.col("sample_id")), F.col("sample_id")], "place").select("sample_id", "place")


_FILE = "coalesce(parquet, audio_filepath)"


@add(f"WITH {_M} SELECT sample_id, row_number() OVER (ORDER BY sha1('8:' || {_FILE}), {_FILE}, row_no, sample_id) AS place FROM m")
def epoch_file_order(spark, base):
    rows = manifest(spark, base, "parquet", "audio_filepath", "row_no").select("sample_id", F.coalesce("parquet", "audio_filepath").alias("file"), F.coalesce("row_no", F.lit(-1)).alias("row_no"), F.lit(1).alias("all"))
    return spread_rank(rows, ["all"], [S.seeded(SEED + 1, F.col("file")), F.col("file"), F.col("row_no"), F.col("sample_id")], "place").select("sample_id", "place")


@add()
def crc_shard(spark, base):
    """Rows each of four workers owns, by CRC-32 of their file; DuckDB has no CRC-32."""
    owner = F.pmod(F.crc32(F.coalesce("parquet", "audio_filepath").cast("binary")), F.lit(4))
    return manifest(spark, base, "parquet", "audio_filepath").groupBy(owner.alias("worker")).agg(F.count(F.lit(1)).alias("rows"))


_BATCHES = f"""{_OK}, f AS (SELECT {_FILE} AS file, sample_id, millis, text, row_number() OVER (PARTITION BY {_FILE} ORDER BY sample_id) AS n FROM d WHERE regexp_matches({_CLEAN}, '^[a-z ''.,?!]*$'))"""


_OPEN = f"""WITH RECURSIVE {_BATCHES.removeprefix('WITH ')}, b AS (
  SELECT file, sample_id, text, n, millis AS longest, 1 AS rows, 0 AS batch FROM f WHERE n = 1
  UNION ALL SELECT f.file, f.sample_id, f.text, f.n,
    CASE WHEN greatest(b.longest, f.millis) * (b.rows + 1) > 60000 THEN f.millis ELSE greatest(b.longest, f.millis) END,
    CASE WHEN greatest(b.longest, f.millis) * (b.rows + 1) > 60000 THEN 1 ELSE b.rows + 1 END,
    CASE WHEN greatest(b.longest, f.millis) * (b.rows + 1) > 60000 THEN b.batch + 1 ELSE b.batch END
  FROM b JOIN f ON f.file = b.file AND f.n = b.n + 1)"""


def _batched(spark, base):
    """Rows whose text can be encoded, in padded batches of at most a minute; other rows are skipped before a batch is formed."""
    ids = T.encode(F.lower("text"), VOCABULARY)
    rows = _timed(spark, base, F.coalesce("parquet", "audio_filepath").alias("file"), "text").where(ids.isNotNull())
    return S.greedy_batches(rows, "file", ["sample_id"], "millis", 60_000, ["text"]).withColumn("ids", ids)


@add(f"{_OPEN} SELECT file, sample_id, batch FROM b")
def greedy_batches(spark, base):
    return _batched(spark, base).select("file", "sample_id", "batch")


_IDS = f"list_transform(list_filter(string_split({_CLEAN}, ''), lambda c: c <> ''), lambda c: CAST(list_position({_VOC}, c) - 1 AS INTEGER))"


@add(
    f"{_OPEN}, e AS (SELECT file, batch, sample_id, {_IDS} AS ids FROM b), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY file, batch) AS longest FROM e) "
    "SELECT file, batch, sample_id, list_concat(ids, list_transform(range(longest - len(ids)), lambda x: CAST(0 AS INTEGER))) AS ids, len(ids) AS length FROM w"
)
def pad_targets(spark, base):
    """Encoded targets of every batch padded to its longest, with their lengths."""
    coded = _batched(spark, base)
    longest = coded.groupBy("file", "batch").agg(F.max(F.size("ids")).alias("longest"))
    joined = coded.join(longest, ["file", "batch"])
    return joined.select("file", "batch", "sample_id", S.pad(F.col("ids"), F.col("longest")).alias("ids"), F.size("ids").cast("bigint").alias("length"))


@add(
    "SELECT n AS step, round(CASE WHEN n < 10 THEN 1e-5 + (1e-4 - 1e-5) * n / 10 ELSE 1e-5 + (1e-4 - 1e-5) * 0.5 * (1 + cos(pi() * least((n - 10) / 90.0, 1))) END, 12) AS rate FROM range(101) t(n)"
)
def lr_schedule(spark, base):
    n = F.col("id")
    warm = F.lit(1e-5) + F.lit(1e-4 - 1e-5) * n / 10
    cosine = F.lit(1e-5) + F.lit(1e-4 - 1e-5) * 0.5 * (1 + F.cos(F.pi() * F.least((n - 10) / F.lit(90.0), F.lit(1.0))))
    return spark.range(101).select(n.alias("step"), F.round(F.when(n < 10, warm).otherwise(cosine), 12).alias("rate"))
