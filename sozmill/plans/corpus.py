"""Corpus queries: preparation, manifests, registry and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.functions import urls as U
from sozmill.functions.keys import key, split_name
from sozmill.functions.metadata import iso_date as as_iso, parse_info
from sozmill.operators import manifest as M
from sozmill.plans.catalog import Catalog, sql_normalize, sql_raw
from sozmill.session import table

CATALOG = Catalog()
add = CATALOG.add
SITE, SHORT = "video.example", "v.example"
BASE_URL = "https://video.example"

_S = lambda c: f"nullif(lower(trim({c})), '')"
#: Distinct manifest rows: exact repeats count once.
_M = f"m AS (SELECT DISTINCT sample_id, parquet, row_no, audio_filepath, duration, text, coalesce(nullif(text_raw, ''), text) AS raw, {_S('source')} AS source, {_S('split')} AS split FROM asr_manifest)"
_SEG = f"""s AS (SELECT lower(trim(id)) AS id, {_S('channel_id')} AS channel_id, {_S('source')} AS source, {_S('speaker_id')} AS speaker_id, text, text_normalized, duration, snr_db,
  asr_cer, asr_avg_logprob, asr_compression_ratio, lang_prob, audio_path FROM segments QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY written_at DESC NULLS LAST) = 1)"""
_C = f"c AS (SELECT DISTINCT {_S('channel_id')} AS channel_id, url, name, {_S('genre')} AS genre, {_S('status')} AS status FROM channels)"
_STAT = f"st AS (SELECT {_S('channel_id')} AS channel_id, video_count, hours FROM channel_stats QUALIFY row_number() OVER (PARTITION BY {_S('channel_id')} ORDER BY counted_at DESC, video_count DESC, hours DESC) = 1)"
_V = "v AS (SELECT DISTINCT * FROM video_meta)"
_MS = "CAST(round(duration * 1000) AS BIGINT)"


def manifest_rows(spark: SparkSession, base: str) -> DataFrame:
    """The manifest as stored, repeats included; columns are pruned by what is selected."""
    raw = F.coalesce(F.nullif("text_raw", F.lit("")), F.col("text"))
    return table(spark, base, "asr_manifest").select("sample_id", "parquet", "row_no", "audio_filepath", "duration", "text", raw.alias("raw"), key("source").alias("source"), key("split").alias("split"))


def manifest(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """sample_id and the named columns, exact repeats once; what a query computes from texts goes in before, so texts aren't shuffled."""
    return manifest_rows(spark, base).select("sample_id", *columns).distinct()


def segments(spark: SparkSession, base: str) -> DataFrame:
    columns = ["text", "text_normalized", "duration", "snr_db", "asr_cer", "asr_avg_logprob", "asr_compression_ratio", "lang_prob", "audio_path"]
    rows = table(spark, base, "segments")
    packed = F.struct("written_at", *[key(c).alias(c) for c in ("channel_id", "source", "speaker_id")], *columns)
    return rows.groupBy(key("id").alias("id")).agg(F.max(packed).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in ["channel_id", "source", "speaker_id", *columns]])


def channels(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "channels").select(key("channel_id").alias("channel_id"), "url", "name", key("genre").alias("genre"), key("status").alias("status")).distinct()


def stats(spark: SparkSession, base: str) -> DataFrame:
    return M.last_wins(table(spark, base, "channel_stats"), key("channel_id"), F.col("counted_at"), ["video_count", "hours"]).withColumnRenamed("key", "channel_id")


def videos(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "video_meta").distinct()


def _millis(c: str = "duration") -> Column:
    return F.round(F.col(c) * 1000).cast("bigint")


# --- preparation -----------------------------------------------------------------------------------------------------

_N = sql_normalize("raw")
_NW = f"len(list_filter(string_split({_N}, ' '), lambda w: w <> ''))"
_REASON = f"""CASE WHEN {_N} = '' THEN 'empty' WHEN regexp_matches(raw, '[\\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨]') THEN 'digits'
 WHEN NOT regexp_full_match({sql_raw('raw').replace(sql_raw('raw'), 'okina')}, '[a-zA-Zʻʼ .,!?—–:;"''()…-]*\\n?') THEN 'charset'
 WHEN duration IS NULL OR duration NOT BETWEEN 0.5 AND 30.0 THEN 'duration' WHEN length({_N}) / duration > 18.0 THEN 'char_rate'
 WHEN {_NW} / duration NOT BETWEEN 0.3 AND 2.67 THEN 'word_rate' END"""


def _sql_okina() -> str:
    from sozmill.plans.catalog import sql_apostrophes

    return sql_apostrophes("raw", T.CORPUS_APOSTROPHES)


_J = f"j AS (SELECT m.*, {_sql_okina()} AS okina FROM m), r AS (SELECT *, {_REASON} AS reason FROM j)"


def _judged(spark: SparkSession, base: str) -> DataFrame:
    """Stored manifest rows with their reason, repeats included."""
    reason = T.bind(T.normalize_text(F.col("raw")), lambda n: T.reject_reason(F.col("raw"), n, F.col("duration")))
    return manifest_rows(spark, base).withColumn("reason", reason)


@add(f"WITH {_M}, {_J} SELECT sample_id, coalesce(reason, 'kept') AS reason FROM r")
def reject_reasons(spark, base):
    return _judged(spark, base).select("sample_id", F.coalesce("reason", F.lit("kept")).alias("reason")).distinct()


_EXCLUDED = "x AS (SELECT DISTINCT parquet, row_no FROM m WHERE split IN ('val', 'dev', 'test') AND parquet IS NOT NULL)"
_FULL = """CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.parquet = r.parquet AND x.row_no = r.row_no) THEN 'excluded' WHEN parquet IS NULL AND audio_filepath IS NULL THEN 'missing_audio'
 WHEN coalesce(duration, 0) <= 0 THEN 'no_duration' ELSE coalesce(reason, 'kept') END"""


def exclusions(spark: SparkSession, base: str) -> DataFrame:
    """Pointers of held-out rows, as an exclusion file would list them, read back from its JSON."""
    held = manifest(spark, base, "parquet", "row_no", "split").where("split in ('val', 'dev', 'test') and parquet is not null")
    # A file's rows are listed in many short maps, none of which grows with the file.
    listed = held.groupBy("parquet", F.floor(F.col("row_no") / 64).alias("part")).agg(F.collect_set("row_no").alias("rows"))
    return M.exclusion_rows(listed.select(F.to_json(F.create_map("parquet", "rows")).alias("json")), "json")


@add(f"WITH {_M}, {_J}, {_EXCLUDED} SELECT source, {_FULL} AS reason, count(*) AS rows FROM r GROUP BY ALL")
def reject_reasons_full(spark, base):
    """The whole cascade: excluded pointers, missing audio, no duration, then the reasons of the text."""
    reason = F.when(F.col("parquet").isNull() & F.col("audio_filepath").isNull(), "missing_audio").when(F.coalesce("duration", F.lit(0.0)) <= 0, "no_duration").otherwise(F.coalesce("reason", F.lit("kept")))
    rows = _judged(spark, base).select("sample_id", "parquet", "row_no", "source", reason.alias("reason")).distinct()
    listed = exclusions(spark, base).withColumn("listed", F.lit(True))
    marked = rows.join(listed, ["parquet", "row_no"], "left")
    return marked.groupBy("source", F.when(F.col("listed"), "excluded").otherwise(F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@add(f"WITH {_M}, {_J} SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS rows, sum({_MS}) AS millis FROM r GROUP BY ALL")
def reject_histogram(spark, base):
    rows = _judged(spark, base).select("sample_id", "source", F.coalesce("reason", F.lit("kept")).alias("reason"), _millis().alias("millis")).distinct()
    return rows.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("millis").alias("millis"))


_BUCKET = "CAST(('0x' || substr(sha1(source || ':' || CAST(sample_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100"
_SPLIT = f"CASE WHEN {_BUCKET} < 96 THEN 'train' WHEN {_BUCKET} < 98 THEN 'val' ELSE 'test' END"


@add(f"WITH {_M} SELECT sample_id, source, {_SPLIT} AS new_split FROM m")
def hash_split(spark, base):
    return manifest(spark, base, "source").select("sample_id", "source", T.hash_split(F.concat_ws(":", "source", F.col("sample_id").cast("string"))).alias("new_split"))


@add(f"WITH {_M}, {_J} SELECT sample_id, parquet, row_no, audio_filepath, {_MS} AS millis, {_N} AS text, {sql_raw('raw')} AS text_raw, source, {_SPLIT} AS split FROM r WHERE reason IS NULL")
def prepare_manifest(spark, base):
    return _prepared(spark, base).distinct()


def _prepared(spark: SparkSession, base: str) -> DataFrame:
    kept = _judged(spark, base).where("reason is null")
    return kept.select(
        "sample_id", "parquet", "row_no", "audio_filepath", _millis().alias("millis"), T.normalize_text(F.col("raw")).alias("text"), T.clean_raw(F.col("raw")).alias("text_raw"), "source",
        T.hash_split(F.concat_ws(":", "source", F.col("sample_id").cast("string"))).alias("split"),
    )


@add(f"WITH {_M}, {_J}, k AS (SELECT {_SPLIT} AS split, duration FROM r WHERE reason IS NULL) SELECT split, count(*) AS rows, sum({_MS}) AS millis FROM k GROUP BY split")
def prepare_summary(spark, base):
    """Flagship: normalise, reject, split, summarise."""
    return _prepared(spark, base).select("sample_id", "split", "millis").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("millis").alias("millis"))


@add(f"WITH {_M}, d AS (SELECT unnest(['train', 'val', 'test']) AS split) SELECT d.split, count(m.sample_id) AS rows FROM d LEFT JOIN m ON d.split = CASE m.split WHEN 'dev' THEN 'val' WHEN 'validation' THEN 'val' ELSE m.split END GROUP BY ALL")
def split_counts(spark, base):
    names = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    counts = manifest(spark, base, "split").groupBy(split_name("split").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("rows"))


@add(f"WITH {_M} SELECT coalesce(split, '(none)') AS split, source, count(*) AS rows, sum({_MS}) AS millis FROM m GROUP BY ALL")
def snapshot_stats(spark, base):
    return manifest(spark, base, "split", "source", "duration").groupBy(F.coalesce("split", F.lit("(none)")).alias("split"), "source").agg(F.count(F.lit(1)).alias("rows"), F.sum(_millis()).alias("millis"))


@add(f"WITH {_M} SELECT sample_id, parquet, row_no FROM m WHERE parquet IS NOT NULL")
def source_scan_pointer(spark, base):
    return manifest(spark, base, "parquet", "row_no").where("parquet is not null")


@add(f"WITH {_M}, x AS (SELECT DISTINCT parquet, row_no FROM m WHERE split IN ('val', 'dev', 'test') AND parquet IS NOT NULL) SELECT count(*) AS kept, (SELECT count(*) FROM m) - count(*) AS excluded FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.parquet = m.parquet AND x.row_no = m.row_no)")
def exclusion_anti_join(spark, base):
    rows = manifest(spark, base, "parquet", "row_no")
    kept = rows.join(exclusions(spark, base), ["parquet", "row_no"], "left_anti").agg(F.count(F.lit(1)).alias("kept"))
    return kept.crossJoin(rows.agg(F.count(F.lit(1)).alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("excluded"))


@add(f"WITH {_M} SELECT a.sample_id, b.sample_id AS other_id FROM m a JOIN m b ON a.parquet = b.parquet AND a.row_no = b.row_no")
def pointer_join(spark, base):
    rows = manifest(spark, base, "parquet", "row_no")
    return rows.join(rows.withColumnRenamed("sample_id", "other_id"), ["parquet", "row_no"]).select("sample_id", "other_id")


@add(f"WITH {_M}, d AS (SELECT DISTINCT parquet FROM m WHERE split = 'val' AND parquet IS NOT NULL) SELECT m.parquet, count(*) AS rows FROM m WHERE parquet IS NOT NULL AND parquet NOT IN (SELECT parquet FROM d) GROUP BY ALL")
def shard_resume(spark, base):
    rows = manifest(spark, base, "parquet", "split").where("parquet is not null")
    done = rows.where("split = 'val'").select("parquet").distinct()
    return rows.join(done, "parquet", "left_anti").groupBy("parquet").agg(F.count(F.lit(1)).alias("rows"))


@add(f"WITH {_M}, {_SEG} SELECT 'manifest' AS kind, source, count(*) AS rows FROM m GROUP BY source UNION ALL SELECT 'segments', source, count(*) FROM s GROUP BY source")
def union_sources(spark, base):
    a = manifest(spark, base, "source").select(F.lit("manifest").alias("kind"), "source")
    b = segments(spark, base).select(F.lit("segments").alias("kind"), "source")
    return a.unionByName(b).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("rows"))


@add("SELECT sample_id, json_object('sample_id', sample_id, 'source', source, 'text', text) AS value FROM (SELECT DISTINCT sample_id, source, text FROM asr_manifest)")
def json_rows(spark, base):
    rows = table(spark, base, "asr_manifest").select("sample_id", "source", "text").distinct()
    return rows.select("sample_id", F.to_json(F.struct("sample_id", "source", "text")).alias("value"))


# --- segments manifest -----------------------------------------------------------------------------------------------

_ISSUES = r"""concat_ws('; ', CASE WHEN id IS NULL OR NOT regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$') THEN 'id: bad identifier' END,
 CASE WHEN speaker_id IS NULL OR NOT regexp_matches(speaker_id, '^[a-z0-9][a-z0-9_-]*$') THEN 'speaker_id: bad identifier' END,
 CASE WHEN NOT regexp_matches(channel_id, '^[a-z0-9][a-z0-9_-]*$') THEN 'channel_id: bad identifier' END, CASE WHEN trim(text) = '' THEN 'text: blank' END,
 CASE WHEN trim(text_normalized) = '' THEN 'text_normalized: blank' END, CASE WHEN trim(style_caption) = '' THEN 'style_caption: blank' END,
 CASE WHEN source IS NULL OR trim(source) = '' THEN 'source: blank' END, CASE WHEN duration IS NULL OR isnan(duration) OR duration <= 0 THEN 'duration: not above 0' END,
 CASE WHEN sample_rate IS NULL OR sample_rate <= 0 THEN 'sample_rate: not above 0' END, CASE WHEN quality_tag NOT IN ('clean', 'medium', 'noisy') THEN 'quality_tag: unknown' END,
 CASE WHEN license IS NULL OR license NOT IN ('owned', 'licensed', 'public_domain', 'web_scraped') THEN 'license: unknown' END, CASE WHEN asr_cer < 0 THEN 'asr_cer: below 0' END,
 CASE WHEN asr_compression_ratio <= 0 THEN 'asr_compression_ratio: not above 0' END, CASE WHEN lang_prob NOT BETWEEN 0 AND 1 THEN 'lang_prob: outside 0 to 1' END,
 CASE WHEN text_normalized IS NOT NULL AND text IS NULL THEN 'text_normalized needs text' END)"""


@add(f"SELECT id, written_at, {_ISSUES} AS issues FROM segments WHERE {_ISSUES} <> ''")
def row_validate(spark, base):
    return table(spark, base, "segments").withColumn("issues", M.segment_issues()).where("issues <> ''").select("id", "written_at", "issues")


@add(f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_ISSUES} <> '') AS broken, count(*) FILTER (WHERE separated) AS separated FROM segments")
def manifest_scan(spark, base):
    rows = table(spark, base, "segments").withColumn("issues", M.segment_issues())
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("issues") != "").alias("broken"), F.count_if("separated").alias("separated"))


@add("SELECT lower(trim(id)) AS key, count(*) - 1 AS later FROM segments GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, base):
    rows = table(spark, base, "segments").select(key("id").alias("key"))
    return rows.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("later")).where("later > 0")


@add(f"WITH {_SEG} SELECT coalesce(channel_id, '(none)') AS channel_id, count(*) AS rows, round(sum({_MS}) / 3600000.0, 6) AS hours FROM s GROUP BY ALL")
def manifest_summary(spark, base):
    return M.hours_by(segments(spark, base), F.col("channel_id"), _millis(), "channel_id")


@add(f"WITH {_SEG}, h AS (SELECT coalesce(channel_id, '(none)') AS channel_id, sum({_MS}) AS millis FROM s GROUP BY ALL) SELECT channel_id, millis, rank() OVER (ORDER BY millis DESC, channel_id) AS place FROM h")
def ranked_hours(spark, base):
    from sozmill.operators.ranking import spread_rank

    sums = segments(spark, base).groupBy(F.coalesce("channel_id", F.lit("(none)")).alias("channel_id")).agg(F.sum(_millis()).alias("millis"))
    return spread_rank(sums.withColumn("all", F.lit(1)), ["all"], [F.col("millis").desc(), F.col("channel_id").asc()], "place").select("channel_id", "millis", "place")


@add(f"WITH {_SEG} SELECT 'ch_' || substr(sha1(audio_path), 1, 10) AS id, coalesce(channel_id, 'none') || '_c0' AS speaker_id, replace(audio_path, '\\', '/') AS audio_path, {_MS} AS millis FROM s")
def segment_projection(spark, base):
    digest = F.substring(F.sha1(F.col("audio_path").cast("binary")), 1, 10)
    return segments(spark, base).select(F.concat(F.lit("ch_"), digest).alias("id"), F.concat(F.coalesce("channel_id", F.lit("none")), F.lit("_c0")).alias("speaker_id"), F.replace("audio_path", F.lit("\\"), F.lit("/")).alias("audio_path"), _millis().alias("millis"))


@add(f"WITH {_SEG} SELECT id, nullif(trim(text), '') AS text, CASE WHEN asr_compression_ratio < 0.01 THEN 0.01 ELSE asr_compression_ratio END AS ratio, CASE WHEN lang_prob < 0 THEN 0 WHEN lang_prob > 1 THEN 1 ELSE lang_prob END AS lang_prob FROM s")
def clamp_diagnostics(spark, base):
    """Blank texts and diagnostics out of range put right; what is missing stays missing."""
    at_least = lambda c, low: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(low)))
    prob = F.when(F.col("lang_prob").isNotNull(), F.least(at_least("lang_prob", 0.0), F.lit(1.0)))
    return segments(spark, base).select("id", F.nullif(F.trim("text"), F.lit("")).alias("text"), at_least("asr_compression_ratio", 0.01).alias("ratio"), prob.alias("lang_prob"))


@add(f"WITH {_SEG} SELECT channel_id, coalesce(round(sum(asr_avg_logprob * greatest(duration, 0.01)) / sum(CASE WHEN asr_avg_logprob IS NOT NULL THEN greatest(duration, 0.01) END), 6), -10) AS logprob, coalesce(max(asr_compression_ratio), 1) AS ratio FROM s GROUP BY ALL")
def weighted_mean(spark, base):
    """Duration-weighted log probability, -10 where there is none, and the greatest compression ratio."""
    weight = F.greatest("duration", F.lit(0.01))
    mean = F.sum(F.col("asr_avg_logprob") * weight) / F.sum(F.when(F.col("asr_avg_logprob").isNotNull(), weight))
    return segments(spark, base).groupBy("channel_id").agg(F.coalesce(F.round(mean, 6), F.lit(-10.0)).alias("logprob"), F.coalesce(F.max("asr_compression_ratio"), F.lit(1.0)).alias("ratio"))


@add(f"WITH {_SEG}, t AS (SELECT coalesce(nullif(regexp_extract(lower(audio_path), '_(v[0-9a-z]{{9}})_', 1), ''), audio_path) AS recording, id, trim(text) AS text FROM s) SELECT recording, string_agg(text, ' ' ORDER BY id) AS text, count(*) AS parts FROM t WHERE text <> '' GROUP BY recording")
def joined_texts(spark, base):
    """Texts of one recording's parts in order; a recording is bounded by its audio."""
    video = F.nullif(F.regexp_extract(F.lower("audio_path"), "_(v[0-9a-z]{9})_", 1), F.lit(""))
    rows = segments(spark, base).where(F.trim("text") != "").select(F.coalesce(video, F.col("audio_path")).alias("recording"), "id", F.trim("text").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "text")))
    return rows.groupBy("recording").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("parts"))


@add(f"WITH {_SEG} SELECT s.id FROM s WHERE text IS NOT NULL AND id NOT IN (SELECT id FROM s WHERE text_normalized IS NOT NULL)")
def resume_anti_join(spark, base):
    rows = segments(spark, base)
    return rows.where("text is not null").select("id").join(rows.where("text_normalized is not null").select("id"), "id", "left_anti")


@add(f"WITH {_SEG} SELECT source, sum({_MS}) AS millis, count(*) AS rows, sum({_MS}) FILTER (WHERE channel_id IN (SELECT {_S('channel_id')} FROM channels WHERE {_S('status')} = 'approved')) AS approved_millis FROM s GROUP BY source")
def semi_join_yield(spark, base):
    rows = segments(spark, base)
    approved = table(spark, base, "channels").where(key("status") == "approved").select(key("channel_id").alias("channel_id")).distinct()
    part = rows.join(approved, "channel_id", "left_semi").groupBy("source").agg(F.sum(_millis()).alias("approved_millis"))
    return rows.groupBy("source").agg(F.sum(_millis()).alias("millis"), F.count(F.lit(1)).alias("rows")).join(part, "source", "left")


@add(f"WITH {_SEG}, w AS (SELECT regexp_extract(lower(audio_path), '_(v[0-9a-z]{{9}})_', 1) AS video, count(*) AS segments, sum({_MS}) AS speech FROM s GROUP BY 1), {_V.replace('v AS', 'vm AS')}, r AS (SELECT lower(trim(video_id)) AS video, max({_MS}) AS raw FROM vm GROUP BY 1) SELECT count(*) AS videos, sum(raw) AS raw_millis, sum(speech) AS speech_millis, round(sum(speech) * 100.0 / sum(raw), 1) AS percent, sum(segments) AS segments FROM r JOIN w USING (video)")
def segment_yield(spark, base):
    """Raw time of the videos that were cut, the speech that came of them, its percentage and the segments."""
    cut_ = segments(spark, base).groupBy(F.regexp_extract(F.lower("audio_path"), "_(v[0-9a-z]{9})_", 1).alias("video")).agg(F.count(F.lit(1)).alias("segments"), F.sum(_millis()).alias("speech"))
    raw = table(spark, base, "video_meta").groupBy(F.lower(F.trim("video_id")).alias("video")).agg(F.max(_millis()).alias("raw"))
    both = raw.join(cut_, "video")
    return both.agg(
        F.count(F.lit(1)).alias("videos"), F.sum("raw").alias("raw_millis"), F.sum("speech").alias("speech_millis"),
        F.round(F.try_divide(F.sum("speech") * F.lit(100.0), F.sum("raw")), 1).alias("percent"), F.sum("segments").alias("segments"),
    )


@add(f"WITH {_SEG} SELECT id, CASE WHEN duration < 2 THEN format('duration {{:.0f}}s < min 2s', duration) WHEN duration > 20 THEN format('duration {{:.0f}}s > max 20s', duration) END AS verdict FROM s")
def duration_bounds(spark, base):
    return segments(spark, base).select("id", M.outside_bounds(F.col("duration"), 2.0, 20.0).alias("verdict"))


@add(f"""WITH {_SEG} SELECT source, count(*) FILTER (WHERE duration BETWEEN 2 AND 20 AND asr_avg_logprob > -1 AND asr_compression_ratio < 2.4 AND length(text) / duration BETWEEN 5 AND 25 AND lang_prob > 0.8) AS clean, count(*) AS rows FROM s GROUP BY source""")
def planned_filter(spark, base):
    """Extension: documented thresholds that tag rows and drop none."""
    clean = F.col("duration").between(2, 20) & (F.col("asr_avg_logprob") > -1) & (F.col("asr_compression_ratio") < 2.4) & F.try_divide(F.length("text"), F.col("duration")).between(5, 25) & (F.col("lang_prob") > 0.8)
    return segments(spark, base).groupBy("source").agg(F.count_if(clean).alias("clean"), F.count(F.lit(1)).alias("rows"))


# --- registry and reports --------------------------------------------------------------------------------------------

_BADC = r"""concat_ws('; ', CASE WHEN channel_id IS NULL OR NOT regexp_matches(channel_id, '^[a-z0-9][a-z0-9_-]*$') THEN 'channel_id: bad identifier' END,
 CASE WHEN NOT coalesce(regexp_matches(lower(url), '^https?://(([^/]*\.)?video\.example|v\.example)([/?#]|$)'), false) THEN 'url: other host' END, CASE WHEN name IS NULL OR trim(name) = '' THEN 'name: blank' END,
 CASE WHEN genre IS NULL OR genre NOT IN ('conversation', 'news', 'education', 'vlog', 'audiobook', 'other') THEN 'genre: unknown' END, CASE WHEN script IS NULL OR script NOT IN ('latin', 'cyrillic', 'mixed') THEN 'script: unknown' END,
 CASE WHEN est_quality IS NULL OR est_quality NOT IN ('clean', 'medium', 'noisy') THEN 'est_quality: unknown' END, CASE WHEN status IS NULL OR status NOT IN ('candidate', 'approved', 'rejected') THEN 'status: unknown' END,
 CASE WHEN trim(reject_reason) = '' THEN 'reject_reason: blank' END, CASE WHEN trim(notes) = '' THEN 'notes: blank' END)"""
_BADR = f"CASE WHEN {_BADC} <> '' THEN {_BADC} WHEN status = 'rejected' AND reject_reason IS NULL THEN 'reject_reason missing' WHEN status <> 'rejected' AND reject_reason IS NOT NULL THEN 'reject_reason without rejection' ELSE '' END"


@add(f"SELECT channel_id, {_BADR} AS issues FROM channels")
def registry_validate(spark, base):
    return table(spark, base, "channels").select("channel_id", M.channel_issues(U.is_video_host(F.col("url"), SITE, SHORT)).alias("issues"))


@add(f"WITH {_C} SELECT status, genre, count(*) AS channels FROM c GROUP BY ALL")
def registry_scan(spark, base):
    return channels(spark, base).groupBy("status", "genre").agg(F.count(F.lit(1)).alias("channels"))


@add(f"WITH {_STAT} SELECT * FROM st")
def stats_last_wins(spark, base):
    return stats(spark, base)


_J3 = f"WITH {_C}, {_STAT}, {_SEG}, {_V}, ih AS (SELECT {_S('channel_id')} AS channel_id, sum({_MS}) AS raw_millis FROM v WHERE {_S('channel_id')} IS NOT NULL GROUP BY 1), sp AS (SELECT channel_id, sum({_MS}) AS speech_millis FROM s WHERE channel_id IS NOT NULL GROUP BY 1)"


@add(f"{_J3} SELECT c.channel_id, c.genre, st.hours AS counted_hours, coalesce(ih.raw_millis, 0) AS raw_millis, coalesce(sp.speech_millis, 0) AS speech_millis FROM c LEFT JOIN st USING (channel_id) LEFT JOIN ih USING (channel_id) LEFT JOIN sp USING (channel_id)")
def channel_left_joins(spark, base):
    """Counted hours (missing stays null), raw and speech time of every channel."""
    speech = segments(spark, base).where("channel_id is not null").groupBy("channel_id").agg(F.sum(_millis()).alias("speech_millis"))
    raw = videos(spark, base).select(key("channel_id").alias("channel_id"), _millis().alias("m")).where("channel_id is not null").groupBy("channel_id").agg(F.sum("m").alias("raw_millis"))
    joined = channels(spark, base).join(stats(spark, base), "channel_id", "left").join(raw, "channel_id", "left").join(speech, "channel_id", "left")
    return joined.select("channel_id", "genre", F.col("hours").alias("counted_hours"), F.coalesce("raw_millis", F.lit(0)).alias("raw_millis"), F.coalesce("speech_millis", F.lit(0)).alias("speech_millis"))


@add(f"WITH {_C}, {_STAT} SELECT channel_id FROM c WHERE status <> 'rejected' AND channel_id NOT IN (SELECT channel_id FROM st)")
def missing_stats(spark, base):
    return channels(spark, base).where("status <> 'rejected'").select("channel_id").join(stats(spark, base), "channel_id", "left_anti")


_GENRE = f"WITH {_C}, {_STAT}, k AS (SELECT c.genre, st.* FROM c JOIN st USING (channel_id) WHERE status <> 'rejected')"


@add(f"{_GENRE} SELECT coalesce(genre, 'total') AS genre, count(*) AS channels, sum(video_count) AS videos, round(sum(hours), 6) AS hours, round(sum(hours) / (SELECT sum(hours) FROM k), 6) AS share FROM k GROUP BY ROLLUP (genre)")
def genre_report(spark, base):
    counted = channels(spark, base).where("status <> 'rejected'").join(stats(spark, base), "channel_id")
    rolled = counted.rollup("genre").agg(F.count(F.lit(1)).alias("channels"), F.sum("video_count").alias("videos"), F.sum("hours").alias("h"))
    total = counted.agg(F.sum("hours").alias("all"))
    return rolled.crossJoin(F.broadcast(total)).select(F.coalesce("genre", F.lit("total")).alias("genre"), "channels", "videos", F.round("h", 6).alias("hours"), F.round(F.col("h") / F.col("all"), 6).alias("share"))


@add(f"{_GENRE} SELECT round(coalesce(sum(hours), 0), 6) AS hours, (SELECT count(*) FROM c WHERE status <> 'rejected' AND channel_id NOT IN (SELECT channel_id FROM st)) AS missing, coalesce(sum(hours), 0) >= 1000.0 AS met FROM k")
def hours_gate(spark, base):
    """Counted hours of the channels that aren't rejected, those without a count, and whether the wanted hours are reached."""
    joined = channels(spark, base).where("status <> 'rejected'").join(stats(spark, base), "channel_id", "left")
    total = F.coalesce(F.sum("hours"), F.lit(0.0))
    return joined.agg(F.round(total, 6).alias("hours"), F.count_if(F.col("video_count").isNull() & F.col("hours").isNull()).alias("missing"), (total >= RAW_HOURS).alias("met"))


# Hours wanted in all, and shares of hours per genre in percent.
RAW_HOURS = 1000.0
GENRE_BANDS = {"conversation": (40.0, 50.0), "education": (15.0, 25.0), "vlog": (10.0, 15.0), "news": (5.0, 15.0), "audiobook": (5.0, 10.0), "other": (0.0, 5.0)}


@add(f"{_GENRE}, b(genre, low, high) AS (VALUES ('conversation', 40, 50), ('education', 15, 25), ('vlog', 10, 15), ('news', 5, 15), ('audiobook', 5, 10), ('other', 0, 5)), h AS (SELECT genre, sum(hours) / (SELECT sum(hours) FROM k) * 100 AS share FROM k GROUP BY 1) SELECT b.genre, round(coalesce(share, 0), 6) AS share, CASE WHEN coalesce(share, 0) < low THEN 'low' WHEN share > high THEN 'high' ELSE 'ok' END AS verdict FROM b LEFT JOIN h USING (genre)")
def genre_verdict(spark, base):
    bands = spark.createDataFrame([(g, *band) for g, band in GENRE_BANDS.items()], "genre string, low double, high double")
    counted = channels(spark, base).where("status <> 'rejected'").join(stats(spark, base), "channel_id")
    hours = counted.groupBy("genre").agg(F.sum("hours").alias("h")).crossJoin(F.broadcast(counted.agg(F.sum("hours").alias("all"))))
    share = F.coalesce(F.col("h") / F.col("all") * 100, F.lit(0.0))
    joined = F.broadcast(bands).join(hours, "genre", "left").withColumn("share", share)
    return joined.select("genre", F.round("share", 6).alias("share"), F.when(F.col("share") < F.col("low"), "low").when(F.col("share") > F.col("high"), "high").otherwise("ok").alias("verdict"))


@add(f"{_J3} SELECT count(*) FILTER (WHERE status = 'candidate') AS candidate, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected, round(sum(hours) FILTER (WHERE status <> 'rejected'), 6) AS available, count(*) FILTER (WHERE status <> 'rejected' AND hours IS NULL) AS missing, coalesce(round((SELECT sum(speech_millis) FROM sp) * 100.0 / (SELECT sum(raw_millis) FROM ih), 6), 0) AS speech_percent FROM c LEFT JOIN st USING (channel_id)")
def status_summary(spark, base):
    """Channels by status, hours available, channels without a count, and speech as a percentage of the ingested time."""
    joined = channels(spark, base).join(stats(spark, base), "channel_id", "left")
    active = F.col("status") != "rejected"
    counts = joined.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("candidate", "approved", "rejected")], F.round(F.sum(F.when(active, F.col("hours"))), 6).alias("available"), F.count_if(active & F.col("hours").isNull()).alias("missing"))
    speech = segments(spark, base).where("channel_id is not null").agg(F.sum(_millis()).alias("speech"))
    raw = videos(spark, base).where(key("channel_id").isNotNull()).agg(F.sum(_millis()).alias("raw"))
    percent = F.coalesce(F.round(F.try_divide(F.col("speech") * F.lit(100.0), F.col("raw")), 6), F.lit(0.0))
    return counts.crossJoin(speech).crossJoin(raw).select(*counts.columns, percent.alias("speech_percent"))


@add(f"WITH {_C}, {_STAT} SELECT c.channel_id, coalesce(st.video_count, 0) AS video_count, CASE WHEN st.channel_id IS NULL THEN 'fetch' ELSE 'cached' END AS origin FROM c LEFT JOIN st USING (channel_id) WHERE status <> 'rejected'")
def stats_merge(spark, base):
    known = stats(spark, base).withColumn("known", F.lit(True))
    return channels(spark, base).where("status <> 'rejected'").join(known, "channel_id", "left").select("channel_id", F.coalesce("video_count", F.lit(0)).alias("video_count"), F.when(F.col("known"), "cached").otherwise("fetch").alias("origin"))


# --- videos ----------------------------------------------------------------------------------------------------------


@add(
    f"WITH {_V} SELECT video_id, url, title, nullif(trim(channel), '') AS channel, duration, nullif(trim(language), '') AS language, "
    "CASE WHEN regexp_full_match(upload_date, '[0-9]{8}') THEN substr(upload_date, 1, 4) || '-' || substr(upload_date, 5, 2) || '-' || substr(upload_date, 7, 2) END AS upload_date, "
    "CASE WHEN uz_subtitles IN ('manual', 'automatic') THEN uz_subtitles END AS uz_subtitles, CASE WHEN nullif(trim(video_id), '') IS NULL THEN 'no video id' WHEN duration IS NULL THEN 'no duration' END AS issue FROM v"
)
def metadata_parse(spark, base):
    """Descriptions as JSON, the owner under either name, read back."""
    rows = videos(spark, base)
    odd = F.pmod(F.length("video_id") + F.length("url"), F.lit(2)) == 1
    tracks = lambda kind: F.create_map(F.when(F.col("uz_subtitles") == kind, "uz-Latn").otherwise("ru"), F.lit("x"))
    info = F.to_json(F.struct(
        F.col("video_id").alias("id"), "title", F.when(odd, F.col("channel")).otherwise(" ").alias("channel"), F.col("channel").alias("uploader"), "duration", "language", "upload_date",
        tracks("manual").alias("subtitles"), tracks("automatic").alias("automatic_captions"),
    ))
    return rows.select(parse_info(info, F.col("url")).alias("m")).select("m.*")


@add(f"WITH {_V} SELECT video_id, CASE WHEN regexp_full_match(upload_date, '[0-9]{{8}}') THEN substr(upload_date, 1, 4) || '-' || substr(upload_date, 5, 2) || '-' || substr(upload_date, 7, 2) END AS iso FROM v")
def iso_date(spark, base):
    return videos(spark, base).select("video_id", as_iso(F.col("upload_date")).alias("iso"))


@add(f"WITH {_V} SELECT {_S('channel_id')} AS channel_id, count(*) AS videos, round(sum(duration) / 3600, 2) AS hours FROM v GROUP BY ALL")
def channel_stats(spark, base):
    return videos(spark, base).groupBy(key("channel_id").alias("channel_id")).agg(F.count(F.lit(1)).alias("videos"), F.round(F.sum("duration") / 3600, 2).alias("hours"))


@add(f"WITH {_V} SELECT CASE WHEN regexp_full_match(video_id, '[A-Za-z0-9_-]{{10,11}}') THEN 'ok' ELSE 'bad id' END AS outcome, coalesce(uz_subtitles, 'none') AS subtitles, count(*) AS videos FROM v GROUP BY ALL")
def outcome_counts(spark, base):
    outcome = F.when(F.col("video_id").rlike("^[A-Za-z0-9_-]{10,11}$"), "ok").otherwise("bad id")
    return videos(spark, base).groupBy(outcome.alias("outcome"), F.coalesce("uz_subtitles", F.lit("none")).alias("subtitles")).agg(F.count(F.lit(1)).alias("videos"))


@add(f"WITH {_V} SELECT video_id, nullif(substr({_S('channel_id')}, 4), '') AS slug FROM v WHERE starts_with({_S('channel_id')}, 'ch_')")
def prefix_strip(spark, base):
    c = key("channel_id")
    return videos(spark, base).where(F.startswith(c, F.lit("ch_"))).select("video_id", F.nullif(F.substring(c, 4, 1 << 30), F.lit("")).alias("slug"))
