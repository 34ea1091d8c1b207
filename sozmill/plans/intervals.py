"""Interval queries: coverage of labelled audio events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.functions.keys import key, latest
from sozmill.functions import text as T
from sozmill.operators import intervals as I
from sozmill.operators.coverage import coverage, to_millis
from sozmill.operators.sampling import spread_prefix
from sozmill.plans.catalog import Catalog
from sozmill.session import table

# The labels an event may carry.
EVENT_LABELS = ("laughter", "music", "applause", "cough")


def valid_events(events: DataFrame) -> DataFrame:
    """clip_id, label, start_ms, end_ms of the events that keep the contract, times rounded to milliseconds."""
    rows = events.select(key("clip_id").alias("clip_id"), key("label").alias("label"), to_millis(F.col("start_s")).alias("start_ms"), to_millis(F.col("end_s")).alias("end_ms"), "score")
    return rows.where(
        F.col("label").isin(*EVENT_LABELS) & (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & (F.col("score").isNull() | F.col("score").between(0.0, 1.0))
    ).drop("score")


_P2 = """WITH e AS (
  SELECT lower(trim(clip_id)) AS clip_id, lower(trim(label)) AS label, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS t
  FROM audio_events WHERE lower(trim(label)) IN ('laughter', 'music', 'applause', 'cough') AND (score IS NULL OR score BETWEEN 0 AND 1)),
v AS (SELECT * FROM e WHERE s >= 0 AND t > s),
r AS (SELECT *, max(t) OVER (PARTITION BY clip_id, label ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, label ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM r),
p AS (SELECT clip_id, label, min(s) AS start_ms, max(t) AS end_ms FROM i GROUP BY clip_id, label, island),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id, label ORDER BY start_ms) AS next_ms FROM p)
SELECT clip_id, label, 'period' AS kind, start_ms, end_ms FROM n
UNION ALL SELECT clip_id, label, 'gap', end_ms, next_ms FROM n WHERE next_ms IS NOT NULL"""

CATALOG = Catalog()
add = CATALOG.add


@add(_P2)
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return coverage(valid_events(table(spark, base, "audio_events")), ["clip_id", "label"], "start_ms", "end_ms")


# Screening thresholds per label.
SCREEN = {"laughter": 0.05, "music": 0.2, "applause": 0.1, "cough": 0.1}

_E = """e AS (SELECT lower(trim(clip_id)) AS clip_id, lower(trim(label)) AS label, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS t, score
  FROM audio_events WHERE lower(trim(label)) IN ('laughter', 'music', 'applause', 'cough') AND (score IS NULL OR score BETWEEN 0 AND 1)), v AS (SELECT DISTINCT * FROM e WHERE s >= 0 AND t > s)"""
_ISLANDS = """r AS (SELECT *, max(t) OVER (PARTITION BY clip_id, label ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN s - reach <= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, label ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM r),
p AS (SELECT clip_id, label, min(s) AS start_ms, max(t) AS end_ms, max(score) AS score FROM i GROUP BY clip_id, label, island HAVING max(t) - min(s) >= 200)"""


def scored_events(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "audio_events")
    rows = events.select(key("clip_id").alias("clip_id"), key("label").alias("label"), to_millis(F.col("start_s")).alias("start_ms"), to_millis(F.col("end_s")).alias("end_ms"), "score")
    return rows.where(F.col("label").isin(*EVENT_LABELS) & (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & (F.col("score").isNull() | F.col("score").between(0.0, 1.0))).distinct()


@add(f"WITH {_E}, {_ISLANDS} SELECT * FROM p")
def consolidate_intervals(spark, base):
    return I.consolidate(scored_events(spark, base), ["clip_id", "label"])


@add(f"WITH {_E}, {_ISLANDS} SELECT clip_id, to_json(list(struct_pack(start := start_ms, \"end\" := end_ms, label := label) ORDER BY start_ms, end_ms, label)) AS events FROM p GROUP BY clip_id")
def events_json(spark, base):
    """Events of a clip as one JSON array in order of time; a clip's array is bounded by its length and the least gap."""
    rows = consolidate_intervals(spark, base)
    packed = F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "label")))
    return rows.groupBy("clip_id").agg(F.to_json(packed).alias("events"))


@add(f"WITH {_E} SELECT clip_id, label, max(score) AS best, max(score) >= CASE label WHEN 'laughter' THEN 0.05 WHEN 'music' THEN 0.2 ELSE 0.1 END AS flagged FROM v GROUP BY clip_id, label")
def screen_flags(spark, base):
    threshold = F.element_at(F.create_map(*[F.lit(x) for pair in SCREEN.items() for x in pair]), F.col("label"))
    return scored_events(spark, base).groupBy("clip_id", "label").agg(F.max("score").alias("best")).withColumn("flagged", F.col("best") >= threshold)


_DURATIONS = "d AS (SELECT lower(trim(video_id)) AS clip_id, max(CAST(round(duration * 1000) AS BIGINT)) AS dur FROM video_meta GROUP BY 1)"


@add(f"WITH {_E}, {_DURATIONS} SELECT clip_id, label, max(score) AS best, count(DISTINCT s // 10000) AS chunks FROM v LEFT JOIN d USING (clip_id) WHERE s < 10000 OR dur IS NULL OR dur - s // 10000 * 10000 >= 250 GROUP BY ALL")
def chunk_max(spark, base):
    """Best score per clip and label over 10 s chunks; a trailing chunk below 0.25 s counts only if it is the first.

    A clip of unknown length has no trailing chunk.
    """
    durations = table(spark, base, "video_meta").groupBy(key("video_id").alias("clip_id")).agg(F.max(to_millis(F.col("duration"))).alias("dur"))
    chunk = F.floor(F.col("start_ms") / 10_000)
    kept = scored_events(spark, base).join(durations, "clip_id", "left").where((F.col("start_ms") < 10_000) | F.col("dur").isNull() | (F.col("dur") - chunk * 10_000 >= 250))
    per_chunk = kept.groupBy("clip_id", "label", chunk.alias("chunk")).agg(F.max("score").alias("best"))
    return per_chunk.groupBy("clip_id", "label").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("chunks"))


@add(
    f"WITH {_E}, c AS (SELECT clip_id, label, s, t, greatest(CAST(ceil((t - s) / 20000.0) AS BIGINT), 1) AS parts FROM v WHERE t - s >= 2000), x AS (SELECT *, unnest(range(parts)) AS part FROM c) "
    "SELECT clip_id, label, s AS start_ms, part, CAST(s + floor((t - s) * part / parts) AS BIGINT) AS part_start, CAST(s + floor((t - s) * (part + 1) / parts) AS BIGINT) AS part_end FROM x"
)
def clamp_spans(spark, base):
    return I.clamp_spans(scored_events(spark, base), "start_ms", "end_ms", 2_000, 20_000).select("clip_id", "label", "start_ms", "part", "part_start", "part_end")


@add(f"WITH {_E} SELECT label, count(*) FILTER (WHERE t - s < 2000) AS dropped, coalesce(sum(t - s) FILTER (WHERE t - s < 2000), 0) AS dropped_millis, count(*) AS spans FROM v GROUP BY label")
def dropped_spans(spark, base):
    """What the least length of ``clamp_spans`` costs per label."""
    length = F.col("end_ms") - F.col("start_ms")
    return scored_events(spark, base).groupBy("label").agg(F.count_if(length < 2000).alias("dropped"), F.coalesce(F.sum(F.when(length < 2000, length)), F.lit(0)).alias("dropped_millis"), F.count(F.lit(1)).alias("spans"))


@add(f"WITH {_E} SELECT clip_id, label, s * 16 AS first_frame, t * 16 AS end_frame FROM v")
def span_frame_bounds(spark, base):
    return scored_events(spark, base).select("clip_id", "label", (F.col("start_ms") * 16).alias("first_frame"), (F.col("end_ms") * 16).alias("end_frame"))


# A recording is its segments end to end in the order of their ids; the words of a segment are equally long.
_TAGS = "CASE label WHEN 'laughter' THEN '[kulgu]' WHEN 'music' THEN '[musiqa]' WHEN 'applause' THEN '[qarsak]' WHEN 'cough' THEN '[yoʻtal]' END"
_WORDS = """w AS (SELECT lower(trim(id)) AS id, regexp_extract(lower(audio_path), '_(v[0-9a-z]{9})_', 1) AS clip_id, greatest(coalesce(CAST(round(duration * 1000) AS BIGINT), 0), 0) AS dur,
  list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x{85}\\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM segments
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY written_at DESC) = 1),
l AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY clip_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM w WHERE clip_id <> '')"""
_HITS = f"""{_E}, {_ISLANDS}, {_WORDS}, h AS (SELECT l.id, words, label, p.start_ms AS s, p.end_ms AS t, CAST((p.start_ms + p.end_ms) // 2 - begins AS BIGINT) AS mid, dur // greatest(len(words), 1) AS step
  FROM l JOIN p ON p.clip_id = l.clip_id AND (p.start_ms + p.end_ms) // 2 >= begins AND (p.start_ms + p.end_ms) // 2 < begins + dur),
k AS (SELECT *, list_transform(range(len(words) + 1), lambda j: abs(j * step - mid)) AS gaps FROM h), n AS (SELECT *, list_position(gaps, list_min(gaps)) - 1 AS place FROM k)"""


def _spoken(spark: SparkSession, base: str) -> DataFrame:
    """id, clip_id (null without a recording), dur, words of the latest version of every segment."""
    rows = latest(table(spark, base, "segments"), "id", "written_at", {"text": F.col("text"), "audio_path": F.col("audio_path"), "duration": F.col("duration")})
    split = F.filter(F.split(T.collapse(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")
    clip = F.nullif(F.regexp_extract(F.lower("audio_path"), "_(v[0-9a-z]{9})_", 1), F.lit(""))
    return rows.select("id", clip.alias("clip_id"), F.greatest(F.coalesce(to_millis(F.col("duration")), F.lit(0)), F.lit(0)).alias("dur"), split.alias("words"))


def _placed(spark: SparkSession, base: str) -> DataFrame:
    """Consolidated events at the word of the segment their middle lies in: id, label, start_ms, end_ms, place.

    Segments and events meet by recording and minute, so a recording with many of both is no product.
    """
    rows = _spoken(spark, base).where("clip_id is not null").select("id", "clip_id", "dur", F.size("words").alias("n"))
    laid = spread_prefix(rows, ["clip_id"], [F.col("id")], "dur", "begins").where("dur > 0")
    minute = lambda c: F.floor(c / 60_000)
    cells = laid.withColumn("minute", F.explode(F.sequence(minute(F.col("begins")), minute(F.col("begins") + F.col("dur") - 1))))
    events = consolidate_intervals(spark, base).withColumn("middle", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    met = cells.join(events.withColumn("minute", minute(F.col("middle"))), ["clip_id", "minute"]).where("middle >= begins and middle < begins + dur")
    step = F.floor(F.col("dur") / F.greatest("n", F.lit(1)))
    boundaries = F.transform(F.sequence(F.lit(0), F.col("n")), lambda j: j * step)
    return met.select("id", "label", "start_ms", "end_ms", I.nearest(boundaries, F.col("middle") - F.col("begins")).alias("place"))


@add(f"WITH {_HITS} SELECT id, label, s AS start_ms, place FROM n")
def nearest_boundary(spark, base):
    return _placed(spark, base).select("id", "label", "start_ms", "place")


@add(
    f"WITH {_HITS}, u AS (SELECT id, place, {_TAGS} AS tag, min({{'s': s, 't': t, 'label': label}}) AS first FROM n GROUP BY ALL), g AS (SELECT id, place, string_agg(tag, ' ' ORDER BY first) AS tags FROM u GROUP BY ALL), "
    "m AS (SELECT id, map_from_entries(list({'k': place, 'v': tags})) AS m FROM g GROUP BY id) "
    "SELECT w.id, coalesce(array_to_string(list_filter(flatten(list_transform(range(len(words) + 1), lambda i: [m[i], words[i + 1]])), lambda x: x IS NOT NULL), ' '), '') AS text FROM w LEFT JOIN m USING (id)"
)
def merge_transcript(spark, base):
    """Words of every segment with the tags of its events before the word they are nearest to, in order of time, one tag once a place."""
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "label")))
    tag = F.create_map(*[F.lit(x) for pair in T.EVENT_TAGS.items() for x in pair])
    placed = _placed(spark, base).groupBy("id", "place").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda e: tag[e["label"]])), " ").alias("tags"))
    tags = placed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("int"), "tags"))).alias("tags"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.array(F.try_element_at("tags", i), F.get("words", i))))
    return _spoken(spark, base).select("id", "words").join(tags, "id", "left").select("id", F.array_join(pieces, " ").alias("text"))


# Embeddings stand for tracks of frame scores.
_P = "x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 0.5 + 0.5) AS raw FROM embeddings)"
_SMOOTH = "m AS (SELECT vec_id, raw, list_transform(range(1, len(raw) + 1), lambda i: list_sort(list_transform(range(i - 2, i + 3), lambda j: raw[greatest(1, least(len(raw), j))]))[3]) AS smooth FROM x)"
_LEVEL = 0.53


def _tracks(spark: SparkSession, base: str) -> DataFrame:
    raw = F.transform("embedding", lambda e: e.cast("double") * 0.5 + 0.5)
    return table(spark, base, "embeddings").select("vec_id", raw.alias("raw")).withColumn("smooth", I.median(F.col("raw"), 5))


@add(f"WITH {_P}, {_SMOOTH} SELECT vec_id, list_transform(smooth, lambda s: CAST(round(s * 1000000) AS BIGINT)) AS smooth FROM m")
def median_filter(spark, base):
    return _tracks(spark, base).select("vec_id", F.transform("smooth", lambda s: F.round(s * 1000000).cast("bigint")).alias("smooth"))


_RUNS = f"""WITH {_P}, {_SMOOTH}, f AS (SELECT vec_id, unnest(range(len(raw))) AS frame, unnest(raw) AS r, unnest(smooth) AS s FROM m),
a AS (SELECT *, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS island FROM f WHERE s >= {_LEVEL})"""


@add(f"{_RUNS} SELECT vec_id, min(frame) AS first, max(frame) + 1 AS last, CAST(round(least(max(r), 1) * 1000000) AS BIGINT) AS score FROM a GROUP BY vec_id, island")
def frame_runs(spark, base):
    return I.runs(_tracks(spark, base), "vec_id", "smooth", "raw", _LEVEL).withColumn("score", F.round(F.col("score") * 1000000).cast("bigint"))


@add(f"{_RUNS} SELECT vec_id, min(frame) * 40 AS start_ms, least((max(frame) + 1) * 40, 2500) AS end_ms FROM a WHERE vec_id IN (SELECT vec_id FROM m WHERE list_max(smooth) >= 0.57) GROUP BY vec_id, island HAVING least((max(frame) + 1) * 40, 2500) > min(frame) * 40")
def localize_events(spark, base):
    """Runs, in time and cut to the clip's length, of the tracks whose greatest smoothed score flags them."""
    flagged = _tracks(spark, base).where(F.array_max("smooth") >= 0.57)
    found = I.runs(flagged, "vec_id", "smooth", "raw", _LEVEL)
    return found.select("vec_id", (F.col("first") * 40).alias("start_ms"), F.least(F.col("last") * 40, F.lit(2500)).alias("end_ms")).where("end_ms > start_ms")


@add(
    "WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(round(abs(CAST(e AS DOUBLE)) * 1000000) AS BIGINT)) AS a FROM embeddings), "
    "s AS (SELECT vec_id, list_transform(range(19, 40), lambda i: list_sum(a[i + 1:i + 5])) AS sums FROM x) SELECT vec_id, 19 + list_position(sums, list_min(sums)) - 1 + 2 AS place FROM s"
)
def quietest_window(spark, base):
    values = F.transform("embedding", lambda e: F.round(F.abs(e.cast("double")) * 1000000).cast("bigint"))
    return table(spark, base, "embeddings").select("vec_id", values.alias("a")).select("vec_id", I.quietest(F.col("a"), 5).alias("place"))
