"""Feed and URL queries: posts, links, tags, ids, registry upserts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.functions import urls as U
from sozmill.functions.keys import key
from sozmill.operators.ranking import newest, spread_rank
from sozmill.plans.catalog import Catalog
from sozmill.plans.corpus import BASE_URL, SHORT, SITE, _S, _V, channels, segments, videos, _SEG
from sozmill.session import table
from sozmill.streaming.feed import admitted

CATALOG = Catalog()
add = CATALOG.add

# Genre of each hashtag.
TAG_GENRES = {
    "podkast": "conversation", "podcast": "conversation", "suhbat": "conversation", "intervyu": "conversation", "tokshou": "conversation", "talim": "education", "dars": "education",
    "maruza": "education", "kurs": "education", "vlog": "vlog", "flog": "vlog", "sayohat": "vlog", "kundalik": "vlog", "food": "vlog", "yangilik": "news", "yangiliklar": "news", "news": "news",
    "hikoya": "audiobook", "hikoyalar": "audiobook", "audiokitob": "audiobook", "ertak": "audiobook",
}

# Every registry row as a post: its name, its genre as a hashtag, its address.
_POSTS = f"p AS (SELECT DISTINCT {_S('channel_id')} AS post_id, name || ' #' || lower(trim(genre)) || ' #Ta''lim ' || url || '.' AS text, url FROM channels)"
_HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1)"
_PARTS = "list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"


def posts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "channels").select(key("channel_id").alias("post_id"), F.concat("name", F.lit(" #"), F.lower(F.trim("genre")), F.lit(" #Ta'lim "), "url", F.lit(".")).alias("text"), "url").distinct()


@add(f"WITH {_POSTS} SELECT post_id, array_to_string(list_filter([regexp_replace(lower(regexp_extract(text, '#([^ ]+) #', 1)), '[^a-z0-9_]', '', 'g'), 'talim'], lambda t: t <> ''), ' ') AS tags FROM p")
def extract_tags(spark, base):
    return posts(spark, base).select("post_id", F.array_join(U.extract_tags(F.col("text")), " ").alias("tags"))


@add(f"WITH {_POSTS} SELECT post_id, rtrim(regexp_extract(text, 'https?://[^ <>()\"'']+'), '.,;:!?') AS links FROM p")
def extract_links(spark, base):
    return posts(spark, base).select("post_id", F.array_join(U.extract_links(F.col("text")), " ").alias("links"))


_GENRE_SQL = """CASE WHEN t IN ('podkast', 'podcast', 'suhbat', 'intervyu', 'tokshou') THEN 'conversation' WHEN t IN ('talim', 'dars', 'maruza', 'kurs') THEN 'education'
 WHEN t IN ('vlog', 'flog', 'sayohat', 'kundalik', 'food') THEN 'vlog' WHEN t IN ('yangilik', 'yangiliklar', 'news') THEN 'news'
 WHEN t IN ('hikoya', 'hikoyalar', 'audiokitob', 'ertak') THEN 'audiobook' ELSE 'education' END"""


@add(f"WITH {_POSTS}, t AS (SELECT post_id, regexp_replace(lower(regexp_extract(text, '#([^ ]+) #', 1)), '[^a-z0-9_]', '', 'g') AS t FROM p) SELECT post_id, {_GENRE_SQL} AS genre FROM t")
def tag_genre(spark, base):
    mapping = F.create_map(*[F.lit(x) for pair in TAG_GENRES.items() for x in pair])
    found = F.filter(F.transform(U.extract_tags(F.col("text")), lambda t: mapping[t]), lambda g: g.isNotNull())
    return posts(spark, base).select("post_id", F.coalesce(F.get(found, 0), F.lit("other")).alias("genre"))


@add(f"WITH {_POSTS} SELECT post_id, {_HOST} = '{SHORT}' OR ends_with({_HOST}, '{SITE}') AS kept FROM p")
def url_host_filter(spark, base):
    return posts(spark, base).select("post_id", U.is_video_host(F.col("url"), SITE, SHORT).alias("kept"))


_CANON = f"CASE WHEN starts_with({_PARTS}[1], '@') THEN '{BASE_URL}/' || {_PARTS}[1] || '/videos' WHEN {_PARTS}[1] IN ('channel', 'c', 'user') AND len({_PARTS}) > 1 THEN '{BASE_URL}/' || {_PARTS}[1] || '/' || {_PARTS}[2] || '/videos' END"


@add(f"WITH {_POSTS} SELECT post_id, {_CANON} AS canonical FROM p")
def canonical_url(spark, base):
    return posts(spark, base).select("post_id", U.canonical_channel(F.col("url"), BASE_URL, SHORT).alias("canonical"))


_STEM = f"CASE WHEN len({_PARTS}) >= 2 AND {_PARTS}[-1] = 'videos' THEN {_PARTS}[-2] ELSE {_PARTS}[-1] END"
_SLUG = f"regexp_replace(ltrim(lower({_STEM}), '@'), '[^a-z0-9_-]', '', 'g')"
_MINTED = f"'ch_' || CASE WHEN regexp_full_match({_SLUG}, '[a-z0-9][a-z0-9_-]*') THEN {_SLUG} ELSE substr(sha1(url), 1, 8) END"


@add(f"WITH {_POSTS} SELECT post_id, {_MINTED} AS minted, ltrim({_STEM}, '@') AS shown FROM p")
def mint_id(spark, base):
    return posts(spark, base).select("post_id", U.mint_id(F.col("url")).alias("minted"), U.display_name(F.col("url")).alias("shown"))


@add(f"WITH {_V} SELECT video_id, CASE WHEN regexp_full_match(regexp_extract(url, '[?&]v=([^&#]*)', 1), '[A-Za-z0-9_-]{{10,11}}') THEN regexp_extract(url, '[?&]v=([^&#]*)', 1) END AS found FROM v")
def video_id_from_url(spark, base):
    return videos(spark, base).select("video_id", U.video_id(F.col("url"), SHORT, "^[A-Za-z0-9_-]{10,11}$").alias("found"))


@add("SELECT DISTINCT trim(video_id) AS video_id FROM video_meta WHERE regexp_full_match(trim(video_id), '[A-Za-z0-9_-]{10,11}')")
def video_ids(spark, base):
    ids = table(spark, base, "video_meta").select(F.trim("video_id").alias("video_id"))
    return ids.where(F.col("video_id").rlike("^[A-Za-z0-9_-]{10,11}$")).distinct()


@add("SELECT trim(url) AS url, count(*) AS times FROM video_meta WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#') GROUP BY 1")
def url_list_dedupe(spark, base):
    urls = table(spark, base, "video_meta").select(F.trim("url").alias("url")).where("url <> '' and not startswith(url, '#')")
    return urls.groupBy("url").agg(F.count(F.lit(1)).alias("times"))


@add("SELECT count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS lines, count(*) AS rows FROM segments")
def line_count(spark, base):
    return table(spark, base, "segments").agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("lines"), F.count(F.lit(1)).alias("rows"))


@add("SELECT lower(trim(id)) AS id, min(written_at) AS first_at FROM segments GROUP BY 1")
def ordered_distinct(spark, base):
    return table(spark, base, "segments").groupBy(key("id").alias("id")).agg(F.min("written_at").alias("first_at"))


@add(f"WITH {_SEG} SELECT id, row_number() OVER (ORDER BY id) AS place FROM s WHERE text IS NOT NULL")
def sorted_compaction(spark, base):
    rows = segments(spark, base).where("text is not null").select("id", F.lit(1).alias("all"))
    return spread_rank(rows, ["all"], [F.col("id").asc()], "place").select("id", "place")


@add(f"WITH x AS (SELECT DISTINCT {_S('channel_id')} AS channel_id, counted_at FROM channel_stats) SELECT channel_id, counted_at FROM x QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY counted_at DESC) <= 2")
def retention_topk(spark, base):
    """The two newest counts of every channel."""
    rows = table(spark, base, "channel_stats").select(key("channel_id").alias("channel_id"), "counted_at").distinct()
    return newest(rows, "channel_id", F.col("counted_at"), 2)


@add(f"WITH {_POSTS} SELECT post_id, post_id AS chat, text FROM p")
def posts_parse(spark, base):
    """Updates as JSON, read back: the channel post or else the message, its text or else its caption."""
    made = posts(spark, base).select("post_id", F.when(F.length("post_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("post_id").alias("chat"), "text").alias("channel_post")))).otherwise(F.to_json(F.struct(F.struct(F.col("post_id").alias("chat"), F.col("text").alias("caption")).alias("message")))).alias("update"))
    from sozmill.streaming.feed import parse_updates

    return parse_updates(made, "update").select("post_id", "chat", "text")


@add(f"WITH {_V}, x AS (SELECT coalesce({_S('channel_id')}, '(none)') AS channel_id, video_id, CAST(coalesce(floor(duration), 0) AS BIGINT) % 4 AS depth FROM v) SELECT channel_id, video_id FROM x UNION ALL SELECT channel_id, video_id || 'b' FROM x WHERE depth > 0")
def playlist_flatten(spark, base):
    """Videos of playlists nested up to three deep, some beside a playlist of their own level."""
    depth = F.coalesce(F.floor("duration"), F.lit(0)) % 4
    entry = F.concat(F.lit('{"id":"'), "video_id", F.lit('"}'))
    nested = F.when(depth == 0, entry)
    for d in range(1, 4):
        inner = entry
        for _ in range(d):
            inner = F.concat(F.lit('{"entries":['), inner, F.lit("]}"))
        nested = nested.when(depth == d, F.concat(inner, F.lit(',null,{"id":"'), "video_id", F.lit('b"}')))
    rows = videos(spark, base).select(F.coalesce(key("channel_id"), F.lit("(none)")).alias("channel_id"), F.concat(F.lit('{"entries":['), nested, F.lit("]}")).alias("playlist"))
    return rows.select("channel_id", F.explode(U.playlist_ids(F.col("playlist"))).alias("video_id"))


@add("SELECT t.label AS wanted, list_sort(list(DISTINCT lower(trim(a.label)))) AS found FROM (VALUES ('laugh'), ('music'), ('cough'), ('none')) t(label) LEFT JOIN audio_events a ON starts_with(lower(trim(a.label)), t.label) GROUP BY 1")
def class_lookup(spark, base):
    """Classes by the start of their names; a name without any keeps an empty answer."""
    names = table(spark, base, "audio_events").select(key("label").alias("label")).distinct().where("label is not null")
    wanted = spark.createDataFrame([("laugh",), ("music",), ("cough",), ("none",)], "wanted string")
    joined = F.broadcast(wanted).join(names, F.startswith(names["label"], F.col("wanted")), "left")
    found = joined.groupBy("wanted").agg(F.array_sort(F.collect_set("label")).alias("found"))
    return found.select("wanted", F.when(F.size("found") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("found")).alias("found"))


_FRESH = (
    f"WITH {_POSTS}, k AS (SELECT DISTINCT {_S('channel_id')} AS id, url FROM channels WHERE {_S('status')} = 'approved'), c AS (SELECT {_MINTED} AS id, {_CANON} AS canonical, post_id FROM p), "
    "n AS (SELECT * FROM c WHERE canonical IS NOT NULL AND id NOT IN (SELECT id FROM k) AND canonical NOT IN (SELECT url FROM k))"
)


@add(f"{_FRESH} SELECT id AS channel_id, min_by(canonical, post_id) AS url, min(post_id) AS post_id FROM n GROUP BY id")
def registry_upsert(spark, base):
    """Posts against the approved registry: skipped when their id or address is known, the first post of an id admitted."""
    return admitted(_made(spark, base), _known(spark, base), "post_id")


@add(f"{_FRESH} SELECT id AS channel_id, url, false AS added FROM k UNION ALL SELECT id, min_by(canonical, post_id), true FROM n GROUP BY id")
def registry_after(spark, base):
    """The registry with what was admitted."""
    known, fresh = _known(spark, base), registry_upsert(spark, base)
    return known.withColumn("added", F.lit(False)).unionByName(fresh.select("channel_id", "url", F.lit(True).alias("added")))


def _known(spark: SparkSession, base: str) -> DataFrame:
    return channels(spark, base).where("status = 'approved'").select("channel_id", "url").distinct()


def _made(spark: SparkSession, base: str) -> DataFrame:
    return posts(spark, base).select(U.mint_id(F.col("url")).alias("channel_id"), U.canonical_channel(F.col("url"), BASE_URL, SHORT).alias("url"), "post_id")
