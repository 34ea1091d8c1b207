"""URL and feed text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a link, a hashtag and a video id look like.
LINK = r"https?://[^\s<>()\"']+"
TAG = r"#([\p{L}\p{N}_'ʼ’ʻ-]+)"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


def host(url: Column) -> Column:
    """Lower-case host without user and port; null where the text isn't a URL."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def is_video_host(url: Column, site: str, short: str) -> Column:
    h = host(url)
    return F.coalesce((h == short) | F.endswith(h, F.lit(site)), F.lit(False))


def video_id(url: Column, short: str, pattern: str = VIDEO_ID) -> Column:
    """Id from a short link's path, a player path of two parts, or the first v parameter; null unless it fits the pattern."""
    parts = path_parts(url)
    candidate = (
        F.when(host(url) == short, F.ltrim(path(url), F.lit("/")))
        .when((F.size(parts) == 2) & F.get(parts, 0).isin("shorts", "embed", "live", "v"), F.get(parts, 1))
        .otherwise(F.regexp_extract(url, r"[?&]v=([^&#]*)", 1))
    )
    return F.when(candidate.rlike(pattern), candidate)


def canonical_channel(url: Column, base: str, short: str) -> Column:
    """``base``/…/videos of a handle or channel path; null for short links and anything else."""
    parts = path_parts(url)
    head = F.get(parts, 0)
    return F.when(F.coalesce(host(url), F.lit("")) != short, F.when(F.startswith(head, F.lit("@")), F.concat(F.lit(base + "/"), head, F.lit("/videos"))).when(
        head.isin("channel", "c", "user") & (F.size(parts) > 1), F.concat(F.lit(base + "/"), head, F.lit("/"), F.get(parts, 1), F.lit("/videos"))
    ))


def _stem(url: Column) -> Column:
    parts = path_parts(url)
    last = F.get(parts, F.size(parts) - 1)
    return F.when((F.size(parts) >= 2) & (last == "videos"), F.get(parts, F.size(parts) - 2)).otherwise(last)


def mint_id(url: Column) -> Column:
    """``ch_`` and the slug of the last telling path part, else the start of the URL's SHA-1."""
    slug = F.regexp_replace(F.ltrim(F.lower(_stem(url)), F.lit("@")), "[^a-z0-9_-]", "")
    return F.concat(F.lit("ch_"), F.when(F.coalesce(slug.rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), slug).otherwise(F.substring(F.sha1(url.cast("binary")), 1, 8)))


def display_name(url: Column) -> Column:
    return F.ltrim(_stem(url), F.lit("@"))


def extract_tags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9_]", "")), lambda t: t != ""))


def extract_links(text: Column) -> Column:
    """Links of a text in order, trailing punctuation dropped, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;:!?"))))


#: Playlists within playlists that are followed.
PLAYLIST_DEPTH = 6


def playlist_ids(info: Column, depth: int = PLAYLIST_DEPTH) -> Column:
    """Ids of the videos of a playlist given as JSON, entries of entries included, in order; entries without an id are left out."""
    entry = "struct<id:string>"
    for _ in range(depth):
        entry = f"struct<id:string,entries:array<{entry}>>"

    def ids(entries: Column, left: int) -> Column:
        own = lambda e: F.filter(F.array(e["id"]), lambda x: x.isNotNull() & (x != ""))
        if not left:
            return F.flatten(F.transform(entries, own))
        return F.flatten(F.transform(entries, lambda e: F.when(F.coalesce(F.size(e["entries"]), F.lit(-1)) > 0, ids(e["entries"], left - 1)).otherwise(own(e))))

    found = F.from_json(info, f"entries array<{entry}>")["entries"]
    return F.coalesce(ids(F.filter(found, lambda e: e.isNotNull()), depth), F.array().cast("array<string>"))
