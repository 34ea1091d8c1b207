"""Outside services behind factories: what a channel lists, and which channel an address belongs to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sozmill.sources.scorers import ScorerError, retrying, score


def fetched_stats(channels: DataFrame, factory: Callable[[], Callable[[str], Sequence[float]]], attempts: int = 3) -> DataFrame:
    """(channel_id, video_count, hours, error) of channels (channel_id, url) by a lister that each task builds once.

    The lister gives the seconds of every video of an address. A channel that cannot be listed keeps its error.
    """

    def ready():
        once = retrying(factory(), attempts)

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for channel, url in zip(pdf["channel_id"], pdf["url"]):
                try:
                    seconds = list(once(url))
                    rows.append((channel, len(seconds), round(sum(seconds) / 3600, 2), None))
                except ScorerError as e:
                    rows.append((channel, None, None, str(e)))
            return pd.DataFrame(rows, columns=["channel_id", "video_count", "hours", "error"]).astype({"video_count": "Int64"})

        return batch

    return score(channels.select("channel_id", "url"), ready, "channel_id string, video_count int, hours double, error string")


def resolved(links: DataFrame, factory: Callable[[], Callable[[str], str | None]], link: str = "link", attempts: int = 3) -> DataFrame:
    """Rows of ``links`` with ``resolved``, the channel address a resolver gives for the link, or ``error``; each link is asked for once."""

    def ready():
        once = retrying(factory(), attempts)

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for url in pdf[link]:
                try:
                    found = once(url)
                    rows.append((url, found, None if found else "no channel"))
                except ScorerError as e:
                    rows.append((url, None, str(e)))
            return pd.DataFrame(rows, columns=[link, "resolved", "error"])

        return batch

    asked = score(links.select(link).where(F.col(link).isNotNull()).distinct(), ready, f"{link} string, resolved string, error string")
    return links.join(asked, link, "left")


def acknowledgement(added: Column, genre: Column, url: Column) -> Column:
    """One line that tells of an added channel."""
    return F.concat(F.lit("+ "), added, F.lit(" ["), F.coalesce(genre, F.lit("other")), F.lit("] "), url)
