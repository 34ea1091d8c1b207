"""Model scorers behind one interface: a factory per worker, batches of rows in, typed rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.plans.intervals import SCREEN


def score(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows of a scorer that each task builds once and feeds with Arrow batches; errors are the scorer's own columns."""

    def run(batches: Iterable[pd.DataFrame]):
        scorer = None
        for pdf in batches:
            scorer = scorer or factory()
            yield scorer(pdf)

    return df.mapInPandas(run, schema)


def tag_events(clips: DataFrame, screen: Callable, localize: Callable, key: str = "clip_id", thresholds: dict[str, float] = SCREEN) -> DataFrame:
    """Two stages: a cheap screen scores every clip and label, the costly localizer sees flagged pairs only.

    ``screen`` returns (key, label, score) rows, ``localize`` gets the clips with a ``label`` and returns (key, label,
    start_ms, end_ms, score).
    """
    scored = score(clips, screen, f"{key} string, label string, score double")
    least = F.element_at(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]), F.col("label"))
    flagged = scored.where(F.col("score") >= least).select(key, "label")
    return score(clips.join(flagged, key), localize, f"{key} string, label string, start_ms long, end_ms long, score double")


class ScorerError(RuntimeError):
    """A call that failed as often as it may."""


def retrying(call: Callable, attempts: int = 3) -> Callable:
    """``call``, tried up to ``attempts`` times; the last error is the cause of the one raised."""

    def run(*args, **kwargs):
        for left in range(attempts - 1, -1, -1):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                if not left:
                    raise ScorerError(f"failed {attempts} times: {e}") from e

    return run


def splitting(call: Callable[[np.ndarray], str], box: int = 1600, least: int = 16_000) -> Callable[[np.ndarray], str]:
    """A transcriber that halves what it is refused as too long (ValueError) at its quietest place in the middle, and joins the texts.

    Audio below ``least`` samples isn't cut: the refusal is raised.
    """

    def run(samples: np.ndarray) -> str:
        try:
            return call(samples)
        except ValueError:
            if len(samples) < least:
                raise
            low, high = int(len(samples) * 0.3), int(len(samples) * 0.7)
            width = max(1, min(box, high - low))
            energy = np.concatenate([[0.0], np.cumsum(np.abs(samples[low:high], dtype=float))])
            at = low + int(np.argmin(energy[width:] - energy[:-width])) + width // 2
            return " ".join(t for t in (run(samples[:at]), run(samples[at:])) if t)

    return run


def transcribe(clips: DataFrame, factory: Callable[[], Callable[[np.ndarray], str]], key: str = "clip_id", samples: str = "samples", punctuated: bool = False, attempts: int = 3) -> DataFrame:
    """(key, text, error) by a transcriber that each task builds once; calls are repeated, long audio is cut, failures stay rows.

    Texts of a punctuated model begin their sentences with capitals.
    """

    def ready():
        once = retrying(splitting(factory()), attempts)

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for k, s in zip(pdf[key], pdf[samples]):
                try:
                    rows.append((k, None, "no audio") if s is None else (k, once(np.asarray(s, np.float32)), None))
                except ScorerError as e:
                    rows.append((k, None, str(e)))
            return pd.DataFrame(rows, columns=[key, "text", "error"])

        return batch

    kind = clips.schema[key].dataType.simpleString()
    out = score(clips.select(key, samples), ready, f"{key} {kind}, text string, error string")
    return out.withColumn("text", T.capitalize_sentences(F.col("text"))) if punctuated else out
