"""Bounded samples of rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def bounded_sample(df: DataFrame, id_col: str, bound: int, seed: int = 0) -> DataFrame:
    """About ``bound`` rows chosen by a hash of the id (never more than twice that), or all rows of a smaller table."""
    total = df.select(id_col).count()
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_SPACE)) < int(_SPACE * bound / total)).limit(2 * bound)
