"""Comparable identifiers and current versions of manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(column: str | Column) -> Column:
    """Trimmed, lower-cased identifier; blank becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def split_name(column: str | Column) -> Column:
    """train, val or test; ``dev`` and ``validation`` mean val; anything else is null."""
    c = key(column)
    return F.when(c.isin("dev", "validation", "val"), "val").when(c.isin("train", "test"), c)


def latest(df: DataFrame, id_col: str, version_col: str, columns: dict[str, Column]) -> DataFrame:
    """The row with the greatest version per trimmed, lower-cased id; ties go to the greatest remaining content.

    Rows with a null or blank id are dropped, null versions are the oldest; partial maxima are taken before the shuffle.
    Returns ``id`` and ``columns``.
    """
    packed = F.struct(F.col(version_col).alias("_version"), *[c.alias(n) for n, c in columns.items()])
    rows = df.select(key(id_col).alias("id"), packed.alias("_row")).where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(F.max("_row").alias("_row")).select("id", *[F.col("_row")[n].alias(n) for n in columns])
