"""Order-dependent selection at scale: budgets by prefix sums, greedy batches, seeded orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sozmill.operators.ranking import spread_before


def seeded(seed: int, key: Column) -> Column:
    """Order key of a seeded shuffle, the same in any engine with SHA-1."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def spread_prefix(df: DataFrame, group: list[str], order: list[Column], value: str, name: str = "before") -> DataFrame:
    """Sum of ``value`` over the rows before each one in its group, no group being gathered in one task."""
    return spread_before(df, group, order, {name: value})


def cap_by_budget(df: DataFrame, group: str, budgets: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Rows of each group while the sum before them is below its budget; groups without a budget keep all.

    ``budgets`` has the group column and ``budget`` in the unit of ``value``; values must not be negative.
    """
    limited = spread_prefix(df.join(budgets, group), [group], order, value)
    free = df.join(budgets, group, "left_anti")
    return limited.where("before < budget").select(*df.columns).unionByName(free.select(*df.columns))


def cap_from_base(df: DataFrame, group: str, base: DataFrame, value: str, order: list[Column], cap: float) -> DataFrame:
    """Rows with ``taken``: whether what their group has already, and the rows before, are still below ``cap``.

    ``base`` has the group column and ``base``, at most one row a group, in the unit of ``value``; a group without starts at 0.
    """
    summed = spread_prefix(df, [group], order, value).join(base, group, "left")
    return summed.withColumn("taken", F.col("before") + F.coalesce("base", F.lit(0)) < cap).select(*df.columns, "taken")


def greedy_batches(df: DataFrame, shard: str, order: list[str], cost: str, budget: float, columns: list[str]) -> DataFrame:
    """Batches of consecutive rows per shard: a batch closes when its longest cost times its rows would exceed the budget.

    A shard is one file's rows; its rows stream through one task in order and only the open batch is held.
    """
    names = [shard, *order, *[c for c in columns if c not in (shard, *order)]]
    # Rows with equal order must leave in one order whatever the partitioning.
    rows = df.select(*names, F.col(cost).cast("double").alias("_cost")).repartition(F.col(shard)).sortWithinPartitions(shard, *order, "_cost")

    def run(batches):
        current, longest, count, batch = None, 0.0, 0, 0
        for pdf in batches:
            numbers = []
            for s, c in zip(pdf[shard], pdf["_cost"]):
                if s != current:
                    current, longest, count, batch = s, 0.0, 0, 0
                if count and max(longest, c) * (count + 1) > budget:
                    batch, longest, count = batch + 1, 0.0, 0
                longest, count = max(longest, c), count + 1
                numbers.append(batch)
            yield pdf.drop(columns="_cost").assign(batch=pd.Series(numbers, dtype="int64", index=pdf.index))

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*df.select(*names).schema.fields]).add("batch", LongType())
    return rows.mapInPandas(run, schema)


def pad(values: Column, length: Column) -> Column:
    """An array padded with zeros on the right."""
    return F.concat(values, F.array_repeat(F.lit(0), F.greatest(length - F.size(values), F.lit(0))))
