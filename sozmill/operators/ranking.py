"""Exact ranks and sums before a row, within groups of any size, without a window over a whole group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from sozmill.session import cut, parallelism


def _running(group: list[str], values: list[str]):
    """Per partition and group, the rows and the sums of ``values`` before each row; rows come sorted by group."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, before = None, [0] * (1 + len(values))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(g)) for g in group]
            codes = np.stack([c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in columns])
            fresh = np.ones(n, bool)
            fresh[1:] = (codes[:, 1:] != codes[:, :-1]).any(0)
            fresh[0] = [c[0].as_py() for c in columns] != last
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            carried = ~fresh[0] & (np.cumsum(fresh) == 0)
            added = [np.ones(n, np.int64), *[batch.column(batch.schema.get_field_index(v)).fill_null(0).to_numpy(zero_copy_only=False) for v in values]]
            out = []
            for k, value in enumerate(added):
                value = value.astype(np.float64 if value.dtype.kind == "f" else np.int64)
                upto = np.cumsum(value) - value
                out.append(upto - upto[start] + np.where(carried, before[k], 0).astype(value.dtype))
                before[k] = (out[-1][-1] + value[-1]).item()
            last = [c[n - 1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), *[pa.array(o) for o in out]], names=[*batch.schema.names, "_part", *[f"_b{k}" for k in range(len(out))]]
            )

    return run


def spread_before(df: DataFrame, group: list[str], order: list[Column], names: dict[str, str | None], partitions: int | None = None) -> DataFrame:
    """Adds, under each name of ``names``, the sum of the named column over the rows before each one in its group, or their number for None.

    Rows are range-partitioned by group and order together, so a hot group spans many partitions, and are summed up within
    their partition as they stream through. Only a group that goes on from one partition to the next needs an offset, so
    there are fewer offsets than partitions. The rows are cut to the checkpoint folder, because they are read twice and
    partition ids must not change in between. Null values count as 0.
    """
    n = partitions or parallelism(df)
    keys = [F.col(c).asc_nulls_first() for c in group]
    values = [v for v in names.values() if v]
    sums = {name: f"_b{values.index(v) + 1 if v else 0}" for name, v in names.items()}
    kinds = [DoubleType() if isinstance(df.schema[v].dataType, (DoubleType, FloatType)) else LongType() for v in values]
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_b0", LongType()), *[StructField(f"_b{k + 1}", t) for k, t in enumerate(kinds)]])
    placed = cut(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(_running(group, values), schema))
    whole = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_b0"), *[F.coalesce(F.sum(v), F.lit(0)).alias(f"_b{k + 1}") for k, v in enumerate(values)])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), *[F.sum(f"_b{k}").over(earlier).alias(f"_o{k}") for k in range(len(values) + 1)])
    condition = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        condition = condition & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(F.broadcast(offsets.where("_o0 is not null")), condition, "left")
    return joined.select(*df.columns, *[(F.col(b) + F.coalesce(F.col(f"_o{b[2:]}"), F.lit(0))).alias(name) for name, b in sums.items()])


def spread_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in its group, however large the group is."""
    return spread_before(df, group, order, {name: None}, partitions).withColumn(name, F.col(name) + 1)


def newest(df: DataFrame, group: str, order: Column, keep: int) -> DataFrame:
    """The ``keep`` greatest rows of each group by ``order``; a null group or order is left out.

    A window with a rank limit keeps at most ``keep`` rows of a group in each task before the shuffle.
    """
    rows = df.where(F.col(group).isNotNull() & order.isNotNull())
    place = F.row_number().over(Window.partitionBy(group).orderBy(order.desc(), *[F.col(c).desc() for c in df.columns if c != group]))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
