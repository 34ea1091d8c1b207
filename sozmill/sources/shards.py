"""Writing prepared rows: a shard per input file that is never written twice, and one folder per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.session import exists, file_system


def finished_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard) of the folders written below ``path``; none if there is no such path."""
    names: list[tuple[str]] = []
    if exists(spark, path):
        files, at = file_system(spark, path)
        names = [(f.getPath().getName().removeprefix("shard="),) for f in files.listStatus(at) if f.getPath().getName().startswith("shard=")]
    return spark.createDataFrame(names, "shard string")


def write_shards(df: DataFrame, file_col: str, path: str) -> DataFrame:
    """Write the rows of every input file that has no shard yet as JSON lines below ``path``; returns (shard, rows) of all shards.

    A shard is named by its file's digest, so any file name will do. Rows of a file go to one folder, by as many tasks
    as hold them. A run that was ended early leaves no shard: Spark moves the folders when its job is committed.
    """
    spark = df.sparkSession
    named = df.withColumn("shard", F.substring(F.sha2(F.col(file_col).cast("binary"), 256), 1, 16))
    fresh = named.join(F.broadcast(finished_shards(spark, path)), "shard", "left_anti")
    fresh.write.mode("append").partitionBy("shard").json(path, ignoreNullFields=False)
    if not exists(spark, path):
        return spark.createDataFrame([], "shard string, rows long")
    return spark.read.text(path).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


def fan_out(df: DataFrame, path: str, splits: tuple[str, ...] = ("train", "val", "test")) -> dict[str, int]:
    """One pass that writes every row below ``path``/split=<its split>; rows by split, empty ones with an empty folder.

    A row of no known split raises before anything is written.
    """
    spark = df.sparkSession
    other = df.where(~F.coalesce(F.col("split").isin(*splits), F.lit(False))).select("split").first()
    if other:
        raise ValueError(f"unknown split: {other['split']}")
    df.write.mode("overwrite").partitionBy("split").json(path, ignoreNullFields=False)
    files, _ = file_system(spark, path)
    for name in splits:
        files.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/split={name}"))
    counts = {r["split"]: r["rows"] for r in spark.read.schema("value string, split string").text(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows")).collect()}
    return {name: counts.get(name, 0) for name in splits}
