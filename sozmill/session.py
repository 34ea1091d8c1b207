"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, as used by the tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sozmill")
    merged = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "12g"} | conf
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan one Parquet table of a directory; columns and filters are pushed down by Catalyst."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; a path that may not be looked at raises."""
    files, at = file_system(spark, path)
    return files.exists(at)


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that spark.checkpoint.dir names; it is deleted when the application ends.

    Only a local session may do without the setting: it gets a folder of its own machine, which is all there is.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sozmill-checkpoint-"))
    files, path = file_system(spark, context.getCheckpointDir())
    files.deleteOnExit(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no earlier stage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, partitions: int, *columns: str, placed: bool = False) -> DataFrame:
    """As ``cut_to_table``, hash-partitioned by columns in a way that later joins and groupings on them know of.

    The table is bucketed; its entry in the catalog is only there until it is read. ``placed`` rows are already partitioned so.
    A checkpoint would not do: adaptive execution hides its partitioning, and the size estimates that it keeps multiply
    from step to step of an iteration.
    """
    spark, name = df.sparkSession, f"sozmill_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{name}"
    rows = df if placed else df.repartition(partitions, *columns)
    rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(partitions, *columns).sortBy(*columns).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


#: Whether Spark deletes the shuffle files of a plan once it has run.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_to_table(df: DataFrame, freed: bool = False) -> DataFrame:
    """As ``cut``, as a compressed Parquet table beside the checkpoints: for wide rows of which later stages read some columns.

    ``freed`` deletes the shuffle files that the table was made from, which else stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, "false")
    if freed:
        spark.conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if freed:
            spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    """Partitions for an explicit repartitioning: the session's shuffle setting, never below the cluster's slots."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
