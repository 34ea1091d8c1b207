"""JSON-lines manifests: scans with line numbers, strict validation, atomic publication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sozmill.session import exists, file_system


class ManifestError(ValueError):
    """The first broken line of a manifest, as ``path:line: reason``."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all non-blank lines; numbers are 1-based and count blank lines, files may be split.

    Blocks number their own lines; a table of one row per block carries the offsets, so no file is read by one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    block = Window.partitionBy("file", "block")
    placed = raw.withColumn("n", F.row_number().over(block.orderBy("seq")))
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"))
    joined = placed.join(offsets, ["file", "block"])
    return joined.select("file", (F.col("offset") + F.col("n")).alias("line_no"), F.trim("value").alias("line")).where("line <> ''")


def manifest_issues(lines: DataFrame, schema: StructType, rules: Column | None = None, key: str | None = None) -> DataFrame:
    """Adds ``row`` (the parsed struct) and ``issue``; null where the line is sound.

    Issues are: not JSON, keys outside the schema, the messages of ``rules`` (a column over the schema's names, empty for a
    valid row), and, where the row has none of these, a ``key`` met on an earlier line of its file.
    """
    loose = StructType([*schema.fields, StructField("_broken", StringType())])
    parsed = lines.withColumn("row", F.from_json("line", loose, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    unknown = F.array_except(F.coalesce(F.json_object_keys("line"), F.array()), F.array(*[F.lit(n) for n in schema.names]))
    issue = F.when(F.col("row").isNull() | F.col("row._broken").isNotNull(), F.lit("not a JSON object of the schema")).when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ", ")))
    if rules is not None:
        # Rules name bare columns, so the line's own stand aside in a struct.
        spread = parsed.select(F.struct(*[F.col(c) for c in parsed.columns], issue.alias("_issue")).alias("_line"), *[F.col(f"row.{n}").alias(n) for n in schema.names])
        parsed = spread.withColumn("_rules", F.nullif(rules, F.lit(""))).select("_line.*", "_rules")
        issue = F.coalesce(F.col("_issue"), F.col("_rules"))
    checked = parsed.withColumn("issue", issue).drop("_issue", "_rules")
    if key is None:
        return checked
    sound = checked.where("issue is null").select("file", F.col(f"row.{key}").alias("_key"), "line_no")
    first = sound.groupBy("file", "_key").agg(F.min("line_no").alias("_first"))
    met = checked.withColumn("_key", F.col(f"row.{key}")).join(first, ["file", "_key"], "left")
    again = F.when(F.col("line_no") > F.col("_first"), F.concat(F.lit(f"duplicate {key}: "), F.col("_key").cast("string")))
    return met.withColumn("issue", F.coalesce("issue", again)).select(*checked.columns)


def scan_strict(spark: SparkSession, path: str, schema: StructType, rules: Column | None = None, key: str | None = None) -> DataFrame:
    """Typed rows of a manifest; raises ManifestError naming the first broken line of the first broken file.

    Without ``rules``, fields that the schema doesn't allow to be null must be there.
    """
    if rules is None:
        rules = F.concat_ws("; ", *[F.when(F.col(f.name).isNull(), f"{f.name}: missing") for f in schema.fields if not f.nullable], F.lit(None))
    checked = manifest_issues(numbered_lines(spark, path), schema, rules, key)
    broken = checked.where("issue is not null").orderBy("file", "line_no").select("file", "line_no", "issue").first()
    if broken:
        raise ManifestError(f"{broken['file']}:{broken['line_no']}: {broken['issue']}")
    return checked.select(*[F.col(f"row.{n}").alias(n) for n in schema.names])


def _replace(spark: SparkSession, staged: str, target: str) -> None:
    """Move ``staged`` to ``target``; what was there stays beside it until the move is done, and comes back if it fails."""
    files, new = file_system(spark, staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place, old = path(target), path(f"{target}.old-{uuid.uuid4().hex[:8]}")
    had = files.exists(place)
    if had and not files.rename(place, old):
        raise OSError(f"cannot move {target} aside")
    if not files.rename(new, place):
        if had:
            files.rename(old, place)
        raise OSError(f"cannot move {staged} to {target}")
    if had:
        files.delete(old, True)


def publish(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Write a JSON-lines directory beside ``path`` and move it there when complete; returns the rows written."""
    staged, seen = f"{path}.tmp-{uuid.uuid4().hex[:8]}", Observation()
    rows = df.orderBy(*order) if order else df
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(staged, ignoreNullFields=False)
    _replace(df.sparkSession, staged, path)
    return seen.get["rows"]


def append_then_compact(spark: SparkSession, finished: DataFrame, path: str, key: str, schema: StructType) -> int:
    """Add finished rows to a manifest without repeating a key, and leave it sorted by key; safe to run again.

    Only a path that isn't there counts as an empty manifest; a manifest that cannot be read, or holds broken lines, raises
    and stays as it is.
    """
    known = scan_strict(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)
    fresh = finished.select(*schema.names).dropDuplicates([key]).join(known.select(key), key, "left_anti").select(*schema.names)
    return publish(known.unionByName(fresh), path, [key])
