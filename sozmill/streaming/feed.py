"""A feed of updates as a stream: parsing, admission to a registry, exactly-once by offsets and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<message_id:bigint,chat:string,text:string,caption:string,entities:array<struct<type:string,url:string>>>"
UPDATE = f"update_id bigint, channel_post {MESSAGE}, message {MESSAGE}"


def parse_updates(df: DataFrame, column: str) -> DataFrame:
    """Adds chat, message_id, text and links of text entities; updates of neither kind are dropped."""
    parsed = df.withColumn("_u", F.from_json(F.col(column), UPDATE)).withColumn("_m", F.coalesce("_u.channel_post", "_u.message")).where("_m is not null")
    text = F.coalesce(F.nullif("_m.text", F.lit("")), F.col("_m.caption"), F.lit(""))
    links = F.transform(F.filter(F.coalesce("_m.entities", F.array()), lambda e: (e["type"] == "text_link") & e["url"].isNotNull()), lambda e: e["url"])
    return parsed.select(*df.columns, F.col("_u.update_id").alias("update_id"), F.col("_m.chat").alias("chat"), F.col("_m.message_id").alias("message_id"), text.alias("text"), links.alias("entity_links"))


def admitted(candidates: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """Candidates (channel_id, url, order) whose id and url the registry lacks, the first of each id.

    An id is a function of its url, so two candidates that share a url share the id; first-per-id after both anti joins
    is what admitting them one by one gives. Candidates without url are dropped.
    """
    fresh = candidates.where("url is not null and channel_id is not null")
    fresh = fresh.join(registry.select("channel_id").distinct(), "channel_id", "left_anti").join(registry.select("url").distinct(), "url", "left_anti")
    return fresh.groupBy("channel_id").agg(F.min(F.struct(order, "url")).alias("r")).select("channel_id", F.col("r.url").alias("url"), F.col(f"r.{order}").alias(order))


def follow(spark: SparkSession, updates: str, registry: str, checkpoint: str, site: str, short: str, base_url: str):
    """Start a stream that reads update files once, and appends newly admitted channels to a Parquet registry.

    The checkpoint holds the offset; a batch that is run again admits nothing twice, because its channels are known then.
    Returns the started query (trigger: all available, then stop).
    """
    from sozmill.functions import urls as U

    stream = spark.readStream.text(updates).withColumnRenamed("value", "update")
    parsed = parse_updates(stream, "update")
    links = F.array_distinct(F.concat(U.extract_links(F.col("text")), F.col("entity_links")))
    found = parsed.select("update_id", F.explode(links).alias("link")).where(U.is_video_host(F.col("link"), site, short))
    made = found.select("update_id", U.mint_id(F.col("link")).alias("channel_id"), U.canonical_channel(F.col("link"), base_url, short).alias("url"))

    def upsert(batch: DataFrame, _number: int) -> None:
        known = batch.sparkSession.read.schema("channel_id string, url string, update_id long").parquet(registry)
        admitted(batch, known, "update_id").write.mode("append").parquet(registry)

    return made.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
