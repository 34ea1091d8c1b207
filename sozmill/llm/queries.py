"""Queries of the llm operators over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.functions.keys import key, latest
from sozmill.session import cut, table

CAP_SHARE = 0.02
SPLIT_SHARES = {"train": 0.96, "val": 0.02, "test": 0.02}


def _segments(spark: SparkSession, base: str, **columns) -> DataFrame:
    return latest(table(spark, base, "segments"), "id", "written_at", columns)


def _runs(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.language import fit_on, identify

    documents = table(spark, base, "documents")
    dictionaries = fit_on(documents)
    # Every line of a raw-line source is a sentence.
    text = F.when(key("source") == "asr_raw_lines", F.regexp_replace("text", "\n", "\n\n")).otherwise(F.col("text")).alias("text")
    docs = documents.select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("record_key"), F.col("lang").alias("label"), text)
    segments = _segments(spark, base, text=F.col("text")).select(F.lit("segment").alias("record_kind"), F.col("id").alias("record_key"), F.lit("uz").alias("label"), "text")
    return identify(docs, dictionaries).unionByName(identify(segments, dictionaries, "uz"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.language import label_language

    wrong = (F.col("parts") > 1) | ~label_language(F.col("label")).eqNullSafe(F.col("lang"))
    # What can't be told is no case.
    return _runs(spark, base).where(wrong & (F.col("lang") != "und")).select("record_kind", "record_key", "part_no", "lang")


def p1_runs(spark: SparkSession, base: str) -> DataFrame:
    return _runs(spark, base)


def _capped(spark: SparkSession, base: str, randomness: float) -> DataFrame:
    from sozmill.llm.cap import cap_contributors

    rows = cut(_segments(spark, base, contributor=key("channel_id"), score=F.col("asr_cer")))
    limit = rows.agg(F.floor(F.count("contributor") * CAP_SHARE).alias("n")).first()["n"]
    return cap_contributors(rows, "id", "contributor", "score", limit, randomness=randomness)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return _capped(spark, base, 0.0).where("not keep").select("id")


def p3_sample(spark: SparkSession, base: str) -> DataFrame:
    return _capped(spark, base, 1.0)


def p3_counts(spark: SparkSession, base: str) -> DataFrame:
    rows = _capped(spark, base, 0.0).where("contributor is not null")
    return rows.groupBy(F.col("contributor").alias("channel_id")).agg(F.count(F.lit(1)).alias("records"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def _packed(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.packing import pack

    length = F.when(~F.isnan("duration") & (F.col("duration") < 9e12), F.ceil(F.col("duration") * 1000 - 1e-6))
    segments = _segments(spark, base, grp=key("source"), duration=F.col("duration")).select(F.concat(F.lit("segment "), "id").alias("item"), "grp", length.alias("length"))
    manifest = table(spark, base, "asr_manifest").where("sample_id is not null").groupBy("sample_id").agg(F.max(F.struct("duration", key("source").alias("grp"))).alias("r"))
    samples = manifest.select(F.concat(F.lit("sample "), F.col("sample_id").cast("string")).alias("item"), F.col("r.grp").alias("grp"), F.col("r.duration").alias("duration"))
    samples = samples.select("item", "grp", length.alias("length"))
    limits = table(spark, base, "batch_limits").select(key("source").alias("grp"), F.floor(F.col("capacity_seconds") * 1000 + 1e-6).alias("capacity"))
    packed = pack(segments.unionByName(samples), limits)
    return packed.withColumns({"item_kind": F.substring_index("item", " ", 1), "item_key": F.substring(F.col("item"), F.instr("item", " ") + 1, F.length("item"))})


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base).where("pieces > 1").select("item_kind", "item_key").distinct()


def p4_packed(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base).select("item_kind", "item_key", F.col("grp").alias("source"), "piece", "pieces", F.col("length").alias("length_ms"), "container")


def p4_pieces(spark: SparkSession, base: str) -> DataFrame:
    """Every item with its pieces put together again: all of its length is placed, in as few pieces as its capacity allows."""
    placed = F.col("container").isNotNull()
    rows = _packed(spark, base).groupBy("item_kind", "item_key")
    return rows.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.bool_and(placed), F.lit(False)).alias("placed"), F.sum("length").alias("length_ms"))


def p4_containers(spark: SparkSession, base: str) -> DataFrame:
    used = _packed(spark, base).where("container is not null").groupBy("grp", "container").agg(F.sum("length").alias("used"), F.max("capacity").alias("capacity"))
    return used.groupBy(F.col("grp").alias("source")).agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("used") / F.max("capacity")).alias("least_containers"), F.max(F.col("used") - F.col("capacity")).alias("most_over_ms"),
        F.round(1 - F.sum("used") / F.sum("capacity"), 5).alias("unused_share"),
    )


def _overlaps(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    from sozmill.llm.contamination import cross_split_overlaps, current_utterances

    return cross_split_overlaps(current_utterances(table(spark, base, "segments"), table(spark, base, "segment_splits")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.contamination import overlap_pairs

    pairs = overlap_pairs(*_overlaps(spark, base))
    return pairs.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def p5_counts(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.contamination import overlap_records

    return overlap_records(*_overlaps(spark, base)).groupBy(F.col("held_split").alias("split"), F.col("held_source").alias("source")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("partners").alias("pairs"), F.count_if(F.col("edits") == 0).alias("exact_records"), F.round(F.avg("coverage"), 4).alias("mean_coverage")
    )


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.grouped_split import group_records

    return group_records(table(spark, base, "segments"))


def p6_split(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.grouped_split import assign_splits

    return assign_splits(p6_found(spark, base), SPLIT_SHARES)


def p7_leaks(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.leakage import find_leaks

    return find_leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_leaks(spark, base).select("doc_id", "item_id")


def p8_selection(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.mixing import mix

    return mix(table(spark, base, "documents"), table(spark, base, "mix_targets"))[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.mixing import mix

    return mix(table(spark, base, "documents"), table(spark, base, "mix_targets"))[1]


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    from sozmill.llm.sentences import sentence_units

    return sentence_units(table(spark, base, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_runs, p3_found, p3_sample, p3_counts, p4_found, p4_packed, p4_pieces, p4_containers, p5_found, p5_counts, p6_found, p6_split, p7_found, p7_leaks, p8_selection, p8_shares, p9_found)}


_CURRENT = """current_segments AS (
  SELECT lower(trim(id)) AS sid, nullif(lower(trim(channel_id)), '') AS channel, nullif(lower(trim(source)), '') AS src,
         nullif(lower(trim(speaker_id)), '') AS speaker, asr_cer, duration, text
  FROM segments
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY written_at DESC NULLS LAST) = 1)"""

_P3 = f"""WITH {_CURRENT}, limits AS (SELECT floor(count(channel) * {CAP_SHARE}) AS cap FROM current_segments),
ranked AS (SELECT sid, channel, row_number() OVER (PARTITION BY channel ORDER BY asr_cer ASC NULLS LAST, sid) AS r
  FROM current_segments WHERE channel IS NOT NULL)"""


_TIES = f"""WITH RECURSIVE {_CURRENT}, n AS (SELECT sid, 'c:' || channel AS c, CASE WHEN regexp_matches(speaker, '^spk_[0-9]{{7}}$') THEN 's:' || src || '/' || speaker END AS s FROM current_segments),
e AS (SELECT DISTINCT coalesce(c, s) AS a, coalesce(s, c) AS b FROM n WHERE coalesce(c, s) IS NOT NULL), pair AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reached FROM pair UNION SELECT r.node, pair.b FROM r JOIN pair ON pair.a = r.reached), k AS (SELECT node, min(reached) AS component FROM r GROUP BY node)"""

_COUNTED = f"""WITH {_CURRENT}, lim AS (SELECT lower(trim(source)) AS src, max(CAST(floor(capacity_seconds * 1000 + 1e-6) AS BIGINT)) AS cap FROM batch_limits GROUP BY 1),
x AS (SELECT 'segment' AS item_kind, sid AS item_key, src, duration FROM current_segments UNION ALL SELECT 'sample', CAST(sample_id AS VARCHAR), max(lower(trim(source))), max(duration) FROM asr_manifest GROUP BY sample_id),
y AS (SELECT x.*, cap, CASE WHEN NOT isnan(duration) THEN CAST(ceil(duration * 1000 - 1e-6) AS BIGINT) END AS len FROM x LEFT JOIN lim USING (src))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"{_TIES} SELECT sid AS id, coalesce(component[3:], sid) AS group_key FROM n LEFT JOIN k ON k.node = coalesce(c, s)",
        "p4_pieces": f"{_COUNTED} SELECT item_kind, item_key, CAST(CASE WHEN len > 0 AND cap > 0 THEN (len + cap - 1) // cap ELSE 1 END AS BIGINT) AS pieces, coalesce(len > 0 AND cap > 0, false) AS placed, len AS length_ms FROM y",
        "p4_found": f"""WITH {_CURRENT}, lim AS (SELECT lower(trim(source)) AS src, max(capacity_seconds) AS cap FROM batch_limits GROUP BY 1)
SELECT DISTINCT 'segment' AS item_kind, sid AS item_key FROM current_segments JOIN lim USING (src) WHERE duration > cap
UNION ALL SELECT DISTINCT 'sample', CAST(sample_id AS VARCHAR) FROM asr_manifest m JOIN lim ON lim.src = lower(trim(m.source)) WHERE duration > cap""",
        "p3_found": f"{_P3} SELECT sid AS id FROM ranked, limits WHERE r > cap",
        "p3_counts": f"""{_P3} SELECT channel AS channel_id, count(*) AS records, count(*) FILTER (WHERE r <= cap) AS kept,
  count(*) FILTER (WHERE r > cap) AS dropped FROM ranked, limits GROUP BY channel""",
    }
