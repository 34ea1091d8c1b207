"""Error rates of hypotheses against references: each manifest text against the next one of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.operators.ranking import spread_before, spread_rank
from sozmill.plans.catalog import Catalog, sql_normalize
from sozmill.plans.corpus import _M, manifest_rows

CATALOG = Catalog()
add = CATALOG.add

_PLAIN = lambda x: f"translate({sql_normalize(x)}, 'ʻʼ', '''''')"
_PAIRS = f"""{_M}, q AS (SELECT sample_id, source, {_PLAIN('raw')} AS t FROM m), a AS (SELECT sample_id, source, t AS ref, lead(t) OVER (PARTITION BY source ORDER BY sample_id) AS hyp FROM q),
pairs AS (SELECT * FROM a WHERE hyp IS NOT NULL AND ref <> '')"""
_CLITICS = lambda x: rf"trim(regexp_replace(regexp_replace(replace({x}, ' ', '  '), ' {{1,2}}(da|ku|chi|mi|yu|ya|ta)( |$)', '\1\2', 'g'), ' +', ' ', 'g'))"


def _sql_words(ref: str, hyp: str) -> tuple[str, str]:
    """(distance, reference words): each distinct word becomes one byte for DuckDB's byte-wise distance."""
    split = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    both = f"list_distinct(list_concat({split(ref)}, {split(hyp)}))"
    code = lambda x: f"coalesce(array_to_string(list_transform({split(x)}, lambda w: chr(CAST(32 + list_position({both}, w) AS INTEGER))), ''), '')"
    return f"levenshtein({code(ref)}, {code(hyp)})", f"len({split(ref)})"


def pairs(spark: SparkSession, base: str) -> DataFrame:
    """(sample_id, source, ref, hyp) without a window over a whole source: ranks are joined to the next rank."""
    rows = manifest_rows(spark, base).select("sample_id", "source", F.translate(T.normalize_text(F.col("raw")), "ʻʼ", "''").alias("t")).distinct()
    ranked = spread_rank(rows, ["source"], [F.col("sample_id").asc()])
    following = ranked.select("source", (F.col("rank") - 1).alias("rank"), F.col("t").alias("hyp"))
    return ranked.join(following, ["source", "rank"]).select("sample_id", "source", F.col("t").alias("ref"), "hyp").where("ref <> ''")


def _rates(df: DataFrame, edits: Column, units: Column) -> DataFrame:
    """Edits over units of the whole corpus, not the mean of the rows."""
    sums = df.groupBy("source").agg(F.sum(edits).alias("edits"), F.sum(units).alias("units"))
    return sums.withColumn("rate", F.round(F.col("edits") / F.col("units"), 6))


_RATE = "SELECT source, sum(e) AS edits, sum(u) AS units, round(sum(e) / sum(u), 6) AS rate FROM d GROUP BY source"


@add(f"WITH {_PAIRS}, d AS (SELECT source, levenshtein(ref, hyp) AS e, length(ref) AS u FROM pairs) {_RATE}")
def corpus_cer(spark, base):
    return _rates(pairs(spark, base), F.levenshtein("ref", "hyp"), F.length("ref"))


_WD, _WN = _sql_words("ref", "hyp")


@add(f"WITH {_PAIRS}, d AS (SELECT source, {_WD} AS e, {_WN} AS u FROM pairs) {_RATE}")
def corpus_wer(spark, base):
    ref, hyp = T.words(F.col("ref")), T.words(F.col("hyp"))
    return _rates(pairs(spark, base), T.word_distance(ref, hyp), F.size(ref))


@add(f"WITH {_PAIRS}, c AS (SELECT source, {_CLITICS('ref')} AS ref, {_CLITICS('hyp')} AS hyp FROM pairs), d AS (SELECT source, {_WD} AS e, {_WN} AS u FROM c) {_RATE}")
def corpus_wer_canonical(spark, base):
    joined = pairs(spark, base).select("source", T.join_clitics(F.col("ref")).alias("ref"), T.join_clitics(F.col("hyp")).alias("hyp"))
    ref, hyp = T.words(F.col("ref")), T.words(F.col("hyp"))
    return _rates(joined, T.word_distance(ref, hyp), F.size(ref))


@add(f"WITH {_PAIRS}, d AS (SELECT source, {_WD} / {_WN} AS rate FROM pairs) SELECT source, round(quantile_cont(rate, 0.5), 6) AS median, round(quantile_cont(rate, 0.9), 6) AS p90 FROM d GROUP BY source")
def wer_quantiles(spark, base):
    """Extension: quantiles of the rows' rates."""
    ref, hyp = T.words(F.col("ref")), T.words(F.col("hyp"))
    rated = pairs(spark, base).select("source", (T.word_distance(ref, hyp) / F.size(ref)).alias("rate"))
    return rated.groupBy("source").agg(F.round(F.percentile("rate", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("rate", F.lit(0.9)), 6).alias("p90"))


@add(
    f"WITH {_PAIRS}, d AS (SELECT sample_id, source, {_WD} AS e, {_WN} AS u FROM pairs), w AS (SELECT source, row_number() OVER o AS n, sum(e) OVER o AS edits, sum(u) OVER o AS units FROM d "
    "WINDOW o AS (PARTITION BY source ORDER BY sample_id)) SELECT source, n AS rows, edits, units FROM w WHERE n % 50 = 0"
)
def running_wer(spark, base):
    ref, hyp = T.words(F.col("ref")), T.words(F.col("hyp"))
    rows = pairs(spark, base).select("sample_id", "source", T.word_distance(ref, hyp).alias("e"), F.size(ref).alias("u"))
    summed = spread_before(rows, ["source"], [F.col("sample_id").asc()], {"e0": "e", "u0": "u", "n0": None})
    n = F.col("n0") + 1
    return summed.where(n % 50 == 0).select("source", n.alias("rows"), (F.col("e0") + F.col("e")).alias("edits"), (F.col("u0") + F.col("u")).alias("units"))
