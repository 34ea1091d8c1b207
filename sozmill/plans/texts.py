"""Text queries over segments and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozmill.functions import text as T
from sozmill.plans.catalog import Catalog, sql_apostrophes, sql_collapse, sql_normalize, sql_raw
from sozmill.session import table

CATALOG = Catalog()
add = CATALOG.add


def _texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "segments").select("id", "text").where("text is not null")


def _each(spark, base, value) -> DataFrame:
    return _texts(spark, base).select("id", value.alias("value"))


def _sql(expression: str) -> str:
    return f"SELECT id, {expression} AS value FROM segments WHERE text IS NOT NULL"


@add(_sql(sql_normalize("text")))
def normalize_text(spark, base):
    return _each(spark, base, T.normalize_text(F.col("text")))


@add(_sql(sql_raw("text")))
def clean_raw_text(spark, base):
    return _each(spark, base, T.clean_raw(F.col("text")))


@add(_sql(sql_apostrophes("text", T.FRONTEND_APOSTROPHES)))
def apostrophes_frontend(spark, base):
    return _each(spark, base, T.apostrophes_frontend(F.col("text")))


@add(_sql(sql_apostrophes("text", T.CORPUS_APOSTROPHES)))
def apostrophes_corpus(spark, base):
    return _each(spark, base, T.apostrophes_corpus(F.col("text")))


def _sql_translit(x: str) -> str:
    """The letter е twice, as neighbouring ones share their context; placeholders stand for its ye."""
    before = r"(^|[^\p{L}\x01\x02]|[аеёиоуэюяўъьАЕЁИОУЭЮЯЎЪЬ\x01\x02])"
    for _ in range(2):
        x = rf"regexp_replace({x}, '{before}е', '\1' || chr(1), 'g')"
        x = rf"regexp_replace({x}, '{before}Е', '\1' || chr(2), 'g')"
    x = rf"replace(replace(regexp_replace({x}, '\x02(\p{{Lu}}|\x02)', 'YE\1', 'g'), chr(1), 'ye'), chr(2), 'Ye')"
    for letter, latin in T.SEVERAL.items():
        upper = letter.upper()
        x = f"replace({x}, '{letter}', '{latin}')"
        for _ in range(2):
            x = rf"regexp_replace({x}, '{upper}(\p{{Lu}})', '{latin.upper()}\1', 'g')"
        x = f"replace({x}, '{upper}', '{latin[0].upper() + latin[1:]}')"
    plain, target = T.SINGLE_FROM + "е", T.SINGLE_TO + "e"
    return f"replace(replace(translate({x}, '{plain + plain.upper()}ъЪ', '{target + target.upper()}ʼʼ'), 'ь', ''), 'Ь', '')"


@add(_sql(_sql_translit("text")))
def transliterate(spark, base):
    return _each(spark, base, T.transliterate(F.col("text")))


def _words_macro(n: str) -> str:
    """SQL words of a whole number below 10**18 (a BIGINT): the groups of three from the highest on, with their scales."""
    ones = "['', 'bir', 'ikki', 'uch', 'toʻrt', 'besh', 'olti', 'yetti', 'sakkiz', 'toʻqqiz']"
    tens = "['', 'oʻn', 'yigirma', 'oʻttiz', 'qirq', 'ellik', 'oltmish', 'yetmish', 'sakson', 'toʻqson']"
    scales = "['', 'ming', 'million', 'milliard', 'trillion', 'kvadrillion']"
    triple = f"list_filter([CASE WHEN g // 100 > 1 THEN {ones}[g // 100 + 1] ELSE '' END, CASE WHEN g >= 100 THEN 'yuz' ELSE '' END, {tens}[g % 100 // 10 + 1], {ones}[g % 10 + 1]], lambda w: w <> '')"
    group = f"list_transform([abs({n}) // CAST(pow(1000, k) AS BIGINT) % 1000], lambda g: CASE WHEN g = 0 THEN '' WHEN g = 1 AND k = 1 THEN 'ming' ELSE trim(array_to_string({triple}, ' ') || ' ' || {scales}[k + 1]) END)[1]"
    groups = f"list_filter(list_transform([5, 4, 3, 2, 1, 0], lambda k: {group}), lambda w: w <> '')"
    return f"CASE WHEN {n} = 0 THEN 'nol' ELSE CASE WHEN {n} < 0 THEN 'minus ' ELSE '' END || array_to_string({groups}, ' ') END"


@add(f"WITH x AS (SELECT DISTINCT CAST(row_no AS BIGINT) AS r FROM asr_manifest WHERE row_no IS NOT NULL), y AS (SELECT DISTINCT unnest([r, -r, r * 1000003, r * 1000000007]) AS n FROM x) SELECT n, {_words_macro('n')} AS words FROM y")
def int_to_words(spark, base):
    """Words of row numbers, of their negatives, and of multiples that reach the higher scales."""
    r = F.col("row_no").cast("bigint")
    rows = table(spark, base, "asr_manifest").where("row_no is not null").select(r.alias("r")).distinct()
    numbers = rows.select(F.explode(F.array(F.col("r"), -F.col("r"), F.col("r") * 1000003, F.col("r") * 1000000007)).alias("n")).distinct()
    return numbers.select("n", T.int_to_words(F.col("n").cast("string")).alias("words"))


# Digits of the corpus' other scripts, each ten in a row.
_OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९๐๑๒๓๔๕๖๗๘๙０１２３４５６７８９"
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _sql_expand(text: str) -> str:
    """Numbers of a text as words. A group of three must not go on in a digit, which RE2 cannot look ahead for; so a mark
    goes behind every digit that isn't followed by one."""
    marked = rf"regexp_replace({text}, '(\p{{Nd}})(\P{{Nd}}|$)', '\1' || chr(1) || '\2', 'g')"
    number = rf"\p{{Nd}}{{1,3}}(?:\x01[ ,]\p{{Nd}}{{3}})+\x01|\p{{Nd}}+\x01"
    digits = f"translate(translate(regexp_replace(m, '{_SPACE}*%$', ''), ' ,' || chr(1), ''), '{_OTHER_DIGITS}', '{'0123456789' * 5}')"
    words = f"list_transform([TRY_CAST({digits} AS BIGINT)], lambda n: {_words_macro('n')})[1]"
    spelled = f"list_transform(regexp_extract_all({marked}, '({number})({_SPACE}*%)?'), lambda m: CASE WHEN length(ltrim({digits}, '0')) > 18 THEN m ELSE {words} || CASE WHEN m LIKE '%\\%' ESCAPE '\\' THEN ' foiz' ELSE '' END END)"
    return f"replace(array_to_string(list_transform(list_zip(string_split_regex({marked}, '({number})({_SPACE}*%)?'), {spelled}), lambda z: z[1] || coalesce(z[2], '')), ''), chr(1), '')"


@add(_sql(_sql_expand("text")))
def expand_numbers(spark, base):
    return _each(spark, base, T.expand_numbers(F.col("text")))


@add(f"SELECT doc_id, {_sql_expand('text')} AS value FROM documents")
def expand_numbers_documents(spark, base):
    """Numbers of whole documents."""
    return table(spark, base, "documents").select("doc_id", T.expand_numbers(F.col("text")).alias("value"))


_FRONT = sql_collapse("regexp_replace(lower(v), '[^a-zʻʼ ]', ' ', 'g')")


@add(
    f"WITH a AS (SELECT id, {_sql_translit(sql_apostrophes('text', T.FRONTEND_APOSTROPHES))} AS t FROM segments WHERE text IS NOT NULL), b AS (SELECT id, {_sql_expand('t')} AS v FROM a) SELECT id, {_FRONT} AS value FROM b"
)
def frontend_normalize(spark, base):
    return _each(spark, base, T.frontend_normalize(F.col("text")))


@add(
    "SELECT id, trim(regexp_replace(regexp_replace(replace(" + sql_normalize("text") + ", ' ', '  '), ' {1,2}(da|ku|chi|mi|yu|ya|ta)( |$)', '\\1\\2', 'g'), ' +', ' ', 'g')) AS value "
    "FROM segments WHERE text IS NOT NULL"
)
def join_clitics(spark, base):
    return _each(spark, base, T.join_clitics(T.normalize_text(F.col("text"))))


_START = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_HEAD = f"CASE WHEN regexp_matches(lower(text), '^{_START}*[a-z]') THEN regexp_extract(lower(text), '^{_START}*') || upper(regexp_extract(lower(text), '^{_START}*([a-z])', 1)) || regexp_replace(lower(text), '^{_START}*[a-z]', '') ELSE lower(text) END"


@add(
    f"WITH h AS (SELECT id, {_HEAD} AS t FROM segments WHERE text IS NOT NULL) SELECT id, array_to_string(list_transform(list_zip(string_split_regex(t, '[.?!]{_START}+[a-z]'), "
    f"list_transform(regexp_extract_all(t, '[.?!]{_START}+[a-z]'), lambda m: m[:-2] || upper(m[-1]))), lambda z: z[1] || coalesce(z[2], '')), '') AS value FROM h"
)
def capitalize_sentences(spark, base):
    return _each(spark, base, T.capitalize_sentences(F.lower("text")))


@add(_sql(r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s\x0B\x{85}\p{Z}.,?!ʻʼ''\x{200C}\x{200D}-]', ' ', 'g'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ?([.,?!])', '\1', 'g'))"))
def punct_target(spark, base):
    return _each(spark, base, T.punct_target(F.col("text")))


@add(_sql(sql_collapse("translate(text, '.,?!', '    ')")))
def strip_punct(spark, base):
    return _each(spark, base, T.strip_punct(F.col("text")))


@add(_sql(sql_collapse(r"regexp_replace(text, '\[kulgu\]|\[musiqa\]|\[qarsak\]|\[yoʻtal\]', ' ', 'g')")))
def strip_event_tags(spark, base):
    return _each(spark, base, T.strip_event_tags(F.col("text")))


VOCABULARY = [" ", "'", *"abcdefghijklmnopqrstuvwxyz", *T.PUNCTUATION]
_CLEAN = sql_collapse("translate(translate(lower(text), 'ʻʼ’‘`´', ''''''''''''''), '-—–', '   ')")
_VOC = "[" + ", ".join("''''" if v == "'" else f"'{v}'" for v in VOCABULARY) + "]"


@add(f"SELECT id, CASE WHEN regexp_matches({_CLEAN}, '^[a-z ''.,?!]*$') THEN length({_CLEAN}) END AS characters, CASE WHEN regexp_matches({_CLEAN}, '^[a-z ''.,?!]*$') THEN coalesce(list_sum(list_transform(list_filter(string_split({_CLEAN}, ''), lambda c: c <> ''), lambda c: list_position({_VOC}, c) - 1)), 0) END AS id_sum FROM segments WHERE text IS NOT NULL")
def encode_text(spark, base):
    """Number and sum of a text's character ids; null where a character has none."""
    ids = _texts(spark, base).select("id", T.encode(F.lower("text"), VOCABULARY).alias("ids"))
    return ids.select("id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("bigint").alias("characters"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@add(f"SELECT count(*) FILTER (WHERE regexp_matches({_CLEAN}, '^[a-z ''.,?!]+$')) AS encodable, count(*) AS rows FROM segments WHERE text IS NOT NULL")
def encodable_rows(spark, base):
    ids = _texts(spark, base).select(T.encode(F.lower("text"), VOCABULARY).alias("ids"))
    return ids.agg(F.count_if(F.col("ids").isNotNull() & (F.size("ids") > 0)).alias("encodable"), F.count(F.lit(1)).alias("rows"))


_TARGET = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(nullif(text_raw, ''), text)), '[^\p{L}\p{M}\p{N}\p{Pc}\s\x0B\x{85}\p{Z}.,?!ʻʼ''\x{200C}\x{200D}-]', ' ', 'g'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ?([.,?!])', '\1', 'g'))"


@add(f"SELECT sample_id, {_TARGET} AS target FROM asr_manifest")
def training_targets(spark, base):
    raw = F.coalesce(F.nullif("text_raw", F.lit("")), F.col("text"))
    return table(spark, base, "asr_manifest").select("sample_id", T.punct_target(raw).alias("target"))


@add("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS value FROM documents")
def html_escape(spark, base):
    return table(spark, base, "documents").select("doc_id", T.html_escape(F.col("text")).alias("value"))


@add("SELECT channel_id, regexp_matches(name, '[\\x{400}-\\x{4FF}]') AS cyrillic FROM channels")
def script_detect(spark, base):
    return table(spark, base, "channels").select("channel_id", F.col("name").rlike("[Ѐ-ӿ]").alias("cyrillic"))


@add("SELECT sample_id, sha256(coalesce(parquet, '') || '|' || coalesce(CAST(row_no AS VARCHAR), '') || '|' || coalesce(audio_filepath, '') || '|' || text || '|' || source) AS digest FROM asr_manifest")
def row_digest(spark, base):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("parquet", "row_no", "audio_filepath")]
    return table(spark, base, "asr_manifest").select("sample_id", F.sha2(F.concat_ws("|", *parts, "text", "source"), 256).alias("digest"))


@add("SELECT id, substr(sha1(audio_path), 1, 10) AS value FROM segments")
def key_hash(spark, base):
    return table(spark, base, "segments").select("id", F.substring(F.sha1(F.col("audio_path").cast("binary")), 1, 10).alias("value"))

