"""Queries of the text functions and of chunked recordings, over whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import documents, query
from quillmark.catalog_more import _lexicon
from quillmark.functions import text as T
from quillmark.operators import chunks
from quillmark.session import table

#: Added to each document by doc_id, as the corpus holds Latin letters only.
SNIPPETS = ("患者 は バルセロナ です Nakamura san 12", "キョウト へ 行 く ok go 3 4", "百 三百二十 １２３ 四万七千 二〇二四 十", "Привет мир, Dvořák İstanbul", "मरीज़ों को जाँच", "plain end")


def _mixed(spark, sf_dir):
    extra = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS)).cast("int") + 1)
    return documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), extra).alias("text"))


_MIXED = "WITH mixed AS (SELECT doc_id, coalesce(text, '') || ' ' || ([" + ", ".join(f"'{s}'" for s in SNIPPETS) + f"])[CAST(doc_id % {len(SNIPPETS)} AS INT) + 1] AS text FROM documents) "
_LATIN = "regexp_replace(text, '[^\\x00-\\x{24F}]', '', 'g')"


def _latin(spark, sf_dir):
    return _mixed(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x{24F}]", ""))


query("diacritic_fold", _MIXED + f"SELECT doc_id, strip_accents({_LATIN}) AS folded FROM mixed")(lambda s, d: _latin(s, d).select("doc_id", T.without_marks("text").alias("folded")))
query("ascii_fold", _MIXED + f"SELECT doc_id, regexp_replace(strip_accents({_LATIN}), '[^\\x00-\\x7F]', '', 'g') AS folded FROM mixed")(lambda s, d: _latin(s, d).select("doc_id", T.ascii_folded("text").alias("folded")))
_PAIR = "regexp_replace({}, '([^\\x00-\\x7F])[\\s\\x1c-\\x1f\\x85\\pZ]+([^\\x00-\\x7F])', '\\1\\2', 'g')"
query("cjk_space_strip", _MIXED + f"SELECT doc_id, {_PAIR.format(_PAIR.format('text'))} AS stripped FROM mixed")(lambda s, d: _mixed(s, d).select("doc_id", T.space_stripped(F.col("text")).alias("stripped")))
_GLUE = "regexp_replace({}, '([A-Za-z0-9]) ([A-Za-z0-9])', '\\1' || chr(57344) || '\\2', 'g')"
query("cjk_rejoin", _MIXED + ", t AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[぀-ヿ㐀-䶿一-鿿]|[^ \\t\\n぀-ヿ㐀-䶿一-鿿]+'), ' ') AS j FROM mixed) "
      f"SELECT doc_id, replace(replace({_GLUE.format(_GLUE.format('j'))}, ' ', ''), chr(57344), ' ') AS joined FROM t")(
    lambda s, d: _mixed(s, d).select("doc_id", T.rejoined(F.regexp_extract_all("text", F.lit(r"[぀-ヿ㐀-䶿一-鿿]|[^ \t\n぀-ヿ㐀-䶿一-鿿]+"), F.lit(0))).alias("joined")))
query("kana_morae", _MIXED + f", h AS (SELECT doc_id, translate(text, '{T.KATAKANA}', '{T.HIRAGANA}') AS hira FROM mixed) SELECT doc_id, hira, CAST(len(regexp_extract_all(hira, '(?s).[{T.SMALL_KANA}]*')) AS BIGINT) AS morae FROM h")(
    lambda s, d: _mixed(s, d).select("doc_id", T.hiragana(F.col("text")).alias("hira"), F.size(T.morae(F.col("text"))).cast("long").alias("morae")))
_EDGES = T.EDGES.replace("'", "''")
query("clean_words", _MIXED + f", w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t\\n]+')) AS word FROM mixed) SELECT word, nfc_normalize(replace(lower(trim(word, '{_EDGES}')), chr(775), '')) AS clean FROM w")(
    lambda s, d: _mixed(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n]+"), F.lit(0))).alias("word")).distinct().select("word", T.clean_word(F.col("word")).alias("clean")))
query("number_values")(lambda s, d: _mixed(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[0-9０-９]+|[〇零一二三四五六七八九十百千万億]+"), F.lit(0))).alias("i", "span")).withColumn("value", T.number_value(F.col("span")).cast("string")))
query("number_canonical")(lambda s, d: _mixed(s, d).select("doc_id", T.number_canonical("text").alias("canonical")))
query("script_fold")(lambda s, d: _mixed(s, d).select("doc_id", T.script_folded(F.col("text"), F.when(F.col("doc_id") % len(SNIPPETS) == 4, "hi").otherwise("en")).alias("folded")))
_COUNT = {k: f"len(regexp_extract_all(text, '{v}'))" for k, v in T.SCRIPTS.items()}
query("lang_of_text", _MIXED + f"SELECT doc_id, CASE WHEN {_COUNT['ja']} > 0 AND {_COUNT['ja']} >= {_COUNT['en']} THEN 'ja' WHEN {_COUNT['en']} > 0 THEN 'en' ELSE 'neutral' END AS lang FROM mixed")(
    lambda s, d: _mixed(s, d).select("doc_id", T.lang_of(F.col("text")).alias("lang")))
query("script_profile", _MIXED + "SELECT doc_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _COUNT.items()) + " FROM mixed")(
    lambda s, d: _mixed(s, d).select("doc_id", *(T.letters(F.col("text"), k).alias(k) for k in T.SCRIPTS)))
query("script_of_chars", _MIXED + ", c AS (SELECT unnest(string_split(text, '')) AS c FROM mixed) SELECT c, count(*) AS n, CASE " + " ".join(f"WHEN regexp_matches(c, '{v}') THEN '{k}'" for k, v in T.SCRIPTS.items()) + " END AS script FROM c WHERE c <> '' GROUP BY c")(
    lambda s, d: _mixed(s, d).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("script", T.script_of(F.col("c"))))
_J, _E = T.SCRIPTS["ja"][1:-1], T.SCRIPTS["en"][1:-1]
query("lang_run_profile", _MIXED + f", r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)(?:^[^{_J}{_E}]+)?(?:[{_J}][^{_E}]*|[{_E}][^{_J}]*)|^[^{_J}{_E}]+$')) AS run FROM mixed) "
      f"SELECT doc_id, CASE WHEN regexp_matches(run, '[{_J}]') THEN 'ja' WHEN regexp_matches(run, '[{_E}]') THEN 'en' ELSE 'neutral' END AS lang, count(*) AS runs, CAST(sum(length(run)) AS BIGINT) AS chars FROM r GROUP BY ALL")(
    lambda s, d: _mixed(s, d).select("doc_id", F.inline(T.runs(F.col("text")))).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.length("run")).cast("long").alias("chars")))


# ---- chunks: each document's words in windows of 100 that share 20 with the next

def _windows(spark, sf_dir):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("clip_id"), words.alias("w")).where("size(w) > 0")
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - 100) / 80).cast("int")))))
    return rows.select("clip_id", "idx", F.array_join(F.slice("w", F.col("idx") * 80 + 1, 100), " ").alias("text"))


query("spliced_chunks")(lambda s, d: chunks.spliced(_windows(s, d)))


def _utterances(spark, sf_dir):
    """Conversations' turns, and the text of all of them in capitals with some words left out."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip_id"), F.col("turn").cast("int").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w, i: (w != "") & (i % 11 != 5))
    whole = turns.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.upper(F.array_join(words, " ")).alias("t")))).alias("ts"))
    return turns, whole.select("clip_id", F.array_join("ts.t", " ").alias("text"))


query("redistributed_words")(lambda s, d: chunks.redistributed(*_utterances(s, d)))


@query("merged_speaker_chunks")
def merged_speaker_chunks(spark, sf_dir):
    """Conversations as two chunks that share ten seconds around the middle, the second with names of its own."""
    from quillmark.catalog_more import _spoken

    turns = _spoken(spark, sf_dir).withColumn("text", F.col("ord").cast("string"))
    half = turns.groupBy("clip_id").agg(F.floor(F.max("end") / 2).cast("double").alias("offset"))
    rows = turns.join(half, "clip_id")
    first = rows.where("start < offset + 10").select("clip_id", F.lit(0).alias("idx"), F.lit(0.0).alias("offset"), "ord", "start", "end", "speaker", "text")
    second = rows.where("end > offset").select("clip_id", F.lit(1).alias("idx"), "offset", "ord", "start", "end", F.concat(F.lit("x"), F.length("speaker").cast("string")).alias("speaker"), "text")
    return chunks.merged_chunks(first.unionByName(second), 10.0)


_CODE = "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 401 WHEN 1 THEN 402 WHEN 2 THEN 429 WHEN 3 THEN 500 END"
_SAYS = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'quota_exceeded' WHEN 1 THEN 'KEY not found' ELSE event_type END"
_KIND = "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'network' WHEN 1 THEN 'runtime' ELSE 'other' END"
query("failure_classes", f"WITH e AS (SELECT event_id, {_CODE} AS code, {_SAYS} AS says, {_KIND} AS kind FROM events) SELECT event_id, CASE WHEN code IS NOT NULL THEN 'HTTP ' || code || CASE WHEN regexp_matches(lower(says), 'quota|credit') THEN ' OUT OF CREDITS (quota exceeded)' WHEN code = 401 THEN ' bad key' WHEN code = 402 THEN ' OUT OF CREDITS' WHEN code = 429 THEN ' rate-limited' ELSE '' END WHEN kind = 'network' THEN 'network' WHEN kind = 'runtime' AND says LIKE '%not found' THEN 'no API key' ELSE substr(says, 1, 120) END AS reason FROM e")(
    lambda s, d: table(s, d, "events").select("event_id", F.expr(_CODE).alias("code"), F.expr(_SAYS).alias("says"), F.expr(_KIND).alias("kind")).select("event_id", chunks.failure(F.col("code"), F.col("says"), F.col("kind")).alias("reason")))


def _slots(spark, sf_dir):
    """The customers' names as uncertain words, and what two or three fresh reads hear in their place."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot_id"), F.lower(F.substring_index("c_name", "#", 1)).alias("word"))
    heard = base.select("slot_id", F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.expr(e).alias("word")) for f, e in (("whisper", "CASE WHEN slot_id % 3 = 0 THEN 'the' ELSE 'Client' END"), ("gemini", "CASE WHEN slot_id % 2 = 0 THEN 'client.' ELSE 'cl' END"), ("deepgram", "CASE WHEN slot_id % 5 = 0 THEN 'other' ELSE 'client' END"))))).alias("p"))
    return base, heard.select("slot_id", "p.word", "p.family")


query("reask_adoption", """WITH p AS (SELECT c_custkey AS slot_id, lower(split_part(c_name, '#', 1)) AS word FROM customer), h AS (SELECT slot_id, unnest([CASE WHEN slot_id % 3 = 0 THEN 'the' ELSE 'Client' END, CASE WHEN slot_id % 2 = 0 THEN 'client.' ELSE 'cl' END, CASE WHEN slot_id % 5 = 0 THEN 'other' ELSE 'client' END]) AS w FROM p),
 a AS (SELECT slot_id, min(w) AS "to" FROM h GROUP BY slot_id HAVING count(DISTINCT trim(lower(w), '.')) = 1) SELECT slot_id, word, "to" FROM p JOIN a USING (slot_id) WHERE word <> trim(lower("to"), '.') AND length(trim(lower("to"), '.')) >= greatest(3, length(word) // 2)""")(
    lambda s, d: chunks.adopted(*_slots(s, d), _lexicon(s, d)))
