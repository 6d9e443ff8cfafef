"""Queries of the evidence beside the vote, over whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import documents, injected, query
from quillmark.catalog_more import _translations
from quillmark.catalog_text import _COUNT, _MIXED, _mixed
from quillmark.functions import text as T
from quillmark.operators import evidence
from quillmark.plans import oracle, packs, rules

_DOSAGE = next(s for p in packs.PACKS for s in p.scanners if s.name == "dosage_hygiene")
_STAKES = ", ".join(f"'{r}'" for r in evidence.CRITICAL)
query("critical_flags", f"SELECT * FROM ({oracle.scanner_sql(_DOSAGE)}) WHERE severity = 'critical' OR rule IN ({_STAKES})")(lambda s, d: evidence.critical(rules.flags(injected(s, d), [_DOSAGE])).drop("ord"))

_FIRST, _SECOND = "CASE WHEN doc_id % 5 <> 0 THEN lang END", "CASE WHEN doc_id % 3 = 0 THEN 'en' WHEN doc_id % 7 <> 0 THEN lang END"
query("language_check", f"""WITH d AS (SELECT doc_id AS clip_id, coalesce({_FIRST}, '') AS a, coalesce({_SECOND}, '') AS b FROM documents)
 SELECT clip_id, CASE WHEN a <> '' THEN a ELSE b END AS lang, array_to_string(list_sort(list_distinct(list_filter([a, b], lambda x: x <> ''))), ',') AS candidates, a <> '' AND a = b AS agree FROM d""")(
    lambda s, d: evidence.language_check(documents(s, d).select(F.col("doc_id").alias("clip_id"), F.expr(_FIRST).alias("first"), F.expr(_SECOND).alias("second"))).withColumn("candidates", F.array_join("candidates", ",")))

_JA = " AND ".join((f"{_COUNT['ja'].replace('text', 'x')} > 0", f"{_COUNT['ja'].replace('text', 'x')} >= {_COUNT['en'].replace('text', 'x')}", "length(x) > 1"))
query("completeness", _MIXED + f""", t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^ \\t\\n]+'), lambda x: {_JA}) AS w, replace(text, 'バルセロナ', '') AS f FROM mixed)
 SELECT doc_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(len(list_filter(w, lambda x: contains(f, x))) / len(w), 4) END AS completeness FROM t""")(
    lambda s, d: _mixed(s, d).select("doc_id", F.round(evidence.completeness(F.regexp_extract_all("text", F.lit(r"[^ \t\n]+"), F.lit(0)), F.replace("text", F.lit("バルセロナ"), F.lit(""))), 4).alias("completeness")))

_ENTRIES = [("箸", "ハシ", "1"), ("橋", "はし", "2"), ("端", "はし", "0,2"), ("雨", "あめ", "1"), ("飴", "アメ", "0")]


@query("pitch_accents")
def pitch_accents(spark, sf_dir):
    """Every pair of surfaces with one reading."""
    entries = spark.createDataFrame(_ENTRIES, "surface string, reading string, accent string")
    a = entries.select(F.col("surface").alias("a"), T.hiragana(F.col("reading")).alias("reading"))
    return evidence.distinguished(a.join(a.select(F.col("a").alias("b"), "reading"), "reading").where("a < b"), entries)


query("translation_agreement")(lambda s, d: _translations(s, d).select("pair_id", evidence.agreement("source_text", "translation").alias("agreement")))

_CUT = "substr(text, 1, CAST(length(text) * (doc_id % 5 + 1) // 5 AS INT))"
query("leading_translation", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, text AS a, {_CUT} AS b, doc_id % 4 AS pa, doc_id % 7 AS pb, doc_id % 4 = 3 AS oa, doc_id % 7 >= 5 AS ob FROM d)
 SELECT doc_id, CASE WHEN pb > pa AND (length(b) >= length(a) * 0.5 OR (ob AND NOT oa)) THEN 'second' ELSE 'first' END AS "primary" FROM p""")(
    lambda s, d: evidence.leading(documents(s, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.col("text").alias("first"), F.expr(_CUT.replace("//", "div")).alias("second"), (F.col("doc_id") % 4).alias("first_passed"), (F.col("doc_id") % 7).alias("second_passed"),
        (F.col("doc_id") % 4 == 3).alias("first_ok"), (F.col("doc_id") % 7 >= 5).alias("second_ok"))).select("doc_id", "primary"))
