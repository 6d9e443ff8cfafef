"""Readers of transcripts, ledgers and knowledge files, and writers of what the engine makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType



def transcripts(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """(doc_id, path, text, lang): one row per text file; doc_id is a hash of the path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text", F.lit(lang).alias("lang"))


_ENTRY = StructType([StructField(c, StringType()) for c in ("line", "line_no", "decision", "note", "replacement")])


def ledger(rows: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """(key, line, decision): listening decisions from any of their three shapes: a map, a list of entries, or a struct with 'resolved'.

    A decision is its first letter; entries without a line number or a decision go, and text that isn't JSON gives no row.
    """
    j = F.trim(F.col(json))
    listed = F.when(j.startswith("["), F.from_json(j, ArrayType(_ENTRY)))
    wrapped = F.from_json(j, StructType([StructField("resolved", ArrayType(_ENTRY))]))["resolved"]
    entries = F.coalesce(listed, F.when(j.startswith("{"), wrapped))
    flat = rows.select(key, F.explode(entries).alias("e")).select(key, F.coalesce("e.line", "e.line_no").alias("line"), F.col("e.decision").alias("decision"))
    plain = rows.where(j.startswith("{") & entries.isNull()).select(key, F.explode(F.from_json(j, MapType(StringType(), StringType()))).alias("line", "v"))
    plain = plain.select(key, "line", F.coalesce(F.get_json_object("v", "$.decision"), F.col("v")).alias("decision"))
    every = flat.unionByName(plain).select(key, F.col("line").try_cast("int").alias("line"), F.lower(F.substring(F.trim("decision"), 1, 1)).alias("decision"))
    return every.where("line IS NOT NULL AND decision <> ''")


def confusions(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, gold, heard, n) from a file {"confusions": {gold: [[heard, n], ...]}}."""
    schema = StructType([StructField("confusions", MapType(StringType(), ArrayType(ArrayType(StringType()))))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("confusions").alias("gold", "pairs"))
    return rows.select(F.lit(lang).alias("lang"), "gold", F.explode("pairs").alias("p")).select("lang", "gold", F.col("p")[0].alias("heard"), F.col("p")[1].cast("long").alias("n"))


def reliability(spark: SparkSession, path: str) -> DataFrame:
    """(lang, witness, reliability) from a file {lang: {witness: p}}."""
    schema = MapType(StringType(), MapType(StringType(), StringType()))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("lang", "w"))
    return rows.select("lang", F.explode("w").alias("witness", "r")).select("lang", "witness", F.col("r").cast("double").alias("reliability"))


def sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, word) from a file {"sets": [[word, ...], ...]}."""
    rows = spark.read.schema("sets array<array<string>>").json(path, multiLine=True).select(F.posexplode("sets").alias("set_id", "words"))
    return rows.select("set_id", F.explode("words").alias("word"))


def cooccurrences(spark: SparkSession, words: str, pairs: str, least: float = 6.0) -> DataFrame:
    """(word, mate, sig) from tab-separated files words(id, word, n) and pairs(a, b, n, sig), from a significance on."""
    w = spark.read.csv(words, sep="\t", quote="", schema="id long, word string, n long").select("id", "word")
    p = spark.read.csv(pairs, sep="\t", quote="", schema="a long, b long, n long, sig double").where(F.col("sig") >= least)
    return p.join(w.select(F.col("id").alias("a"), "word"), "a").join(w.select(F.col("id").alias("b"), F.col("word").alias("mate")), "b").select("word", "mate", "sig")


def gazetteer_rows(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, ascii, alternates) from a tab-separated place-name file."""
    rows = spark.read.csv(path, sep="\t", quote="")
    c = rows.columns
    return rows.select(F.col(c[1]).alias("canonical"), F.col(c[2]).alias("ascii"), F.col(c[3]).alias("alternates"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): the lines of a file, each once."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line, seconds, flagged): lines of a draft with the time of the last stamp before them, interpolated up to the next one.

    Stamps that go back are left out. Everything happens inside the document's row.
    """
    from quillmark.operators.lines import line_array

    lines = line_array(F.col(text))
    clock = lambda x, i: F.regexp_extract(x, r"\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]", i)
    stamp = lambda x: F.when(clock(x, 3) != "", F.coalesce(clock(x, 1).try_cast("int"), F.lit(0)) * 3600 + clock(x, 2).try_cast("int") * 60 + clock(x, 3).try_cast("int"))
    rows = docs.select(key, F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"), stamp(x).alias("t"))).alias("l"))
    monotone = F.expr("aggregate(l, cast(array() as array<struct<n:int,t:int>>), (s, x) -> CASE WHEN x.t IS NOT NULL AND (size(s) = 0 OR x.t >= element_at(s, -1).t) THEN concat(s, array(struct(x.n AS n, x.t AS t))) ELSE s END)")
    out = rows.select(key, F.explode("l").alias("x"), monotone.alias("a")).select(key, F.col("x.n").alias("n"), F.col("x.line").alias("line"), "a")
    after = F.expr("get(filter(a, y -> y.n > n), 0)")
    before = F.expr("CASE WHEN exists(a, y -> y.n <= n) THEN element_at(filter(a, y -> y.n <= n), -1) END")
    seconds = F.when(before.isNull(), F.lit(None)).when(after.isNull(), before["t"].cast("double")).otherwise(before["t"] + (after["t"] - before["t"]) * (F.col("n") - before["n"]) / (after["n"] - before["n"]))
    return out.select(key, "n", "line", F.round(seconds, 2).alias("seconds"), F.col("line").contains("⚠").alias("flagged"))


def escaped(text):
    """HTML-escaped text column."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_receipts(receipts: DataFrame, flags: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, html): a page for each receipt with its flags in order. All severities have a class of their own."""
    item = F.concat(F.lit('<tr class="'), F.col("severity"), F.lit('"><td>'), F.col("line").cast("string"), F.lit("</td><td>"), escaped(F.col("rule")), F.lit("</td><td>"), escaped(F.col("evidence")), F.lit("</td></tr>"))
    rows = flags.select(key, F.struct("line", "rule", "ord", item.alias("html")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    page = F.concat(F.lit("<!doctype html><meta charset=utf-8><h1>"), F.col("grade"), F.lit("</h1><p>score "), F.col("score").cast("string"), F.lit("</p><table>"), F.coalesce(F.array_join("r.html", ""), F.lit("")), F.lit("</table>"))
    return receipts.join(rows, key, "left").select(key, page.alias("html"))


def write_text(texts: DataFrame, path: str, key: str = "doc_id") -> None:
    """Corrected texts as Parquet, one row per document, in the order of nothing: the key finds them."""
    texts.select(key, "text").write.mode("overwrite").parquet(path)
