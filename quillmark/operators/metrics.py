"""Error rates and overlap scores of text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.align import resegmented
from quillmark.functions.text import number_canonical, script_folded
from quillmark.plans.rules import java

CJK = "[぀-ヿ㐀-䶿一-鿿가-힣]"


def tokens(text: Column) -> Column:
    """Lower-case words; characters of scripts without blanks stand alone where they begin a token."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), java(r"[^\w\s']"), " ")
    return F.regexp_extract_all(plain, F.lit(java(rf"{CJK}|\S+")), F.lit(0))


def characters(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), java(r"[^\w']+|\s+"), "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: each distinct token of the pair becomes one character, the built-in distance does the rest.

    Characters begin at U+4E00 and run past the surrogates where a pair holds more tokens than fit below them.
    """
    words = F.array_distinct(F.concat(a, b))
    at = lambda t: F.array_position(words, t).cast("int") + 0x4DFF
    char = lambda t: F.when(at(t) < 0xD800, F.decode(F.unhex(F.lpad(F.hex(at(t)), 4, "0")), "UTF-16BE")).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(at(t) - 0xD800 + 0x20000), 8, "0")), "UTF-32"))
    return F.levenshtein(F.array_join(F.transform(a, char), ""), F.array_join(F.transform(b, char), ""))


def rate(distance: Column, size: Column, other: Column) -> Column:
    """Distance by the reference's size, four digits; an empty reference is 0 or 1."""
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(F.round(distance / size, 4))


def equalised(text: Column, lang: Column | None = None, numbers: bool = True) -> Column:
    """A text as it is scored: numbers in digits, spellings that sound alike made equal. Without a lang it is English."""
    lang = F.lit("en") if lang is None else F.coalesce(lang, F.lit("en"))
    folded = script_folded(F.coalesce(text, F.lit("")), lang)
    return number_canonical(folded) if numbers else folded


def wer(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", lang: str | None = None, numbers: bool = True) -> DataFrame:
    """pairs with wer. numbers: their formatting doesn't count. lang: the column with the language, else English.

    In Arabic and Urdu where words are parted is a matter of spelling, so differences that are equal when joined don't count.
    """
    language = F.col(lang) if lang else None
    scored = (lambda c: equalised(F.col(c), language, numbers)) if numbers else (lambda c: F.col(c))
    rows = pairs.withColumn("_r", tokens(scored(ref))).withColumn("_h", tokens(scored(hyp)))
    if lang:
        rows = rows.withColumn("_h", F.when(F.col(lang).isin("ar", "ur"), resegmented("_r", "_h")).otherwise(F.col("_h")))
    return rows.withColumn("wer", rate(token_distance(F.col("_r"), F.col("_h")), F.size("_r"), F.size("_h"))).drop("_r", "_h")


def cer(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", lang: str | None = None, numbers: bool = True) -> DataFrame:
    """pairs with cer, by the same rules as wer but for the parting of words, which never counts."""
    language = F.col(lang) if lang else None
    scored = (lambda c: equalised(F.col(c), language, numbers)) if numbers else (lambda c: F.col(c))
    rows = pairs.withColumn("_r", characters(scored(ref))).withColumn("_h", characters(scored(hyp)))
    return rows.withColumn("cer", rate(F.levenshtein("_r", "_h"), F.length("_r"), F.length("_h"))).drop("_r", "_h")


def _grams(text: Column, n: int) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def chrf(pairs: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp", orders: int = 6, beta: float = 2.0) -> DataFrame:
    """(key, chrf): mean n-gram precision and recall over the orders, as an F-score of three digits."""
    lists = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), _grams(F.col(col), n).alias("gs")) for n in range(1, orders + 1) for side, col in (("r", ref), ("h", hyp))))
    rows = pairs.select(key, F.inline(lists)).select(key, "side", "n", F.explode("gs").alias("g"))  # one scan for all orders and sides
    per = rows.groupBy(key, "n", "g").agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "h").alias("h"))
    order = per.groupBy(key, "n").agg(F.sum(F.least("r", "h")).alias("m"), F.sum("r").alias("r"), F.sum("h").alias("h"))
    means = order.groupBy(key).agg(F.avg(F.when(F.col("h") > 0, F.col("m") / F.col("h"))).alias("p"), F.avg(F.when(F.col("r") > 0, F.col("m") / F.col("r"))).alias("q"))
    b2 = beta * beta
    score = F.when(F.col("p") + F.col("q") > 0, F.round((1 + b2) * F.col("p") * F.col("q") / (b2 * F.col("p") + F.col("q")), 3)).otherwise(0.0)
    return pairs.select(key).join(means.select(key, score.alias("chrf")), key, "left").select(key, F.coalesce("chrf", F.lit(0.0)).alias("chrf"))


def reliability(scored: DataFrame, least: int = 2) -> DataFrame:
    """(lang, witness, clips, reliability): one less the mean error rate of witnesses with enough clips, from (lang, witness, wer)."""
    return scored.groupBy("lang", "witness").agg(F.count(F.lit(1)).alias("clips"), F.round(1 - F.avg("wer"), 4).alias("reliability")).where(F.col("clips") >= least)


def harness(expected: DataFrame, fired: DataFrame) -> DataFrame:
    """(rule, cases, caught): recall of expected(case_id, rule) against fired(case_id, rule)."""
    hit = fired.select("case_id", "rule").distinct().withColumn("hit", F.lit(1))
    return expected.join(hit, ["case_id", "rule"], "left").groupBy("rule").agg(F.count(F.lit(1)).alias("cases"), F.count("hit").alias("caught"))
