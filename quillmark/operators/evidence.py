"""Evidence beside the vote: flags with high stakes, detectors and pitch accents that tell readings apart, words that a final text lost, which translation leads."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmark.functions import text as T

# Rules whose flags have high stakes whatever their severity; names of the pitch patterns.
CRITICAL = ("med_drug_name", "med_dosage", "med_dangerous_abbrev", "med_umls_term", "legal_term")
FLAT, FIRST, LAST, MIDDLE = "heiban (flat — no drop, stays high onto the next word)", "atamadaka (drops right after the first mora)", "odaka (drops on the following particle)", "nakadaka (drops after mora "


def critical(flags: DataFrame) -> DataFrame:
    """The flags (rule, severity, ...) that call for another look at their line."""
    return flags.where(F.col("rule").isin(*CRITICAL) | (F.col("severity") == "critical"))


def language_check(clips: DataFrame) -> DataFrame:
    """(clip_id, lang, candidates, agree) of clips(clip_id, first, second): the codes of two detectors, null or empty where one failed; the first one leads."""
    a, b = (F.coalesce(c, F.lit("")) for c in ("first", "second"))
    named = F.array_sort(F.array_distinct(F.filter(F.array(a, b), lambda c: c != "")))
    return clips.select("clip_id", F.when(a != "", a).otherwise(b).alias("lang"), named.alias("candidates"), ((a != "") & (a == b)).alias("agree"))


def completeness(tokens: Column, final: Column) -> Column:
    """Share of the Japanese tokens of two characters or more that a final text still holds; 1 without any."""
    asked = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: (T.lang_of(w) == "ja") & (F.length(w) > 1))
    kept = F.filter(asked, lambda w: F.contains(F.coalesce(final, F.lit("")), w))
    return F.when(F.size(asked) == 0, 1.0).otherwise(F.size(kept) / F.size(asked))


# ---- pitch accents: entries(surface, reading, accent), the accent a list of positions by comma

def accents(entries: DataFrame) -> DataFrame:
    """(surface, reading, accents): the positions of a surface, by reading in hiragana, and of all its readings where reading is null."""
    one = entries.select("surface", T.hiragana(F.col("reading")).alias("reading"), F.explode(F.split("accent", ",")).alias("at")).withColumn("at", F.trim("at")).where(F.col("at").rlike(r"^-?[0-9]+$"))
    both = one.unionByName(one.withColumn("reading", F.lit(None).cast("string")))
    return both.groupBy("surface", "reading").agg(F.array_sort(F.collect_set(F.col("at").cast("int"))).alias("accents"))


def accent_type(reading: Column, accent: Column) -> Column:
    return F.when(accent == 0, FLAT).when(accent == 1, FIRST).when(accent == F.size(T.morae(reading)), LAST).otherwise(F.concat(F.lit(MIDDLE), accent.cast("string"), F.lit(")")))


def distinguished(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pairs(a, b, reading) of homophones with a_accents, b_accents, have_data, distinguishable (no position in common) and a hint of what to listen for."""
    known, rows = accents(entries), pairs.withColumn("_r", T.hiragana(F.col("reading")))
    for side in ("a", "b"):
        own = known.select(F.col("surface").alias("_s"), F.col("reading").alias("_k"), F.col("accents").alias(f"{side}_accents"))
        rows = rows.join(own, (F.col(side) == F.col("_s")) & F.col("_r").eqNullSafe(F.col("_k")), "left").drop("_s", "_k")
        rows = rows.withColumn(f"{side}_accents", F.coalesce(f"{side}_accents", F.array().cast("array<int>")))
    have = (F.size("a_accents") > 0) & (F.size("b_accents") > 0)
    apart = have & ~F.arrays_overlap("a_accents", "b_accents")
    says = lambda s: F.concat(F.col(s), F.lit("=accent "), F.array_join(F.col(f"{s}_accents").cast("array<string>"), ","), F.lit(" ["), accent_type(F.coalesce("reading", F.lit("")), F.get(f"{s}_accents", F.lit(0))), F.lit("]"))
    return rows.drop("_r").withColumn("have_data", have).withColumn("distinguishable", apart).withColumn("hint", F.when(apart, F.concat(says("a"), F.lit("; "), says("b"))))


# ---- two translations of one source

@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two translations word by word, numbers by value, without punctuation; 0 if one has no words."""

    def words(t):
        return [T.canonical(w) for w in re.sub(r"[^\w\s']", " ", (t or "").lower()).split()]

    def one(x, y):
        return round(difflib.SequenceMatcher(a=x, b=y, autojunk=False).ratio(), 3) if x and y else 0.0

    return pd.Series([one(words(x), words(y)) for x, y in zip(a, b)], dtype="float64")


def leading(rows: DataFrame) -> DataFrame:
    """rows(first, first_passed, first_ok, second, second_passed, second_ok) with primary, 'first' or 'second'.

    The second leads if it passes more checks. One under half the first's length may be cut off, and leads only if it is also whole where the first isn't.
    """
    more = F.col("second_passed") > F.col("first_passed")
    short = F.length(F.coalesce("second", F.lit(""))) < F.length(F.coalesce("first", F.lit(""))) * 0.5
    return rows.withColumn("primary", F.when(more & (~short | (F.col("second_ok") & ~F.col("first_ok"))), "second").otherwise("first"))
