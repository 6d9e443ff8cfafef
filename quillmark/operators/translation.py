"""Checks of pairs(pair_id, src_lang, tgt_lang, source_text, translation): what must survive a translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.align import kept_share
from quillmark.plans.rules import java

# Scripts by language (all others Latin), and the span that a translation into Latin script may have.
SCRIPTS = {"ar": "arabic", "fa": "arabic", "ur": "arabic", "ps": "arabic", "sd": "arabic", "he": "hebrew", "yi": "hebrew", "hi": "devanagari", "mr": "devanagari", "ne": "devanagari", "sa": "devanagari", "bn": "bengali", "as": "bengali", "ru": "cyrillic", "uk": "cyrillic", "bg": "cyrillic", "sr": "cyrillic", "mk": "cyrillic", "be": "cyrillic", "kk": "cyrillic", "mn": "cyrillic", "el": "greek", "ja": "japanese", "zh": "han", "ko": "hangul", "th": "thai", "ta": "tamil", "te": "telugu", "kn": "kannada", "ml": "malayalam"}
BANDS = {"latin": (0.50, 1.90), "cyrillic": (0.45, 1.95), "greek": (0.50, 1.90), "arabic": (0.50, 2.40), "hebrew": (0.50, 2.40), "devanagari": (0.45, 2.00), "bengali": (0.45, 2.00), "tamil": (0.45, 2.10), "telugu": (0.45, 2.10), "kannada": (0.45, 2.10), "malayalam": (0.45, 2.10), "thai": (0.50, 2.70), "hangul": (0.60, 3.40), "han": (0.70, 5.80), "japanese": (0.60, 5.00)}
PLACEHOLDER = r"\{\{?\s*[\w.$-]+\s*\}?\}|%\(\w+\)[sdf]|%(?:\d+\$)?[sdf]|\[\d+\]|</?[a-zA-Z][\w:-]*(?:\s[^<>]*?)?/?>"
FOREIGN = "[Ͱ-ϿЀ-ԯԱ-֏֐-׿؀-ۿݐ-ݿࢠ-ࣿऀ-ॿঀ-৿஀-௿ఀ-౿ಀ-೿ഀ-ൿ฀-๿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]+"
PASSTHROUGH = 0.70


def base_lang(code: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.trim(code)), r"^[^-_]*", 0), F.lit("und"))


def script_of(lang: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SCRIPTS.items() for x in kv))[base_lang(lang)], F.lit("latin"))


def span(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), java(r"\s"), "")).cast("long")


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java(PLACEHOLDER)), F.lit(0))


def numbers(text: Column) -> Column:
    """Values written in digits: grouping points and commas go, a last comma or point with other than three digits behind is the decimal one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), F.regexp_replace(x, "[.,]", "")).otherwise(
        F.regexp_replace(F.regexp_replace(x, r"[.,](?=.*[.,])", ""), ",", ".")).cast("double"))


def bag_difference(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, value, side, n): values that one array holds more often than the other; side 'missing' (in a) or 'introduced' (in b)."""
    both = rows.select(key, F.explode(a).alias("value"), F.lit(1).alias("w")).unionByName(rows.select(key, F.explode(b).alias("value"), F.lit(-1).alias("w")))
    net = both.groupBy(key, "value").agg(F.sum("w").alias("w")).where("w <> 0")
    return net.select(key, "value", F.when(F.col("w") > 0, "missing").otherwise("introduced").alias("side"), F.abs("w").alias("n"))


def contains_word(text: Column, needle: Column) -> Column:
    """Case-blind containment, at word edges if the needle has word characters."""
    edge = F.concat(F.lit(java(r"(?<!\w)\Q", True)), F.trim(needle), F.lit(r"\E(?!\w)"))
    return F.when(F.trim(needle) == "", F.lit(False)).when(needle.rlike(java(r"\w")), F.regexp_like(text, edge)).otherwise(F.lower(text).contains(F.lower(F.trim(needle))))


def length_flags(pairs: DataFrame) -> DataFrame:
    """(pair_id, kind, evidence) of pairs (pair_id, src_lang, tgt_lang, ns, nt) with the span() of each text: a translation too short or too long for its source."""
    ss, ts = script_of(F.col("src_lang")), script_of(F.col("tgt_lang"))
    band = F.create_map(*(x for k, (a, b) in BANDS.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))))[F.col("ss")]
    rows = pairs.select("pair_id", ss.alias("ss"), ts.alias("ts"), F.when(F.col("ns") > 0, F.round(F.col("nt") / F.col("ns"), 3)).alias("ratio"))
    rows = rows.where((F.col("ts") == "latin") & ((F.col("ratio") < band[0]) | (F.col("ratio") > band[1])))
    return rows.select("pair_id", F.lit("length_ratio").alias("kind"), F.format_string("%.2f", F.floor(F.col("ratio") * 100 + 0.5) / 100).alias("evidence"))


def echoes(pairs: DataFrame) -> DataFrame:
    """(pair_id, kind, evidence): translations into another language of the same script that keep most of the source's words."""
    src, tgt = base_lang(F.col("src_lang")), base_lang(F.col("tgt_lang"))
    rows = pairs.where((src != tgt) & (script_of(F.col("src_lang")) == script_of(F.col("tgt_lang"))))
    sw, tw = (F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(java(r"\w+")), F.lit(0)) for c in ("source_text", "translation"))
    rows = rows.select("pair_id", kept_share(sw, tw).alias("kept")).where(F.col("kept") >= PASSTHROUGH)
    return rows.select("pair_id", F.lit("untranslated_passthrough").alias("kind"), F.concat(F.round(100 * F.col("kept")).cast("int").cast("string"), F.lit("%")).alias("evidence"))


def glossary_misses(source: DataFrame, target: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pair_id, kind, evidence): a term in source (pair_id, src_lang, source_text) without its rendering in target (pair_id, tgt_lang, translation).

    Each side looks for its own terms before they meet, so that no text is shuffled.
    """
    g = glossary.select(base_lang(F.col("src_lang")).alias("src"), base_lang(F.col("tgt_lang")).alias("tgt"), "term", "rendering")
    asked = source.select("pair_id", base_lang(F.col("src_lang")).alias("src"), F.coalesce("source_text", F.lit("")).alias("s")).join(F.broadcast(g), "src")
    asked = asked.where(contains_word(F.col("s"), F.col("term"))).select("pair_id", "tgt", "rendering")
    given = target.select("pair_id", base_lang(F.col("tgt_lang")).alias("tgt"), F.coalesce("translation", F.lit("")).alias("t")).join(F.broadcast(g.select("tgt", "rendering").distinct()), "tgt")
    given = given.where(~contains_word(F.col("t"), F.col("rendering"))).select("pair_id", "tgt", "rendering")
    return asked.join(given, ["pair_id", "tgt", "rendering"]).select("pair_id", F.lit("glossary").alias("kind"), F.col("rendering").alias("evidence"))


def run_qa(pairs: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """(pair_id, kind, evidence): script leaks, untranslated echoes, placeholders, length and glossary (src_lang, tgt_lang, term, rendering)."""
    p = pairs.select("pair_id", base_lang(F.col("src_lang")).alias("src"), base_lang(F.col("tgt_lang")).alias("tgt"), script_of(F.col("tgt_lang")).alias("ts"),
                     F.coalesce("source_text", F.lit("")).alias("s"), F.coalesce("translation", F.lit("")).alias("t"))
    body = F.regexp_replace("t", r"\([^)]*\)|\[[^\]]*\]", " ")
    leaks = p.where("ts = 'latin'").select("pair_id", F.lit("source_script_leak").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(FOREIGN), F.lit(0)))).alias("evidence"))
    spans = pairs.select("pair_id", "src_lang", "tgt_lang", span(F.col("source_text")).alias("ns"), span(F.col("translation")).alias("nt"))
    flags = leaks.unionByName(echoes(pairs)).unionByName(length_flags(spans))
    lost = bag_difference(p.select("pair_id", placeholders(F.col("s")).alias("a"), placeholders(F.col("t")).alias("b")), "pair_id", "a", "b")
    flags = flags.unionByName(lost.select("pair_id", F.lit("placeholder").alias("kind"), F.col("value").alias("evidence"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_"))
    if glossary is not None:
        g = F.broadcast(glossary.select(base_lang(F.col("src_lang")).alias("src"), base_lang(F.col("tgt_lang")).alias("tgt"), "term", "rendering"))
        flags = flags.unionByName(p.join(g, ["src", "tgt"]).where(contains_word(F.col("s"), F.col("term")) & ~contains_word(F.col("t"), F.col("rendering"))).select("pair_id", F.lit("glossary").alias("kind"), F.col("rendering").alias("evidence")))
    return flags


def verdicts(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """(pair_id, ok, verifiable, n_flags)."""
    n = flags.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_flags"))
    ss, ts = script_of(F.col("src_lang")), script_of(F.col("tgt_lang"))
    can = (ts == "latin") | ((base_lang(F.col("src_lang")) != base_lang(F.col("tgt_lang"))) & (ss == ts))
    rows = pairs.select("pair_id", can.alias("verifiable")).join(n, "pair_id", "left").na.fill(0, ["n_flags"])
    return rows.select("pair_id", ((F.col("n_flags") == 0) & F.col("verifiable")).alias("ok"), "verifiable", "n_flags")


def number_survival(pairs: DataFrame) -> DataFrame:
    """(pair_id, value, side, n): numbers in digits that went missing or were introduced."""
    return bag_difference(pairs.select("pair_id", numbers(F.col("source_text")).alias("a"), numbers(F.col("translation")).alias("b")), "pair_id", "a", "b")
