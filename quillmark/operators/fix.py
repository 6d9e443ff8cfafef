"""Deterministic corrections of transcripts, and the gate before delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.lines import line_array
from quillmark.plans import words as W
from quillmark.plans.rules import LABEL, LABEL_LEGAL, java


def _cased(pattern: str, to: str) -> list[tuple[str, str]]:
    """A replacement that keeps a leading capital; 'okay' never has one."""
    if to == "okay" or not to[:1].islower():
        return [(java(pattern, True), to)]
    return [(rf"(?dU)(?=\p{{Lu}})(?iu:{pattern})", to[0].upper() + to[1:]), (java(pattern, True), to)]


def _table(words: dict[str, str], wrap=lambda w: rf"\b{w}\b") -> list[tuple[str, str]]:
    return [pair for w, to in words.items() for pair in _cased(wrap(w), to)]


HESITATION = [(java(r"\b(?:uh+|ah+|um+|er+|erm+)\b(?!-)[,;]?\s*", True), "")]
DEFAULT = [(java(r"\b(?:um+|uh+|erm+)\b(?!-)[ ,]*", True), ""), (java(r"(?<![ぁ-ん])(?:" + "|".join(W.CASUAL_KANA) + r")(?![ぁ-ん])"), "")]
LEGAL = [
    *HESITATION,
    *((java(rf"\({w}\)", True), f"[{w}]") for w in ("inaudible", "unintelligible", "laugh", "laughs", "laughter", "crosstalk", "applause", "sigh", "sighs", "cough", "coughs", "pause", "silence", "phonetic", "sic")),
    (java(r"\[(?:Inaudible|UNinaudible|INAUDIBLE)\]"), "[inaudible]"), (java(r"\[Unintelligible\]"), "[unintelligible]"),
    (java(r"\ba\.m\.", True), "AM"), (java(r"\bp\.m\.", True), "PM"),
    *(pair for rx, fold, to in W.SPELLING_LEGAL for pair in ([(java(rx), to)] if not fold else _cased(rx, to))),
    (java(r"(?<=[a-z,;:\-]\s)Internet\b"), "internet"),
    *_table({k: v for k, v in W.SLANG_LEGAL.items() if "(" not in v}), *_cased(r"\bgoin'", "going"), *_cased(r"'cause\b", "because"), *_table(W.CONTRACTIONS_LEGAL),
    *_cased(r"\bmm+[-\s]?h+m+\b", "uh-huh"), *_cased(r"\bm+h+m+\b", "uh-huh"), *_cased(r"\bmm+[-\s]?mm+\b", "uh-uh"),
    (java(r"\b(?:Mrs\.?|Miss)\s+(?=[A-Z][a-z]+)"), "Ms. "), (java(r"(?<=\d)\s?%"), " percent"),
    (java(r"\b(could|should|would|must)\s+of\b", True), "$1 have"),
    *((java(rf"\b{a}(?=\s+(?:{W.OWNED})\b)"), b) for a, b in (("You're", "Your"), ("you're", "your"), ("There", "Their"), ("there", "their"), ("They're", "Their"), ("they're", "their"), ("It's", "Its"), ("it's", "its"))),
]
PERSONAL = [*_table(W.APOSTROPHES), (java(r"\b[Ii]m\b"), "I'm")]
SETS = {"default": DEFAULT, "legal": LEGAL, "personal": PERSONAL}


def corrected(body: Column, fixers: list[tuple[str, str]], fold_accents: bool = False) -> Column:
    """A line's speech with every fix, single blanks, none before punctuation, none at the end."""
    out = body
    for rx, to in fixers:
        out = F.regexp_replace(out, rx, to)
    if fold_accents:
        out = F.translate(out, W.ACCENTED, W.PLAIN)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), "　{2,}", "　")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t　]+([,.;:?!、。？！」』）])", "$1"), java(r"\s+$"), "")


def fix(docs: DataFrame, profile: str = "default", key: str = "doc_id") -> DataFrame:
    """(key, text, changed): texts line by line corrected behind their speaker labels, and how many lines changed. Lines stay in their row: nothing is shuffled."""
    rows = docs.select(key, line_array(F.col("text")).alias("lines"))

    def one(line: Column) -> Column:
        head = F.regexp_extract(line, java(f"(?:{LABEL_LEGAL})|(?:{LABEL})"), 0)
        return F.concat(head, corrected(F.substr(line, F.length(head) + 1), SETS[profile], profile == "legal"))

    new = rows.withColumn("new", F.transform("lines", one))
    changed = F.size(F.filter(F.zip_with("lines", "new", lambda a, b: F.regexp_replace(a, java(r"\s+$"), "") != b), lambda x: x))
    return new.select(key, F.array_join("new", "\n").alias("text"), changed.alias("changed"))


def normalised_sounds(text: Column) -> Column:
    """Sounds in brackets, lower case."""
    out = text
    for w in ("laughs?", "laughter", "sighs?", "coughs?", "chuckles?", "gasps?", "applause", "music", "background noise", "crosstalk", "grunts?", "scoffs?"):
        for form in ((w[:-2], w[:-1]) if w.endswith("?") else (w,)):
            out = F.regexp_replace(out, java(rf"[（(]\s*{form}\s*[)）]", True), f"[{form}]")
    for k, v in W.VOCALISATIONS.items():
        out = F.regexp_replace(out, rf"(?<![ァ-ヶ]){k}[。、！]?", v)
    return F.regexp_replace(out, r"\[\s+", "[")


# Hesitations that always go, and those that go where a comma or Latin text follows.
ALWAYS = ("えーと", "えーっと", "えっと", "ええと", "ええっと", "えー", "あのー", "あのう", "そのー", "うーん", "んーと", "あー", "うー")
SOMETIMES = ("あの", "その", "なんか", "まあ", "まぁ")


def finished(text: Column) -> Column:
    """Clean-verbatim finish of Japanese text with Latin words."""
    out = text
    for f in ALWAYS:
        out = F.regexp_replace(out, rf"{f}[、,]?\s*", "")
    for f in SOMETIMES:
        out = F.regexp_replace(F.regexp_replace(out, rf"{f}[、,]\s*", ""), rf"{f}\s+(?=[A-Za-z])", "")
    out = F.regexp_replace(F.regexp_replace(out, "([A-Za-z])。", "$1. "), "([A-Za-z])、", "$1, ")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r" +\n", "\n")


def blockers(docs: DataFrame, ledger: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, kind, evidence): what keeps a transcript from delivery. ledger(key, line, decision): k or e clears a line's marks, u is a blocker."""
    done = ledger.select(key, F.col("line").cast("int").alias("line"), F.lower(F.substring(F.trim("decision"), 1, 1)).alias("d")).where("d <> '' AND line IS NOT NULL")
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw")).select(key, (F.col("pos") + 1).alias("line"), "raw", F.ltrim("raw").alias("s"))
    head = lines.where(F.col("s").startswith("# ") & (F.upper("s").contains("DRAFT") | F.upper("s").contains("VERIFY"))).select(key, "line", F.lit("draft_header").alias("kind"), F.trim("s").alias("evidence"))
    label = r"^(?:\*\*\?[^:*\n]{1,40}:\*\*|\?[^:*\n]{1,40}:)"
    who = lines.where(F.col("s").rlike(label)).select(key, "line", F.lit("unconfirmed_speaker").alias("kind"), F.regexp_extract("s", label, 0).alias("evidence"))
    marked = lines.where(F.col("raw").contains("⚠")).join(done.where("d IN ('k', 'e')"), [key, "line"], "left_anti").select(key, "line", F.lit("unverified_span").alias("kind"), F.expr("substring(raw, locate('⚠', raw))").alias("evidence"))
    open_ = done.where("d = 'u'").join(lines.select(key, "line", "raw"), [key, "line"], "left").select(key, "line", F.lit("unresolved_ear").alias("kind"), F.trim(F.coalesce("raw", F.lit("(entry beyond end of file)"))).alias("evidence"))
    every = head.unionByName(who).unionByName(marked).unionByName(open_)
    return every.withColumn("evidence", F.when(F.length("evidence") > 70, F.concat(F.substring("evidence", 1, 69), F.lit("…"))).otherwise(F.col("evidence")))
