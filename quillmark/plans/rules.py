"""Rules as data, and their compilation into one projection.

A rule looks at one line (its whole text, or the speech behind a speaker label) and yields evidence strings. All rules of
a pack become one array expression per line and one inline(), so a corpus is read once, no line is shuffled and every
regex stays in the JVM. What a rule needs to know of the whole document is computed on the document's row before its lines are exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.lines import line_array

#: What a flag of each severity weighs in a grade.
WEIGHTS = {"critical": 3, "moderate": 1, "minor": 0, "review": 0}
#: Speaker labels that stand before the speech.
LABEL = r"^\s*[^:：]{1,40}?[：:]\s"
LABEL_LEGAL = r"^\s*(?:[A-Z][A-Z .'-]{0,38}|Q|A)\s{2,}|^\s*[^:]{1,40}?:\s"


def java(pattern: str, fold: bool = False) -> str:
    """A pattern with the meaning that it has on Unicode text: word classes of all scripts, only \\n as a line end."""
    return ("(?dUiu)" if fold else "(?dU)") + pattern


@dataclass(frozen=True)
class Rule:
    """pattern: each match is a flag with the match as evidence, or only the first one, or one flag for the line.

    group: the group that is the evidence. keep: a condition on the match (and the line's row). evidence: replaces the match.
    find: instead of a pattern, a column expression that gives the evidence array from the row. langs: only these languages.
    """

    rule: str
    severity: str
    pattern: str = ""
    scope: str = "text"  # text, body or legal
    fold: bool = False
    first: bool = False
    group: int = 0
    keep: Callable[[Column], Column] | None = None
    evidence: Callable[[Column], Column] | None = None
    find: Callable[[], Column] | None = None
    mode: str | None = None
    sql: str | None = None  # evidence array in SQL, where the pattern isn't enough
    no_sql: bool = False
    absent: bool = False  # for a script that the corpus tables don't hold: left out of the SQL

    def found(self) -> Column:
        """Evidence of this rule on a line, as an array of strings."""
        if self.find is not None:
            hits = self.find()
        else:
            source, rx = F.col({"text": "text", "body": "body", "legal": "body_legal"}[self.scope]), java(self.pattern, self.fold)
            if self.first:
                hits = F.when(source.rlike(rx), F.array(F.regexp_extract(source, rx, self.group)))
            else:
                hits = F.regexp_extract_all(source, F.lit(rx), F.lit(self.group))
        if self.keep is not None:
            hits = F.filter(hits, self.keep)
        if self.evidence is not None:
            hits = F.transform(hits, self.evidence)
        if self.mode is not None:
            hits = F.when(F.col("mode") == self.mode, hits)
        return F.coalesce(hits, F.array().cast("array<string>"))


@dataclass(frozen=True)
class Scanner:
    """A named check: the rules that it consists of."""

    name: str
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Pack:
    """Scanners of a language, domain or site; `by_lang` are those that only hold for some languages."""

    axis: str
    name: str
    scanners: tuple[Scanner, ...] = ()
    by_lang: tuple[tuple[str, tuple[Scanner, ...]], ...] = ()
    description: str = ""


def lines_of(docs: DataFrame, key: str = "doc_id", mode: str = "clean_verbatim") -> DataFrame:
    """(key, lang, mode, n, text, body, body_legal and what rules ask of the document): one row per line."""
    lines = line_array(F.col("text"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit("en")
    rows = docs.select(
        F.col(key), lang.alias("lang"), F.lit(mode).alias("mode"), lines.alias("lines"),
        F.coalesce(F.col("text").rlike("[。？.?]"), F.lit(False)).alias("has_terminal"),
        F.size(F.filter(lines, lambda x: x.rlike(java(r"^\s*(?:\d+[.)]|[-*•])\s+\S")))).alias("list_lines"))
    rows = rows.select("*", F.posexplode("lines").alias("pos", "line")).select(
        key, "lang", "mode", "has_terminal", "list_lines", (F.col("pos") + 1).alias("n"), F.col("line").alias("text"))
    return rows.select("*", F.regexp_replace("text", java(LABEL), "").alias("body"), F.regexp_replace("text", java(LABEL_LEGAL), "").alias("body_legal"))


def _flag(r: Rule, at: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), x.alias("evidence"), F.lit(at).alias("ord"))


def flags(docs: DataFrame, scanners: list[Scanner], key: str = "doc_id", mode: str = "clean_verbatim") -> DataFrame:
    """(key, line, rule, severity, evidence, ord): one row per flag; ord is the scanner's and rule's place in the pack."""
    found, at = [], 0
    for scanner in scanners:
        for r in scanner.rules:
            found.append(F.transform(r.found(), _flag(r, at)))
            at += 1
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, line int, rule string, severity string, evidence string, ord int")
    return lines_of(docs, key, mode).select(key, F.col("n").alias("line"), F.inline(F.flatten(F.array(*found)))).select(key, "line", "rule", "severity", "evidence", "ord")


def grade(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade, score, n_critical, n_review, n_flags): one row per document, also of those without a flag."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    per = found.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_flags"), F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "review").alias("n_review"), F.sum(F.coalesce(weight[F.col("severity")], F.lit(0))).alias("score"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("score", "n_critical", "n_review", "n_flags")}
    rows = docs.select(key).distinct().join(per, key, "left").select(key, *(v.alias(c) for c, v in zero.items()))
    letter = (F.when(F.col("n_critical") >= 2, "F").when(F.col("n_critical") == 1, "D").when(F.col("score") >= 4, "D")
              .when(F.col("score") >= 2, "C").when(F.col("score") == 1, "B").when(F.col("n_review") > 0, "B").otherwise("A"))
    return rows.select(key, letter.alias("grade"), "score", "n_critical", "n_review", "n_flags")
