"""Every query that is registered with the driver, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.lines import split_lines
from quillmark.plans import compose, oracle, packs, rules
from quillmark.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "grade_receipts"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with one more line for each, chosen by doc_id, so that every rule has something to find."""
    line = F.element_at(F.array(*map(F.lit, oracle.SNIPPETS)), (F.col("doc_id") % len(oracle.SNIPPETS)).cast("int") + 1)
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))


_LINES = f"WITH {oracle.VIEWS.strip()}\n"


@query("lines_scan", _LINES + "SELECT doc_id, CAST(n AS INT) AS n, raw AS line FROM lines")
def lines_scan(spark, sf_dir):
    return split_lines(injected(spark, sf_dir))


@query("body_split", _LINES + "SELECT doc_id, CAST(n AS INT) AS n, regexp_extract(raw, '^\\s*[^:]{1,40}?:\\s') AS label, regexp_replace(raw, '^\\s*[^:]{1,40}?:\\s', '') AS body FROM lines")
def body_split(spark, sf_dir):
    return rules.lines_of(injected(spark, sf_dir)).select("doc_id", "n", F.regexp_extract("text", rules.java(rules.LABEL), 0).alias("label"), "body")


def _scanner_query(scanner):
    def run(spark, sf_dir):
        return rules.flags(injected(spark, sf_dir), [scanner]).drop("ord")

    return run


for _pack in packs.PACKS:
    for _scanner in (*_pack.scanners, *(s for _, v in _pack.by_lang for s in v)):
        if f"rule_{_scanner.name}" not in QUERIES:
            query(f"rule_{_scanner.name}", oracle.scanner_sql(_scanner))(_scanner_query(_scanner))

_GRADED = [packs.EXCLAMATION, packs.SPACING, packs.TERMINAL, packs.PARAGRAPH, packs.TIMESTAMPS, packs.INAUDIBLE]
_FLAGS = _LINES + ", f AS (" + " UNION ALL ".join(f"SELECT * FROM ({oracle.scanner_sql(s).split(chr(10), 1)[1].partition('SELECT doc_id, CAST(n AS INT)')[1]}{oracle.scanner_sql(s).partition('SELECT doc_id, CAST(n AS INT)')[2]})" for s in _GRADED) + ")"
_GRADE = _FLAGS + """, g AS (SELECT d.doc_id, any_value(d.lang) AS lang, any_value(d.source) AS source, count(f.rule) AS n_flags, count(CASE WHEN f.severity = 'critical' THEN 1 END) AS n_critical, count(CASE WHEN f.severity = 'review' THEN 1 END) AS n_review,
  CAST(coalesce(sum(CASE f.severity WHEN 'critical' THEN 3 WHEN 'moderate' THEN 1 ELSE 0 END), 0) AS BIGINT) AS score FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id),
r AS (SELECT doc_id, lang, source, CASE WHEN n_critical >= 2 THEN 'F' WHEN n_critical = 1 OR score >= 4 THEN 'D' WHEN score >= 2 THEN 'C' WHEN score = 1 OR n_review > 0 THEN 'B' ELSE 'A' END AS grade, score, n_critical, n_review, n_flags FROM g)
"""


def _flags(spark, sf_dir):
    return rules.flags(injected(spark, sf_dir), _GRADED)


def _receipts(spark, sf_dir):
    docs = injected(spark, sf_dir)
    return rules.grade(docs, rules.flags(docs, _GRADED))


@query("flags_fused", _FLAGS + " SELECT doc_id, line, rule, severity, evidence FROM f")
def flags_fused(spark, sf_dir):
    return _flags(spark, sf_dir).drop("ord")


@query("flags_full_legal")
def flags_full_legal(spark, sf_dir):
    return rules.flags(injected(spark, sf_dir), compose.compose("en", "legal", base=False))


@query("grade_receipts", _GRADE + " SELECT doc_id, grade, score, n_critical, n_review, n_flags FROM r")
def grade_receipts(spark, sf_dir):
    return _receipts(spark, sf_dir)


@query("grade_by_lang_rollup", _GRADE + " SELECT lang, grade, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM r GROUP BY ROLLUP (lang, grade)")
def grade_by_lang_rollup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    return _receipts(spark, sf_dir).join(docs, "doc_id").rollup("lang", "grade").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("flag_topk_per_source", _FLAGS + """, c AS (SELECT d.source, f.rule, count(*) AS n FROM f JOIN documents d USING (doc_id) GROUP BY d.source, f.rule)
 SELECT source, rule, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, rule) AS INT) AS rank FROM c QUALIFY rank <= 3""")
def flag_topk_per_source(spark, sf_dir):
    from pyspark.sql import Window

    docs = documents(spark, sf_dir).select("doc_id", "source")
    counted = _flags(spark, sf_dir).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("k")).join(docs, "doc_id").groupBy("source", "rule").agg(F.sum("k").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "rule"))).where("rank <= 3")


@query("label_separation", _GRADE + " SELECT l.quality, r.grade, count(*) AS n, CAST(sum(r.n_flags) AS BIGINT) AS flags FROM r JOIN labels l USING (doc_id) GROUP BY l.quality, r.grade")
def label_separation(spark, sf_dir):
    return _receipts(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality", "grade").agg(F.count(F.lit(1)).alias("n"), F.sum("n_flags").alias("flags"))


@query("compose_rulelist", "SELECT " + ", ".join(f"'{c}' AS c{i}" for i, c in enumerate(("en", "legal", "rev"))) + f", {len(compose.compose('en', 'legal', 'rev'))} AS scanners")
def compose_rulelist(spark, sf_dir):
    n = len({s.name for s in compose.compose("en", "legal", "rev")})
    return spark.createDataFrame([("en", "legal", "rev", n)], "c0 string, c1 string, c2 string, scanners int")


@query("coverage_grid")
def coverage_grid(spark, sf_dir):
    return compose.coverage(spark)


@query("manifest_gap_anti")
def manifest_gap_anti(spark, sf_dir):
    manifest = spark.createDataFrame([("domain", "base"), ("domain", "legal"), ("site", "rev")], "axis string, name string")
    return compose.manifest_gaps(spark, manifest)
