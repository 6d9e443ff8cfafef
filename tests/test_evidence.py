"""Evidence beside the vote against small truths, and its queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark import catalog, catalog_evidence  # noqa: F401
from quillmark.operators import evidence

TABLE = "/root/testdata/sf0.001"


def test_critical_flags(spark):
    rows = [("med_dosage", "moderate"), ("no_exclamation", "minor"), ("ccsl_timecode", "critical"), ("legal_term", "review")]
    got = evidence.critical(spark.createDataFrame(rows, "rule string, severity string")).collect()
    assert {r["rule"] for r in got} == {"med_dosage", "ccsl_timecode", "legal_term"}


def test_language_check(spark):
    rows = [(1, "en", "en"), (2, "ja", "en"), (3, None, "hi"), (4, "", None), (5, "ko", "")]
    got = {r["clip_id"]: (r["lang"], r["candidates"], r["agree"]) for r in evidence.language_check(spark.createDataFrame(rows, "clip_id long, first string, second string")).collect()}
    assert got == {1: ("en", ["en"], True), 2: ("ja", ["en", "ja"], False), 3: ("hi", ["hi"], False), 4: ("", [], False), 5: ("ko", ["ko"], False)}


def test_completeness(spark):
    rows = [(1, ["患者", "は", "バルセロナ", "ok"], "患者は ok"), (2, ["ok"], ""), (3, None, "x"), (4, ["患者"], None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, final string")
    assert {r["id"]: r["c"] for r in df.select("id", evidence.completeness(F.col("tokens"), F.col("final")).alias("c")).collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.0}


def test_pitch_accents(spark):
    entries = spark.createDataFrame([("箸", "ハシ", "1"), ("橋", "はし", "2"), ("端", "はし", "0, 2,x"), ("橋", "きょう", "3")], "surface string, reading string, accent string")
    pairs = spark.createDataFrame([("箸", "橋", "はし"), ("橋", "端", "ハシ"), ("箸", "無", "はし"), ("箸", "橋", None)], "a string, b string, reading string")
    got = {(r["a"], r["b"], r["reading"]): r for r in evidence.distinguished(pairs, entries).collect()}
    one = got["箸", "橋", "はし"]
    assert one["distinguishable"] and one["hint"] == "箸=accent 1 [atamadaka (drops right after the first mora)]; 橋=accent 2 [odaka (drops on the following particle)]"
    assert got["橋", "端", "ハシ"]["b_accents"] == [0, 2] and not got["橋", "端", "ハシ"]["distinguishable"]
    assert not got["箸", "無", "はし"]["have_data"] and got["箸", "橋", None]["b_accents"] == [2, 3]


def test_translations(spark):
    df = spark.createDataFrame([(1, "17 people.", "seventeen people"), (2, "", "x"), (3, None, None), (4, "a b c d", "a b x y")], "id int, a string, b string")
    assert {r["id"]: r["g"] for r in df.select("id", evidence.agreement("a", "b").alias("g")).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.5}
    rows = [(1, "abcd", 1, True, "abcd", 1, True), (2, "abcd", 1, True, "abcd", 2, False), (3, "abcd", 1, True, "a", 2, True), (4, "abcd", 1, False, "a", 2, True), (5, None, 0, False, None, 1, False)]
    df = spark.createDataFrame(rows, "id int, first string, first_passed int, first_ok boolean, second string, second_passed int, second_ok boolean")
    assert {r["id"]: r["primary"] for r in evidence.leading(df).collect()} == {1: "first", 2: "second", 3: "first", 4: "second", 5: "second"}


@pytest.mark.parametrize("name", ["critical_flags", "language_check", "completeness", "leading_translation"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TABLE}/documents.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, TABLE).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    cols = sorted(got.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))
