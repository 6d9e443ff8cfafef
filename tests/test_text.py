"""Text functions and chunked recordings against small truths and plain Python."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunks, consensus, metrics, timeline


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_folds(spark):
    assert _one(spark, "Dvořák saw the Łódź café", lambda c: T.without_marks(c)) == "Dvorak saw the Łodz cafe"
    assert _one(spark, "Dvořák ﬁn", lambda c: T.ascii_folded(c)) == "Dvorak fin" and _one(spark, "日本", lambda c: T.ascii_folded(c)) == "日本"
    assert _one(spark, "«İstanbul»,", T.clean_word) == "istanbul"
    assert _one(spark, "४२ 一 ٣", lambda c: T.script_folded(c, F.lit("en"))) == "42 一 3"
    assert _one(spark, "مَرْحَبًا أنا التاسع والعشرين", lambda c: T.script_folded(c, F.lit("ar"))) == "مرحبا انا تسعه عشرون"
    assert _one(spark, "بچّے ي ك", lambda c: T.script_folded(c, F.lit("ur"))) == "بچے ی ک"
    assert _one(spark, "मरीज़ों जाँच", lambda c: T.script_folded(c, F.lit("hi"))) == unicodedata.normalize("NFC", "मरीजों जांच")


def test_scripts_without_blanks(spark):
    assert _one(spark, "患者 は ok go です", T.space_stripped) == "患者は ok go です"
    assert _one(spark, "患 者 Nakamura san 3 は", lambda c: T.rejoined(F.split(c, " "))) == "患者Nakamura san 3は"
    assert _one(spark, "キョウト", T.hiragana) == "きょうと" and _one(spark, "キョウト", T.morae) == ["きょ", "う", "と"]
    assert _one(spark, "東京 ok", T.lang_of) == "ja" and _one(spark, "12", T.lang_of) == "neutral" and _one(spark, "a東", T.lang_of) == "ja"
    assert [tuple(r) for r in _one(spark, "1 東京, ok go です!", T.runs)] == [("ja", "1 東京, "), ("en", "ok go "), ("ja", "です!")]
    assert [tuple(r) for r in _one(spark, "12 ?", T.runs)] == [("neutral", "12 ?")]
    assert _one(spark, "Я", T.script_of) == "cyr" and _one(spark, "?", T.script_of) is None


@pytest.mark.parametrize("span,value", [("百", 100), ("三百二十", 320), ("四万七千", 47000), ("１２３", 123), ("二〇二四", 2024), ("十", 10), ("零", 0), ("a", None), ("", None)])
def test_number_values(spark, span, value):
    got = _one(spark, span, T.number_value)
    assert (None if got is None else int(got)) == value


def _spell(n):
    ones = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    if n < 20:
        return ones[n]
    if n < 100:
        return tens[n // 10 - 2] + (" " + ones[n % 10] if n % 10 else "")
    for by, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= by:
            return f"{_spell(n // by)} {name}" + ((" and " if by == 100 else " ") + _spell(n % by) if n % by else "")


def test_cardinals():
    import random

    rng = random.Random(4)
    for n in [*range(0, 1200), *(rng.randrange(10**9) for _ in range(300))]:
        assert T.cardinal(_spell(n).split()) == n, n
    for bad in ("twenty twelve", "nineteen eighty four", "five six", "hundred and", "two million three million", "zero five", "and five"):
        assert T.cardinal(bad.split()) is None, bad


def test_canonical_numbers():
    assert T.canonical("Twenty-one dollars and 5%") == "21 dollars and 5 percent"
    assert T.canonical("47,000,000 or forty seven million or 47 million") == "47000000 or 47000000 or 47000000"
    assert T.canonical("2,5 and 5-10 on the 3rd") == "2,5 and 5-10 on the 3" and T.canonical("2.5 million") == "2500000"
    assert T.canonical("nineteen eighty four") == "nineteen eighty four"


def test_error_rates(spark):
    rows = [(1, "twenty dollars", "$20 dollars", "en"), (2, "A日本 b", "a日本 b", "ja"), (3, "日本 語", "日本語", "ja"), (4, "کر دیا ہے", "کردیا ہے", "ur"), (5, "کر دیا ہے", "کردیا ہے", "en"), (6, "", "x", "en"), (7, "it's 2.5", "it's 25", "en")]
    df = spark.createDataFrame(rows, "id int, ref string, hyp string, lang string")
    got = {r["id"]: r["wer"] for r in metrics.wer(df, lang="lang").collect()}
    assert got[1] == 0.0 and got[2] == 0.0 and got[4] == 0.0 and got[5] > 0 and got[6] == 1.0 and got[7] > 0
    assert {r["id"]: r["wer"] for r in metrics.wer(df, numbers=False).collect()}[1] > 0
    assert len(spark.createDataFrame([("A日本 b",)], "t string").select(metrics.tokens(F.col("t")).alias("t")).first()["t"]) == 2
    assert {r["id"]: r["cer"] for r in metrics.cer(df, lang="lang").collect()}[3] == 0.0


def test_list_order_and_lone_reads(spark):
    turns = spark.createDataFrame([(1, 0, 5.0, 9.0, "B"), (1, 1, 0.0, 9.0, "A")], "clip_id long, ord int, start double, end double, speaker string")
    assert timeline.speaker_at(spark.createDataFrame([(1, 6.0)], "clip_id long, t double"), turns).first()["speaker"] == "B"
    lone = spark.createDataFrame([(1, "scribe", "ja", "日本  語です"), (2, "scribe", "en", "a b"), (2, "gemini", "en", "a [x] b")], "clip_id long, witness string, lang string, text string")
    assert {r["clip_id"]: r["text"] for r in consensus.consensus_tokens(lone).collect()} == {1: "日本  語です", 2: "a b"}
    reads = spark.createDataFrame([(1, 0, "whisper", "en", "x y"), (1, 1, "scribe", "en", "a b")], "clip_id long, ord int, witness string, lang string, text string")
    assert consensus.vote(reads).first()["text"] == "x y"


def test_splices(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(1, k, " ".join(words[80 * k: 80 * k + 100])) for k in range(6)] + [(2, 0, "a b c d e f"), (2, 1, "x x y"), (3, 0, ""), (3, 1, "only this"), (4, 0, "p q r s t u v"), (4, 1, "R S T U w")]
    got = {r["clip_id"]: (r["text"], r["bad_seams"]) for r in chunks.spliced(spark.createDataFrame(rows, "clip_id long, idx int, text string")).collect()}
    assert got[1] == (" ".join(words), 0) and got[2] == ("a b c d e f x x y", 1) and got[3] == ("only this", 0) and got[4] == ("p q r s t u v w", 0)


def test_redistribution(spark):
    had = spark.createDataFrame([(1, 0, 0.0, "the quick"), (1, 1, 2.0, "brown fox um"), (1, 2, 3.0, "jumps"), (2, 0, 0.0, "kept")], "clip_id long, ord int, start double, text string")
    new = spark.createDataFrame([(1, "The quick red brown fox leaps"), (2, "")], "clip_id long, text string")
    got = {(r["clip_id"], r["ord"]): r["text"] for r in chunks.redistributed(had, new).collect()}
    assert got == {(1, 0): "The quick", (1, 1): "red brown fox leaps", (1, 2): "jumps", (2, 0): "kept"}


def test_speakers_across_chunks(spark):
    rows = [(1, 0, 0.0, 0, 0.0, 4.0, "a", "1"), (1, 0, 0.0, 1, 4.5, 14.0, "b", "2"), (1, 1, 10.0, 0, 10.0, 14.0, "x", "2"), (1, 1, 10.0, 1, 15.0, 18.0, "y", "3"), (1, 1, 10.0, 2, 19.0, 21.0, "x", "4"), (1, 1, 10.0, 3, 22.0, 23.0, "z", "5")]
    df = spark.createDataFrame(rows, "clip_id long, idx int, offset double, ord int, start double, end double, speaker string, text string")
    got = [(r["speaker"], r["text"]) for r in chunks.merged_chunks(df, 6.0).orderBy("ord").collect()]
    assert got == [("a", "1"), ("b", "2"), ("b", "3"), ("b", "4"), ("spk_10_z", "5")]  # y, too, was heard where b spoke last


def test_failures_and_adoption(spark):
    rows = [(401, "bad", "http"), (401, "quota_exceeded", "http"), (402, None, "http"), (429, "", "http"), (500, "", "http"), (None, "x", "network"), (None, "KEY not found", "runtime"), (None, "no .env", "file"), (None, "odd" * 60, "other")]
    df = spark.createDataFrame(rows, "code int, message string, kind string")
    got = [r[0] for r in df.select(chunks.failure(F.col("code"), F.col("message"), F.col("kind"))).collect()]
    assert got == ["HTTP 401 bad key", "HTTP 401 OUT OF CREDITS (quota exceeded)", "HTTP 402 OUT OF CREDITS", "HTTP 429 rate-limited", "HTTP 500", "network", "no API key", "no API key", ("odd" * 60)[:120]]
    slots = spark.createDataFrame([(1, "Shevon"), (2, "yamamoto"), (3, "okumoko"), (4, "same"), (5, "lone")], "slot_id long, word string")
    heard = [(1, "Siobhan", "a"), (1, "siobhan.", "b"), (2, "Yamanoto", "a"), (2, "yamanoto", "b"), (3, "ow", "a"), (3, "ow", "b"), (4, "Same", "a"), (4, "same", "b"), (5, "alone", "a"), (5, "alone", "a")]
    got = chunks.adopted(slots, spark.createDataFrame(heard, "slot_id long, word string, family string"), spark.createDataFrame([("yamamoto",)], "word string"))
    assert [r["slot_id"] for r in got.collect()] == [1]
