"""Consensus, metrics, timelines, translation checks, mining, corrections, timecodes and sources against small truths."""

import difflib
import json
import random

from pyspark.sql import functions as F

from quillmark.operators import consensus, conversation, fix, metrics, mining, smpte, timeline, translation
from quillmark.sources import files


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(3)
    pairs = [(i, " ".join(rng.choice("a bb ccc d e'f".split()) for _ in range(rng.randrange(0, 12))), " ".join(rng.choice("a bb ccc d e'f".split()) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(98, "", ""), (99, "", "x"), (97, None, "x"), (96, "Hello, World!", "hello world")]
    df = spark.createDataFrame(pairs, "id long, ref string, hyp string")
    w = {r["id"]: r["wer"] for r in metrics.wer(df).collect()}
    c = {r["id"]: r["cer"] for r in metrics.cer(df).collect()}
    for i, r, h in pairs[:60]:
        r, h = r.split(), h.split()
        assert w[i] == (round(_edit(r, h) / len(r), 4) if r else float(bool(h)))
        a, b = "".join(r), "".join(h)
        assert abs(c[i] - (round(_edit(a, b) / len(a), 4) if a else float(bool(b)))) < 1e-9
    assert (w[98], w[99], w[97], w[96]) == (0.0, 1.0, 1.0, 0.0)


def test_chrf(spark):
    df = spark.createDataFrame([(1, "the cat", "the cat"), (2, "abc", "xyz"), (3, "", "a")], "id long, ref string, hyp string")
    got = {r["id"]: r["chrf"] for r in metrics.chrf(df, "id").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


READS = [(1, "scribe", "en", "the quick browm fox"), (1, "gemini", "en", "the quick brown fox"), (1, "whisper", "en", "the quick brown fox"), (1, "hf", "en", "the quick brown fox"), (2, "hf", "en", "same text"), (2, "whisper", "en", "same text"), (3, "scribe", "en", "(music) alone"), (3, "gemini", "en", "")]


def test_votes_count_families(spark):
    reads = spark.createDataFrame(READS, "clip_id long, witness string, lang string, text string")
    assert {r["clip_id"]: r["majority"] for r in consensus.majority(reads).collect()} == {1: 2, 2: 1, 3: 1}
    tok = {r["clip_id"]: r for r in consensus.consensus_tokens(reads).collect()}
    assert tok[1]["text"] == "the quick brown fox" and tok[1]["changed"] == 1 and tok[3]["text"] == "alone"
    lexicon = spark.createDataFrame([("browm",), ("brown",)], "word string")
    assert {r["clip_id"]: r["text"] for r in consensus.consensus_tokens(reads, lexicon).collect()}[1] == "the quick browm fox"  # a known word stays
    assert {r["clip_id"]: r["text"] for r in consensus.vote(reads).collect()}[1] == "the quick brown fox"
    gate = {r["clip_id"]: (r["status"], r["families"]) for r in consensus.gate(reads, consensus.consensus_tokens(reads)).collect()}
    assert gate == {1: ("pass", 3), 2: ("review", 1), 3: ("review", 1)}
    dead = spark.createDataFrame([(1, "en", "deepgram", "error")], "clip_id long, lang string, witness string, status string")
    assert {r["clip_id"]: r["status"] for r in consensus.gate(reads, consensus.consensus_tokens(reads), dead).collect()}[1] == "review"


def test_medoid_is_the_nearest_read(spark):
    rows = [(1, w, "en", t) for w, t in (("a", "one two three"), ("b", "one two four"), ("c", "five six seven eight"))]
    got = consensus.medoid(spark.createDataFrame(rows, "clip_id long, witness string, lang string, text string")).first()["witness"]
    dist = {w: sum(1 - difflib.SequenceMatcher(a=t, b=u).ratio() for x, _, _, u in [(r[1], 0, 0, r[3]) for r in rows] if x != w) for _, w, _, t in rows}
    assert got == min(dist, key=lambda k: (dist[k], k))


def test_timelines(spark):
    ref = spark.createDataFrame([(1, 0, 0.0, 5.0, "A"), (1, 1, 5.0, 10.0, "B")], "clip_id long, ord int, start double, end double, speaker string")
    hyp = spark.createDataFrame([(1, 0, 0.0, 5.5, "x"), (1, 1, 5.5, 10.0, "y")], "clip_id long, ord int, start double, end double, speaker string")
    assert {r["h"]: r["mapped"] for r in timeline.map_ids(ref, hyp).collect()} == {"x": "A", "y": "B"}
    got = timeline.agreement(ref, hyp).first()
    assert got["total"] == 21 and got["same"] == 20 and got["agreement_pct"] == 95.2
    assert [r["agree"] for r in timeline.cross_consensus(ref, {"other": hyp}).orderBy("ord").collect()] == [True, True]
    seg = spark.createDataFrame([(1, 0.0, 4.0), (1, 20.0, 22.0), (1, 30.0, 30.5)], "clip_id long, start double, end double")
    cov = timeline.verify_coverage(seg, ref).first()
    assert (cov["n_segments"], cov["n_uncovered"], cov["covered_pct"]) == (2, 1, 66.7)
    assert timeline.fixed_chunks(spark.createDataFrame([(1, 100.0)], "clip_id long, duration double"), 60.0, 10.0).count() == 2


def test_timecodes(spark):
    df = spark.range(0, 4_000_000, 1801).select(F.col("id").alias("f"))
    back = df.select("f", smpte.tc_to_frames(smpte.frame_to_tc(F.col("f"), F.lit(25)), F.lit(25)).alias("a"), smpte.tc_to_frames(smpte.frame_to_tc_drop(F.col("f") % 2589408), F.lit(30)).alias("b"))
    assert back.where("a <> f OR b <> f % 2589408").count() == 0
    one = spark.range(1).select(smpte.frame_to_tc(F.lit(86399), F.lit(24)).alias("a"), smpte.frame_to_tc_drop(F.lit(1800)).alias("b"), smpte.frame_rate(F.lit("24000/1001")).alias("c"), smpte.nominal_rate(F.lit(29.97)).alias("d"), smpte.tc_to_frames(F.lit("1:12"), F.lit(24)).alias("e"), smpte.file_timestamp(F.lit(2), F.lit(600.0), F.lit(61.5)).alias("f")).first()
    assert tuple(one) == ("00:59:59:23", "00:01:00;02", 23.976, 30, None, "[00:21:01]")


def test_translation_checks(spark):
    pairs = spark.createDataFrame([
        (1, "ru", "en", "Привет {name}", "Hello {name}"), (2, "ru", "en", "Привет мир", "Hello мир (мир)"), (3, "es", "en", "hola %s mundo [1]", "hola mundo %s"),
        (4, "ja", "zh", "a", "b"), (5, "en", "fr", "x" * 40, "x"), (6, "en", "en", "", "")], "pair_id long, src_lang string, tgt_lang string, source_text string, translation string")
    gloss = spark.createDataFrame([("es", "en", "mundo", "world")], "src_lang string, tgt_lang string, term string, rendering string")
    flags = translation.run_qa(pairs, gloss)
    got = sorted((r["pair_id"], r["kind"], r["evidence"]) for r in flags.collect())
    assert got == [(2, "source_script_leak", "мир"), (3, "glossary", "world"), (3, "placeholder", "[1]"), (3, "untranslated_passthrough", "75%"), (5, "length_ratio", "0.03")]
    ok = {r["pair_id"]: (r["ok"], r["verifiable"]) for r in translation.verdicts(pairs, flags).collect()}
    assert ok == {1: (True, True), 2: (False, True), 3: (False, True), 4: (False, False), 5: (False, True), 6: (True, True)}
    n = spark.createDataFrame([(1, "1,200 and 3.5 and 3.5", "1.200 and 3,5 and 7")], "pair_id long, source_text string, translation string")
    assert sorted((r["value"], r["side"], r["n"]) for r in translation.number_survival(n).collect()) == [(3.5, "missing", 1), (7.0, "introduced", 1)]


def test_mining(spark):
    docs = spark.createDataFrame([(1, "red wine red wine dry wine"), (2, "red wine"), (3, None)], "doc_id long, text string")
    got = {(r["word"], r["mate"]): r["n"] for r in mining.collocations(docs).collect()}
    assert got == {}  # in so small a corpus every word is a stop word
    many = spark.createDataFrame([(i, f"w{i % 700} v{i % 700} x{i}") for i in range(4000)], "doc_id long, text string")
    top = {(r["word"], r["mate"]): (r["n"], r["rank"]) for r in mining.collocations(many).collect()}
    assert top == {}  # letters only: w, v and x are the words
    conf = mining.confusions(spark.createDataFrame([("en", "a red fox ran", "a bread box ran")], "lang string, gold string, heard string"))
    assert sorted((r["gold"], r["heard"], r["n"]) for r in conf.collect()) == [("fox", "box", 1), ("red", "bread", 1)]
    assert mining.inverted(conf).where("heard = 'box'").first()["golds"] == ["fox"]
    one = spark.range(1).select(mining.phonetic_spanish(F.lit("Quesada")).alias("a"), mining.phonetic_spanish(F.lit("Kezada")).alias("b"), mining.skeleton(F.lit("Theerran")).alias("c")).first()
    assert one["a"] == one["b"] == "kesada" and one["c"] == "thrn"
    near = mining.name_candidates(spark.createDataFrame([("gimenes",)], "word string"), spark.createDataFrame([("Jiménez",), ("Ana",)], "name string"))
    assert [r["name"] for r in near.collect()] == ["Jiménez"]


def test_collocation_decision(spark):
    colloc = spark.createDataFrame([("piece", "cake"), ("peace", "war"), ("peace", "treaty")], "word string, mate string")
    sets = spark.createDataFrame([(1, "piece"), (1, "peace")], "set_id int, word string")
    lines = spark.createDataFrame([(1, 1, "the piece treaty after the war"), (1, 2, "a piece of cake")], "doc_id long, n int, text string")
    assert [(r["n"], r["written"], r["suggest"], r["margin"]) for r in mining.decisions(lines, sets, colloc).collect()] == [(1, "piece", "peace", 2)]


def test_corrections(spark):
    text = "MR. JONES    Um, OK, could of gone at 5 p.m.  there .\nQ: gonna  wait, 50% (laughs)\nAlright Mrs. Hall, you're own café\nfine"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["changed"]) for r in fix.fix(docs, "legal").collect()}
    assert got[1][0].split("\n") == ["MR. JONES    okay, could have gone at 5 PM there.", "Q: going to wait, 50 percent [laughs]", "All right Ms. Hall, your own cafe", "fine"]
    assert got[1][1] == 3 and got[2] == ("", 0) and got[3] == ("", 0)
    again = {r["doc_id"]: r["changed"] for r in fix.fix(spark.createDataFrame([(1, got[1][0])], "doc_id long, text string"), "legal").collect()}
    assert again == {1: 0}
    done = spark.createDataFrame([("えーと、はい。 まあ、Hello。 (laughs)",)], "t string").select(fix.finished(fix.normalised_sounds(F.col("t"))).alias("t")).first()["t"]
    assert done == "はい。 Hello. [laughs]"


def test_delivery_gate(spark):
    docs = spark.createDataFrame([(1, "# DRAFT verify\n?Bose: hi\nx ⚠ y\n⚠ z"), (2, "clean?")], "doc_id long, text string")
    raw = spark.createDataFrame([(1, json.dumps({"3": "kept", "2": "u"})), (2, "not json")], "doc_id long, json string")
    led = files.ledger(raw)
    got = sorted((r["doc_id"], r["line"], r["kind"]) for r in fix.blockers(docs, led).collect())
    assert got == [(1, 1, "draft_header"), (1, 2, "unconfirmed_speaker"), (1, 2, "unresolved_ear"), (1, 4, "unverified_span")]


def test_ledger_shapes(spark):
    shapes = [{"24": "k", "x": "e"}, [{"line": 3, "decision": "Edited"}, {"line": None, "decision": "k"}], {"resolved": [{"line_no": 7, "decision": "unresolved"}], "total_flagged": 2}, {"5": {"decision": "keep"}}]
    raw = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "doc_id long, json string")
    assert sorted((r["doc_id"], r["line"], r["decision"]) for r in files.ledger(raw).collect()) == [(0, 24, "k"), (1, 3, "e"), (2, 7, "u"), (3, 5, "k")]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo ⚠\n")
    assert files.transcripts(spark, str(tmp_path / "t")).first()["text"] == "one\ntwo ⚠\n"
    (tmp_path / "c.json").write_text(json.dumps({"_meta": {}, "confusions": {"fox": [["box", 3]]}}))
    assert tuple(files.confusions(spark, str(tmp_path / "c.json"), "en").first()) == ("en", "fox", "box", 3)
    (tmp_path / "r.json").write_text(json.dumps({"en": {"scribe": 0.9}}))
    assert tuple(files.reliability(spark, str(tmp_path / "r.json")).first()) == ("en", "scribe", 0.9)
    (tmp_path / "s.json").write_text(json.dumps({"sets": [["a", "b"]]}))
    assert files.sets(spark, str(tmp_path / "s.json")).count() == 2
    draft = spark.createDataFrame([(1, "[00:10] a\nb ⚠\n[00:20] c\n[00:05] d")], "doc_id long, text string")
    assert [(r["n"], r["seconds"], r["flagged"]) for r in files.anchors(draft).orderBy("n").collect()] == [(1, 10.0, False), (2, 15.0, True), (3, 20.0, False), (4, 20.0, False)]


def test_html_receipt_escapes(spark):
    rec = spark.createDataFrame([(1, "B", 1), (2, "A", 0)], "doc_id long, grade string, score long")
    fl = spark.createDataFrame([(1, 2, "spacing", "review", "<b>", 0)], "doc_id long, line int, rule string, severity string, evidence string, ord int")
    got = {r["doc_id"]: r["html"] for r in files.html_receipts(rec, fl).collect()}
    assert "&lt;b&gt;" in got[1] and 'class="review"' in got[1] and "<tr" not in got[2]


def test_conversation_rules(spark):
    talk = [
        (1, 0, "user", "I want a refill. See Doctor Fake."), (1, 1, "assistant", "Your prescription is ready, we called it in."), (1, 2, "assistant", "Openings with him on Monday."), (1, 3, "assistant", "Goodbye, have a great day."),
        (2, 0, "assistant", "You are booked on Sunday with Dr. Wolfe."), (2, 1, "assistant", "Connecting you to a representative."), (2, 2, "assistant", "Goodbye."),
        (3, 0, "assistant", "What is your date of birth?"), (3, 1, "assistant", "What is your date of birth?"), (3, 2, "assistant", "Please, your dob."), (3, 3, "assistant", "I have your date of birth as May 5, profile created. Take 20 mg."), (4, 0, "system", "booked on sunday"), (5, 0, "user", None)]
    c = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    dims = spark.createDataFrame([("sunday",)], "day string"), spark.createDataFrame([("adams",)], "name string"), spark.createDataFrame([("fake",)], "name string")
    got = sorted((r["conv_id"], r["turn"], r["rule"]) for r in conversation.audit(c, *dims).collect())
    assert got == [(1, 1, "refill_without_verification"), (1, 2, "played_along_fake_provider"), (1, 3, "dropped_intent"), (2, 0, "closed_day_booking"), (2, 0, "hallucinated_doctor"), (2, 2, "false_transfer"), (3, 1, "repetition"), (3, 2, "stuck_loop"), (3, 3, "fabricated_identity"), (3, 3, "medical_advice")]


def test_translation_queries_read_whole_texts(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(0, "first line\nkeep {late} here", "en"), (1, "first line\nnothing here", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["translation_qa"](spark, str(tmp_path)).collect()
    assert any("{late}" in str(r) for r in got)
    assert queries()["translation_verdicts"](spark, str(tmp_path)).count() == 1


def test_drop_frames_of_many_days(spark, tmp_path):
    """The round trip keeps the days that a code doesn't show."""
    from __spark_entry__ import queries

    ids = (0, 1, 1799, 70_053, 70_054, 140_109, 6_000_000)
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in queries()["smpte_drop_round_trip"](spark, str(tmp_path)).collect()} == {(i, i * 37) for i in ids}


def test_translation_queries_compute_their_own_check(spark, tmp_path):
    """Each does its check alone: no text is shuffled to measure it or to look up a term, and kept words are not searched list by list."""
    from __spark_entry__ import queries

    docs = [(0, "the cat", "en"), (1, "un gato", "en"), (2, "Uno dos dos tres", "es"), (3, "dos uno x 1", "en"), (4, None, "de"), (5, "x" * 90, "en"), (6, "and", "en"), (7, "the  end", "ru")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {q: queries()[q](spark, str(tmp_path)) for q in ("glossary_miss", "length_band", "passthrough_ratio")}
    assert sorted(map(tuple, got["glossary_miss"].collect())) == [(0,)]
    assert {r["pair_id"] for r in got["length_band"].collect()} == {3, 4, 5}
    assert [tuple(r) for r in got["passthrough_ratio"].collect()] == [(2,)]
    for q, df in got.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "array_contains" not in plan and "FOREIGN" not in plan and "Generate" not in plan
        assert q == "passthrough_ratio" or "regexp" in plan.split("Join", 1)[1]  # below the join
    from quillmark.functions.align import kept_share
    from pyspark.sql import functions as F

    lists = spark.createDataFrame([(["a", "b", "a", "z"], ["a", "q"]), ([], ["a"]), (["b"], []), (["é", "a"], ["a", "é"])] * 400, "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(kept_share(F.col("a"), F.col("b"))).collect()] == [0.5, None, 0.0, 1.0] * 400
