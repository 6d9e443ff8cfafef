"""Fire and stay-silent pairs for the packs, and the projections around them."""

import pytest
from pyspark.sql import functions as F

from quillmark.plans import compose, packs, rules

ALL = {s.name: s for p in packs.PACKS for s in (*p.scanners, *(x for _, v in p.by_lang for x in v))}
CASES = [
    ("timestamps", "at [0:12] and (00:01:02)", ["[0:12]", "(00:01:02)"]), ("timestamps", "at [00:09:25]", []),
    ("speaker_labels", "Speaker? 1: hi", ["Speaker? 1:"]), ("speaker_labels", "?Speaker 1: hi", []),
    ("inaudible", "it [inaudable 00:01:02]", ["[inaudable 00:01:02]"]), ("inaudible", "it [inaudible 00:01:02]", []),
    ("fillers", "Bob: um, you know", ["um", "you know"]), ("fillers", "うーん、はい", ["うーん"]), ("fillers", "drum", []),
    ("spacing", "two  blanks", ["  …  "]), ("spacing", "end .", ["d ."]), ("spacing", "fine.", []),
    ("no_exclamation", "no!", ["! / ！"]), ("paragraph_length", "a" * 251, ["251 chars"]), ("paragraph_length", "a" * 250, []),
    ("en_format", "gonna be OK, U.S.A. fifty", ["gonna", "OK", "U.S.A.", "fifty"]), ("en_format", "Okay then", []),
    ("sound_event_format", "(laughs) ふん", ["(laughs)", "ふん"]),
    ("legal_spelling", "OK alright the Internet U.S. law", ["OK", "alright", "U.S.", "Internet"]), ("legal_spelling", "Internet is okay", []),
    ("legal_fillers", "uh uh-huh er", ["uh", "er"]), ("legal_nonverbal", "mm-hmm mhm", ["mm-hmm", "mhm"]), ("legal_titles", "Mrs. Hall saw doctor Smith on officer Monday", ["Mrs. Hall", "doctor Smith"]),
    ("legal_numbers", "50% of fifteen", ["50%", "fifteen"]), ("legal_accents", "a café", ["café"]), ("legal_accents", "a cafe", []), ("legal_ampm", "5 p.m.", ["p.m."]),
    ("legal_grammar", "could of, you're own, their is", ["could of", "you're own", "their is"]), ("legal_oxford_comma", "red, white and blue", ["red, white and blue"]), ("legal_oxford_comma", "red, white, and blue", []),
    ("legal_comma_splice", "done, this is", [", this is"]), ("legal_dash_form", "wait — no -", ["—", "wait — no -"]), ("legal_repeated_words", "to go to go, that that", ["to go to go"]),
    ("legal_partial_words", "wha- what", ["wha-"]), ("legal_money_numerals", "twenty five dollars", ["twenty five dollars"]), ("legal_decade_apostrophe", "the 70's", ["70's"]),
    ("legal_date_commas", "June, 2020", ["June, 2020"]), ("legal_conjunction_comma", "So, I went", ["So,"]), ("legal_quote_punct", 'a "b".', ['".']), ("legal_spoken_punct", "yes, comma", [", comma"]),
    ("legal_speaker_ids", "Mr. Smith: hi", ["Mr. Smith:"]), ("legal_speaker_ids", "MR. SMITH: hi", []), ("legal_terms", "habeus corpus and subpena duces tecum", ["habeus corpus", "subpena duces tecum"]), ("legal_tags", "(inaudible) [Inaudible]", ["(inaudible)", "[Inaudible]"]),
    ("dangerous_abbreviations", "MSO4 qd T3 H.C.T.Z.", ["MSO4", "qd", "T3", "HCTZ"]), ("dosage_hygiene", "5.0 mg, .5 mg 3 @ 4 x 5d", ["5.0 mg", ".5 mg", "3 @ 4", "x 5d"]),
    ("french_spacing", "oui! «non»", ["i!", "n»", "«n"]), ("german_old_spelling", "Daß muss", ["Daß"]), ("portuguese_cedilla", "façil", ["façil"]), ("turkish_foreign_letters", "show bir", ["show"]), ("vietnamese_foreign_letters", "jazz z", ["jazz"]),
    ("tatweel", "مـرحبا", ["ـ"]), ("mixed_script", "мoст mост", ["мoст", "mост"]), ("latin_leak_arabic", "مرحبا بكم ok", ["ok"]), ("japanese_punctuation", "はい. 3.14", ["い."]), ("personal_apostrophes", "dont im cant", ["dont", "im", "cant"]),
    ("tm_sound_tags", "[laughs] [coughs]", ["[laughs]"]), ("tm_lowercase_terms", "see Page 4 on the Line 5", ["Page", "Line"]), ("tm_speaker_caps", "Mr. Jones    Yes", ["Mr. Jones"]), ("tm_double_dash", "so -- and", ["--"]), ("tm_spoken_punct", "so, comma, and, semicolon, ok", ["comma", "semicolon"]),
    ("rev_tags", "[inaudible] [crosstalk 00:01:02] [hum]", ["[inaudible]", "[hum]"]), ("rev_affirmative", "Mm-hmm. Uh-uh (negative)", ["Mm-hmm"]), ("rev_punctuation", "wait-- no", ["t--"]), ("rev_spelled_words", "b-o-b", ["b-o-b"]), ("rev_informal_contractions", "'em gonna", ["gonna"]),
    ("scribie_tags", "[laughter] [inaudible] [hum]", ["[inaudible]", "[hum]"]), ("scribie_style", "etc. N.A.S.A. i.e.", ["etc.", "N.A.S.A."]), ("scribie_speakers", "Male: hi", ["Male:"]),
    ("qt_unknown_words", "**** ** ____", ["____", "**"]), ("qt_spelled_words", "b-o-b", ["b-o-b"]), ("qt_speakers", "Speaker 1: hi", ["Speaker 1:"]),
    ("al_tags", "[inaudible] [laughs] [hum]", ["[laughs]", "[hum]"]), ("al_qa_labels", "Q: why", ["Q:"]), ("al_contractions", "ain't OK", ["ain't", "OK"]), ("al_numbers", "5 men .5", [".5", "5"]), ("al_format", "a — 10:11:12", ["—", "10:11:12"]),
    ("ccsl_timecode", "01:12:04 01:02:03:04", ["01:12:04"]), ("ccsl_frame_range", "01:02:03:30", ["01:02:03:30"]), ("ccsl_inout_order", "00:00:05:00 00:00:04:23", ["00:00:05:00 -> 00:00:04:23"]), ("ccsl_inout_order", "00:00:04:23 00:00:05:00", []),
    ("ccsl_speaker_case", "Maria: hi", ["Maria:"]), ("ccsl_speaker_case", "MARIA: hi", []), ("ccsl_scene_heading", "Int. house", ["Int. house"]), ("ccsl_speaker_mode", "(ON) (XX)", ["(XX)"]), ("ccsl_sound_prefix", "music: low", ["music:"]),
]


@pytest.fixture(scope="module")
def fired(spark):
    """All cases at once: evidence by case, in the order of rules and places."""
    docs = spark.createDataFrame([(i, t, "en") for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string, lang string")
    out = {}
    by = {}
    for i, (name, _, _) in enumerate(CASES):
        by.setdefault(name, []).append(i)
    for name, ids in by.items():
        rows = rules.flags(docs.where(F.col("doc_id").isin(ids)), [ALL[name]]).collect()
        for i in ids:
            out[i] = [r["evidence"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["ord"])]
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{n}-{i}" for i, (n, _, _) in enumerate(CASES)])
def test_fires(fired, i):
    assert fired[i] == CASES[i][2]


def test_every_scanner_has_a_case():
    assert set(ALL) - {c[0] for c in CASES} <= {"terminal_punctuation", "legal_spacing", "legal_slang", "legal_contractions", "qt_lists", "qt_runons", "scribie_spelled_names", "al_spelling", "latin_leak_devanagari"}


def test_document_gates(spark):
    docs = spark.createDataFrame([(1, "a line\nanother.", "en"), (2, "no ends\nat all", "en"), (3, "- one\n- two", "en"), (4, "- one", "en")], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["line"]) for r in rules.flags(docs, [packs.TERMINAL]).collect()}
    assert got == {(1, 1)}
    assert {(r["doc_id"], r["line"]) for r in rules.flags(docs, [ALL["qt_lists"]]).collect()} == {(3, 1), (3, 2)}


def test_short_abbreviation_needs_a_digit_outside_english(spark):
    docs = spark.createDataFrame([(1, "er nahm IU ein", "de"), (2, "er nahm 5 IU ein", "de"), (3, "er nahm IU ein", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in rules.flags(docs, [ALL["dangerous_abbreviations"]]).collect()} == {2, 3}


def test_grade_ladder(spark):
    docs = spark.createDataFrame([(i,) for i in range(7)], "doc_id long")
    f = [(1, "review"), (2, "moderate"), *[(3, "moderate")] * 2, *[(4, "moderate")] * 4, (5, "critical"), *[(6, "critical")] * 2]
    rows = rules.grade(docs, spark.createDataFrame(f, "doc_id long, severity string")).collect()
    assert "".join(r["grade"] for r in sorted(rows, key=lambda r: r["doc_id"])) == "ABBCDDF"


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
    assert rules.flags(docs, compose.compose("en", "legal", "rev")).count() == 0
    assert {r["grade"] for r in rules.grade(docs, rules.flags(docs, [packs.SPACING])).collect()} == {"A"}


def test_line_rules_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    plan = rules.flags(docs, compose.compose("en", "legal"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_compose_and_coverage(spark):
    names = [s.name for s in compose.compose("en-US", "legal", "rev")]
    assert len(names) == len(set(names)) and {"timestamps", "legal_terms", "legal_slang", "rev_tags", "personal_apostrophes"} <= set(names)
    assert "legal_slang" not in [s.name for s in compose.compose("fr", "legal")]
    grid = {(r["lang"], r["name"]): r["covered"] for r in compose.coverage(spark).collect()}
    assert grid["en", "legal"] == "full" and grid["fr", "legal"] == "core" and grid["fr", "rev"] == "none"
    gaps = compose.manifest_gaps(spark, spark.createDataFrame([("site", "rev")], "axis string, name string"))
    assert gaps.where("axis = 'site' AND name = 'rev'").count() == 0 and gaps.where("axis = 'site' AND name = 'scribie'").count() == 1


def test_line_ends(spark):
    from quillmark.operators.lines import split_lines

    docs = spark.createDataFrame([(1, "a\r\nb\x0bc\u2028d\n"), (2, None), (3, "\n\n")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n"], r["line"]) for r in split_lines(docs).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (3, 1, ""), (3, 2, "")]
