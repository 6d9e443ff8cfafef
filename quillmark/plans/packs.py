"""Rule packs: what each style guide checks. Patterns are fixed values, as they must be for equal results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.plans import words as W
from quillmark.plans.rules import Pack, Rule, Scanner, java


def _s(name: str, *rules: Rule) -> Scanner:
    return Scanner(name, rules)


def _line(rule: str, severity: str, condition, evidence, **more) -> Rule:
    """One flag for a line that meets a condition."""
    return Rule(rule, severity, find=lambda: F.when(condition(), F.array(evidence().cast("string"))), **more)


def _not(values):
    return lambda x: ~F.lower(x).isin(*values)


def trim(x):
    return F.trim(x)


def _always(word: str):
    return lambda x: F.lit(word)


def _full(pattern: str):
    return lambda x: ~x.rlike(java(f"^(?:{pattern})$"))


# ---- base pack: mechanical checks of any transcript

# White space of all kinds, as a strip of Unicode text takes it.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def stripped(column: str, left: bool = True):
    """A column without white space at its ends, or only at its right end."""
    return F.regexp_replace(column, (rf"^{_BLANK}+|" if left else "") + rf"{_BLANK}+\z", "")


def stripped_sql(column: str, left: bool = True) -> str:
    right = f"regexp_replace({column}, '{_BLANK}+$', '')"
    return f"regexp_replace({right}, '^{_BLANK}+', '')" if left else right


TIMESTAMPS = _s("timestamps", Rule("timestamps", "moderate", r"[\[\(]\s*\d{1,2}:\d{2}(?::\d{2})?\s*[\]\)]", keep=_full(r"\[\d{2}:\d{2}:\d{2}\]"),
    sql=r"list_filter(regexp_extract_all(text, '[\[\(]\s*\d{1,2}:\d{2}(?::\d{2})?\s*[\]\)]'), lambda x: NOT regexp_full_match(x, '\[\d{2}:\d{2}:\d{2}\]'))"))
SPEAKER_LABELS = _s("speaker_labels", Rule("speaker_labels", "moderate", r"^\s*[^:]{1,40}?:\s", first=True, keep=lambda x: F.trim(x).contains("?") & ~F.trim(x).startswith("?"), evidence=trim,
    sql=r"list_filter([trim(regexp_extract(text, '^\s*[^:]{1,40}?:\s'))], lambda x: contains(x, '?') AND NOT starts_with(x, '?'))"))
INAUDIBLE = _s("inaudible", Rule("inaudible", "moderate", r"\[\s*(?:in[\s-]?aud\w*|un[\s-]?intel\w*|inaudable|unintelligable|unintellligible)[^\]]*\]", fold=True, keep=_full(r"\[(inaudible|unintelligible)\s+\d{2}:\d{2}:\d{2}\]"),
    sql=r"list_filter(regexp_extract_all(text, '(?i)\[\s*(?:in[\s-]?aud\w*|un[\s-]?intel\w*|inaudable|unintelligable|unintellligible)[^\]]*\]'), lambda x: NOT regexp_full_match(x, '\[(inaudible|unintelligible)\s+\d{2}:\d{2}:\d{2}\]'))"))
FILLERS = _s("fillers",
    Rule("fillers", "minor", r"\b(um+|uh+|erm+|uh[-\s]?huh|you know|i mean|kind of|sort of)\b", "body", fold=True, mode="clean_verbatim"),
    Rule("fillers", "minor", r"(?<![ぁ-ん])" + W.any_of(W.CASUAL_KANA) + r"(?![ぁ-ん])", "body", mode="clean_verbatim", absent=True),
    Rule("fillers", "minor", r"(?<![ぁ-ん])(なんか|まぁ|まあ)(?![ぁ-ん])", "body", mode="clean_verbatim", absent=True))
SPACING = _s("spacing",
    _line("spacing", "minor", lambda: stripped("text").contains("  ") | stripped("text").contains("　　"), lambda: F.lit("  …  "), sql=f"CASE WHEN contains({stripped_sql('raw')}, '  ') OR contains({stripped_sql('raw')}, '　　') THEN ['  …  '] END"),
    Rule("spacing", "minor", r"\S[ 　]+[,.;:?!、。？！」』）]", first=True, sql=r"CASE WHEN regexp_matches(text, '\S +[,.;:?!]') THEN [regexp_extract(text, '\S +[,.;:?!]')] END"))
EXCLAMATION = _s("no_exclamation", _line("no_exclamation", "moderate", lambda: F.col("text").rlike("[!！]"), lambda: F.lit("! / ！"), sql="CASE WHEN regexp_matches(text, '[!！]') THEN ['! / ！'] END"))
_BODY = stripped_sql(r"regexp_replace(raw, '^\s*[^:]{1,40}?:\s', '')", left=False)
TERMINAL = _s("terminal_punctuation", _line("terminal_punctuation", "minor",
    lambda: F.col("has_terminal") & (stripped("body", left=False) != "") & ~stripped("body", left=False).rlike("(?:--|\\]|-|[。？」』）】〕.?])$"),
    lambda: F.concat(F.lit("…"), F.right(stripped("body", left=False), F.lit(8))),
    sql=rf"CASE WHEN has_terminal AND {_BODY} <> '' AND NOT regexp_matches({_BODY}, '(--|\]|-|[。？」』）】〕.?])$') THEN ['…' || substr({_BODY}, greatest(length({_BODY}) - 7, 1), 8)] END"))
PARAGRAPH = _s("paragraph_length", _line("paragraph_length", "minor", lambda: F.length(stripped("text")) > 250, lambda: F.concat(F.length(stripped("text")).cast("string"), F.lit(" chars")),
    sql=f"CASE WHEN length({stripped_sql('raw')}) > 250 THEN [length({stripped_sql('raw')}) || ' chars'] END"))
ENGLISH_FORMAT = _s("en_format",
    *(Rule("slang", "moderate", rf"\b{w}\b", fold=True, first=True, evidence=_always(w), sql=f"CASE WHEN regexp_matches(text, '(?i)\\b{w}\\b') THEN ['{w}'] END") for w in (*W.SLANG_ENGLISH, *W.YES_FORMS)),
    Rule("okay", "moderate", r"\b(?:OK|Ok|okay)\b"),
    Rule("spelling", "moderate", r"\balright\b", fold=True, first=True, evidence=lambda x: F.lit("alright"), sql=r"CASE WHEN regexp_matches(text, '(?i)\balright\b') THEN ['alright'] END"),
    Rule("abbreviation", "moderate", r"\b(?:[A-Z]\.){2,}[A-Z]?\.?"),
    Rule("brackets", "moderate", r"\((?:laughs?|laughter|inaudible|unintelligible|crosstalk|applause|sighs?|coughs?|pause|silence)[^)]*\)", fold=True),
    Rule("mixed_punctuation", "moderate", r"[A-Za-z][。、！]", absent=True),
    Rule("numbers", "review", r"\b(?:eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million)\b", fold=True))
SOUND_EVENTS = _s("sound_event_format",
    Rule("sound_event", "moderate", r"[（(]\s*(?:laughs?|laughter|sighs?|coughs?|chuckles?|gasps?|applause|music|background noise|crosstalk|grunts?|scoffs?)\s*[)）]", fold=True),
    *(Rule("sound_event", "review", rf"(?<![ァ-ヶ]){k}[。、！]?", first=True, evidence=_always(k), absent=True) for k in W.VOCALISATIONS))
UNTRANSLATED = _s("untranslated_english", Rule("untranslated", "review", r"[ァ-ヶー]{7,}", absent=True))

BASE = (TIMESTAMPS, SPEAKER_LABELS, INAUDIBLE, FILLERS, SPACING, EXCLAMATION, TERMINAL, PARAGRAPH, ENGLISH_FORMAT, SOUND_EVENTS)

# ---- legal

_LEGAL_BODY = r"regexp_replace(raw, '^\s*(?:[A-Z][A-Z .''-]{0,38}|Q|A)\s{2,}|^\s*[^:]{1,40}?:\s', '')"
LEGAL_CORE = (
    _s("legal_tags",
        Rule("legal_tag", "moderate", r"\((?:inaudible|unintelligible)\)", fold=True),
        Rule("legal_tag", "moderate", r"\[(?:In|UN|Un)[a-z]*\]"),
        Rule("legal_tag", "moderate", r"\[\s*(?:inaudable|unintelligable|unintellligible|inadible)\s*\]", fold=True),
        Rule("legal_tag", "moderate", r"\((?:laughs?|laughter|crosstalk|applause|sighs?|coughs?|pause|silence|phonetic|sic)\)", fold=True)),
    _s("legal_spacing",
        _line("legal_spacing", "minor", lambda: stripped("body_legal").contains("  "), lambda: F.lit("  "), sql=f"CASE WHEN contains({stripped_sql(_LEGAL_BODY)}, '  ') THEN ['  '] END"),
        Rule("legal_spacing", "minor", r"\S +[,.;:?]", "legal", first=True, sql=r"""CASE WHEN regexp_matches(regexp_replace(raw, '^\s*(?:[A-Z][A-Z .''-]{0,38}|Q|A)\s{2,}|^\s*[^:]{1,40}?:\s', ''), '\S +[,.;:?]') THEN [regexp_extract(regexp_replace(raw, '^\s*(?:[A-Z][A-Z .''-]{0,38}|Q|A)\s{2,}|^\s*[^:]{1,40}?:\s', ''), '\S +[,.;:?]')] END""")),
    _s("legal_dash_form", Rule("legal_dash_form", "moderate", r"[—–]", "legal"),
        Rule("legal_dash_form", "moderate", r"\w\s+-\s*$", "legal", first=True, evidence=lambda x: F.expr("right(body_legal, 12)"), sql=r"""CASE WHEN regexp_matches(body_legal, '\w\s+-\s*$') THEN [right(body_legal, 12)] END""")),
    _s("legal_speaker_ids", Rule("legal_speaker_id", "moderate", r"^\s*((?:Mr|Ms|Mrs|Dr)\.\s+[A-Z][a-z]+|The\s+[A-Z][a-z]+):", first=True, group=1, evidence=lambda x: F.concat(x, F.lit(":")), sql=r"""CASE WHEN regexp_matches(text, '^\s*((?:Mr|Ms|Mrs|Dr)\.\s+[A-Z][a-z]+|The\s+[A-Z][a-z]+):') THEN [regexp_extract(text, '^\s*((?:Mr|Ms|Mrs|Dr)\.\s+[A-Z][a-z]+|The\s+[A-Z][a-z]+):', 1) || ':'] END""")),
    _s("legal_terms", Rule("legal_term", "moderate", r"\b" + W.longest_first(W.LEGAL_TERMS) + r"\b", fold=True)),
)
LEGAL_ENGLISH = (
    _s("legal_spelling", *(Rule("legal_spelling", "moderate", rx, fold=fold, sql=r"""list_filter(regexp_extract_all(text, '\bU\.S\.A?'), lambda x: x = 'U.S.')""" if "(?!" in rx else None) for rx, fold, _ in W.SPELLING_LEGAL),
        Rule("legal_spelling", "moderate", r"(?<=[a-z,;:\-]\s)Internet\b", sql=r"""list_transform(regexp_extract_all(text, '[a-z,;:\-]\sInternet\b'), lambda x: 'Internet')""")),
    _s("legal_slang", Rule("legal_slang", "moderate", r"\b" + W.any_of(W.SLANG_LEGAL) + r"\b", "legal", fold=True), Rule("legal_slang", "moderate", r"\bgoin'", "legal", fold=True), Rule("legal_slang", "moderate", r"'cause\b", "legal", fold=True)),
    _s("legal_contractions", Rule("legal_contraction", "moderate", r"\b(?:could|should|would)'ve\b", "legal", fold=True)),
    _s("legal_fillers", Rule("legal_filler", "moderate", r"\b(?:uh+|ah+|um+|er+|erm+)\b(?!-)", "legal", fold=True, sql=r"""list_filter(regexp_extract_all(body_legal, '(?i)\b(?:uh+|ah+|um+|er+|erm+)\b-?'), lambda x: x NOT LIKE '%-')""")),
    _s("legal_nonverbal", Rule("legal_nonverbal", "moderate", r"\bmm+[-\s]?h+m+\b", "legal", fold=True), Rule("legal_nonverbal", "moderate", r"\bm+h+m+\b", "legal", fold=True), Rule("legal_nonverbal", "moderate", r"\bmm+[-\s]?mm+\b", "legal", fold=True)),
    _s("legal_titles", Rule("legal_title", "moderate", r"\b(?:Mrs\.?|Miss)\s+[A-Z][a-z]+"),
        Rule("legal_title_caps", "moderate", rf"\b(?:{W.TITLES})\s+[A-Z][a-z]+", keep=lambda x: ~F.element_at(F.split(x, r"\s+"), -1).isin(*W.NOT_NAMES), evidence=lambda x: F.regexp_replace(x, r"\s+", " "),
             sql=rf"list_filter(regexp_extract_all(text, '\b(?:{W.TITLES})\s+[A-Z][a-z]+'), lambda x: string_split(x, ' ')[-1] NOT IN {W.NOT_NAMES})")),
    _s("legal_numbers", Rule("legal_number", "moderate", r"\d[\d,.]*\s?%", "legal"),
        Rule("legal_number", "review", r"\b(?:eleven|twelve|thir|four|fif|six|seven|eigh|nine)teen\b|\b(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)\b", "legal", fold=True)),
    _s("legal_accents", Rule("legal_accent", "moderate", r"\b\w*[^\x00-\x7F]\w*\b", keep=lambda x: x.rlike(r"[\p{L}&&[^\x00-\x7F]]") & (F.translate(x, W.ACCENTED, W.PLAIN) != x), sql=rf"""list_filter(regexp_extract_all(raw, '[\pL\pN_]*[^\x00-\x7F][\pL\pN_]*'), lambda x: translate(x, '{W.ACCENTED}', '{W.PLAIN}') <> x)""")),
    _s("legal_ampm", Rule("legal_ampm", "moderate", r"\b[ap]\.m\.", "legal", fold=True)),
    _s("legal_grammar", Rule("legal_grammar", "moderate", r"\b(?:could|should|would|must)\s+of\b", "legal", fold=True), Rule("legal_grammar", "moderate", rf"\byou're\s+(?:{W.OWNED})\b", "legal", fold=True),
        Rule("legal_grammar", "moderate", rf"\b(?:there|they're)\s+(?:{W.OWNED})\b", "legal", fold=True), Rule("legal_grammar", "moderate", rf"\bit's\s+(?:{W.OWNED})\b", "legal", fold=True), Rule("legal_grammar", "review", r"\btheir\s+(?:is|are|was|were)\b", "legal", fold=True)),
    _s("legal_oxford_comma", Rule("legal_oxford", "review", r"\b\w+,\s+\w+\s+(?:and|or)\s+\w+\b", "legal", sql=r"""regexp_extract_all(regexp_replace(raw, '^\s*(?:[A-Z][A-Z .''-]{0,38}|Q|A)\s{2,}|^\s*[^:]{1,40}?:\s', ''), '[\pL\pN_]+,\s+[\pL\pN_]+\s+(?:and|or)\s+[\pL\pN_]+')""")),
    _s("legal_comma_splice", Rule("legal_comma_splice", "review", r",\s+(?:this|that|these|those)\s+(?:is|are|was|were|should|would|will|can|could|do|does|did|have|has|had)\b", "legal", fold=True)),
    _s("legal_repeated_words", Rule("legal_repeat", "review", r"\b(\w{2,}(?:\s+\w+)?)\s+\1\b", "legal", fold=True, keep=lambda x: ~F.regexp_extract(F.lower(x), java(r"^(\w{2,}(?:\s+\w+)?)\s+\1$"), 1).isin("that", "had", "very", "no", "really"), no_sql=True)),
    _s("legal_partial_words", Rule("legal_partial_word", "review", r"\b[A-Za-z]{1,4}-\s+(?=\w)", "legal", evidence=trim, sql=r"""list_transform(regexp_extract_all(body_legal, '\b[A-Za-z]{1,4}-\s+\w'), lambda x: trim(x[:-2]))""")),
    _s("legal_money_numerals", Rule("legal_money", "moderate", rf"\b(?:{W.NUMBER_WORDS})(?:[ -](?:{W.NUMBER_WORDS}))*\s+(?:dollars?|euros?|pounds?)\b", "legal", fold=True)),
    _s("legal_decade_apostrophe", Rule("legal_decade", "moderate", r"\b(?:19|20)?\d0's\b", "legal")),
    _s("legal_date_commas", Rule("legal_date_comma", "moderate", rf"\b(?:{W.MONTHS}),\s+(?:19|20)\d{{2}}\b", "legal"), Rule("legal_date_comma", "review", rf"\b(?:{W.MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,\s+(?:19|20)\d{{2}}\s+[a-z]", "legal")),
    _s("legal_conjunction_comma", Rule("legal_conj_comma", "review", r"(?:^|[.!?]\s+)(?:So|And|But|Or),\s+(?![A-Z][a-z]+,)", "legal", evidence=trim, sql=r"""list_transform(list_filter(regexp_extract_all(body_legal, '(?:^|[.!?]\s+)(?:So|And|But|Or),\s+(?:[A-Z][a-z]+,)?'), lambda x: NOT regexp_matches(x, '[A-Z][a-z]+,$') OR regexp_matches(x, '^(?:[.!?]\s+)?(?:So|And|But|Or),\s*$')), lambda x: trim(x))""")),
    _s("legal_quote_punct", Rule("legal_quote_punct", "moderate", r'"[.,]', "legal")),
    _s("legal_spoken_punct", Rule("legal_spoken_punct", "review", r",\s*(?:comma|semicolon|full stop|open quote|close quote|quote unquote)\b[,.]?", "legal", fold=True)),
)

# ---- medical

_UNIT = r"(?:mg|ml|mcg|g|units?|l|iu|meq|mmol|%|gtt)"
_KEYS_CI = {k.upper(): k for k in W.DO_NOT_USE if len(k) >= 3}


def _abbreviations():
    """Letter runs (with digits behind) that are in the list: exact, without dots, or in any case from three letters on.

    A hit of two letters or less outside English counts only with a digit within eight characters, which the wrapped match shows.
    """
    known = F.create_map(*(F.lit(x) for k in W.DO_NOT_USE for x in (k, k)))
    folded = F.create_map(*(F.lit(x) for k, v in _KEYS_CI.items() for x in (k, v)))
    run = r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ỿµ][A-Za-zÀ-ÖØ-öø-ÿĀ-ỿµ.]*"
    hits = F.regexp_extract_all("text", F.lit(java(rf"{run}\d*")), F.lit(0))
    edge = "A-Za-zÀ-ÖØ-öø-ÿĀ-ỿµ."

    def near(x):
        """A digit within eight characters of the run."""
        word = F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
        return F.regexp_like("text", F.concat(F.lit(rf"\d.{{0,7}}(?<![{edge}])"), word, F.lit(rf"(?![{edge}])"))) | F.regexp_like("text", F.concat(F.lit(f"(?<![{edge}])"), word, F.lit(r".{0,7}\d")))

    def name(x):
        letters = F.regexp_replace(x, r"\d+$", "")
        plain = F.regexp_replace(letters, r"^\.+|\.+$", "")
        bare = F.replace(letters, F.lit("."), F.lit(""))
        return F.coalesce(
            F.when(x != letters, F.coalesce(known[x], F.when(folded[F.upper(F.replace(x, F.lit("."), F.lit("")))].isNotNull(), x))),
            known[letters], known[plain], known[bare], F.when(folded[F.upper(bare)].isNotNull(), letters))

    named = F.transform(hits, lambda x: F.struct(x.alias("run"), name(x).alias("name")))
    short = lambda s: F.length(F.replace(s["name"], F.lit("."), F.lit(""))) <= 2
    kept = F.filter(named, lambda s: s["name"].isNotNull() & (~short(s) | (F.col("lang") == "en") | near(s["run"])))
    return F.transform(kept, lambda s: s["name"])


MEDICAL = (
    _s("dangerous_abbreviations", Rule("med_dangerous_abbrev", "moderate", find=_abbreviations, no_sql=True)),
    _s("dosage_hygiene",
        Rule("med_dosage", "moderate", rf"\b\d+\.\d?0\s*{_UNIT}\b", fold=True, evidence=trim), Rule("med_dosage", "moderate", rf"(?<![\d.])\.\d+\s*{_UNIT}\b", fold=True, evidence=trim, sql=r"""regexp_extract_all(text, '(?i)(?:^|[^\d.])(\.\d+\s*(?:mg|ml|mcg|g|units?|l|iu|meq|mmol|%|gtt))\b', 1)"""),
        Rule("med_dosage", "moderate", rf"\b\d+,\d?0\s*{_UNIT}\b", fold=True, evidence=trim), Rule("med_dosage", "moderate", rf"(?<![\d,]),\d+\s*{_UNIT}\b", fold=True, evidence=trim, sql=r"""regexp_extract_all(text, '(?i)(?:^|[^\d,])(,\d+\s*(?:mg|ml|mcg|g|units?|l|iu|meq|mmol|%|gtt))\b', 1)"""),
        Rule("med_dosage", "moderate", r"\d\s*@\s*\d"), Rule("med_dosage", "moderate", r"\b[xX]\s?\d+\s?[dD]\b"), Rule("med_dosage", "moderate", r"\b\d{5,}\s*(?:units?|iu)\b", fold=True),
        Rule("med_dosage", "moderate", r"\d+\s*units?\s*/\s*\d+\s*units?\b", fold=True), Rule("med_dosage", "moderate", r"[<>]\s*\d+\s*(?:mg|kg|mmol|bpm|%)", fold=True)),
)

# ---- languages

_JP = r"[぀-ゟ゠-ヿ一-鿿々ー]"
_SCRIPTS = {"ar": r"[؀-ۿ]", "ur": r"[؀-ۿ]", "hi": r"[ऀ-ॿ]"}


def _latin_leak(script: str, native: str) -> Scanner:
    """Latin words in a line that is mostly of another script."""
    def find():
        n, latin = F.regexp_count("text", F.lit(native)), F.regexp_count("text", F.lit("[A-Za-z]"))
        return F.when((n >= 3) & (n > latin), F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)))

    return _s(f"latin_leak_{script}", Rule("latin_leak", "review", find=find, absent=True))


_TATWEEL = _s("tatweel", _line("tatweel", "minor", lambda: F.col("text").contains("ـ"), lambda: F.lit("ـ"), sql="CASE WHEN contains(text, 'ـ') THEN ['ـ'] END"))
_MIXED = _s("mixed_script", Rule("cyrillic_mixed_script", "moderate", r"[^\W\d_]+", keep=lambda x: x.rlike("[Ѐ-ӿ]") & x.rlike("[A-Za-z]"), absent=True))
APOSTROPHES = _s("personal_apostrophes", Rule("me_apostrophe", "moderate", r"\b" + W.any_of(W.APOSTROPHES) + r"\b", fold=True), Rule("me_apostrophe", "moderate", r"\b[Ii]m\b"), Rule("me_apostrophe", "review", r"\b(?:cant|wont)\b", fold=True))
LANGUAGES = {
    "fr": (_s("french_spacing", Rule("fr_spacing", "minor", r"[A-Za-zÀ-ÿ][;!?»]|[A-Za-zÀ-ÿ]:(?=\s|$)", sql=r"""list_transform(regexp_extract_all(raw, '[A-Za-zÀ-ÿ][;!?»]|[A-Za-zÀ-ÿ]:(?:\s|$)'), lambda x: trim(x))"""), Rule("fr_spacing", "minor", r"«[^\s]")),),
    "de": (_s("german_old_spelling", Rule("de_old_spelling", "minor", r"[A-Za-zÀ-ÿäöüßÄÖÜ]+", keep=lambda x: F.lower(x).isin(*W.GERMAN_OLD),
        sql="list_filter(regexp_extract_all(text, '[A-Za-zÀ-ÿäöüßÄÖÜ]+'), lambda x: lower(x) IN (" + ", ".join(f"'{w}'" for w in W.GERMAN_OLD) + "))")),),
    "pt": (_s("portuguese_cedilla", Rule("pt_cedilla", "minor", r".{0,2}ç(?=[eiéíêî]).{0,2}", fold=True, evidence=trim, sql=r"""list_transform(regexp_extract_all(raw, '(?i).{0,2}ç[eiéíêî].?'), lambda x: trim(x))""")),),
    "tr": (_s("turkish_foreign_letters", Rule("tr_foreign_letter", "review", r"\b[\wçğıöşüÇĞİÖŞÜ]*[qwxQWX][\wçğıöşüÇĞİÖŞÜ]*\b", sql=r"""regexp_extract_all(raw, '[\pL\pN_]*[qwxQWX][\pL\pN_]*')""")),),
    "vi": (_s("vietnamese_foreign_letters", Rule("vi_foreign_letter", "review", r"\b[^\W\d_]*[fjwzFJWZ][^\W\d_]*\b", keep=lambda x: F.length(x) >= 2, sql=r"""list_filter(regexp_extract_all(raw, '[\pL\pN_]+'), lambda x: length(x) >= 2 AND regexp_full_match(x, '\pL*[fjwzFJWZ]\pL*'))""")),),
    "ar": (_TATWEEL, _latin_leak("arabic", _SCRIPTS["ar"])), "ur": (_TATWEEL, _latin_leak("arabic", _SCRIPTS["ur"])), "hi": (_latin_leak("devanagari", _SCRIPTS["hi"]),),
    "ru": (_MIXED,), "uk": (_MIXED,),
    "ja": (_s("japanese_punctuation", Rule("ja_punct", "minor", _JP + r"\.", absent=True), Rule("ja_punct", "minor", _JP + ",", absent=True)),),
    "en": (APOSTROPHES,),
}

# ---- sites

_SPELLED = Rule("spelled", "moderate", r"\b[a-z]-(?:[a-z]-){1,}[a-z]\b")


def _named(rule: Rule, name: str) -> Rule:
    from dataclasses import replace

    return replace(rule, rule=name)


_LEGAL_LABELS = ("mr", "ms", "mrs", "dr", "miss", "mister", "madam", "sir", "judge", "justice", "officer", "detective", "sergeant", "lieutenant", "captain", "deputy", "attorney", "counsel", "counselor", "chief", "doctor", "professor", "investigator",
                 "the court", "the witness", "the clerk", "the bailiff", "the reporter", "the interpreter", "the defendant", "the plaintiff", "the foreperson", "the jury", "by mr", "by ms", "by mrs", "by the")
_inner = lambda x: F.lower(F.trim(F.regexp_extract(x, r"^[\[(]\s*(.*?)\s*[\])]$", 1)))
SITES = {
    "transcribeme": (
        _s("tm_sound_tags", Rule("tm_sound_tag", "moderate", r"\[\s*[a-zA-Z][a-zA-Z ]+?\s*\]", keep=lambda x: _inner(x).isin("laughs", "laughter", "applause", "sighs", "sigh", "cough", "sneeze", "music", "pause", "silence", "background noise", "noise", "chuckles", "clears throat", "clapping", "ringing"), sql=r"""list_filter(regexp_extract_all(text, '\[\s*[a-zA-Z][a-zA-Z ]+?\s*\]'), lambda x: lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))) IN ('laughs', 'laughter', 'applause', 'sighs', 'sigh', 'cough', 'sneeze', 'music', 'pause', 'silence', 'background noise', 'noise', 'chuckles', 'clears throat', 'clapping', 'ringing'))""")),
        _s("tm_lowercase_terms", Rule("tm_lowercase", "minor", r"\b[a-z]+ (Number|Page|Paragraph|Line)\b(?=\s+\d)", group=1, sql=r"""regexp_extract_all(text, '\b[a-z]+ (Number|Page|Paragraph|Line)\s+\d', 1)""")),
        _s("tm_speaker_caps", Rule("tm_speaker_caps", "moderate", r"^\s*([A-Za-z][A-Za-z .'\-]{0,37}?[A-Za-z])\s{2,}\S", first=True, group=1, evidence=trim,
            keep=lambda x: x.rlike("[a-z]") & F.lower(F.trim(x)).rlike("^(?:" + "|".join(_LEGAL_LABELS) + r")(?:$|[ .])"), sql=r"""list_filter([trim(regexp_extract(text, '^\s*([A-Za-z][A-Za-z .''\-]{0,37}?[A-Za-z])\s{2,}\S', 1))], lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(lower(x), '^(?:mr|ms|mrs|dr|miss|mister|madam|sir|judge|justice|officer|detective|the court|the witness)(?:$|[ .])'))""")),
        _s("tm_double_dash", Rule("tm_double_dash", "minor", r"(?<=\w) -- ", evidence=trim, sql=r"""list_transform(regexp_extract_all(text, '\w -- '), lambda x: '--')""")),
        _s("tm_spoken_punct", Rule("tm_spoken_punct", "moderate", no_sql=True, find=lambda: (lambda m: F.when(F.size(m) >= 2, F.transform(m, lambda x: F.regexp_extract(x, java(r"([a-z]+(?: stop)?)", True), 1))))(
            F.regexp_extract_all("text", F.lit(r"(?dU),\s*(?i:comma|semicolon|colon)\s*,|,\s*(?i:period|full stop|stop)\s*(?=\.|$|\s[A-Z])"), F.lit(0)))))),
    "rev": (
        _s("rev_tags",
            Rule("rev_tag", "moderate", r"\[[a-z][a-z ]{1,25}?(?:\s+\d{2}:\d{2}:\d{2})?\]", fold=True, keep=lambda x: _inner(x).isin("inaudible", "crosstalk", "foreign language", "phonetic"), sql=r"""list_filter(regexp_extract_all(text, '(?i)\[[a-z][a-z ]{1,25}?(?:\s+\d{2}:\d{2}:\d{2})?\]'), lambda x: lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))) IN ('inaudible', 'crosstalk', 'foreign language', 'phonetic'))"""),
            Rule("rev_tag", "review", r"\[[a-z][a-z ]{1,25}?(?:\s+\d{2}:\d{2}:\d{2})?\]", fold=True, keep=lambda x: ~F.regexp_replace(_inner(x), r"\s+\d{2}:\d{2}:\d{2}$", "").isin("inaudible", "crosstalk", "foreign language", "phonetic"), sql=r"""list_filter(regexp_extract_all(text, '(?i)\[[a-z][a-z ]{1,25}?(?:\s+\d{2}:\d{2}:\d{2})?\]'), lambda x: regexp_replace(lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))), '\s+\d{2}:\d{2}:\d{2}$', '') NOT IN ('inaudible', 'crosstalk', 'foreign language', 'phonetic'))"""),
            Rule("rev_tag", "review", r"\((?:laughter|chuckle|coughs|coughing|applause|clapping)\)", fold=True)),
        _s("rev_affirmative", Rule("rev_affirmative", "review", r"\b(?:Mm-hmm|Mm-mm|Uh-huh|Uh-uh)\b(?!\s*\((?:affirmative|negative)\))", fold=True, sql=r"""list_filter(regexp_extract_all(text, '(?i)\b(?:Mm-hmm|Mm-mm|Uh-huh|Uh-uh)\b(?:\s*\((?:affirmative|negative)\))?'), lambda x: x NOT LIKE '%)')""")),
        _s("rev_punctuation", Rule("rev_punct", "review", r".{0,8}(?:\.\.\.|…)(?=[^\s.\"']).{0,6}", sql=r"""list_filter(regexp_extract_all(raw, '.{0,8}(?:\.\.\.|…)[^\s."''].{0,5}'), lambda x: true)"""), Rule("rev_punct", "moderate", r"\w--(?:\s|$)", first=True, evidence=trim)),
        _s("rev_spelled_words", _named(_SPELLED, "rev_spelled")),
        _s("rev_informal_contractions", Rule("rev_contraction", "moderate", r"\b(?:gonna|wanna|gotta|kinda|sorta|'cause|cuz|doin'|goin'|'em)\b", fold=True, sql=r"""regexp_extract_all(text, '(?i)\b(?:gonna|wanna|gotta|kinda|sorta|''cause|cuz|doin''|goin''|''em)\b')""", keep=lambda x: F.col("mode") != "verbatim")),
    ),
    "scribie": (
        _s("scribie_tags", Rule("scribie_tag", "moderate", r"\[[a-z][a-z :\d-]{1,30}\]", fold=True, keep=lambda x: _inner(x).rlike("^(?:inaudible|indiscernible|crosstalk|phonetic|unintelligible)"), sql=r"""list_filter(regexp_extract_all(text, '(?i)\[[a-z][a-z :\d-]{1,30}\]'), lambda x: regexp_matches(lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))), '^(?:inaudible|indiscernible|crosstalk|phonetic|unintelligible)'))"""),
            Rule("scribie_tag", "review", r"\[[a-z][a-z :\d-]{1,30}\]", fold=True, keep=lambda x: ~_inner(x).isin("laughter", "chuckle") & ~_inner(x).rlike("^(?:inaudible|indiscernible|crosstalk|phonetic|unintelligible)"), sql=r"""list_filter(regexp_extract_all(text, '(?i)\[[a-z][a-z :\d-]{1,30}\]'), lambda x: NOT regexp_matches(lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))), '^(?:inaudible|indiscernible|crosstalk|phonetic|unintelligible)') AND lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))) NOT IN ('laughter', 'chuckle'))""")),
        _s("scribie_style", Rule("scribie_style", "moderate", r"\betc\.?(?=[\s,.]|$)", fold=True, sql=r"""list_transform(regexp_extract_all(text, '(?i)\b(etc\.?)(?:[\s,]|$)'), lambda x: rtrim(rtrim(x), ','))"""), Rule("scribie_style", "review", r"\b(?:[A-Za-z]\.){2,}(?![A-Za-z])", keep=_not(("i.e.", "e.g.", "a.m.", "p.m.", "u.s.", "a.d.", "b.c.")), sql=r"""list_filter(regexp_extract_all(text, '\b(?:[A-Za-z]\.){2,}[A-Za-z]?'), lambda x: x LIKE '%.' AND lower(x) NOT IN ('i.e.', 'e.g.', 'a.m.', 'p.m.', 'u.s.', 'a.d.', 'b.c.'))""")),
        _s("scribie_speakers", Rule("scribie_speaker", "review", r"^(?:interviewer|interviewee|respondent|person \d+|male|female)\s*:", fold=True, first=True)),
        _s("scribie_spelled_names", _named(_SPELLED, "scribie_spelled")),
    ),
    "quicktate": (
        _s("qt_unknown_words", Rule("qt_unknown", "moderate", r"\[(?:indiscernible|unintelligible|crosstalk)[^\]]*\]|____+", fold=True), Rule("qt_unknown", "review", r"(?<!\*)(?:\*{1,3}|\*{5,})(?!\*)", sql=r"""list_filter(regexp_extract_all(text, '\*+'), lambda x: length(x) <> 4)""")),
        _s("qt_spelled_words", Rule("qt_spelled", "moderate", r"\b(?:[A-Za-z][- ]){2,}[A-Za-z]\b")),
        _s("qt_speakers", Rule("qt_speaker", "review", r"^(?:Speaker\s*\d+|MALE\s*\d*|FEMALE\s*\d*|Interviewer|Interviewee)\s*:", fold=True, first=True)),
        _s("qt_lists", _line("qt_list", "review", lambda: (F.col("list_lines") >= 2) & F.col("text").rlike(java(r"^\s*(?:\d+[.)]|[-*•])\s+\S")), lambda: F.substring(F.trim("text"), 1, 30), sql=r"""CASE WHEN list_lines >= 2 AND regexp_matches(raw, '^\s*(?:\d+[.)]|[-*•])\s+\S') THEN [substr(trim(raw), 1, 30)] END""")),
        _s("qt_runons", _line("qt_runon", "review", lambda: (F.size(F.split(F.trim("text"), r"\s+")) > 60) & ~F.col("text").contains("."), lambda: F.concat(F.substring(F.trim("text"), 1, 50), F.lit("…")),
            sql=r"CASE WHEN len(regexp_split_to_array(trim(text), '\s+')) > 60 AND NOT contains(text, '.') THEN [substr(trim(text), 1, 50) || '…'] END")),
    ),
    "allegis": (
        _s("al_tags", Rule("al_tag", "moderate", r"\[[a-z][a-z .]{1,28}\]", fold=True, keep=lambda x: _inner(x).isin("sounds like", "crosstalk", "rd", "laughs", "laughing", "laughter", "indiscernible", "unintelligible", "phonetic"), sql=r"""list_filter(regexp_extract_all(text, '(?i)\[[a-z][a-z .]{1,28}\]'), lambda x: lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))) IN ('sounds like', 'crosstalk', 'rd', 'laughs', 'laughing', 'laughter', 'indiscernible', 'unintelligible', 'phonetic'))"""),
            Rule("al_tag", "review", r"\[[a-z][a-z .]{1,28}\]", fold=True, keep=lambda x: ~_inner(x).isin("inaudible", "ph", "sic", "no audible response.", "sounds like", "crosstalk", "rd", "laughs", "laughing", "laughter", "indiscernible", "unintelligible", "phonetic"), sql=r"""list_filter(regexp_extract_all(text, '(?i)\[[a-z][a-z .]{1,28}\]'), lambda x: lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))) NOT IN ('sounds like', 'crosstalk', 'rd', 'laughs', 'laughing', 'laughter', 'indiscernible', 'unintelligible', 'phonetic') AND lower(trim(regexp_extract(x, '^[\[(]\s*(.*?)\s*[\])]$', 1))) NOT IN ('inaudible', 'ph', 'sic', 'no audible response.'))""")),
        _s("al_qa_labels", Rule("al_qa", "review", r"^\s*(?:Q|A):\s", first=True, evidence=trim, sql=r"""list_filter([trim(regexp_extract(text, '^\s*(?:Q|A):\s'))], lambda x: x <> '')""")),
        _s("al_contractions", Rule("al_contraction", "moderate", r"\b(?:gonna|wanna|gotta|ain't|would've|could've|should've|'?cuz)\b", fold=True), Rule("al_spelling", "moderate", r"\bO[Kk]\b|\bm'?kay\b|\balright\b")),
        _s("al_numbers", Rule("al_number", "moderate", r"(?<![\d.])\.\d+\b", sql=r"""regexp_extract_all(text, '(?:^|[^\d.])(\.\d+)\b', 1)"""), Rule("al_number", "review", r"(?:^|[.!?]\s+)\d+\b", evidence=trim)),
        _s("al_format", Rule("al_dash", "moderate", r"[—–]", first=True), Rule("al_timestamp", "review", r"\[?\b\d{2}:\d{2}:\d{2}\b\]?")),
    ),
    "gotranscript": (ENGLISH_FORMAT,),
    "ubiqus": (), "typeitup": (), "smartcat": (), "unbabel": (), "proz": (),
}

# ---- continuity and spotting lists

_TC = r"\d{2}:\d{2}:\d{2}[:;]\d{2}"


def _frames(x):
    """Frames at 24 a second; drop-frame codes by their own count."""
    p = lambda i: F.regexp_extract(x, r"(\d{2}):(\d{2}):(\d{2})([:;])(\d{2})", i).cast("long")
    minutes = p(1) * 60 + p(2)
    drop = p(1) * 108000 + p(2) * 1800 + p(3) * 30 + p(5) - 2 * (minutes - F.floor(minutes / 10))
    return F.when(F.regexp_extract(x, r"([:;])\d{2}$", 1) == ";", drop).otherwise(((p(1) * 60 + p(2)) * 60 + p(3)) * 24 + p(5))


def _in_out():
    codes = F.regexp_extract_all("text", F.lit(_TC), F.lit(0))
    return F.when((F.size(codes) >= 2) & (_frames(F.get(codes, 1)) < _frames(F.get(codes, 0))), F.array(F.concat(F.get(codes, 0), F.lit(" -> "), F.get(codes, 1))))


def _label():
    return F.trim(F.regexp_extract("text", java(r"^\s*([^:]{1,40}?):\s"), 1))


CCSL = (
    _s("ccsl_timecode", Rule("ccsl_timecode", "critical", r"\d{1,2}:\d{2}(?:[:;]\d{2}){0,2}", keep=_full(_TC),
        sql=r"list_filter(regexp_extract_all(text, '\d{1,2}:\d{2}(?:[:;]\d{2}){0,2}'), lambda x: NOT regexp_full_match(x, '\d{2}:\d{2}:\d{2}[:;]\d{2}'))")),
    _s("ccsl_frame_range", Rule("ccsl_frame_range", "critical", _TC, keep=lambda x: F.substring(x, -2, 2).cast("int") >= 30,
        sql=r"list_filter(regexp_extract_all(text, '\d{2}:\d{2}:\d{2}[:;]\d{2}'), lambda x: CAST(right(x, 2) AS INT) >= 30)")),
    _s("ccsl_inout_order", Rule("ccsl_inout_order", "critical", find=_in_out, no_sql=True)),
    _s("ccsl_speaker_case", _line("ccsl_speaker_case", "moderate", lambda: (_label() != "") & ~F.lower(_label()).isin("music", "sfx") & (_label() != F.upper(_label())), lambda: F.concat(_label(), F.lit(":")), sql=r"""list_transform(list_filter([trim(regexp_extract(raw, '^\s*([^:]{1,40}?):\s', 1))], lambda x: x <> '' AND lower(x) NOT IN ('music', 'sfx') AND x <> upper(x)), lambda x: x || ':')""")),
    _s("ccsl_scene_heading", _line("ccsl_scene_heading", "moderate", lambda: F.col("text").rlike(java(r"^\s*(?:int|ext)\b\.?", True)) & (F.trim("text") != F.upper(F.trim("text"))), lambda: F.trim("text"), sql=r"""CASE WHEN regexp_matches(raw, '(?i)^\s*(?:int|ext)(?:[^\pL\pN_]|$)') AND trim(raw) <> upper(trim(raw)) THEN [trim(raw)] END""")),
    _s("ccsl_speaker_mode", Rule("ccsl_speaker_mode", "review", r"\([A-Za-z]{1,4}\)", keep=lambda x: ~F.upper(x).isin("(ON)", "(VO)", "(OS)", "(OFF)"),
        sql=r"list_filter(regexp_extract_all(text, '\([A-Za-z]{1,4}\)'), lambda x: upper(x) NOT IN ('(ON)', '(VO)', '(OS)', '(OFF)'))")),
    _s("ccsl_sound_prefix", Rule("ccsl_sound_prefix", "moderate", r"^\s*(music|sfx)\s*:", fold=True, first=True, group=1, keep=lambda x: x != F.upper(x), evidence=lambda x: F.concat(x, F.lit(":")), sql=r"""list_transform(list_filter([regexp_extract(text, '(?i)^\s*(music|sfx)\s*:', 1)], lambda x: x <> '' AND x <> upper(x)), lambda x: x || ':')""")),
)

PACKS = (
    Pack("domain", "base", BASE, description="mechanical checks of any transcript"),
    Pack("domain", "legal", LEGAL_CORE, (("en", LEGAL_ENGLISH),), "court and deposition style"),
    Pack("domain", "medical", MEDICAL, description="dangerous abbreviations and dosage"),
    Pack("domain", "ccsl", CCSL, description="continuity and spotting lists"),
    *(Pack("language", k, v) for k, v in LANGUAGES.items()),
    *(Pack("site", k, (), (("en", v),) if v else ()) for k, v in SITES.items()),
)
