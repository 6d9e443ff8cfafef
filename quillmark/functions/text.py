"""Text functions: folding of letters and scripts, languages by script, numbers written out.

Those that Spark's own functions can say are columns; the few that need Unicode normal forms or a number grammar are Arrow-batched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.plans.rules import java

# Letters by script; small kana that join the one before; punctuation at a word's edge; signs of kanji numerals.
SCRIPTS = {"ja": "[぀-ヿ一-鿿々〆ー]", "ko": "[가-힣]", "cyr": "[Ѐ-ӿ]", "ar": "[؀-ۿ]", "hi": "[ऀ-ॿ]", "en": "[A-Za-z]"}
CJK = "[぀-ヿ㐀-䶿一-鿿]"
SMALL_KANA = "ゃゅょゎァィゥェォャュョヮ"
EDGES = ".,!?;:'\"()[]«»„“”…-—"
KANJI_DIGITS, KANJI_SCALES = "〇一二三四五六七八九", {"十": 10, "百": 100, "千": 1000, "万": 10_000, "億": 100_000_000}
# Arabic-script folds (optional marks, seats of hamza, final letters), Urdu's letters, number words and their ordinals.
TASHKEEL = "".join(map(chr, [*range(0x64B, 0x653), 0x670, 0x640]))
ARABIC = ("أإآٱىة", "اااايه")
URDU = ("يكهأإآ", "یکہااا")
ARABIC_ORDINALS = {"اول": "واحد", "حادي": "واحد", "ثاني": "اثنا", "ثالث": "ثلاثه", "رابع": "اربعه", "خامس": "خمسه", "سادس": "سته", "سابع": "سبعه", "ثامن": "ثمانيه", "تاسع": "تسعه", "عاشر": "عشره", "اثني": "اثنا", "اثنين": "اثنا"}
ARABIC_NUMBERS = "عشر عشرون عشرين ثلاثون ثلاثين اربعون اربعين خمسون خمسين ستون ستين سبعون سبعين ثمانون ثمانين تسعون تسعين مائه مايه الف مليون مليار".split()
# Rule: katakana stand 0x60 above hiragana; decimal digits of other scripts run from their zero.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
DIGITS = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd")
PLAIN_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)


# ---- folding

@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Letters without their combining marks (canonical decomposition), composed again."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")))


@F.pandas_udf(StringType())
def ascii_folded(text: pd.Series) -> pd.Series:
    """The ASCII letters of the compatibility decomposition; a text without any stays as it is."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() or t)


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def clean_word(word: Column) -> Column:
    """Lower case, without punctuation at the edges and without the dot that a lowered İ leaves, composed."""
    edges = re.escape(EDGES)
    bare = F.regexp_replace(word, rf"^[{edges}]+|[{edges}]+$", "")
    return composed(F.replace(F.lower(bare), F.lit("̇"), F.lit("")))


def script_folded(text: Column, lang: Column) -> Column:
    """Spellings that sound alike made equal: decimal digits of all scripts; Arabic, Urdu and Hindi marks and letters; Arabic number words."""
    text = F.translate(text, DIGITS, PLAIN_DIGITS)
    hindi = composed(F.replace(F.replace(_decomposed(text), F.lit("़"), F.lit("")), F.lit("ँ"), F.lit("ं")))
    urdu = F.translate(F.translate(text, TASHKEEL, ""), *URDU)
    arabic = F.translate(F.translate(text, TASHKEEL, ""), *ARABIC)
    numbers = [*ARABIC_ORDINALS, *set(ARABIC_ORDINALS.values()), *ARABIC_NUMBERS]
    bare = F.transform(F.split(F.trim(arabic), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?،؛؟]+|[.,;:!?،؛؟]+$", ""))
    bare = F.transform(bare, lambda w: F.regexp_replace(w, rf"^(?:وال|ال|و)(?=(?:{'|'.join(numbers)})$)", ""))
    bare = F.transform(bare, lambda w: F.when(w.isin(*(n for n in ARABIC_NUMBERS if n.endswith("ين"))), F.regexp_replace(w, "ين$", "ون")).otherwise(w))
    ordinals = F.create_map(*(F.lit(x) for kv in ARABIC_ORDINALS.items() for x in kv))
    arabic = F.array_join(F.transform(bare, lambda w: F.coalesce(ordinals[w], w)), " ")
    return F.when(lang == "hi", hindi).when(lang == "ur", urdu).when(lang == "ar", arabic).otherwise(text)


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFD", t))


# ---- scripts without blanks

def space_stripped(text: Column) -> Column:
    """Text without the white space between two characters beyond ASCII."""
    return F.regexp_replace(text, r"(?<=[^\x00-\x7f])[\s\x1c-\x1f\x85\p{Z}]+(?=[^\x00-\x7f])", "")


def rejoined(tokens: Column) -> Column:
    """Tokens side by side, with a blank only between two ASCII letters or digits."""
    return F.regexp_replace(F.array_join(F.filter(tokens, lambda t: t != ""), " "), "(?<![A-Za-z0-9]) | (?![A-Za-z0-9])", "")


def hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def morae(reading: Column) -> Column:
    """Morae of a reading in hiragana: small kana belong to the one before."""
    return F.regexp_extract_all(hiragana(reading), F.lit(rf"(?s).[{SMALL_KANA}]*"), F.lit(0))


# ---- languages by script

def letters(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(SCRIPTS[script])).cast("long")


def script_of(char: Column) -> Column:
    """The script of one character, null for none of them."""
    out = F.lit(None).cast("string")
    for name, letter in reversed(SCRIPTS.items()):
        out = F.when(char.rlike(letter), name).otherwise(out)
    return out


def lang_of(text: Column) -> Column:
    """ja or en, whichever has more letters (ja of equal ones), or neutral."""
    ja, en = letters(text, "ja"), letters(text, "en")
    return F.when((ja > 0) & (ja >= en), "ja").when(en > 0, "en").otherwise("neutral")


def runs(text: Column) -> Column:
    """Array of (lang, run): where the script turns between Japanese and Latin; other characters belong to the run that they stand in."""
    j, e = SCRIPTS["ja"][1:-1], SCRIPTS["en"][1:-1]
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?:\A[^{j}{e}]+)?(?:[{j}][^{e}]*|[{e}][^{j}]*)|\A[^{j}{e}]+\z"), F.lit(0))
    kind = lambda r: F.when(r.rlike(SCRIPTS["ja"]), "ja").when(r.rlike(SCRIPTS["en"]), "en").otherwise("neutral")
    return F.transform(found, lambda r: F.struct(kind(r).alias("lang"), r.alias("run")))


# ---- numbers

def number_value(span: Column) -> Column:
    """The integer that a span of digits (of any script) or kanji numerals stands for, else null."""
    plain = F.translate(F.replace(span, F.lit("零"), F.lit("〇")), DIGITS, PLAIN_DIGITS)
    kanji = KANJI_DIGITS + "".join(KANJI_SCALES)
    digit = F.create_map(*(F.lit(x) for i, c in enumerate(KANJI_DIGITS) for x in (c, i)))
    scale = F.create_map(*(F.lit(x) for kv in KANJI_SCALES.items() for x in kv))
    big = "decimal(38,0)"
    zero = F.struct(F.lit(0).cast(big).alias("done"), F.lit(0).cast(big).alias("open"))

    def step(s, c):
        by = scale[c]
        scaled = s["done"] + F.when(s["open"] == 0, F.lit(1).cast(big)).otherwise(s["open"]) * by
        return F.struct(F.when(by.isNull(), s["done"]).otherwise(scaled).cast(big).alias("done"), F.when(by.isNull(), s["open"] * 10 + digit[c]).otherwise(0).cast(big).alias("open"))

    value = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), zero, step, lambda s: (s["done"] + s["open"]).cast(big))
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast(big)).when(plain.rlike(f"^[{kanji}]+$"), value)


_ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_ORDINALS = {"first": "one", "second": "two", "third": "three", "fifth": "five", "eighth": "eight", "ninth": "nine", "twelfth": "twelve", "twentieth": "twenty", "thirtieth": "thirty"} | {w + "th": w for w in ("four", "six", "seven", "ten", "eleven", "thirteen")}
_PLAIN = {*_ONES, *_TENS, *_SCALES, "hundred"}


def cardinal(words: list[str]) -> int | None:
    """The value of an English cardinal, or None if the words are not one as it is read out."""
    if words == ["zero"]:
        return 0
    total, group, below, before = 0, 0, 10**15, ""
    for k, w in enumerate(words):
        if w == "and":
            if before not in ("hundred", *_SCALES) or k + 1 == len(words):
                return None
        elif w == "hundred":
            if not 0 <= group <= 9 or (group == 0 and (total or k)):
                return None
            group = (group or 1) * 100
        elif w in _SCALES:
            if _SCALES[w] >= below or (group == 0 and k) or before == "and":
                return None
            total, group, below = total + (group or 1) * _SCALES[w], 0, _SCALES[w]
        else:
            n = _ONES.get(w, _TENS.get(w))
            room = group % 100
            if not n or (room and not (room >= 20 and room % 10 == 0 and n < 10)):
                return None
            group += n
        before = w
    return total + group


def canonical(text: str) -> str:
    """Lower-case text with numbers in digits: cardinals and ordinals that are written out, groups of thousands, amounts and shares.

    What is not cleanly a number stays: ranges, telephone numbers, decimals and years that are read in pairs.
    """
    s = text.lower().replace("%", " percent ").replace("$", " ")
    s = re.sub(r"\b\d{1,3}(?:,\d{3})+\b", lambda m: m[0].replace(",", ""), s)
    s = re.sub(r"\b(\d+)(?:st|nd|rd|th)\b", r"\1", s)
    words = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", s).split()
    plain = [w.strip(".,;:!?'") for w in words]
    plain = [_ORDINALS.get(w, w) for w in plain]
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and (plain[j] in _PLAIN or j > i and plain[j] == "and"):
            j += 1
        while j > i and plain[j - 1] == "and":
            j -= 1
        if j == i:
            out.append(words[i])
            i += 1
            continue
        scaled = [100 if w == "hundred" else _SCALES.get(w) for w in plain[i:j]]
        if out and re.fullmatch(r"\d+(?:\.\d+)?", out[-1]) and len(scaled) == 1 and scaled[0]:  # '47 million'
            whole, _, part = out[-1].partition(".")
            value = int(whole + part) * scaled[0]
            out[-1] = str(value // 10 ** len(part)) if value % 10 ** len(part) == 0 else str(value / 10 ** len(part))
        else:
            value = cardinal(plain[i:j])
            out += words[i:j] if value is None else [str(value)]
        i = j
    return " ".join(out)


@F.pandas_udf(StringType())
def number_canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda t: canonical(t or ""))
