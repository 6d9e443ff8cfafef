"""Recordings that are read in chunks: texts spliced at their seams, votes put back on utterances, speakers across chunks; why a witness failed.

A recording's chunks, utterances and turns are bounded by its length, so they are gathered by clip_id; clips are many and spread.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.align import opcodes

# Words at a seam that are looked at, and least words of an overlap; seconds between samples, and slack after a turn's end.
WINDOW, LEAST = 80, 4
STEP, SLACK = 0.5, 0.01


def overlap(left: list[str], right: list[str]) -> tuple[int, bool]:
    """(words of the right side that the left side has already, whether the seam is clean). Nothing of the left side is ever cut."""
    a, b = [w.lower() for w in left[-WINDOW:]], [w.lower() for w in right[:WINDOW]]
    for n in range(min(len(a), len(b)), LEAST - 1, -1):
        if a[-n:] == b[:n]:
            return n, True
    m = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
    return (m.size, True) if m.b == 0 and m.size >= LEAST else (0, not a or not b)


def spliced(chunks: DataFrame) -> DataFrame:
    """(clip_id, text, bad_seams) of chunks (clip_id, idx, text): words joined in order without what overlaps."""

    def join(key, rows):
        words, bad = [], 0
        for text in rows.sort_values("idx")["text"]:
            new = (text or "").split()
            n, clean = overlap(words, new)
            bad += not clean
            words += new[n:]
        return pd.DataFrame([(key[0], " ".join(words), bad)], columns=["clip_id", "text", "bad_seams"])

    return chunks.groupBy("clip_id").applyInPandas(join, "clip_id long, text string, bad_seams int")


def redistributed(utterances: DataFrame, texts: DataFrame) -> DataFrame:
    """utterances (clip_id, ord, text and others) with the words of texts (clip_id, text) that stand in their place; without any they keep their own."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    low = lambda c: F.transform(c, lambda w: F.lower(w))
    ranked = utterances.select("clip_id", "ord", F.posexplode(words(F.col("text"))).alias("k", "w")).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", "k", "w"))).alias("had"))
    both = ranked.join(texts.select("clip_id", words(F.col("text")).alias("new")), "clip_id").where("size(new) > 0")
    ops = both.withColumn("o", F.explode(opcodes(low(F.col("had.w")), low("new")))).where("o.op != 'delete' AND o.j2 > o.j1")
    placed = ops.select("clip_id", "had", "new", "o", F.explode(F.sequence(F.col("o.j1"), F.col("o.j2") - 1)).alias("j"))
    at = F.when(F.col("o.op") == "equal", F.col("o.i1") + F.col("j") - F.col("o.j1")).otherwise(F.least(F.col("o.i1"), F.size("had") - 1))
    placed = placed.select("clip_id", F.get("had", at.cast("int"))["ord"].alias("ord"), "j", F.get("new", F.col("j")).alias("w"))
    text = placed.groupBy("clip_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda x: x["w"]), " ").alias("_text"))
    return utterances.join(text, ["clip_id", "ord"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")


def _speaker(turns: list[tuple], t: float):
    """Of turns (start, end, speaker) in list order the first that holds t, else the last that began before it."""
    last = None
    for start, end, speaker in turns:
        if start <= t:
            if t <= end + SLACK:
                return speaker
            last = speaker
    return last


def merged_chunks(turns: DataFrame, overlap_s: float) -> DataFrame:
    """(clip_id, ord, start, end, speaker, text) of chunks' turns (clip_id, idx, offset, ord, start, end, speaker, text), already in the clip's time.

    At each seam the new chunk's speakers take the names that most sample points of the overlap give them, else one of their own; the turns before
    the overlap's middle come from the left side, those from it on from the right one.
    """

    def merge(key, rows):
        out: list[tuple] = []
        for _, part in rows.sort_values(["idx", "ord"], kind="stable").groupby("idx", sort=True):
            new = list(part[["start", "end", "speaker", "text"]].itertuples(index=False, name=None))
            if out:
                begin = float(part["offset"].iloc[0])
                votes: dict[str, dict[str, float]] = {}
                for k in range(int(overlap_s / STEP) + 1):
                    was, now = (_speaker([t[:3] for t in side], begin + k * STEP) for side in (out, new))
                    if was is not None and now is not None:
                        votes.setdefault(now, {})[was] = votes.get(now, {}).get(was, 0) + 1
                names = {s: max(v, key=v.get) for s, v in votes.items()}
                middle = begin + overlap_s / 2
                new = [(a, b, names.get(s, f"spk_{begin:.0f}_{s}"), x) for a, b, s, x in new if a >= middle]
                out = [t for t in out if t[0] < middle]
            out += new
        out.sort(key=lambda t: t[0])
        return pd.DataFrame([(key[0], i, *t) for i, t in enumerate(out)], columns=["clip_id", "ord", "start", "end", "speaker", "text"])

    return turns.groupBy("clip_id").applyInPandas(merge, "clip_id long, ord int, start double, end double, speaker string, text string")


def failure(code: Column, message: Column, kind: Column) -> Column:
    """Why a witness failed, by HTTP code, the answer's text and the kind of error, in the words that tell what to do."""
    spent = F.lower(F.coalesce(message, F.lit(""))).rlike("quota|credit")
    word = F.when(spent, " OUT OF CREDITS (quota exceeded)").when(code == 401, " bad key").when(code == 402, " OUT OF CREDITS").when(code == 429, " rate-limited").otherwise("")
    keyless = (kind == "runtime") & message.endswith("not found") | (kind == "file") & message.contains(".env")
    return F.when(code.isNotNull(), F.concat(F.lit("HTTP "), code.cast("string"), word)).when(kind == "network", "network").when(keyless, "no API key").otherwise(F.substring(message, 1, 120))


def adopted(slots: DataFrame, proposals: DataFrame, lexicon: DataFrame) -> DataFrame:
    """slots (slot_id, word) with the word that fresh reads put there, where they may: (slot_id, word, to).

    proposals (slot_id, word, family). Two families at least must propose one and the same word; it must differ, not be a fragment of
    the old one (half its length and three letters at least), be a known word, or else replace an unknown one. lexicon: (word).
    """
    fold = lambda c: F.regexp_replace(F.lower(c), r"^[.,;:!?'’،؛؟]+|[.,;:!?'’،؛؟]+$", "")
    known = lexicon.select(F.lower("word").alias("_w")).distinct()
    agreed = proposals.where(fold(F.col("word")) != "").groupBy("slot_id").agg(F.countDistinct("family").alias("families"), F.countDistinct(fold(F.col("word"))).alias("n"), F.min("word").alias("to"))
    rows = slots.join(agreed.where("families >= 2 AND n = 1"), "slot_id").withColumn("old", fold(F.col("word"))).withColumn("new", fold(F.col("to")))
    rows = rows.where((F.col("old") != F.col("new")) & (F.length("new") >= F.greatest(F.lit(3), F.floor(F.length("old") / 2))))
    has = lambda c, name: known.select(F.col("_w").alias(c), F.lit(True).alias(name))
    rows = rows.join(has("old", "was"), "old", "left").join(has("new", "is"), "new", "left")
    return rows.where("is OR was IS NULL").select("slot_id", "word", "to")
