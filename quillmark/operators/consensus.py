"""Voting over independent reads(clip_id, witness, lang, text) of the same recording.

A witness name may carry a rate ('scribe@0.65x'). Witnesses of one base model are a family, and families vote, not reads.
A clip has few reads, so pairs of reads within a clip are bounded by its panel; all joins are on clip_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.align import opcodes, ratio
from quillmark.functions.text import rejoined
from quillmark.plans.rules import java

# Families, measured reliability, and the floors of the gate.
FAMILIES = {"deepgram": "deepgram", "scribe": "elevenlabs", "gemini": "gemini", "hf": "whisper", "whisper": "whisper", "mms": "mms", "seamless": "seamless", "phowhisper": "phowhisper", "wav2vec2": "wav2vec2", "vaani": "vaani"}
RELIABILITY = {"scribe": 0.93, "gemini": 0.87, "whisper": 0.82, "hf": 0.77, "deepgram": 0.71, "seamless": 0.64, "mms": 0.63, "phowhisper": 0.80, "wav2vec2": 0.70}
UNKNOWN_RELIABILITY = 0.70
LEAST_FAMILIES, MOST_CONTESTED, MOST_CONTESTED_STRICT = 2, 0.10, 0.05
ROSTER = {"ja": ("deepgram", "scribe", "gemini", "whisper", "hf"), "ru": ("deepgram", "scribe", "hf", "gemini"), "uk": ("deepgram", "scribe"), "es": ("deepgram", "scribe", "hf", "gemini"), "en": ("deepgram", "scribe", "hf", "gemini"), "fr": ("deepgram", "scribe", "hf", "gemini"), "de": ("deepgram", "scribe", "hf", "gemini"), "pt": ("deepgram", "scribe", "hf", "gemini"), "tr": ("deepgram", "scribe", "hf", "gemini"), "ko": ("deepgram", "scribe", "gemini", "hf"), "vi": ("deepgram", "scribe", "gemini", "phowhisper"), "ar": ("deepgram", "scribe", "gemini", "hf", "wav2vec2", "mms"), "hi": ("vaani", "deepgram", "scribe", "gemini", "hf", "mms"), "ur": ("scribe", "gemini", "hf", "mms")}
CJK = "[぀-ヿ㐀-䶿一-鿿]"


def _dim(values: dict, column: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[column], default)


def base(witness: Column) -> Column:
    return F.split_part(witness, F.lit("@"), F.lit(1))


def family(witness: Column) -> Column:
    return _dim(FAMILIES, base(witness), base(witness))


def normalised(text: Column) -> Column:
    folded = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, java(r"[^\w\s']"), " "), java(r"\s+"), " "))


def words(text: Column) -> Column:
    """Tokens by blanks; characters of Han and Kana stand alone, wherever they are."""
    return F.regexp_extract_all(text, F.lit(java(rf"{CJK}|(?:(?!{CJK})\S)+")), F.lit(0))


def ordered(reads: DataFrame) -> DataFrame:
    """reads with ord, their order in the panel: their own, or else the witness's name."""
    return reads if "ord" in reads.columns else reads.withColumn("ord", F.col("witness"))


def cleaned(reads: DataFrame, reliability: DataFrame | None = None, annotations: bool = False) -> DataFrame:
    """Non-empty reads in panel order, without annotations in brackets unless they are wanted, with family, norm and reliability (a table (lang, witness, reliability) wins over the priors)."""
    text = F.coalesce("text", F.lit(""))
    text = F.trim(text if annotations else F.regexp_replace(text, r"[\(\[][^\)\]]{0,40}[\)\]]", " "))
    rows = ordered(reads).withColumn("text", text).where("text <> ''").withColumn("family", family(F.col("witness"))).withColumn("norm", normalised(F.col("text"))).withColumn("base", base(F.col("witness")))
    prior = _dim(RELIABILITY, F.col("base"), F.lit(UNKNOWN_RELIABILITY))
    if reliability is None:
        return rows.withColumn("rel", prior)
    own = reliability.select("lang", F.col("witness").alias("base"), F.col("reliability").alias("own"))
    return rows.join(own, ["lang", "base"], "left").withColumn("rel", F.coalesce("own", prior)).drop("own")


def family_agreement(reads: DataFrame) -> DataFrame:
    """(clip_id, norm, families): independent families behind each distinct text."""
    return cleaned(reads).groupBy("clip_id", "norm").agg(F.countDistinct("family").alias("families"))


def majority(reads: DataFrame) -> DataFrame:
    """(clip_id, majority): most families that agree on one text."""
    return family_agreement(reads).groupBy("clip_id").agg(F.max("families").alias("majority"))


def centrality(rows: DataFrame) -> DataFrame:
    """(clip_id, witness, distance): summed distance of each cleaned read to the clip's others."""
    a = rows.select("clip_id", F.col("witness").alias("wa"), F.col("norm").alias("na"))
    b = rows.select("clip_id", F.col("witness").alias("wb"), F.col("norm").alias("nb"))
    pairs = a.join(b, "clip_id").where("wa != wb").withColumn("d", 1 - ratio("na", "nb"))
    return rows.select("clip_id", "witness").join(pairs.groupBy("clip_id", F.col("wa").alias("witness")).agg(F.sum("d").alias("distance")), ["clip_id", "witness"], "left").na.fill(0.0, ["distance"])


def _nearest(rows: DataFrame) -> DataFrame:
    near = rows.join(centrality(rows), ["clip_id", "witness"])
    return near.groupBy("clip_id").agg(F.min(F.struct("distance", "ord", "witness", "text")).alias("m")).select("clip_id", "m.witness", "m.text")


def medoid(reads: DataFrame) -> DataFrame:
    """(clip_id, witness, text): the read that is nearest to the clip's others; of ties the first in the panel."""
    return _nearest(cleaned(reads))


def vote(reads: DataFrame) -> DataFrame:
    """(clip_id, text, by): the text of two families or more, of ties the one read first, else the medoid's. Annotations are part of a text here."""
    rows = cleaned(reads, annotations=True)
    top = rows.groupBy("clip_id", "norm").agg(F.countDistinct("family").alias("n"), F.min(F.struct("ord", "witness", "text")).alias("r"))
    best = top.groupBy("clip_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "r")).alias("b")).select("clip_id", (-F.col("b.n")).alias("n"), F.col("b.r.text").alias("agreed"))
    mid = _nearest(rows).select("clip_id", "text")
    return best.join(mid, "clip_id").select("clip_id", F.when(F.col("n") >= 2, F.col("agreed")).otherwise(F.col("text")).alias("text"), F.when(F.col("n") >= 2, "family").otherwise("medoid").alias("by"))


def votes(reads: DataFrame, reliability: DataFrame | None = None) -> DataFrame:
    """(clip_id, i, backbone, word, surface, families, rel): every candidate word at every place of the anchor read.

    The anchor is the most reliable read, of ties the most central. Equal tokens and one-for-one replacements vote; other
    differences leave the anchor as it is.
    """
    rows = cleaned(reads, reliability)
    ranked = rows.join(centrality(rows), ["clip_id", "witness"])
    anchor = ranked.groupBy("clip_id").agg(F.max_by(F.struct("witness", "text", "family", "rel"), F.struct("rel", -F.col("distance"), "witness")).alias("a")).select("clip_id", F.col("a.witness").alias("aw"), words(F.col("a.text")).alias("at"), F.col("a.family").alias("af"), F.col("a.rel").alias("ar"))
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    others = rows.join(anchor, "clip_id").where("witness != aw").withColumn("ot", words(F.col("text"))).withColumn("ops", opcodes(low("at"), low("ot")))
    cast = others.select("clip_id", "family", "rel", "at", "ot", F.explode("ops").alias("o")).where("o.op = 'equal' OR (o.op = 'replace' AND o.i2 - o.i1 = o.j2 - o.j1)")
    cast = cast.select("clip_id", "family", "rel", "at", "ot", "o", F.explode(F.sequence(F.lit(0), F.col("o.i2") - F.col("o.i1") - 1)).alias("k"))
    cast = cast.select("clip_id", (F.col("o.i1") + F.col("k")).alias("i"), F.get("at", F.col("o.i1") + F.col("k")).alias("backbone"), F.get("ot", F.col("o.j1") + F.col("k")).alias("surface"), "family", "rel")
    own = anchor.select("clip_id", F.posexplode("at").alias("i", "backbone"), F.col("af").alias("family"), F.col("ar").alias("rel")).select("clip_id", "i", "backbone", F.col("backbone").alias("surface"), "family", "rel")
    cast = own.unionByName(cast).withColumn("word", F.lower("surface"))
    return cast.groupBy("clip_id", "i", F.lower("backbone").alias("backbone"), "word").agg(F.countDistinct("family").alias("families"), F.max("rel").alias("rel"), F.max_by("surface", "rel").alias("surface"))


def consensus_tokens(reads: DataFrame, lexicon: DataFrame | None = None, reliability: DataFrame | None = None) -> DataFrame:
    """(clip_id, text, tokens, contested, changed): the anchor with each word decided.

    A backbone word in the lexicon stays. Else a larger majority of two families or more wins, else a more reliable candidate. Candidates
    outside the lexicon are left out while others are in it. lexicon: (word); without one every word counts as unknown.
    """
    cast = votes(reads, reliability)
    known = lexicon.select(F.lower("word").alias("word")).distinct().withColumn("known", F.lit(True)) if lexicon is not None else None
    cast = cast.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False))) if known is not None else cast.withColumn("known", F.lit(False))
    place = cast.groupBy("clip_id", "i", "backbone").agg(F.collect_list(F.struct("families", "rel", "word", "surface", "known")).alias("c"))
    place = place.withColumn("alive", F.expr("CASE WHEN exists(c, x -> x.known) THEN filter(c, x -> x.known) ELSE c END"))
    place = place.withColumn("own", F.get(F.expr("filter(c, x -> x.word = backbone)"), 0)).withColumn("stands", F.expr("exists(alive, x -> x.word = backbone)"))
    top = F.array_max("alive")  # most families, then most reliable
    alone = F.size(F.expr("filter(alive, x -> x.families = array_max(alive).families)")) == 1
    trusted = F.expr("array_max(transform(alive, x -> struct(x.rel, x.families, x.word, x.surface, x.known)))")
    winner = (F.when(F.size("c") == 1, F.col("own.surface"))
              .when(~F.col("stands"), F.when(alone & (top["families"] >= 2), top["surface"]).otherwise(trusted["surface"]))
              .when(F.col("own.known"), F.col("own.surface"))
              .when((top["word"] != F.col("backbone")) & (top["families"] > F.col("own.families")) & (top["families"] >= 2), top["surface"])
              .when((trusted["word"] != F.col("backbone")) & (trusted["rel"] > F.col("own.rel")), trusted["surface"])
              .otherwise(F.col("own.surface")))
    decided = place.withColumn("winner", winner).withColumn("contested", (F.size("c") > 1) & (F.lower("winner") == F.col("backbone"))).withColumn("changed", (F.size("c") > 1) & (F.lower("winner") != F.col("backbone")))
    whole = decided.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "winner"))).alias("t"), F.count(F.lit(1)).alias("tokens"), F.count_if("contested").alias("contested"), F.count_if("changed").alias("changed"))
    lone = cleaned(reads).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("only")).where("n = 1").select("clip_id", "only")  # returned as it is read
    return whole.join(lone, "clip_id", "left").select("clip_id", F.coalesce("only", F.when(F.exists("t.winner", lambda w: w.rlike(CJK)), rejoined(F.col("t.winner"))).otherwise(F.array_join("t.winner", " "))).alias("text"), "tokens", "contested", "changed")


def gate(reads: DataFrame, decided: DataFrame, health: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(clip_id, status, contested_ratio, families, reasons): review where a rostered witness failed, too few families read, or too much is contested.

    decided: (clip_id, tokens, contested); health: (clip_id, lang, witness, status).
    """
    fams = cleaned(reads).groupBy("clip_id").agg(F.countDistinct("family").alias("families"))
    rows = fams.join(decided, "clip_id", "left")
    if health is not None:
        roster = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in ROSTER.items() for x in kv))
        dead = health.where("status = 'error'").where(F.array_contains(roster[F.col("lang")], F.col("witness"))).groupBy("clip_id").agg(F.array_sort(F.collect_set("witness")).alias("dead"))
        rows = rows.join(dead, "clip_id", "left")
    else:
        rows = rows.withColumn("dead", F.lit(None).cast("array<string>"))
    share = F.coalesce(F.col("contested"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.col("tokens"), F.lit(0)))
    cap = MOST_CONTESTED_STRICT if strict else MOST_CONTESTED
    why = F.array_compact(F.array(F.when(F.size(F.coalesce("dead", F.array().cast("array<string>"))) > 0, F.concat(F.lit("dead:"), F.array_join("dead", ","))), F.when(F.col("families") < LEAST_FAMILIES, F.lit("families")), F.when(share > cap, F.lit("contested"))))
    return rows.select("clip_id", F.when(F.size(why) > 0, "review").otherwise("pass").alias("status"), F.round(share, 3).alias("contested_ratio"), "families", why.alias("reasons"))


def needs_slow(reads: DataFrame, strict: bool = False) -> DataFrame:
    """(clip_id, needs_slow): whether slowed reads are wanted."""
    return majority(reads).select("clip_id", (F.lit(strict) | (F.col("majority") < 2)).alias("needs_slow"))


def agreement_pct(reads: DataFrame) -> DataFrame:
    """(clip_id, base, other, agreement_pct): tokens on which the medoid and its nearest other read agree, in whole percent."""
    rows = cleaned(reads)
    rows = rows.select("clip_id", "witness", "text", "norm")
    mid = rows.join(centrality(rows), ["clip_id", "witness"]).groupBy("clip_id").agg(F.min(F.struct("distance", "witness", "text", "norm")).alias("m")).select("clip_id", F.col("m.witness").alias("base"), F.col("m.text").alias("bt"), F.col("m.norm").alias("bn"))
    near = rows.join(mid, "clip_id").where("witness != base").withColumn("d", 1 - ratio("bn", "norm"))
    near = near.groupBy("clip_id", "base", "bt").agg(F.min(F.struct("d", "witness", "text")).alias("o")).select("clip_id", "base", "bt", F.col("o.witness").alias("other"), F.col("o.text").alias("ot"))
    ops = near.withColumn("ops", opcodes(words(F.col("ot")), words(F.col("bt"))))
    same = F.expr("aggregate(filter(ops, x -> x.op = 'equal'), 0, (s, x) -> s + x.i2 - x.i1)")
    differ = F.expr("aggregate(filter(ops, x -> x.op != 'equal'), 0, (s, x) -> s + greatest(x.i2 - x.i1, x.j2 - x.j1))")
    return ops.select("clip_id", "base", "other", F.floor(100 * same / F.greatest(same + differ, F.lit(1))).cast("int").alias("agreement_pct"))


def synthetic_reads(docs: DataFrame, every: int = 7) -> DataFrame:
    """Four witnesses' reads of texts: each alters words that its own rule picks, so that votes have something to do."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    out = None
    for w, (name, shift) in enumerate((("scribe", 3), ("gemini", 5), ("whisper", 1), ("hf", 2))):
        alter = F.transform(parts, lambda x, i: F.when((i + F.col("doc_id") + shift) % (every + w) == 0, F.concat(F.substring(x, 1, 1), F.lit("q"))).otherwise(x))
        r = docs.select(F.col("doc_id").alias("clip_id"), F.lit(name).alias("witness"), "lang", F.array_join(alter, " ").alias("text"))
        out = r if out is None else out.unionByName(r)
    return out
