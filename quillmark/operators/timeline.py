"""Speaker timelines: turns(clip_id, source, start, end, speaker) and segments(clip_id, start, end).

A recording's turns are bounded by its length, so everything groups by clip_id; clips are many and spread.
Times are seconds as doubles; sample points are whole multiples of STEP from the clip's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 0.5
# Slack after a turn's end; the shortest speech that can be missed, and the share of it that must be covered.
SLACK, SHORTEST, COVERED = 0.01, 0.8, 0.5


def speaker_at(points: DataFrame, turns: DataFrame) -> DataFrame:
    """points(clip_id, t, ...) with speaker: the first turn that holds t, else the last one that began before, in list order (ord)."""
    spoken = turns.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "speaker"))).alias("turns"))
    holds = F.expr(f"filter(turns, x -> x.start <= t AND t <= coalesce(x.end, x.start) + {SLACK})")
    before = F.expr("filter(turns, x -> x.start <= t)")
    speaker = F.when(F.size(holds) > 0, F.get(holds, 0)["speaker"]).when(F.size(before) > 0, F.element_at(before, -1)["speaker"])
    return points.join(spoken, "clip_id", "left").withColumn("speaker", speaker).drop("turns")


def grid(turns: DataFrame, step: float = STEP) -> DataFrame:
    """(clip_id, t): the sample points of each clip, from its first start to its last end."""
    span = turns.groupBy("clip_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    return span.select("clip_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int"))).alias("k"), "lo").select("clip_id", "k", (F.col("lo") + F.col("k") * step).alias("t"))


def _sampled(ref: DataFrame, other: DataFrame, step: float) -> DataFrame:
    points = grid(ref.select("clip_id", "start", "end").unionByName(other.select("clip_id", "start", "end")), step)
    return speaker_at(speaker_at(points, ref).withColumnRenamed("speaker", "r"), other).withColumnRenamed("speaker", "h").where("r IS NOT NULL AND h IS NOT NULL")


def map_ids(ref: DataFrame, other: DataFrame, step: float = STEP) -> DataFrame:
    """(clip_id, h, mapped): each other speaker's majority reference speaker; of ties the one seen first."""
    votes = _sampled(ref, other, step).groupBy("clip_id", "h", "r").agg(F.count(F.lit(1)).alias("votes"), F.min("k").alias("seen"))
    return votes.groupBy("clip_id", "h").agg(F.max_by("r", F.struct("votes", -F.col("seen"))).alias("mapped"))


def agreement(ref: DataFrame, hyp: DataFrame, step: float = STEP) -> DataFrame:
    """(clip_id, same, total, agreement_pct): sample points where both have speech and the mapped speakers agree."""
    both = _sampled(ref, hyp, step).join(map_ids(ref, hyp, step), ["clip_id", "h"], "left")
    per = both.groupBy("clip_id").agg(F.count_if(F.coalesce("mapped", "h") == F.col("r")).alias("same"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("agreement_pct", F.round(100 * F.col("same") / F.col("total"), 1))


def apply_reference_speakers(turns: DataFrame, reference: DataFrame) -> DataFrame:
    """turns with the reference's speaker at each midpoint, where it has one."""
    points = turns.withColumn("t", (F.col("start") + F.coalesce("end", "start")) / 2).withColumnRenamed("speaker", "own")
    return speaker_at(points, reference).withColumn("speaker", F.coalesce("speaker", "own")).drop("own", "t")


def cross_consensus(ref: DataFrame, others: dict[str, DataFrame], step: float = STEP) -> DataFrame:
    """Reference turns with every source's mapped speaker at the midpoint, and whether all are present and agree."""
    out = ref.withColumn("t", (F.col("start") + F.col("end")) / 2)
    same = F.lit(True)
    for name, turns in others.items():
        ids = map_ids(ref, turns, step).withColumnRenamed("h", "raw")
        held = out.withColumnRenamed("speaker", "_ref")
        held = speaker_at(held, turns).withColumnRenamed("speaker", "raw").withColumnRenamed("_ref", "speaker")
        out = held.join(ids, ["clip_id", "raw"], "left").withColumn(name, F.coalesce("mapped", "raw")).drop("raw", "mapped")
        same = same & F.coalesce(F.col(name) == F.col("speaker"), F.lit(False))
    return out.withColumn("agree", same).drop("t")


def verify_coverage(segments: DataFrame, utterances: DataFrame) -> DataFrame:
    """(clip_id, n_segments, n_uncovered, covered_pct): speech that the transcript has utterances for."""
    s = segments.where(F.col("end") - F.col("start") >= SHORTEST).select("clip_id", F.col("start").alias("s"), F.col("end").alias("e"))
    u = utterances.where("start IS NOT NULL AND end IS NOT NULL").select("clip_id", F.col("start").alias("us"), F.col("end").alias("ue"))
    hit = s.join(u, (s["clip_id"] == u["clip_id"]) & (u["us"] < s["e"]) & (u["ue"] > s["s"]), "left").drop(u["clip_id"])
    per = hit.groupBy("clip_id", "s", "e").agg(F.sum(F.when(F.col("us").isNull(), 0.0).otherwise(F.least("e", "ue") - F.greatest("s", "us"))).alias("ov"))
    long = F.col("e") - F.col("s")
    return per.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("ov") / long < COVERED).alias("n_uncovered"),
                                      F.round(100 * F.sum(F.least("ov", long)) / F.sum(long), 1).alias("covered_pct"))


def seam_owned(chunks: DataFrame, window: float, head: float = 0.5) -> DataFrame:
    """Utterances of overlapping chunks(clip_id, idx, offset, start, end, ...) on the file's clock, each kept by the chunk that owns its start."""
    own = (F.col("start") < window) & ((F.col("idx") == 0) | (F.col("start") >= head))
    return chunks.where(own).withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset"))


def fixed_chunks(clips: DataFrame, window: float, overlap: float) -> DataFrame:
    """(clip_id, idx, offset, end): windows of a length with an overlap over clips(clip_id, duration)."""
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - overlap) / (window - overlap))).cast("int")
    at = F.col("idx") * F.lit(window - overlap)
    return clips.select("clip_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).select("clip_id", "idx", at.alias("offset"), F.least(at + window, "duration").alias("end"))


def shot_buckets(shots: DataFrame, events: DataFrame) -> DataFrame:
    """events(clip_id, frame, ...) in the shot(clip_id, shot, f_in, f_out) whose half-open frame interval holds them."""
    e, s = events.alias("e"), shots.alias("s")
    return e.join(s, (F.col("e.clip_id") == F.col("s.clip_id")) & (F.col("e.frame") >= F.col("s.f_in")) & (F.col("e.frame") < F.col("s.f_out"))).select("e.*", "s.shot", "s.f_in", "s.f_out")
