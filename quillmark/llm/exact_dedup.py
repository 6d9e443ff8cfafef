"""Operator 10: exact dedup by skew-safe combining.

Texts are equal when they are identical after every character of [\\x20\\x09-\\x0D] is deleted. The normalised text itself
is a grouping key at each stage, so full content is compared, never a digest alone:

1. rows of one task with equal text are combined before anything is shuffled (partial aggregation);
2. the partial groups are merged per (digest, salt, text), where the salt comes from doc_id, so that a text held by a
   third of all rows meets in SALTS tasks;
3. the salt winners, SALTS per text at most, are merged per (digest, text).

The winner is carried as one number, code points * 2^64 + (2^63 - 1 - doc_id), so the aggregates stay in fixed-width
buffers. The winners go back to the documents by digest: stage 3 has compared all texts of a digest, so where it found one
text (no case of another is known for SHA-256) rows with that digest are equal in content; should it find more, those rows are
joined by their text as well. Winners are broadcast if they are under the bound; else those of groups of HOT rows are joined first,
and the rest in a shuffle in which no key has more than HOT rows.

Defined results: null text is empty; all empty (and all white) texts form one group; an empty table gives an empty table;
a null doc_id takes part as any row, loses ties against all others, and its kept is true only if it is the group's winner;
rows that repeat a doc_id are rows of their own for group_size, and each of them has kept = true if that doc_id wins;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.common import Kept, bounded, spread, table, text_of

SALTS = 32
#: Rows of a group that is joined apart from the others.
HOT = 10_000
#: Fixed value: the deleted characters.
WHITE = " \t\n\x0b\x0c\r"
#: 2^64 and 2^63 - 1 as SQL decimals.
SHIFT, TOP = "18446744073709551616BD", "9223372036854775807BD"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def groups(docs: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, norm): one row per distinct normalised text; norm is null unless texts share the digest."""
    norm = normalised(text_of())
    rank = F.length(text_of()).cast("decimal(10,0)") * F.expr(SHIFT) + F.coalesce(F.expr(TOP) - F.col("doc_id").cast("decimal(20,0)"), F.lit(-1))
    rows = docs.select(
        norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), rank.cast("decimal(38,0)").alias("rank"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    low = F.pmod(F.col("rank") + F.expr(SHIFT), F.expr(SHIFT))  # 2^63 - 1 - doc_id, or 2^64 - 1 for a null doc_id
    keep = F.when(low != F.expr(SHIFT) - 1, F.expr(TOP) - low).cast("long")
    return whole.select("digest", keep.alias("keep_id"), "group_size", "norm")


def winners(docs: DataFrame) -> tuple[Kept, DataFrame | None]:
    """(digest, keep_id, group_size) of each text that has its digest alone, and groups() of the texts that share one, if there are any."""
    found = groups(docs)
    thin = Kept(found.select("digest", "keep_id", "group_size"), 96)
    shared = Kept(thin.df.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest"), 64)
    if not shared.rows:
        return thin, None
    return Kept(thin.df.join(shared.df, "digest", "left_anti"), 96), found.join(shared.df, "digest", "left_semi")


def _told(rows: DataFrame, won: Kept) -> DataFrame:
    """rows (doc_id, digest) with their digest's keep_id and group_size, or nulls."""
    if won.bytes <= 4 * common.BROADCAST_BYTES:  # the only broadcast of its plan
        return rows.join(F.broadcast(won.df), "digest", "left")
    many = Kept(won.df.where(F.col("group_size") >= HOT).select("digest", F.col("keep_id").alias("k"), F.col("group_size").alias("g")), 96)
    rows = spread(rows, many.df, many.bytes, "digest", "left")
    own = F.when(F.col("g").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id").cast("string").cast("binary"))  # at most 20 bytes, where a digest has 32
    rest = won.df.where(F.col("group_size") < HOT).select(F.col("digest").alias("own"), "keep_id", "group_size")
    return rows.withColumn("own", own).join(rest, "own", "left").select("doc_id", "digest", F.when(F.col("g").isNull(), F.col("keep_id")).otherwise(F.col("k")).alias("keep_id"), F.coalesce("g", "group_size").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row."""
    won, shared = winners(docs)
    norm = normalised(text_of())
    told = _told(docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest")), won)
    if shared is not None:
        rows = docs.select("doc_id", norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("digest"))
        told = told.where("group_size IS NOT NULL").unionByName(rows.join(shared, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size"))
    return told.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept, all columns as they were.

    Texts stay where they are unless the list of winners is too large to broadcast. Rows that repeat a doc_id are told
    apart by their digest, and rows equal in both become one; so do rows without a doc_id that win their group.
    """
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    won = Kept(groups(docs).select("digest", "keep_id"), 64)
    again = Kept(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), 32)
    single = docs.join(bounded(Kept(won.df.where("keep_id IS NOT NULL").select(F.col("keep_id").alias("doc_id")), 32)), "doc_id", "left_semi")
    if not again.rows:
        return single
    single = single.join(bounded(again), "doc_id", "left_anti")
    several = docs.join(found := bounded(again), docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi").withColumn(digest, F.unhex(F.sha2(normalised(text_of()), 256)))
    best = won.df.select(F.col("digest").alias(digest), F.col("keep_id"))
    several = several.join(best, (several[digest] == best[digest]) & several["doc_id"].eqNullSafe(best["keep_id"]), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", digest]).drop(digest))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, max(cp) AS cp FROM n GROUP BY norm
), k AS (
  SELECT g.norm, any_value(g.group_size) AS group_size, min(n.doc_id) AS keep_id FROM g JOIN n ON n.norm = g.norm AND n.cp = g.cp GROUP BY g.norm
)
SELECT n.doc_id, k.keep_id, k.group_size, n.doc_id = k.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN k ON n.norm = k.norm
"""
